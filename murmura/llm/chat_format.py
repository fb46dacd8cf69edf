"""Conversations to training text with per-segment loss flags, by DataFrame functions only.

A template is a table: role -> opening mark, closing mark, whether the role's text counts for
the loss. ``format_conversations`` puts the turns of each conversation in order, runs a
finite-state machine over the roles (its state is the last role; ``NEXT`` lists the allowed
steps) and emits text segments: mark, text, mark. Marks never count for the loss.

Control strings inside texts are made harmless and can be restored: every backslash is doubled,
and inside every control string a backslash is put after the first character, so no control
string is left in a text. ``read_back`` parses the formatted text into turns by its marks and
undoes both.

Defined results: turns are ordered by turn, then role and text, a null turn first; equal rows
stay; null text is empty; a null role is the empty role; roles outside the template get a mark
with their (escaped) name, no loss, and make the order invalid; rows with null conv_id form one
conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.llm.common import table

TEMPLATE = {
    "system": ("<<SYS>>", "<</SYS>>", False),
    "user": ("[INST]", "[/INST]", False),
    "assistant": ("<s>", "</s>", True),
}
"""Role -> opening mark, closing mark, loss on the text."""
OTHER = ("<|role:", "|>", "<|end|>")
"""For roles outside the template: before the role's name, after it, after the text."""
NEXT = {"": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]}
"""Finite-state machine: state -> roles that may come next."""
FINAL = ["assistant"]


def controls(template: dict) -> list[str]:
    return [m for t in template.values() for m in t[:2]] + list(OTHER)


def quoted(strings: list[str]) -> str:
    return "|".join(re.sub(r"([\\\[\]|.*+?(){}^$])", r"\\\1", s)
                    for s in sorted(strings, key=len, reverse=True))


def escape(text: Column, template: dict = TEMPLATE) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    first = "|".join(sorted({re.sub(r"([\[|])", r"\\\1", c[0]) for c in controls(template)}))
    rest = quoted([c[1:] for c in controls(template)])
    return F.regexp_replace(doubled, f"({first})(?={rest})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def by_role(role: Column, values: dict[str, object], other: Column) -> Column:
    chosen = other
    for name, value in values.items():
        chosen = F.when(role == name, F.lit(value)).otherwise(chosen)
    return chosen


def segments_of(turn: Column, template: dict) -> Column:
    """Three segments of a turn: opening mark, text, closing mark."""
    opening = by_role(turn["role"], {r: t[0] for r, t in template.items()},
                      F.concat(F.lit(OTHER[0]), escape(turn["role"], template), F.lit(OTHER[1])))
    closing = by_role(turn["role"], {r: t[1] for r, t in template.items()}, F.lit(OTHER[2]))
    loss = by_role(turn["role"], {r: t[2] for r, t in template.items()}, F.lit(False))

    def segment(text: Column, flag: Column) -> Column:
        return F.struct(text.alias("text"), flag.alias("loss"))

    return F.array(segment(opening, F.lit(False)), segment(escape(turn["text"], template), loss),
                   segment(closing, F.lit(False)))


def format_conversations(rows: DataFrame, template: dict | None = None,
                         steps: dict | None = None) -> DataFrame:
    """conv_id, n_turns, valid_order, first_bad_turn, segments (text, loss), formatted.

    ``first_bad_turn`` is the position of the first turn that the machine does not allow, or
    the number of turns if the conversation stops in a state that is not final; null if valid.
    """
    template, steps = template or TEMPLATE, steps or NEXT
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, after in steps.items() for b in after])

    def bad(all_turns: Column) -> Column:
        """Place of the first step outside the table: the state is the role before."""
        step = F.transform(all_turns, lambda t, i: F.concat(
            F.coalesce(F.get(all_turns, i - 1)["role"], F.lit("")), F.lit(">"), t["role"]))
        flags = F.transform(step, lambda s: ~F.array_contains(allowed, s))
        return F.array_position(flags, True).cast("long") - 1

    first_bad = F.element_at(F.transform(F.array("turns"), bad), 1)
    last = F.element_at("turns", -1)["role"]
    bad_turn = F.when(first_bad >= 0, first_bad).when(
        ~last.isin(FINAL), F.size("turns").cast("long"))
    return (turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        bad_turn.alias("first_bad_turn"), bad_turn.isNull().alias("valid_order"),
        F.flatten(F.transform("turns", lambda t: segments_of(t, template))).alias("segments"))
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "")))


def read_back(formatted: Column, template: dict | None = None) -> Column:
    """array<struct<role, text>> parsed from a formatted text by its marks."""
    template = template or TEMPLATE
    openings = quoted([t[0] for t in template.values()])
    closings = quoted([t[1] for t in template.values()] + [OTHER[2]])
    name = f"{quoted([OTHER[0]])}.*?{quoted([OTHER[1]])}"
    pattern = F.lit(f"(?s)({openings}|{name})(.*?)({closings})")
    marks = F.regexp_extract_all(formatted, pattern, F.lit(1))
    texts = F.regexp_extract_all(formatted, pattern, F.lit(2))

    def role(mark: Column) -> Column:
        inner = F.substring(mark, len(OTHER[0]) + 1, 2**31 - 1)
        other = unescape(F.substring(inner, F.lit(1), F.length(inner) - len(OTHER[1])))
        chosen = other
        for r, t in template.items():
            chosen = F.when(mark == t[0], F.lit(r)).otherwise(chosen)
        return chosen

    return F.zip_with(marks, texts, lambda m, t: F.struct(
        role(m).alias("role"), unescape(t).alias("text")))


PROBE = "SELECT -7L AS conv_id, {turn}L AS turn, '{role}' AS role, '</s>[INST] ok [/INST]' AS text"


def digests(formatted: DataFrame) -> DataFrame:
    """The digest columns, from the formatted text and the flagged segments."""
    turns = F.array_join(F.transform(read_back(F.col("formatted")), lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]),
                                    lambda s: unescape(s["text"])), "")
    return formatted.select(
        "conv_id", F.size(read_back(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"), loss.alias("_loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    ).select("conv_id", "n_turns", "turns_sha256",
             F.length("_loss").cast("long").alias("loss_chars"),
             F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = [spark.sql(PROBE.format(turn=i, role=r)) for i, r in enumerate(("user", "assistant"))]
    return digests(format_conversations(rows.unionByName(probe[0]).unionByName(probe[1])))


def escaped_length_sql() -> str:
    """DuckDB text for the characters that escaping adds to ``text``.

    Control strings of the template do not overlap each other, so their occurrences add up.
    """
    added = "(length(text) - length(replace(text, '\\', '')))"
    for mark in controls(TEMPLATE):
        added += f" + (length(text) - length(replace(text, '{mark}', ''))) / {len(mark)}"
    return added


OP5_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (
  SELECT *, length(text) + CAST({escaped_length_sql()} AS BIGINT)
    + CASE role {' '.join(f"WHEN '{r}' THEN {len(t[0]) + len(t[1])}" for r, t in TEMPLATE.items())}
      ELSE {sum(map(len, OTHER))} + length(role) END AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id"""
