"""Quality rules whose cutoffs are chosen so that few good documents are rejected, per stratum.

Base features are computed from every whole text with DataFrame functions only. Each rule
rejects documents whose feature exceeds a cutoff. Cutoffs are learned from labelled documents:

* Strata are the languages (null is a stratum of its own).
* For a stratum and rule the cutoffs of a fixed grid are tested from lenient to strict. A cutoff
  passes if the exact binomial tail P(Bin(n, alpha / rules) <= k) is at most delta / (strata x rules),
  where n counts the stratum's good labelled documents and k those that the cutoff would reject.
  That is the one-sided Clopper-Pearson bound: with that confidence the cutoff rejects at most
  a share alpha of good documents.
* Testing stops at the first cutoff that fails (a fixed sequence), so the grid costs nothing
  extra, and the division by strata x rules (Bonferroni) holds all choices together: with
  probability 1 - delta all rules of a stratum together reject at most alpha of its good documents.
* A rule without a passing cutoff, as in a stratum with few labels, rejects nothing.

Defined results: null text has no words; an empty text or one below ``min_words`` fails the
base; null or unseen language without a chosen cutoff keeps what the base keeps; repeated rows
stay, and repeated labels of a document count once per distinct label; empty tables work (no
labels: no cutoffs); other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmura.llm.common import table
from murmura.runtime import materialize

BLANK = r"[\x20\x09-\x0D]+"
WINDOW = 8
SYMBOLS = "#*$%&|<>"
ALPHA = 0.01
DELTA = 0.05
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
RULES = {
    "symbol_rate": [1.0, 0.5, 0.2, 0.1, 0.05, 0.03, 0.02, 0.01],
    "dup_line_rate": [1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1],
    "upper_rate": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3],
    "mark_rate": [2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3],
    "long_word_mean": [40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0],
}
"""Rule -> its cutoffs from lenient to strict. A document is rejected above the cutoff."""


def bound(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, where it is used inside a lambda."""
    return F.element_at(F.transform(F.array(value), then), 1)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more, the first occurrence included.

    Windows are compared by a 64-bit hash of their words' hashes. Sorting (hash, place) puts
    equal windows side by side; sorted places of repeated windows then give the words covered.
    """
    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, i: F.least(
            F.lit(window), F.coalesce(F.get(places, i + 1) - p, F.lit(window))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(pairs: Column) -> Column:
        hits = F.filter(pairs, lambda p, i: (
            p["h"] == F.coalesce(F.get(pairs, i - 1)["h"], F.bitwise_not(p["h"])))
            | (p["h"] == F.coalesce(F.get(pairs, i + 1)["h"], F.bitwise_not(p["h"]))))
        return bound(F.array_sort(F.transform(hits, lambda p: p["i"])), covered)

    def windows(keys: Column) -> Column:
        pairs = F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        # Most texts repeat nothing, which a set of longs shows without the sort.
        return F.when(F.size(F.array_distinct(keys)) < F.size(keys),
                      bound(F.array_sort(pairs), repeated)).otherwise(F.lit(0).cast("long"))

    def keys(hashes: Column) -> Column:
        return bound(F.transform(F.sequence(F.lit(1), F.size(hashes) - (window - 1)),
                                 lambda i: F.xxhash64(F.slice(hashes, i, window))), windows)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) >= window, bound(hashes, keys)).otherwise(
        F.lit(0)).cast("long")


def features(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """doc_id, lang (or the columns ``carry``) and the base features of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(*carry or ["doc_id", "lang"], text.alias("_text")).withColumns({
        "_words": F.filter(F.split("_text", BLANK), lambda w: w != ""),
        "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})

    def length_without(pattern: str) -> Column:
        return F.length(F.regexp_replace("_text", pattern, "")).cast("long")

    letters = r"[^\p{L}]+"
    return base.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": length_without(BLANK),
        "n_symbols": (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_words")),
        "n_letters": length_without(letters),
        "n_upper": length_without(r"[^\p{Lu}]+"),
        "n_marks": length_without(r"[\p{L}\p{N}\x20\x09-\x0D]+"),
    }).drop("_text", "_words", "_lines").withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS)
        | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def with_rates(rows: DataFrame) -> DataFrame:
    """The rules' features, each a ratio of base features (0 where the divisor is 0)."""
    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return rows.withColumns({
        "symbol_rate": ratio("n_symbols", "word_chars"), "dup_line_rate": ratio("n_dup_lines", "n_lines"),
        "upper_rate": ratio("n_upper", "n_letters"), "mark_rate": ratio("n_marks", "n_words"),
        "long_word_mean": ratio("word_chars", "n_words")})


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """log P(Bin(n, p) <= k), exact up to rounding, summed term by term in log space."""
    odds = math.log(p / (1 - p))

    def step(state: Column, i: Column) -> Column:
        term = state["term"] + F.log((n - i + 1) / i) + odds
        high, low = F.greatest(state["sum"], term), F.least(state["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    first = n * F.lit(math.log1p(-p))
    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(
        F.array().cast("array<bigint>"))
    return F.aggregate(terms, F.struct(first.alias("term"), first.alias("sum")), step,
                       lambda s: s["sum"])


def choose_cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA,
                   rules: dict[str, list[float]] | None = None) -> DataFrame:
    """stratum, rule, cutoff: the strictest cutoff of each that the labels bear out.

    ``labelled`` has lang, quality and the rules' features. Good documents are counted per
    stratum, rule and number of cutoffs that reject them, in one pre-aggregating pass.
    """
    rules = rules or RULES
    grid = F.array(*[F.struct(F.lit(name).alias("rule"), sum(
        ((F.col(name) > c).cast("int") for c in cuts), F.lit(0)).alias("level"))
        for name, cuts in rules.items()])
    good = labelled.filter(F.col("quality") == 1).select(
        F.coalesce("lang", F.lit("")).alias("stratum"), F.explode(grid).alias("g"))
    counts = good.groupBy("stratum", "g.rule", "g.level").agg(F.count("*").alias("n_at"))
    # From here on there are at most strata x rules x cutoffs rows.
    cuts = F.create_map(*[x for name, c in rules.items()
                          for x in (F.lit(name), F.array(*map(F.lit, c)))])
    each = counts.groupBy("stratum", "rule").agg(
        F.sum("n_at").alias("n"), F.map_from_entries(F.collect_list(F.struct("level", "n_at"))).alias("at"))
    strata = F.size(F.collect_set("stratum").over(Window.partitionBy()))
    tests = each.withColumn("strata", strata).select(
        "stratum", "rule", "n", "at", "strata", F.posexplode(cuts[F.col("rule")]).alias("i", "cutoff"))
    # Cutoffs fall from lenient to strict: level l is above the last l of them.
    last = F.size(cuts[F.col("rule")]) - 1
    tests = tests.withColumn("from_level", last - F.col("i") + 1)
    k = F.aggregate(F.map_entries("at"), F.lit(0).cast("long"), lambda a, e: a + F.when(
        e["key"] >= F.col("from_level"), e["value"]).otherwise(F.lit(0)))
    tests = tests.withColumn("k", k).withColumn("limit", F.log(
        F.lit(delta) / (F.col("strata") * len(rules))))
    # Each rule gets an equal part of alpha, so that all rules of a stratum together keep it.
    share = alpha / len(rules)
    tail = F.when(F.col("k") < F.col("n") * share, log_binomial_cdf(F.col("k"), F.col("n"), share))
    tests = tests.withColumn("passed", F.coalesce(tail <= F.col("limit"), F.lit(False)))
    # A fixed sequence: the cutoffs before the first that fails.
    return (tests.groupBy("stratum", "rule").agg(
        F.min(F.when(~F.col("passed"), F.col("i"))).alias("stop"),
        F.collect_list(F.struct("i", "cutoff")).alias("all"))
        .select("stratum", "rule", F.filter("all", lambda c: F.coalesce(
            c["i"] == F.col("stop") - 1, c["i"] == F.size("all") - 1))["cutoff"].alias("c"))
        .select("stratum", "rule", F.get("c", F.lit(0)).alias("cutoff"))
        .filter(F.col("cutoff").isNotNull()))


def apply_rules(rows: DataFrame, cutoffs: DataFrame, rules: list[str]) -> DataFrame:
    """Add ``kept`` (and ``failed_rules``) to rows with features. Cutoffs: strata x rules rows."""
    wide = cutoffs.groupBy(F.col("stratum").alias("_stratum")).agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cut"))
    joined = rows.join(F.broadcast(wide), F.coalesce("lang", F.lit("")) == F.col("_stratum"), "left")
    failed = F.filter(F.array(*[F.when(
        F.col(r) > F.col("_cut")[r], F.lit(r)) for r in rules]), lambda x: x.isNotNull())
    return joined.withColumn("failed_rules", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("_cut", "_stratum")


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA,
          delta: float = DELTA, carry: list[str] | None = None) -> DataFrame:
    """Features and verdict of every document, with cutoffs learned from ``labels``.

    The texts are read once: their features are written as a narrow table, from which both the
    labelled part and the verdicts come.
    """
    rows = with_rates(materialize(features(docs, carry), "quality-features"))
    marks = labels.select("doc_id", "quality").distinct()
    labelled = rows.select("doc_id", "lang", *RULES).join(marks, "doc_id")
    return apply_rules(rows, choose_cutoffs(labelled, alpha, delta), list(RULES))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return judge(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "failed_rules")


_GRID = ", ".join(f"('{rule}', {i}, CAST({c} AS DOUBLE))"
                  for rule, cuts in RULES.items() for i, c in enumerate(cuts))
_RATES = " UNION ALL ".join(f"SELECT doc_id, '{r}' AS rule, {r} AS value FROM rates" for r in RULES)
_ORDER = "[" + ", ".join(f"'{r}'" for r in RULES) + "]"

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
places AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW}),
counted AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i:i + {WINDOW - 1}]) AS c FROM places),
hits AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM counted WHERE c > 1),
covered AS (SELECT doc_id, sum(least({WINDOW}, coalesce(after - i, {WINDOW}))) AS n FROM hits GROUP BY doc_id),
f AS (SELECT w.doc_id, lang, len(ws) AS n_words,
  length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols,
  len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
  length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS n_letters,
  length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_upper,
  length(regexp_replace(t, '[\p{{L}}\p{{N}}\x20\x09-\x0D]+', '', 'g')) AS n_marks
  FROM w LEFT JOIN covered USING (doc_id)),
rates AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_rate,
  CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_rate,
  CASE WHEN n_letters > 0 THEN n_upper / n_letters ELSE 0 END AS upper_rate,
  CASE WHEN n_words > 0 THEN n_marks / n_words ELSE 0 END AS mark_rate,
  CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS long_word_mean FROM f),
vals AS ({_RATES}),
grid(rule, i, cutoff) AS (VALUES {_GRID}),
good AS (SELECT doc_id, coalesce(lang, '') AS stratum FROM rates
         JOIN (SELECT DISTINCT doc_id, quality FROM labels) USING (doc_id) WHERE quality = 1),
tests AS (SELECT stratum, rule, i, cutoff, count(*) AS n, count(*) FILTER (value > cutoff) AS k
          FROM good JOIN vals USING (doc_id) JOIN grid USING (rule) GROUP BY ALL),
tails AS (SELECT *, (SELECT count(DISTINCT stratum) FROM good) AS strata,
  list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
    + j * ln({ALPHA / len(RULES)!r}) + (n - j) * ln(1 - {ALPHA / len(RULES)!r})))) AS tail FROM tests),
judged AS (SELECT *, tail <= {DELTA} / (strata * {len(RULES)}) AS passed FROM tails),
chosen AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM (SELECT *, bool_and(passed) OVER (
  PARTITION BY stratum, rule ORDER BY i) AS so_far FROM judged) WHERE so_far GROUP BY ALL),
failures AS (SELECT doc_id, list(rule ORDER BY list_position({_ORDER}, rule)) AS failed_rules
  FROM vals JOIN rates USING (doc_id) JOIN chosen USING (rule)
  WHERE chosen.stratum = coalesce(lang, '') AND value > cutoff GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_rules IS NULL AS kept,
       coalesce(failed_rules, CAST([] AS VARCHAR[])) AS failed_rules
FROM rates LEFT JOIN failures USING (doc_id)"""
"""The same in DuckDB; doc_id must be unique. Cutoffs are tested on the values themselves."""
