"""Daily counters over token tables: entities, authors, tags and pairs.

Every count is a ``groupBy`` with a partial aggregate on the map side, so a term
that appears in a third of all posts reaches the shuffle as one row per task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from murmura.functions import text as tx
from murmura.functions.text import entity_kind
from murmura.runtime import materialize
from murmura.schema import AUTHOR, COUNT, DATE, TOKENS


def _exploded(df: DataFrame, tokens: Column | str, name: str, *keep) -> DataFrame:
    # explode_outer + filter: a plain explode makes the optimizer push a copy of the
    # token expression below it as a filter, which would tokenize every post twice.
    return (df.select(*keep, F.explode_outer(tokens).alias(name))
            .filter(F.col(name).isNotNull() & (F.col(name) != "")))


def entity_counts(toks: DataFrame, by: str = DATE, tokens: str = TOKENS) -> DataFrame:
    """Posts per (date, term), with the term's kind: ``#``, ``@`` or ``S``."""
    return (_exploded(toks, tokens, "term", by)
            .groupBy(by, "term").agg(F.count("*").alias(COUNT))
            .select(by, entity_kind("term").alias("kind"), "term", COUNT))


def author_counts(toks: DataFrame, by: str = DATE) -> DataFrame:
    author = F.col(AUTHOR)
    return (toks.filter(author.isNotNull() & (author != ""))
            .groupBy(by, author.alias("author")).agg(F.count("*").alias(COUNT)))


def hashtag_counts(toks: DataFrame, by: str = DATE) -> DataFrame:
    return (_exploded(toks, tx.hashtags(TOKENS), "hashtag", by)
            .groupBy(by, "hashtag").agg(F.count("*").alias(COUNT)))


def hashtag_reach(toks: DataFrame, by: str = DATE) -> DataFrame:
    """Distinct authors per (date, hashtag); deduplicated before it is counted."""
    return (_exploded(toks, tx.hashtags(TOKENS), "hashtag", by, AUTHOR)
            .distinct()
            .groupBy(by, "hashtag").agg(F.count("*").alias(COUNT)))


def hashtag_author_counts(toks: DataFrame, verb: str | None = "post", by: str = DATE) -> DataFrame:
    """Original posts per (date, hashtag, author)."""
    if verb:
        toks = toks.filter(F.col("verb") == verb)
    return (_exploded(toks, tx.hashtags(TOKENS), "hashtag", by, F.col(AUTHOR).alias("author"))
            .groupBy(by, "hashtag", "author").agg(F.count("*").alias(COUNT)))


PAIR_BLOCK = 256
"""Tokens of a block; two blocks make at most PAIR_BLOCK ** 2 pairs at a time."""
TASK_PAIRS = 4_000_000
"""Pairs expanded by a task, on average: their counts stay in its memory."""
HELD_PAIRS = 4_000_000
"""Pairs that a task holds before it adds up equal ones."""
HELD_WORDS = 1 << 20
"""Different tokens, and groups, that a task numbers before it hands its counts on."""


@lru_cache(maxsize=PAIR_BLOCK + 1)
def _above(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of n tokens, the earlier one first."""
    return np.triu_indices(n, 1)


class _Numbers(dict):
    """Numbers from 0 up for values as they come."""

    def __missing__(self, value) -> int:
        self[value] = len(self)
        return self[value]

    def of(self, values: pa.Array) -> np.ndarray:
        """Numbers of a column's values, each different one asked for once."""
        found = values.dictionary_encode(null_encoding="encode")
        known = np.fromiter((self[v] for v in found.dictionary.to_pylist()), np.int64, len(found.dictionary))
        return known[found.indices.to_numpy(zero_copy_only=False)]


def _added_up(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    starts = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[starts], np.add.reduceat(counts[order], starts)


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _pair_counter(group_type: pa.DataType, buckets: int):
    """Counts of a task's pairs as rows (_bucket, _counts), packed batches of all pairs of a bucket.

    A pair is one number made of those of its group and tokens, so equal pairs are sorted and
    added up as flat arrays. A bucket is a hash of group and first token, whose partners follow
    each other in order.
    """
    def rows(groups: _Numbers, words: _Numbers, codes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        names, tokens = pa.array(list(groups), group_type), pa.array(list(words), pa.string())
        first = codes >> HALF
        heads, owner = np.unique(first, return_inverse=True)
        own = np.fromiter((crc32(f"{g}\n{t}".encode("utf-8", "surrogatepass")) % buckets for g, t in zip(
            names.take(pa.array(heads >> HALF)).to_pylist(), tokens.take(pa.array(heads & LOW)).to_pylist())),
            np.int64, len(heads))
        place = np.empty(len(words), np.int64)
        place[pc.sort_indices(tokens).to_numpy()] = np.arange(len(words))
        order = np.lexsort((place[codes & LOW], owner, own[owner]))
        codes, counts, bucket = codes[order], counts[order], own[owner][order]
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(codes)]):
            one, n = codes[low:high], counts[low:high]
            yield pa.record_batch([pa.array([bucket[low]], pa.int32()), pa.array([_packed(pa.record_batch(
                [names.take(pa.array(one >> 2 * HALF)).dictionary_encode(),
                 tokens.take(pa.array(one >> HALF & LOW)).dictionary_encode(),
                 tokens.take(pa.array(one & LOW)), pa.array(n)], PAIR))], pa.binary())], ["_bucket", "_counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, words, held, size = _Numbers(), _Numbers(), [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                group = groups.of(part.column(0)) << 2 * HALF
                n = part.column(1).to_numpy(zero_copy_only=False)
                (a, a_at), (b, b_at) = ((words.of(c.flatten()), np.append(0, np.cumsum(pc.fill_null(
                    pc.list_value_length(c), 0).to_numpy()))) for c in (part.column(2), part.column(3)))
                single = part.column(3).is_null().to_numpy(zero_copy_only=False)
                for i in range(part.num_rows):
                    own = a[a_at[i]:a_at[i + 1]]
                    if single[i]:
                        x, y = _above(len(own))
                        pairs = own[x] << HALF | own[y]
                    else:
                        pairs = (own[:, None] << HALF | b[b_at[i]:b_at[i + 1]]).ravel()
                    held.append((pairs | group[i], np.full(len(pairs), n[i])))
                    size += len(pairs)
                full = max(len(words), len(groups) << 6) >= HELD_WORDS
                if size >= HELD_PAIRS or full:
                    held = [_added_up(*map(np.concatenate, zip(*held)))]
                    size = len(held[0][0])
                    if size and (full or size >= HELD_PAIRS // 2):
                        yield from rows(groups, words, *held[0])
                        groups, words, held, size = _Numbers(), _Numbers(), [], 0
        if size:
            yield from rows(groups, words, *_added_up(*map(np.concatenate, zip(*held))))
    return count


def _pair_adder(schema: pa.Schema):
    """The counts of one bucket, added up a part at a time, so that equal pairs are held once."""
    def add(rows: pa.Table) -> pa.Table:
        held, size, kept = [], 0, 0
        for packed in rows.column("_counts").to_pylist():
            part = pa.Table.from_batches(pa.ipc.open_stream(packed)).cast(schema)
            held.append(part)
            size += len(part)
            if size >= HELD_PAIRS + 2 * kept:
                held = [_summed(held)]
                size = kept = len(held[0])
        return _summed(held)
    return add


def _summed(parts: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(parts).group_by(PAIR[:3]).aggregate([(COUNT, "sum")])
    return whole.select([*PAIR[:3], f"{COUNT}_sum"]).rename_columns(PAIR)


PAIR = ["_group", "tok1", "tok2", COUNT]
ROWS = 64
"""Rows whose pairs are made between two looks at what a task holds."""
HALF = 24
LOW = (1 << HALF) - 1
"""A pair's number: the group, then both tokens in HALF bits each."""


def pair_counts(toks: DataFrame, by: str | None = DATE, tokens: Column | str = TOKENS) -> DataFrame:
    """Posts per unordered token pair ``tok1 < tok2``, optionally per ``by``.

    Equal token sets are counted first and expanded once with their number, so
    copies and shares of one text cost a single expansion. A set is cut into blocks, and its pairs
    of blocks are expanded one by one; those of a long set are dealt over all tasks, so the
    pairs of a post are never together, whatever its length. A task adds up its pairs as numbers
    and hands them on packed by bucket, so no row is shuffled for each pair.
    """
    keys = [by] if by else []
    chosen = F.col(tokens) if isinstance(tokens, str) else tokens
    # Single tokens are dropped after the grouping: a filter before it would be pushed below the
    # token expression as a second copy of it.
    sets = (toks.select(*keys, F.sort_array(F.array_distinct(F.array_compact(chosen))).alias("_set"))
            .withColumn("_key", F.sha2(F.to_json("_set"), 256))
            .groupBy(*keys, "_key").agg(F.any_value("_set").alias("_set"),
                                        F.count("*").alias("_n"))
            .filter(F.size("_set") > 1))
    sets = materialize(sets, "sets")
    size = F.size("_set").cast("long")
    total = sets.agg(F.sum(size * (size - 1) / 2)).first()[0] or 0
    last = F.floor((F.size("_set") - 1) / PAIR_BLOCK).cast("int")

    def block(i: Column) -> Column:
        return F.slice("_set", i * PAIR_BLOCK + 1, F.lit(PAIR_BLOCK))

    # Sets are small where their pairs are many, so tasks are counted by pairs and not by bytes.
    left = sets.select(*keys, "_n", "_key", "_set", last.alias("_last"),
                       F.explode(F.sequence(F.lit(0), last)).alias("_i"))
    both = (left.select(*keys, "_n", "_key", "_set", "_i",
                        F.explode(F.sequence("_i", "_last")).alias("_j"))
            .select(*keys, "_n", "_key", "_i", "_j", block(F.col("_i")).alias("_a"),
                    F.when(F.col("_j") > F.col("_i"), block(F.col("_j"))).alias("_b"))
            .repartition(max(1, ceil(total / TASK_PAIRS)), "_key", "_i", "_j"))
    # A block meets itself (the tokens after each of its own) or a later one (all of its tokens).
    rows = both.select((F.col(by) if by else F.lit(0)).alias("_group"), "_n", "_a", "_b")
    pair = T.StructType([rows.schema["_group"], *T._parse_datatype_string(f"tok1 string, tok2 string, {COUNT} long")])
    schema = to_arrow_schema(pair)
    counted = (rows.mapInArrow(_pair_counter(schema.field("_group").type, max(1, ceil(total / TASK_PAIRS))),
                               "_bucket int, _counts binary")
               .groupBy("_bucket").applyInArrow(_pair_adder(schema), pair))
    return counted.select(*[F.col("_group").alias(k) for k in keys], "tok1", "tok2", COUNT)


def hashtag_pair_counts(toks: DataFrame, by: str | None = None) -> DataFrame:
    return pair_counts(toks, by, tx.hashtags(TOKENS))


def entity_pair_counts(activities: DataFrame, by: str | None = None) -> DataFrame:
    """Pairs of the record's own hashtag and mention entities, shared ones included."""
    entities = tx.token_set(
        tx.tag_texts("twitter_entities.hashtags"),
        tx.tag_texts("object.twitter_entities.hashtags"),
        tx.mention_texts("twitter_entities.user_mentions"),
        tx.mention_texts("object.twitter_entities.user_mentions"))
    keys = [by] if by else []
    return pair_counts(activities.select(*keys, entities.alias(TOKENS)), by)


def both_directions(pairs: DataFrame) -> DataFrame:
    """Pair counts readable from either token."""
    keys = [c for c in pairs.columns if c not in ("tok1", "tok2", COUNT)]
    turned = pairs.select(*keys, F.col("tok2").alias("tok1"), F.col("tok1").alias("tok2"), COUNT)
    return pairs.select(*keys, "tok1", "tok2", COUNT).unionByName(turned)


def token_totals(toks: DataFrame, tokens: str = TOKENS) -> DataFrame:
    """Posts per token over the whole table."""
    return _exploded(toks, tokens, "term").groupBy("term").agg(F.count("*").alias(COUNT))


def word_frequency(toks: DataFrame, min_count: int, tokens: str = TOKENS) -> DataFrame:
    """Vocabulary with frequency at least ``min_count``."""
    return (token_totals(toks, tokens).filter(F.col(COUNT) >= min_count)
            .select(F.col("term").alias("word"), F.col(COUNT).alias("freq")))


def largest_first(counts: DataFrame, *ties: str) -> DataFrame:
    """Globally sorted by count, then by the given columns."""
    return counts.orderBy(F.col(COUNT).desc(), *ties)


def posts_per_hour(posts: DataFrame) -> DataFrame:
    return (posts.groupBy(tx.post_hour("postedTime").alias("postedHour"))
            .agg(F.count("*").alias(COUNT)))


def term_series(series: str, points: DataFrame, order: str = "batch_id") -> DataFrame:
    """One count per (series, term, date); the write with the highest order wins."""
    return (points.groupBy(F.lit(series).alias("series"), "term", DATE)
            .agg(F.max_by(COUNT, order).alias(COUNT)))


def series_map(points: DataFrame) -> DataFrame:
    """One row per (series, term) with a date-to-count map, one entry per day."""
    day = F.struct(F.col(DATE), F.col(COUNT))
    return (points.groupBy("series", "term")
            .agg(F.map_from_entries(F.array_sort(F.collect_list(day))).alias("points")))
