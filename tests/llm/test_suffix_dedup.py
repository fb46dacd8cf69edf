"""Removed bytes against a set of all earlier strings, with small buckets and batches."""

import hashlib
import random

import numpy as np
import pytest

from murmura.llm import suffix_dedup as S


def brute(docs):
    """One result per row, texts taken by doc_id and then by row."""
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0, i))
    seen, found = set(), [None] * len(docs)
    for i in order:
        data = (docs[i][1] or "").encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - S.SPAN + 1):
            piece = data[at:at + S.SPAN]
            if piece in seen:
                gone[at:at + S.SPAN] = True
            seen.add(piece)
        spans = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        found[i] = (docs[i][0], len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return found


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
                   .collect()), key=str)


def random_docs(seed, count=160):
    rng = random.Random(seed)
    letters = "abcdefgh é\n"
    shared = ["".join(rng.choice(letters) for _ in range(n)) for n in (60, 99, 101, 130, 260, 700)]
    docs = []
    for i in range(count):
        parts = [rng.choice(shared) if rng.random() < .5 else
                 "".join(rng.choice(letters) for _ in range(rng.randint(1, 300)))
                 for _ in range(rng.randint(0, 6))]
        docs.append((rng.randint(0, 10 ** 6), "".join(parts)))
    docs += [(7, docs[3][1]), (7, docs[3][1]), (None, docs[4][1]), (8, None), (9, ""), (10, "a" * 3000),
             (11, "ab" * 900 + "a" * 500), (12, "x" * 99), (13, "x" * 100), (14, "x" * 101), (None, "x" * 100)]
    return docs


def test_cover_meets_for_every_two_places():
    for r in range(S.PERIOD):
        for q in range(S.PERIOD):
            a, b = S.SHIFTS[r, S.MEETING[r, q]], S.SHIFTS[q, S.MEETING[q, r]]
            assert a == b < S.PERIOD and (r + a) % S.PERIOD in S.COVER and (q + a) % S.PERIOD in S.COVER


@pytest.mark.parametrize("partitions, bucket", [(1, 1_000_000), (5, 700)])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, partitions, bucket):
    monkeypatch.setattr(S, "BUCKET", bucket)
    docs = random_docs(partitions)
    rows = spark.createDataFrame(docs, "doc_id long, text string").selectExpr(
        "*", "'x' AS row", "1 AS file", "text AS kept").coalesce(1)
    if partitions > 1:  # equal ids would change their order; keep one row of each
        docs = list({d[0]: d for d in docs if d[0] is not None}.values())
        rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(partitions)
    assert rows_of(S.remove_repeats(rows)) == sorted(brute(docs), key=str)
    assert S.remove_repeats(rows.limit(0)).count() == 0


def test_window_minima_across_segments(monkeypatch):
    data = np.random.default_rng(1).integers(97, 100, 700).astype(np.uint8)
    data[300:420], valid = 98, np.ones(700, bool)
    valid[250:349] = valid[601:] = False
    grams = S.hashes(data, S.GRAM)
    width = S.SPAN - S.GRAM + 1
    windows = [i for i in range(601) if valid[i]]
    monkeypatch.setattr(S, "SEGMENT", 64)
    powers = [pow(pow(S.BASE, -1, 1 << 64), i, 1 << 64) for i in range(3)]
    assert S.INVERSE[:3].tolist() == powers
    minima, taken = S.window_minima(data, valid)
    assert len(np.unique(minima)) > 5
    groups = {}
    for i in windows:  # hashes are relative to their segment's start: equal windows, equal minima
        groups.setdefault(data[i:i + S.SPAN].tobytes(), set()).add(int(minima[i]))
    assert all(len(g) == 1 for g in groups.values()) and not minima[~valid].any()
    assert [int(grams[i:i + width].min()) for i in windows] == minima[windows].tolist()
    places = {j for i in windows for j in range(i, i + width) if grams[j] == grams[i:i + width].min()}
    assert sorted(taken.tolist()) == sorted(grams[sorted(places)].tolist())


def test_places_are_packed_and_read_back():
    rng = np.random.default_rng(2)
    for size in (0, 1, 500, 90_000):
        places = np.sort(rng.choice(S.CHUNK, size, replace=False))
        assert S.unpack(S.pack(places)).tolist() == places.tolist()


def test_ranks_settle_long_ties(monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(97, 100, 400).astype(np.uint8)
    text = np.concatenate([base, base[:300], base[50:], base, np.zeros(S.PAD, np.uint8)])
    size = len(text) - S.PAD
    flat = S.Flat("none")
    flat.held = {("text", 0): text, ("id", 0): np.zeros(1, np.int64), ("start", 0): np.zeros(1, np.int64)}
    places = np.arange(size)
    sampled = places[S.PLACE[places % S.PERIOD] >= 0]
    found = S.sort_by_words(flat, np.zeros(len(sampled), int), sampled, S.RANK_WORDS).rank
    ranks = np.zeros((size // S.PERIOD + 3) * len(S.COVER), np.uint64)
    ranks[sampled // S.PERIOD * len(S.COVER) + S.PLACE[sampled % S.PERIOD]] = found
    flat.held["rank", 0] = ranks
    heads = places[:size - S.SPAN - S.PERIOD]
    later = S.later_windows(flat, np.zeros(len(heads), int), heads)
    seen = {}
    for p in heads:
        assert later[p] == (seen.setdefault(text[p:p + S.SPAN].tobytes(), p) != p)
    assert later.sum() > 300


def test_query_equals_brute_force(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    found = rows_of(S.op12_suffix_dedup(spark, small))
    assert found == sorted(brute(docs), key=str) and any(r[2] for r in found)
