"""Runs of word patterns against brute force, and the defined odd cases."""

import hashlib
import random
from zlib import crc32

import pytest

from murmura.llm import periodic_runs as P


def brute_runs(words):
    """All runs by trying every period at every place."""
    n, found = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            size = i - a + q
            if i > a and size >= max(6, 4 * q):
                run = words[a:a + size]
                if all(run[:-p] != run[p:] for p in range(1, q)):
                    found.add((a, size, q))
            i += i == a
    return found


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = 1 if doc_id is None else crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        a = (h // 10) % len(words)
        p = 1 + (len(words) - a) // (3 + (h // 10) % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    kept = [w for i, w in enumerate(words)
            if not any(a + q <= i < a + n for a, n, q in runs)]
    return (len(runs), hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(kept)).hexdigest())


def random_texts():
    rng = random.Random(3)
    for i in range(120):
        block = [rng.choice("abc") for _ in range(rng.randint(1, 40))]
        words = block * rng.randint(1, 7) + [rng.choice("abcdef") for _ in range(rng.randint(0, 60))]
        yield i, rng.choice([" ", "\n", "\t "]).join(words)


def test_runs_equal_brute_force(spark):
    docs = [*random_texts(), (500, "x " * 900), (501, "a b " * 300 + "c " + "a b " * 300),
            (502, None), (503, ""), (504, " \x0b "), (None, "u v " * 4), (7, "z " * 9), (7, "z " * 9),
            (505, "é é " * 6)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").selectExpr(
        "*", "'x' AS row", "1 AS period", "text AS plain", "2 AS fragments")
    found = P.periodic_runs(rows).collect()
    assert sorted(((r.doc_id or -1), r.n_runs, r.runs_sha256, r.collapsed_sha256) for r in found) \
        == sorted((i or -1, *expected(i, t)) for i, t in docs)
    whole = next(r for r in found if r.doc_id == 500)
    assert (whole.start, whole.length, whole.period, whole.exponent_milli) == (0, 900, 1, 900_000)
    assert P.periodic_runs(rows.limit(0)).count() == 0


def test_query_equals_brute_force(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()
            if len(r.text) < 4000}
    found = {r.doc_id: r for r in P.op13_periodic_runs(spark, small).collect()}
    assert len(found) == 200 and any(r.n_runs for r in found.values())
    for i, text in docs.items():
        r = found[i]
        assert (r.n_runs, r.runs_sha256, r.collapsed_sha256) == expected(i, text)


@pytest.mark.parametrize("groups", [1, 3])
def test_fragments_of_many_tile_groups_are_stitched(spark, monkeypatch, groups):
    monkeypatch.setattr(P, "JOINED", groups)
    text = "s " + "a b c " * 200 + "t"
    tiled = P.tiled_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert len(tiled.first().fragments) > 10
    assert [(r.start, r.length, r.period) for r in P.stitch(tiled).collect()] == [(1, 600, 3)]
