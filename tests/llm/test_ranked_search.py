"""Ranked search against plain scoring of every document, and the blocks it skips."""

import math
import random
import re
from collections import Counter

import numpy as np

from murmura.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranking(docs, items, k=10):
    bags = [Counter(plain_terms(t)) for _, t in docs]
    sizes = [sum(b.values()) for b in bags]
    total, words = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for b in bags for t in b)
    found = []
    for item_id, text in items:
        scores = []
        for row, ((doc_id, _), bag, n) in enumerate(zip(docs, bags, sizes)):
            m = 25 + (75 * n * total) // words if words else 25
            score = sum(times * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                        * ((10 ** 9 * bag[t]) // (1000 * bag[t] + 8 * m))
                        for t, times in Counter(plain_terms(text)).items() if bag[t])
            if score > 0:
                scores.append((-score, math.inf if doc_id is None else doc_id, row))
        found += [(item_id, rank, None if d == math.inf else d, -s)
                  for rank, (s, d, _) in enumerate(sorted(scores)[:k], 1)]
    return found


def random_docs(rng, count):
    topics = [[f"w{t}x{i}" for i in range(40)] for t in range(6)]
    return [(i, " ".join(rng.choice(topics[i % 6] if rng.random() < .8 else topics[0])
                         for _ in range(rng.randint(1, 60)))) for i in range(count)]


def as_rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_ranks_equal_plain_scoring(spark, monkeypatch):
    monkeypatch.setattr(R, "SHARD", 64)
    monkeypatch.setattr(R, "BLOCK", 8)
    monkeypatch.setattr(R, "ITEMS", 7)
    monkeypatch.setattr(R, "ITEM_BYTES", 300)
    monkeypatch.setattr(R, "CELLS", 2_000)
    rng = random.Random(2)
    docs = random_docs(rng, 400)
    docs += [(900, None), (901, ""), (902, "..;"), (None, docs[5][1]), (903, docs[5][1]), (903, docs[5][1]),
             (904, "É é \x85 w0x1-W0X2 w0X3 " * 300)]
    items = [(i, " ".join(rng.choice(docs[rng.randrange(400)][1].split()) for _ in range(9)))
             for i in range(14)]
    items += [(20, docs[5][1]), (20, docs[5][1]), (21, None), (22, "none-such"), (23, "é É W0x1 w0x1 w0x1")]
    rows = spark.createDataFrame(docs, "doc_id long, text string").selectExpr(
        "*", "1 AS n", "'x' AS terms", "2 AS row", "3 AS code").coalesce(1)
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "5 AS item")
    found = as_rows(R.rank_documents(rows, asked))
    assert found == sorted(plain_ranking(docs, items), key=str)
    assert R.rank_documents(rows.limit(0), asked).count() == 0
    assert R.rank_documents(rows, asked.limit(0)).count() == 0


def test_blocks_are_skipped_by_their_bound_alone(monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 16)
    rng = np.random.default_rng(1)
    size, docs = 300, 2_000
    own = [np.unique(rng.integers(0, 50, 12) + 50 * (i % 6)).astype(np.int32) for i in range(docs)]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in own])])
    terms, values = np.concatenate(own), rng.integers(300_000, 900_000, ends[-1])
    weights = np.full(size, 10, np.int64)
    built = R.Shard.build(np.arange(docs), np.arange(docs), ends, terms, values, weights, R.planes(size),
                          np.arange(size))
    shard = R.Shard.unpacked(built.packed())
    shard.open()
    for b, term in enumerate(shard.block_terms):
        inside = shard.block_docs[shard.block_ends[b]:shard.block_ends[b + 1]]
        assert term in shard.known and len(inside) <= 16
        later = shard.known >= term
        assert (shard.tops[b].astype(int) * R.STEP >= shard.vectors[inside].max(axis=0))[later].all()
    asked = np.array([3, 7, 11, 20, 60])
    best = R.Best(10)
    met, skipped = shard.search(asked, np.full(5, 10, np.int64), best)
    scores = np.zeros(docs, np.int64)
    np.add.at(scores, np.repeat(np.arange(docs), np.diff(ends)), np.where(np.isin(terms, asked), values * 10, 0))
    order = np.lexsort((np.arange(docs), -scores))[:10]
    assert best.found[1].tolist() == order.tolist() and best.found[0].tolist() == scores[order].tolist()
    assert skipped > 0
