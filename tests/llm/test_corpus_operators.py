"""Joins, graph, classifier and language model on small tables, against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from murmura.llm import embedding_dedup, language_model, ngram_jaccard, quality_classifier
from murmura.llm.components import components
from murmura.llm.word_keys import word_keys

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, quality string, n int"


def make_docs(spark):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [[draw.choice(words) for _ in range(draw.choice([1, 3, 5, 7, 9, 12, 60, 200]))] for _ in range(60)]
    texts = [None, "", "  "]
    for b in base:
        texts.append(" ".join(b))
        for _ in range(draw.randrange(4)):
            copy = list(b)
            if draw.random() < 0.8:
                copy[draw.randrange(len(copy))] = draw.choice(words)
            if draw.random() < 0.3:
                copy.append("more")
            texts.append(" ".join(copy).upper() if draw.random() < 0.2 else " ".join(copy))
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "x", 1) for i, t in enumerate(texts)]
    rows += [rows[5], (None, texts[6], None, None, None, "x", 1)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_join_equals_all_pairs(spark):
    rows, docs = make_docs(spark)
    sets = {}
    for i, text, *_ in rows:
        w = (text or "").lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = [i for i in sets if i is not None]
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) \
                        and least[b] < least[a]:
                    least[a], changed = least[b], True
    got = ngram_jaccard.link_components(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        assert r.component_id == (least[r.doc_id] if r.doc_id is not None else None)
    assert ngram_jaccard.link_components(docs.limit(0)).count() == 0


def test_join_links_light_and_heavy_members_of_a_dealt_list(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "SALT_EVERY", 2)
    monkeypatch.setattr(ngram_jaccard, "choose_boundary", lambda nodes, percent: 3)
    rows = []
    for i in range(40):
        words = [f"g{i}w{k}" for k in range(8)]
        rows += [(2 * i, " ".join(words[:7])), (2 * i + 1, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in ngram_jaccard.link_components(docs).collect()}
    assert got == {i: i - i % 2 for i in range(80)}


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(1, 40) if i % 10] + [(50, 51), (51, 50), (60, 60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got[10] == 1 and got[20] == 11 and got[51] == 50 and 60 not in got


def test_vector_links_reach_recall(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(60, 16))
    rows = [(i, [float(x) for x in centres[i % 60] + draw.normal(size=16) * 0.12], i % 60 % 3) for i in range(600)]
    rows += [(600, rows[0][1], 0), (601, None, 0), (602, [0.0] * 16, 0), (603, [float("nan")] * 16, 0),
             (604, rows[0][1], None), (605, rows[0][1][:8], 0), (606, [], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embedding_dedup.link_vectors(vectors).collect()}
    known = [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab in rows
             if v and len(v) == 16 and any(v) and v[0] == v[0] and lab is not None]
    total = found = 0
    for i, v, lab in known:
        links = sum(1 for j, w, m in known if j != i and m == lab
                    and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98)
        assert got[i].n_links <= links
        total, found = total + links, found + got[i].n_links
    assert total > 500 and found >= 0.9 * total
    assert all(got[i].n_links == 0 and got[i].kept for i in (601, 602, 603, 604, 605, 606))
    assert got[600].component_id == 0 and not got[600].kept
    assert embedding_dedup.link_vectors(vectors.limit(0)).count() == 0


def test_vector_links_over_many_shards_and_splits(spark, monkeypatch, caplog):
    monkeypatch.setattr(embedding_dedup, "SHARD", 20)
    monkeypatch.setattr(embedding_dedup, "CAP", 5)
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(700, 16))
    centres[400:] = draw.normal(size=16) + draw.normal(size=(300, 16)) * 0.4
    unit = np.concatenate([centres, centres + draw.normal(size=centres.shape) * 0.05])
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(unit)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    links = (unit @ unit.T >= 0.98).sum(1) - 1
    with caplog.at_level("INFO", embedding_dedup.__name__):
        got = {r.vec_id: r.n_links for r in embedding_dedup.link_vectors(vectors).collect()}
    found = np.array([got[i] for i in range(len(unit))])
    assert links.sum() > 1_000 and (found <= links).all() and found.sum() >= 0.995 * links.sum()
    assert f"found {found[::20].sum()} of the {links[::20].sum()} links" in caplog.text


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model_equals_plain_counts(spark, order):
    rows, docs = make_docs(spark)
    folded = language_model.with_fold(docs)
    model = language_model.train(folded.filter("not held_out"), order)
    got = language_model.score_texts(folded, model).collect()
    tokens = [((t or "").encode().lower().split() + [b"\n"], i) for i, t, *_ in rows]
    train = [w for w, i in tokens if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1]
    grams = {order: Counter()}
    for t in train:
        whole = [None] * (order - 1) + t
        grams[order].update(zip(*[whole[i:] for i in range(order)]))
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    history = {k: defaultdict(Counter) for k in grams}
    for k in grams:
        for g, c in grams[k].items():
            history[k][g[:-1]].update({0: c, min(c, 3): 1})
    levels = {k: Counter(g.values()) for k, g in grams.items()}
    d = {k: language_model.discounts(*[n[i] for i in range(1, 5)]) for k, n in levels.items()}
    size = len(grams[1])

    def p_of(h, w):
        k = len(h) + 1
        below = p_of(h[1:], w) if h else 1 / (size + 1)
        if h not in history[k]:
            return below
        n, c = history[k][h], grams[k][*h, w]
        return (max(c - d[k][min(c, 3)], 0) + sum(d[k][i] * n[i] for i in (1, 2, 3)) * below) / n[0]

    expected = sorted(sum(math.log10(p_of(tuple(whole[i:i + order - 1]), whole[i + order - 1]))
                          for whole in [[None] * (order - 1) + t] for i in range(len(t))) for t, _ in tokens)
    assert np.allclose(sorted(r.score for r in got), expected)
    assert {r.train_tokens for r in got} == {sum(map(len, train))}
    assert 0.9 < sum(p_of((None,) * (order - 1), w) for (w,) in grams[1]) <= 1


def test_language_model_of_nothing_and_of_frequent_words(spark):
    rows, docs = make_docs(spark)
    folded = language_model.with_fold(docs)
    empty = docs.limit(0)
    model = language_model.train(empty)
    assert language_model.score_texts(language_model.with_fold(empty), model).count() == 0
    unknown = language_model.score_texts(folded, model).first()
    assert unknown.n_known == 0 and math.isfinite(unknown.score)
    same = spark.createDataFrame([(i, "a " * 400) for i in range(40)], "doc_id long, text string")
    likely = language_model.score_texts(language_model.with_fold(same), language_model.train(same)).first()
    assert likely.perplexity < 1.2
    with pytest.raises(ValueError):
        language_model.train(docs, 1)


def test_language_model_counts_beyond_one_byte():
    counts = np.array([1, 254, 255, 256, 2**40, 3], np.uint64)
    parts = language_model.small(counts)
    assert language_model.counts_at(parts, np.array([5, 4, 3, 2, 1, 0])).tolist() == counts[::-1].tolist()


def test_language_model_finds_hashes_that_share_a_half():
    keys = np.array([3 << 32, 3 << 32 | 1 << 16, 3 << 32 | 2 << 16, 5 << 32 | 7 << 16, 2**64 - 1], np.uint64)
    absent = np.array([3 << 32 | 3 << 16, 5 << 32, 0, 2**64 - 1 - (1 << 16)], np.uint64)
    at, found = language_model.look_up_cut(language_model.cut(keys), np.concatenate([keys[::-1], absent]))
    assert at[:5].tolist() == [4, 3, 2, 1, 0] and found.tolist() == [True] * 5 + [False] * 4
    at, found = language_model.look_up_cut(language_model.cut(keys[:0]), absent)
    assert not found.any()


def test_classifier_keeps_good_and_rejects_bad(spark):
    draw = random.Random(2)
    rows = []
    for i in range(400):
        good = i % 4 > 0
        text = " ".join("".join(draw.choice("aeinorst") for _ in range(5)) for _ in range(40))
        rows.append((i, text if good else text.upper().replace(" ", "!! "), "en", "s", len(text), "x", 1))
    docs = spark.createDataFrame(rows + [(None, None, None, None, None, "x", 1)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 400, 1) if i % 3], "doc_id long, quality int")
    got = quality_classifier.classify(docs, quality_classifier.fit(docs, labels)).collect()
    kept = {r.doc_id: r.kept for r in got}
    assert sum(kept[i] for i in range(400) if i % 4) >= 297 and not any(kept[i] for i in range(0, 400, 4))
    blind = quality_classifier.classify(docs, quality_classifier.fit(docs, labels.limit(0))).collect()
    assert all(r.kept and r.quality is None for r in blind)
    assert quality_classifier.classify(docs.limit(0), quality_classifier.fit(docs, labels)).count() == 0


def test_classifier_reads_long_words_to_their_end(spark):
    draw = random.Random(6)
    rows = []
    for i in range(400):
        start = "".join(draw.choice("aeinorst") for _ in range(64))
        rest = "".join(draw.choice("aeinorst" if i % 4 else "!?#%") for _ in range(640))
        rows.append((i, start + rest, "en", "s", 704, "x", 1))
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400) if i % 3], "doc_id long, quality int")
    got = quality_classifier.classify(docs, quality_classifier.fit(docs, labels)).collect()
    text = {r.doc_id: r.text_score for r in got}
    assert min(text[i] for i in range(400) if i % 4) > max(text[i] for i in range(0, 400, 4))


def test_labels_that_differ_in_marks_alone_do_not_link(spark):
    rows = [(1, [1.0, 0.5], "a-b"), (2, [1.0, 0.5], "a_b"), (3, [1.0, 0.5], "a-b"), (4, [1.0, 0.5], "x" * 300)]
    found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.link_vectors(
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")).collect()}
    assert found == {1: (1, 1), 2: (0, 2), 3: (1, 1), 4: (0, 4)}


def test_language_model_hashes_words_as_plain_text_splits_them():
    texts = ["pad", None, "", " \t", "One one ONE oNe\x1c", "a\x0bb\x0cc\rd\ne f", "É é", "Q" * 200 + " q", "q" * 200]
    keys, sizes = word_keys(pa.array(texts, pa.string()).slice(1))
    plain = [[*(t or "").encode().lower().split(), b"\n"] for t in texts[1:]]
    assert sizes.tolist() == [len(row) for row in plain]
    pairs = set(zip(keys.tolist(), (w for row in plain for w in row), strict=True))
    assert len(pairs) == len({k for k, _ in pairs}) == len({w for _, w in pairs})
    assert len(word_keys(pa.array([], pa.string()))[0]) == 0


def test_shingles_of_whole_texts_equal_plain_sets():
    texts = [None, "", "One two", "one\tTWO", "a b c d e f a b c d e", "A b c\x0bd e f a", "a b c d\x1ce f"]
    plain = []
    for text in texts:
        words = (text or "").encode().lower().split()
        width = min(5, len(words))
        plain.append({(width, *words[i:i + width]) for i in range(len(words) - width + 1)} if words else set())
    found = ngram_jaccard.shingle_sets(pa.array(texts, pa.string()))
    assert [len(f) for f in found] == [len(p) for p in plain]
    common = [[len(set(a.tolist()) & set(b.tolist())) for b in found] for a in found]
    assert common == [[len(a & b) for b in plain] for a in plain]


def test_join_hands_its_shingles_on_when_it_holds_enough(monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "FLUSH", 50)
    texts = [" ".join(f"w{i}x{j}" for j in range(24)) for i in range(10)]
    batch = pa.record_batch([pa.array(range(10), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    blocks = [b.filter(b.column("data").is_valid()) for b in ngram_jaccard.scanner(3, 5)(iter([batch]))]
    keys = [sum(len(ngram_jaccard.unpacked(d)) for d in b.column("data").to_pylist()) for b in blocks]
    assert sum(keys) == 200 and max(keys) <= 60
