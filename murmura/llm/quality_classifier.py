"""Quality by co-training: a text view and a page-metadata view teach each other, then combine.

* The text view sees the shapes and hashes of words, and of each piece of a very long word; the metadata view sees language, source,
  length and line layout. Both are naive Bayes over hashed features with per-document shares.
* Fitting uses a bounded sample of documents: at most LABELLED labelled ones and POOL others,
  those with the smallest hash of doc_id, so the sample is the same at every run. Half of the
  labelled ones fit, the other half calibrate.
* In each of ROUNDS rounds a view is fitted on the labelled part and what the other view was
  sure of, calibrated (logistic regression of its score), and labels the pool: documents beyond
  SURE either way, at most SHARE of the pool per class and round, go to the other view.
* The calibrated views are combined by logistic regression on the calibration half. The cutoff
  rejects at most MISSED of its good documents and never one of probability above 0.5.
* All documents are scored in one pass; only the weights travel with the tasks.

Defined results: null text, language, source or length count as empty, empty or 0; a document
labelled both ways counts as bad; without good or without bad labels nothing is rejected and
the quality is null; repeated rows stay; an empty table gives no rows. Other columns are kept by
``classify``; where a name clashes with a result's, the result wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmura.llm.common import flat, slices, table

LABELLED = 6_000
POOL = 6_000
ROUNDS = 3
SURE = 0.98
SHARE = 0.05
MISSED = 0.005
TEXT_BITS = 14
SHAPE_BITS = 12
META_BITS = 10
KEEP_WORDS = 150_000
TEXTS = 2 << 20
"""Bytes of text that a task holds as Python words at a time."""
PIECE = 64
RESULTS = {"text_score": T.DoubleType(), "meta_score": T.DoubleType(),
           "quality": T.DoubleType(), "kept": T.BooleanType()}
RUN = re.compile(r"(.)\1+", re.S)


def shape(word: str) -> str:
    """Letters as A or a, digits as 9, runs as one: ``Hello,!!`` is ``Aa,!``."""
    marks = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
                    for c in word)
    return RUN.sub(r"\1", marks)


def pieces(text: str) -> list[str]:
    """The text's words; longer ones are cut into pieces of PIECE characters."""
    return [w[at:at + PIECE] for w in text.split() for at in range(0, len(w), PIECE)]


def feature_numbers(word: str) -> tuple[int, int]:
    return (xxhash.xxh32_intdigest(shape(word)) >> (32 - SHAPE_BITS),
            (1 << SHAPE_BITS) + (xxhash.xxh32_intdigest(word.lower()) >> (32 - TEXT_BITS)))


class Features(dict):
    """Word -> its two feature numbers: shape first, then the lower-cased word."""

    def __missing__(self, word: str) -> tuple[int, int]:
        value = feature_numbers(word)
        if len(word) <= 64:
            if len(self) >= KEEP_WORDS:
                self.clear()
            self[word] = value
        return value


TEXT_SIZE = (1 << SHAPE_BITS) + (1 << TEXT_BITS)


def metadata(lang, source, n_chars, text) -> list[int]:
    """Feature numbers of a page's metadata and layout."""
    lines = text.count("\n") + 1
    length = int(n_chars or 0).bit_length()
    facts = [f"lang {lang}", f"source {source}", f"length {length}", f"lines {lines.bit_length()}",
             f"line length {(len(text) // lines).bit_length()}", f"{lang} {source}",
             f"{lang} {length} {lines.bit_length()}"]
    return [xxhash.xxh32_intdigest(x) >> (32 - META_BITS) for x in facts]


def sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct text features with their shares, and metadata features, of sampled documents."""
    known = Features()
    for batch in slices(batches, 2, TEXTS):
        rows = batch.to_pylist()
        texts, shares, metas = [], [], []
        for r in rows:
            words = pieces(r["text"] or "")
            both = np.array([f for w in words for f in known[w]], np.int32)
            values, counts = np.unique(both, return_counts=True)
            texts.append(values)
            shares.append((counts / max(1, len(words))).astype(np.float32))
            metas.append(metadata(r["lang"], r["source"], r["n_chars"], r["text"] or ""))
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(texts, pa.list_(pa.int32())),
             pa.array(shares, pa.list_(pa.float32())), pa.array(metas, pa.list_(pa.int32()))],
            ["doc_id", "label", "features", "shares", "meta"])


def logistic(x: np.ndarray, y: np.ndarray, weight: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression with a constant first, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + weight * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + weight * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def probability(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class View:
    """Naive Bayes weights over one kind of features, and their calibration."""

    def __init__(self, size: int, number: np.ndarray, ends: np.ndarray, share: np.ndarray):
        self.size, self.rows = size, len(ends) - 1
        self.row = np.repeat(np.arange(self.rows, dtype=np.int32), np.diff(ends))
        self.number, self.share = number, share

    def fit(self, labels: np.ndarray, usable: np.ndarray, smooth: float = 0.05) -> None:
        """labels: 1, 0, or -1 where there is none."""
        sums = []
        for value in (1, 0):
            chosen = (usable & (labels == value))[self.row]
            total = np.bincount(self.number[chosen], self.share[chosen], self.size) + smooth
            sums.append(np.log(total / total.sum()))
        self.weights = sums[0] - sums[1]

    def scores(self) -> np.ndarray:
        return np.bincount(self.row, self.weights[self.number] * self.share, self.rows)


@dataclass
class Classifier:
    text_weights: np.ndarray
    meta_weights: np.ndarray
    combination: np.ndarray | None
    """Constant, text and metadata weight; None without both kinds of labels."""
    cutoff: float


def co_train(labels: np.ndarray, calibrating: np.ndarray, views: list[View],
             rounds: int = ROUNDS) -> Classifier:
    """Fit both views on labels (1, 0, -1 for none), where ``calibrating`` marks the held half."""
    fitting = (labels >= 0) & ~calibrating
    good_bad = [(labels[m] == v).any() for m in (fitting, calibrating) for v in (0, 1)]
    if not all(good_bad):
        return Classifier(np.zeros(TEXT_SIZE), np.zeros(1 << META_BITS), None, 0.0)
    pool = labels < 0
    taught = [labels.copy(), labels.copy()]
    for turn in range(rounds + 1):
        for own, other in ((0, 1), (1, 0)):
            view = views[own]
            view.fit(taught[own], fitting | (pool & (taught[own] >= 0)))
            score = view.scores()
            view.line = logistic(score[calibrating], labels[calibrating])
            if turn == rounds:
                continue
            p = probability(view.line[0] + view.line[1] * score)
            for value, sure in ((1, p), (0, 1 - p)):
                free = np.flatnonzero(pool & (taught[other] < 0) & (sure >= SURE))
                best = free[np.argsort(-sure[free], kind="stable")][:max(1, int(SHARE * pool.sum()))]
                taught[other][best] = value
    logits = np.column_stack([v.line[0] + v.line[1] * v.scores() for v in views])
    combined = logistic(logits[calibrating], labels[calibrating])
    p = probability(combined[0] + logits @ combined[1:])
    good = p[calibrating & (labels == 1)]
    cutoff = min(0.5, float(np.quantile(good, MISSED, method="lower")))
    constant = combined[0] + sum(c * v.line[0] for c, v in zip(combined[1:], views))
    slopes = [c * v.line[1] for c, v in zip(combined[1:], views)]
    return Classifier(views[0].weights, views[1].weights, np.array([constant, *slopes]), cutoff)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> Classifier:
    """Draw the sample, extract its features in Spark, and co-train on those."""
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.min(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("label"))
    ids = docs.filter("doc_id is not null").select("doc_id").distinct()
    order = [F.xxhash64("doc_id"), "doc_id"]
    known = marks.join(ids, "doc_id", "left_semi").orderBy(*order).limit(labelled)
    others = (ids.join(marks, "doc_id", "left_anti").orderBy(*order).limit(pool)
              .withColumn("label", F.lit(-1)))
    drawn = known.unionByName(others)  # at most labelled + pool rows
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").join(F.broadcast(drawn), "doc_id")
    found = (rows.select("doc_id", "label", "text", "lang", "source", "n_chars").mapInArrow(
        sample_features, "doc_id long, label int, features array<int>, shares array<float>, meta array<int>")
        .dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id"))
    marked = found.column("label").to_numpy().astype(np.int64)
    held = np.array([xxhash.xxh32_intdigest(str(i)) & 1 for i in found.column("doc_id").to_pylist()], bool)
    (number, ends), (share, _), (meta, meta_ends) = (
        flat(found.column(c)) for c in ("features", "shares", "meta"))
    views = [View(TEXT_SIZE, number, ends, share),
             View(1 << META_BITS, meta, meta_ends, np.ones(len(meta), np.float32))]
    return co_train(marked, held & (marked >= 0), views)


class Weights(dict):
    """Word -> its weight in the text view."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        a, b = feature_numbers(word)
        value = float(self.weights[a] + self.weights[b])
        if len(word) <= 64:
            if len(self) >= KEEP_WORDS:
                self.clear()
            self[word] = value
        return value


def classify(docs: DataFrame, model: Classifier) -> DataFrame:
    """All columns of ``docs`` and text_score, meta_score, quality, kept, in one pass."""
    carried = [f for f in docs.schema.fields if f.name not in RESULTS]
    schema = T.StructType(carried + [T.StructField(n, k) for n, k in RESULTS.items()])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(model.text_weights)
        for batch in slices(batches, names.index("text"), TEXTS):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            text = np.array([sum(map(weights.__getitem__, w)) / max(1, len(w))
                             for w in map(pieces, texts)])
            meta = np.array([model.meta_weights[metadata(*facts)].sum() for facts in zip(*(
                batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")), texts)])
            if model.combination is None:
                quality, kept = pa.nulls(len(texts), pa.float64()), np.ones(len(texts), bool)
            else:
                c = model.combination
                p = probability(c[0] + c[1] * text + c[2] * meta)
                quality, kept = pa.array(p), p >= model.cutoff
            yield pa.record_batch([*batch.columns, pa.array(text), pa.array(meta), quality,
                                   pa.array(kept)], names)

    return docs.select(*[f.name for f in carried]).mapInArrow(run, schema)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return classify(docs, fit(docs, labels)).select("doc_id", *RESULTS)
