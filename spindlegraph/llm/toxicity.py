"""Toxic documents by non-negative positive-unlabelled learning (a class-prior-corrected risk that isn't let below zero).

A numpy linear model over hashed words and word beginnings is trained from documents labelled toxic and from all documents,
taken as unlabelled; labels of clean documents serve for the class prior alone. Of the documents labelled toxic at most
`most_positive` (those of the least hashes of their doc_id) are used; near copies among them count once, since each copy would
teach its other words again. Features are chosen by the number of all documents that have them, and one classifier is trained
over all documents, at any size of the table: documents of the same chosen features are counted, and one task holds each different
set of features with its number. So no document is left out of the unlabelled risk, which is the same for a table and for copies
of it. All documents are scored, over their whole texts; should more of them than the class prior come out as toxic, the bias is
lowered to where the number is nearest to the prior's.

Nulls count as empty texts, which score the bias; rows without doc_id are never rejected. Rows that repeat a doc_id are
scored by their own texts and make one row, of the greatest score. Labels with nulls, labels of absent documents and labels
that contradict each other are allowed: one toxic label makes a document toxic. Without toxic labels there is no model and
nothing is rejected. Columns besides doc_id and text (and toxic) are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlegraph.llm.shared import staged, text_chunks
from spindlegraph.llm.words import LOWER, NOT_ALNUM, U, mix, words

BUCKETS, CHUNK = 1 << 20, 50_000
BEGINNINGS = (3, 4, 5, 6)
SKETCH = 64


def _buckets(texts: pa.Array):
    """For words and their beginnings in turn: the text and the bucket of each."""
    w = words(texts, LOWER, NOT_ALNUM)
    yield w.row, (w.hash >> U(44)).astype(np.int64)
    for n in BEGINNINGS:
        h = w.starts_with(n)
        has = h != 0
        yield w.row[has], (h[has] >> U(44)).astype(np.int64)


def features(texts: pa.Array) -> list[np.ndarray]:
    """The distinct buckets of each text."""
    rows, buckets = (np.concatenate(x) for x in zip(*_buckets(texts)))
    key = np.unique(rows * BUCKETS + buckets)
    return np.split((key % BUCKETS).astype(np.int32), np.searchsorted(key, np.arange(1, len(texts)) * BUCKETS)) if len(texts) else []


def columns(texts: pa.Array, column: np.ndarray) -> list[np.ndarray]:
    """The distinct columns of each text, of the buckets that have one (others are -1 in column)."""
    rows, cols = [], []
    for r, b in _buckets(texts):
        c = column[b]
        hit = c >= 0
        rows.append(r[hit])
        cols.append(c[hit])
    key = np.unique(np.concatenate(rows) * BUCKETS + np.concatenate(cols))
    return np.split((key % BUCKETS).astype(np.int32), np.searchsorted(key, np.arange(1, len(texts)) * BUCKETS)) if len(texts) else []


class Rows:
    """Different sets of features, one after another, with their sizes and how many texts have each. Passes go by CHUNK sets."""

    def __init__(self, col: np.ndarray, size: np.ndarray, many: np.ndarray):
        self.col, self.size, self.share = col, size, many / max(1, many.sum())

    def over(self, w: np.ndarray):
        """The scores of CHUNK sets at a time, with their shares, their features and the set of each."""
        end = 0
        for k in range(0, len(self.size), CHUNK):
            size = self.size[k : k + CHUNK]
            row, begin, end = np.repeat(np.arange(len(size)), size), end, end + int(size.sum())
            col = self.col[begin:end]
            yield np.bincount(row, w[col], len(size)) + w[-1], self.share[k : k + CHUNK], col, row

    def sums(self, w: np.ndarray, *slopes) -> tuple[float, list[np.ndarray]]:
        """The mean softplus of the scores, and for each slope the mean of its value by feature, the bias last."""
        risk, out = 0.0, [np.zeros(len(w)) for _ in slopes]
        for z, share, col, row in self.over(w):
            risk += float((share * np.logaddexp(0, z)).sum())
            for g, slope in zip(out, slopes):
                v = slope(z) * share
                g += np.bincount(col, v[row], len(w))
                g[-1] += v.sum()
        return risk, out


def counted(found: list[np.ndarray]) -> Rows:
    times: dict[bytes, int] = {}
    for f in found:
        key = f.tobytes()
        times[key] = times.get(key, 0) + 1
    return Rows(np.frombuffer(b"".join(times), np.int32), np.array([len(k) // 4 for k in times], np.int64), np.array(list(times.values()), np.int64))


def unlike(found: list[np.ndarray]) -> list[np.ndarray]:
    """Texts of which no earlier one shares half of the SKETCH least hashed features."""
    kept: list[np.ndarray] = []
    index: dict[int, list[int]] = {}
    for f in found:
        least = np.sort(mix(f.astype(np.uint64) + U(1)))[:SKETCH].tolist()
        hits = np.bincount(np.array([i for h in least for i in index.get(h, ())], np.int64), minlength=1)
        if len(least) and hits.max() >= len(least) / 2:
            continue
        for h in least:
            index.setdefault(h, []).append(len(kept))
        kept.append(f)
    return kept


def chosen(p: np.ndarray, n_positive: int, u: np.ndarray, n_all: int, prior: float) -> np.ndarray:
    """Whether each feature, in p of the toxic texts and u of all, is by the prior toxic as often as not, and in toxic texts more often than chance gives among so many."""
    expected = np.maximum(u, 0.5) / max(1, n_all) * n_positive
    surprise = 2 * (p * np.log(np.maximum(p, 1) / expected) - (p - expected))
    return (prior * p >= 0.5 * expected) & (surprise >= 2 * np.log(BUCKETS))


def train(xp: Rows, xu: Rows, n_features: int, prior: float, rounds: int = 600, rate: float = 0.05, lasso: float = 3e-4) -> np.ndarray:
    """Weights by feature, the bias last, from the toxic texts and all of them."""
    size = n_features + 1
    w, m, v, total = np.zeros(size), np.zeros(size), np.zeros(size), np.zeros(size)
    w[-1] = np.log(prior / (1 - prior))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, rounds + 1):
        risk_p, (g_p, g_toxic) = xp.sums(w, sigmoid, lambda z: -sigmoid(-z))
        risk_u, (g_u,) = xu.sums(w, sigmoid)
        g_negative = g_u - prior * g_p
        if risk_u - prior * risk_p >= 0:
            g = g_negative + prior * g_toxic
        else:  # the risk of negatives can't be below zero: go back
            g = -g_negative
        g[:-1] += lasso * np.sign(w[:-1])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if 2 * t > rounds:  # weights move about where they would rest
            total += w
    w = total / (rounds - rounds // 2)
    w[:-1][np.abs(w[:-1]) <= rate] = 0
    return w


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in text_chunks(batches):
        yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array([f.tobytes() for f in features(chunk.column(1))], pa.binary())], names=["doc_id", "found"])


def _counts(column, n: int):
    """How many texts have each column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = np.zeros(n, np.int64)
        for chunk in text_chunks(batches):
            found = columns(chunk.column(0), column.value)
            many += np.bincount(np.concatenate([*found, np.zeros(0, np.int32)]), minlength=n)
        at = np.flatnonzero(many)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(many[at])], names=["feature", "n"])

    return run


def _rows(column):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array([f.tobytes() for f in columns(chunk.column(1), column.value)], pa.binary())], names=["doc_id", "cols"])

    return run


def _trained(positive, n: int, prior: float):
    """The weights, from all different sets of features and how many texts have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        col, size, many = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            col.append(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32))
            size.append(np.asarray(pc.binary_length(batch.column(0)), np.int64) // 4)
            many.append(np.asarray(batch.column(1)))
        w = train(counted(positive.value), Rows(*map(np.concatenate, (col, size, many))), n, prior)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 1, dtype=np.int32)), pa.array(w)], names=["feature", "weight"])

    return run


def fit(texts: DataFrame, labels: DataFrame, prior: float | None = None, most_positive: int = 3000) -> tuple[DataFrame, np.ndarray] | None:
    """(doc_id, cols), the features of every row of texts, staged, and the weights by feature, the bias last; None without toxic labels. prior: the share of toxic documents; by default that of the labelled documents, 0.1 where none is labelled clean."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = dict(marks.groupBy("toxic").count().collect())
    if not counts.get(1):
        return None
    if prior is None:
        prior = min(0.9, max(0.01, counts[1] / sum(counts.values()))) if counts.get(0) else 0.1
    toxic = marks.where("toxic = 1").select("doc_id")
    sample = texts.select("doc_id").join(toxic, "doc_id", "left_semi").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_positive)
    # a text for each of at most most_positive ids
    held = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).mapInArrow(_found, "doc_id long, found binary").orderBy("doc_id").toArrow()
    positive = unlike([np.frombuffer(x.as_py(), np.int32) for x in held["found"]])
    sc = texts.sparkSession.sparkContext
    p = np.bincount(np.concatenate([*positive, np.zeros(0, np.int32)]), minlength=BUCKETS)
    n_all = texts.count()
    if not n_all or not positive:
        return None

    # a feature is in as many of all texts at least; where that is too many already, counts can't make it better
    known = np.flatnonzero(chosen(p, len(positive), p, n_all, prior))
    column = np.full(BUCKETS, -1, np.int32)
    column[known] = np.arange(len(known))
    found = texts.select("text").mapInArrow(_counts(sc.broadcast(column), len(known)), "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    u = np.zeros(len(known), np.int64)
    u[np.asarray(found["feature"])] = np.asarray(found["n"])
    known = known[chosen(p[known], len(positive), u, n_all, prior)]
    column = np.full(BUCKETS, -1, np.int32)
    column[known] = np.arange(len(known))
    rows = staged(texts.mapInArrow(_rows(sc.broadcast(column)), "doc_id long, cols binary"))
    xp = sc.broadcast([column[f][column[f] >= 0] for f in positive])
    sets = rows.groupBy("cols").count().repartition(1).sortWithinPartitions("cols")  # sums in one order, however rows come
    weights = sets.mapInArrow(_trained(xp, len(known), prior), "feature int, weight double").toArrow()
    w = np.zeros(len(known) + 1)
    w[np.asarray(weights["feature"])] = np.asarray(weights["weight"])
    # as many rows as there are different positive scores to two decimals
    steps = _scored(rows, w).where("score > 0").groupBy(F.ceil(F.col("score") * 100).alias("step")).count().orderBy(F.desc("step")).collect()
    over = np.cumsum([r["count"] for r in steps])
    if len(over) and over[-1] > prior * n_all:  # documents of one score are treated alike: the number nearest to the prior
        kept = int(np.abs(np.append(0, over) - prior * n_all).argmin())
        if kept < len(steps):
            w[-1] -= steps[kept]["step"] / 100
    return rows, w


def _scored(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = sent.value
            z = [w[np.frombuffer(x.as_py(), np.int32)].sum() + w[-1] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def scores(docs: DataFrame, labels: DataFrame, prior: float | None = None, **bounds: int) -> DataFrame:
    """(doc_id, score): over 0 the document is rather toxic than not."""
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    model = fit(texts, labels, prior, **bounds)
    if model is None:
        return texts.select("doc_id", F.lit(-30.0).alias("score")).distinct()
    return _scored(*model).groupBy("doc_id").agg(F.round(F.max("score"), 6).alias("score"))


def toxic_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.0, **options) -> DataFrame:
    """(doc_id, score) of the documents that are rejected."""
    return scores(docs, labels, **options).where(F.col("score") > threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.0, **options) -> DataFrame:
    """docs without the rejected ones; rows without doc_id stay."""
    gone = toxic_documents(docs, labels, threshold, **options).select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
