"""Mixing sources to target weights by pivotal dependent rounding.

A document of source s is to be copied weight(s) * total size / size(s) times. What is over the integral part is a
probability; probabilities are rounded in pairs, mass moving from one to the other at random until one of the two is 0 or 1.
Every document keeps its expected number of copies, and sums are kept: a source's copies are within 1 of their expectation.
Buckets of documents are rounded apart, each leaving at most one residual per source; residuals are combined in a tree, and
those of the sources at its root. Random numbers are hashes of the pair, so a task that runs again decides alike.

Rows without doc_id are left out by copies() and kept once by mixed(). Rows of one doc_id and source are one document; their
sizes add up, and each gets the document's copies. A null source is a source of its own. Sizes are characters of the text, 1
at least, so nulls and empty texts count as 1. A source without a weight has weight 0; without weights each source has its
share of the size to the power `temperature`. Columns besides doc_id, source and text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlegraph.llm.shared import staged
from spindlegraph.llm.words import U, mix

BUCKET, FAN_IN = 20_000, 64
SCHEMA = "doc_id long, source string, size long, whole long, p double, bucket long, open boolean"
EDGE, ALL = 1e-9, (1 << 64) - 1


def mixed_int(x: int) -> int:
    """mix() of one integer."""
    x &= ALL
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & ALL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & ALL
    return x ^ (x >> 31)


def pivot(ids: np.ndarray, p: np.ndarray, groups: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities rounded one after another within each run of equal groups, and whether each is left open (one a group at most)."""
    p, n = p.astype(float).copy(), len(p)
    h = mix(ids.astype(np.int64).view(np.uint64) + U(0x9E3779B97F4A7C15 * (seed + 1) % (1 << 64))).tolist()
    draw = lambda a, b: mixed_int(h[a] * 3 + h[b]) / 2.0**64
    value, group, left = p.tolist(), groups.tolist(), -1
    for i in range(n):
        if left >= 0 and group[left] != group[i]:
            left = -1
        b = value[i]
        if b < EDGE or b > 1 - EDGE:
            value[i] = float(round(b))
            continue
        if left < 0:
            left = i
            continue
        a, u = value[left], draw(left, i)
        s = a + b
        if s < 1:
            one, other = (s, 0.0) if u * s < a else (0.0, s)
        else:
            one, other = (1.0, s - 1) if u * (2 - s) < 1 - b else (s - 1, 1.0)
        one, other = (float(round(x)) if x < EDGE or x > 1 - EDGE else x for x in (one, other))
        value[left], value[i] = one, other
        left = left if 0 < one < 1 else i if 0 < other < 1 else -1
    out = np.array(value, float)
    return out, (out > 0) & (out < 1)


def _rounded(seed: int, across: bool):
    def run(group: pa.Table) -> pa.Table:
        x = group.to_pandas()
        x = x.sort_values(["source", "size", "doc_id"], na_position="first", kind="stable").reset_index(drop=True)
        code = np.zeros(len(x), np.int64) if across else (x["source"].fillna("").ne(x["source"].fillna("").shift()) | x["source"].isna().ne(x["source"].isna().shift())).cumsum().to_numpy()
        p, is_open = pivot(x["doc_id"].to_numpy(), x["p"].to_numpy(), code, seed)
        if across and is_open.any():  # the whole sum isn't integral
            last = int(np.flatnonzero(is_open)[0])
            p[last] = float(float(mix(x["doc_id"].to_numpy().view(np.uint64)[last : last + 1] + U(seed))[0]) / 2.0**64 < p[last])
            is_open[last] = False
        return pa.Table.from_pandas(x.assign(p=p, open=is_open), schema=group.schema, preserve_index=False)

    return run


def copies(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, total: float | None = None, seed: int = 17) -> DataFrame:
    """(doc_id, source, expected, copies) of every document. total: the size of the mixture in characters, by default that of docs."""
    spark = docs.sparkSession
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.greatest(F.lit(1), F.coalesce(F.length("text"), F.lit(1))).cast("long").alias("size"))
    units = staged(rows.groupBy("doc_id", "source").agg(F.sum("size").alias("size")))
    by = units.groupBy("source").agg(F.sum("size").alias("of_source"), F.count("*").alias("n"))
    everything = by.agg(F.sum("of_source").alias("all"), F.sum("n").alias("n"), F.sum(F.pow("of_source", F.lit(temperature))).alias("norm")).first()
    n = everything["n"] or 0
    if weights is None:
        weight = F.pow("of_source", F.lit(temperature)) / F.lit(float(everything["norm"] or 1))
        by = by.withColumn("weight", weight)
    else:
        if any(v < 0 for v in weights.values()) or not sum(weights.values()):
            raise ValueError("weights must be positive")
        given = spark.createDataFrame([(k, float(v) / sum(weights.values())) for k, v in weights.items()], "s string, weight double")
        by = by.join(given, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").fillna(0.0, ["weight"])
    goal = float(total if total is not None else everything["all"] or 0)
    by = by.select(F.col("source").alias("s"), (F.col("weight") * goal / F.col("of_source")).alias("expected"))
    buckets = max(1, math.ceil(n / BUCKET))
    start = units.join(by, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", F.floor(F.col("expected") + EDGE).cast("long").alias("whole"), F.greatest(F.lit(0.0), F.col("expected") - F.floor(F.col("expected") + EDGE)).alias("p"), F.pmod(F.xxhash64("doc_id", "source"), F.lit(buckets)).alias("bucket"), F.lit(True).alias("open"))
    done, level = [], 0
    now = staged(start.groupBy("bucket").applyInArrow(_rounded(seed, False), SCHEMA))
    while buckets > 1:
        level, buckets = level + 1, math.ceil(buckets / FAN_IN)
        done.append(now.where("not open"))
        up = now.where("open").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        now = staged(up.groupBy("bucket", "source").applyInArrow(_rounded(seed + level, False), SCHEMA))
    done.append(now.where("not open"))
    done.append(now.where("open").withColumn("bucket", F.lit(0).cast("long")).groupBy("bucket").applyInArrow(_rounded(seed + 99, True), SCHEMA))
    decided = reduce(DataFrame.union, done)
    return decided.join(by, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", F.round("expected", 9).alias("expected"), (F.col("whole") + F.round("p").cast("long")).alias("copies"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, total: float | None = None, seed: int = 17) -> DataFrame:
    """docs with each row as often as its document is to be copied."""
    many = copies(docs, weights, temperature, total, seed).where("copies > 0").select(F.col("doc_id").alias("__doc"), F.col("source").alias("__source"), F.col("copies").cast("int").alias("__copies"))
    named = docs.where("doc_id is not null").join(many, (F.col("doc_id") == F.col("__doc")) & F.col("source").cast("string").eqNullSafe(F.col("__source")))
    return named.withColumn("__each", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns).unionByName(docs.where("doc_id is null"))
