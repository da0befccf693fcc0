"""Nearest rows of every vector by cosine, exactly: all pairs of blocks, in tiles."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, STRIP = 8192, 512


def _by_length(rows: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """vec_id and vectors of each length."""
    lists = rows["embedding"].combine_chunks()
    many = np.asarray(pc.list_value_length(lists))
    at = np.cumsum(many) - many
    flat, ids = np.asarray(lists.flatten().cast(pa.float64()).fill_null(np.nan)), np.asarray(rows["vec_id"])
    return [(ids[k := np.flatnonzero(many == n)], flat[at[k][:, None] + np.arange(n)]) for n in np.unique(many).tolist() if n]


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; a row of zeros stays."""
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.where(np.isnan(norm), np.nan, np.zeros_like(x)), where=norm > 0)


def _tile(most: int, least: float):
    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for (a, x), (b, y) in ((p, q) for p in _by_length(asked) for q in _by_length(rows)):
            n = min(x.shape[1], y.shape[1])
            u, v = _unit(x[:, :n]), _unit(y[:, :n])
            for k in range(0, len(u), STRIP):
                score = np.nan_to_num(np.round(u[k : k + STRIP] @ v.T, 6), nan=-2.0)
                low = np.full(len(score), least)
                if score.shape[1] > most:
                    low = np.maximum(low, np.partition(score, -most, axis=1)[:, -most])
                i, j = np.nonzero(score >= low[:, None])
                by = np.lexsort((b[j], -score[i, j], i))
                i, j = i[by], j[by]
                first = np.arange(len(i)) - np.searchsorted(i, i) < most
                out.append((a[k + i[first]], b[j[first]], score[i[first], j[first]]))
        cat = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"asked": cat[0], "vec_id": cat[1], "score": cat[2]})

    return run


def every_seed(rows: DataFrame, most: int = 5, least: float = 0.25) -> DataFrame:
    """(asked, vec_id, score): for every vec_id the `most` rows of the greatest cosine of `least` or more, itself too; of equal ones those of the smallest vec_id. Rows without vec_id or vector take no part."""
    rows = rows.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    n = max(1, math.ceil(rows.count() / BLOCK))
    block = f"cast(pmod(xxhash64(vec_id), {n}) as int)"
    tiles = lambda tile: rows.selectExpr(f"explode(transform(sequence(0, {n - 1}), k -> {tile.format(block)})) as tile", "vec_id", "embedding")
    asked, others = tiles(f"{{}} * {n} + k"), tiles(f"k * {n} + {{}}")
    found = asked.groupBy("tile").cogroup(others.groupBy("tile")).applyInArrow(_tile(most, least), "asked long, vec_id long, score double")
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= most).select("asked", "vec_id", "score")
