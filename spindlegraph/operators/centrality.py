"""PageRank by what flows along paths of each length, so a graph without cycles takes as many joins as its longest path has edges."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindlegraph.components import dropped, written
from spindlegraph.operators.graph import degrees, few

DAMPING, MOST_ITERATIONS, EPSILON = 0.85, 50, 1e-9


def _shares(n: int, lost: list[float], damping: float, most: int) -> np.ndarray:
    """Row k: the weight in the ranks after k iterations of what flows along paths of each length. lost: how much of each ends in nodes without an edge out."""
    out, base = np.zeros((most + 1, len(lost))), []
    for k in range(most + 1):
        for j in range(min(k + 1, len(lost))):
            out[k, j] = base[k - 1 - j] if j < k else 1 / n
        base.append((1 - damping) / n + damping * float(out[k] @ lost) / n)
    return out


def _changes(steps: np.ndarray):
    """How much the ranks of all rows change in sum by each iteration."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(steps))
        for batch in batches:
            flows = np.stack([np.ones(batch.num_rows), *(np.asarray(c) for c in batch.columns)])
            total += np.abs(steps @ flows).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(steps), dtype=np.int32)), pa.array(total)], names=["k", "change"])

    return run


def pagerank(nodes: DataFrame, triples: DataFrame, damping: float = DAMPING, most: int = MOST_ITERATIONS, epsilon: float = EPSILON) -> tuple[DataFrame, int]:
    """(id, pagerank) of every node, and the iterations it took. Each triple between known nodes is an edge, parallel ones count; nodes without an edge out spread their rank over all. Stops when ranks change by less than epsilon in sum.

    What nodes without an edge out spread comes to all alike. So the ranks after each iteration are sums, with weights that the
    driver finds, of what would flow to a node along paths of 0, 1, 2, ... edges if every node sent 1. Edges are joined once for
    each length that there are paths of, up to `most`, with the ends of paths so far; ranks aren't written for each iteration."""
    ids = written(nodes.select("id").distinct())
    n = ids.count()
    if not n or most < 1:
        return ids.withColumn("pagerank", F.lit(1.0 / max(1, n))), 0
    known = triples.select("s", "o").join(ids.withColumnRenamed("id", "o"), "o", "left_semi").join(ids.withColumnRenamed("id", "s"), "s", "left_semi")
    edges = written(known.select("s", "o", (F.lit(damping) / F.count("*").over(Window.partitionBy("s"))).alias("share")))
    leads = written(edges.select(F.col("s").alias("id")).distinct())
    lost, flows, flow = [float(n - leads.count())], [], edges.select("o", "share")
    while len(flows) < most:
        came = flow.groupBy(F.col("o").alias("id")).agg(F.sum("share").alias("flow"))
        came = written(came.join(leads.withColumn("leads", F.lit(True)), "id", "left"))
        sums = came.agg(F.count("*").alias("n"), F.count("leads").alias("on"), F.sum(F.when(F.col("leads").isNull(), F.col("flow"))).alias("lost")).first()
        if not sums["n"]:
            break
        flows.append(came)
        lost.append(sums["lost"] or 0.0)
        if not sums["on"]:
            break
        at = came.where("leads").select(F.col("id").alias("s"), "flow")
        flow = edges.join(few(at), "s").select("o", (F.col("flow") * F.col("share")).alias("share"))
    weights = _shares(n, lost, damping, most)
    names = [f"flow{j}" for j in range(1, len(flows) + 1)]
    of_length = [f.select("id", *(F.col("flow").alias(c) if c == name else F.lit(None).cast("double").alias(c) for c in names)) for f, name in zip(flows, names)]
    reached = written(reduce(DataFrame.union, of_length).groupBy("id").agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in names))) if flows else None
    changes = np.abs(np.diff(weights[:, 0])) * (n - (reached.count() if flows else 0))
    if flows:
        for r in reached.select(*names).mapInArrow(_changes(np.diff(weights, axis=0)), "k int, change double").groupBy("k").agg(F.sum("change").alias("change")).collect():
            changes[r["k"]] += r["change"]
    small = np.flatnonzero((changes < epsilon) | np.isnan(changes))
    done = int(small[0]) + 1 if len(small) else most
    for table in (edges, leads, *flows):
        dropped(table)
    if not flows:
        return ids.withColumn("pagerank", F.lit(float(weights[done, 0]))), done
    rank = reduce(lambda a, b: a + b, (float(w) * F.coalesce(c, F.lit(0.0)) for w, c in zip(weights[done, 1:], names)), F.lit(float(weights[done, 0])))
    return ids.join(reached, "id", "left").select("id", rank.alias("pagerank")), done


def top_nodes(nodes: DataFrame, triples: DataFrame, k: int = 20, metric: str = "pagerank") -> DataFrame:
    """(id, label, type, degree, pagerank) of the k nodes of the greatest pagerank or degree; of equal ones in the order of ids that people use."""
    if metric not in ("pagerank", "degree"):
        raise ValueError("metric is pagerank or degree")
    order = [F.desc(metric), F.expr("id collate unicode")]
    all_ranks, first = pagerank(nodes, triples)[0], lambda df: few(written(df.orderBy(*order).limit(max(0, k))))
    if metric == "degree":
        top, other = first(degrees(nodes, triples)), all_ranks
    else:
        top = first(all_ranks)
        ends = triples.select(F.explode(F.array("s", "o")).alias("id")).join(top.select("id"), "id", "left_semi").groupBy("id").agg(F.count("*").alias("n"))
        other = top.select("id").join(ends, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("degree"))
    return nodes.select("id", "label", "type").join(top, "id").join(other, "id").select("id", "label", "type", "degree", "pagerank").orderBy(*order)
