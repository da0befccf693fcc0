"""Communities by asynchronous label propagation, exactly as one task would find them: components don't influence one another, so each is done by one."""

from __future__ import annotations

import hashlib
from collections import Counter, deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlegraph.components import connected_components, written
from spindlegraph.operators.graph import community_edges

MOST_ITERATIONS, LEAST_SIZE = 20, 3


def propagated(neighbours: list[list[int]], most: int) -> tuple[list[int], int, bool]:
    """Label of each place, places being in order of ids; iterations; whether it converged. A place takes the label that most neighbours have, of equal ones the first, and later places see that at once."""
    label = list(range(len(neighbours)))

    def majority(v: int) -> int:
        best, n = label[v], -1
        for lab, c in Counter(label[u] for u in neighbours[v]).items():
            if c > n or c == n and lab < best:
                best, n = lab, c
        return best

    for done in range(1, most + 1):
        changed = False
        for v in range(len(neighbours)):
            new = majority(v)
            changed |= new != label[v]
            label[v] = new
        if not changed or all(majority(v) == label[v] for v in range(len(neighbours))):
            return label, done, True
    return label, max(0, most), False


def _component(most: int):
    """rows: (component, a, b, pa, pb), pairs of ids with their places in the order of ids; one row for each node, with its community's first id."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        place = dict(zip(group["a"], group["pa"])) | dict(zip(group["b"], group["pb"]))
        ids = sorted(place, key=lambda i: place[i])
        at = {i: k for k, i in enumerate(ids)}
        near: list[set[int]] = [set() for _ in ids]
        for a, b in zip(group["a"], group["b"]):
            near[at[a]].add(at[b])
            near[at[b]].add(at[a])
        neighbours = [sorted(x) for x in near]
        label, done, settled = propagated(neighbours, most)
        # a label's nodes that aren't linked through one another are apart
        first = [-1] * len(ids)
        for v in range(len(ids)):
            if first[v] < 0:
                first[v], queue = v, deque([v])
                while queue:
                    u = queue.popleft()
                    for w in neighbours[u]:
                        if first[w] < 0 and label[w] == label[v]:
                            first[w] = v
                            queue.append(w)
        inside = [sum(first[w] == first[v] for w in neighbours[v]) for v in range(len(ids))]
        return pd.DataFrame({"id": ids, "first": [ids[f] for f in first], "degree": inside, "iterations": done, "settled": settled})

    return run


def members(triples: DataFrame, most: int = MOST_ITERATIONS) -> DataFrame:
    """(id, first, degree, iterations, settled) of every node with a community edge: the first id of its community, its neighbours inside, and how its component's propagation ended."""
    pairs = written(community_edges(triples))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # places in the order of ids that people use; ranges of ids are counted apart
    groups = connected_components(pairs)
    order = ids.join(groups, "id").withColumn("place", F.expr("row_number() over (partition by component order by id collate unicode)"))
    order = written(order)
    a, b = (order.select(F.col("id").alias(c), F.col("place").alias("p" + c), *(["component"] if c == "a" else [])) for c in "ab")
    return written(pairs.join(a, "a").join(b, "b").groupBy("component").applyInPandas(_component(most), "id string, first string, degree long, iterations int, settled boolean"))


def communities(nodes: DataFrame, triples: DataFrame, most: int = MOST_ITERATIONS, least_size: int = LEAST_SIZE) -> DataFrame:
    """(id, stable_key, label, members, size, internal_triple_count, top_predicates, top_nodes) of communities of least_size nodes or more, the largest first, of equal ones the one of the first id."""
    found = members(triples, most)
    large = found.groupBy("first").agg(F.count("*").alias("size")).where(F.col("size") >= least_size)
    kept = written(found.join(large, "first").join(nodes.select("id", "label"), "id", "left").select("first", "size", "id", "degree", F.coalesce("label", "id").alias("label")))
    order = F.expr("id collate unicode")
    inner = triples.where("r >= 1 and s <> o").join(kept.select(F.col("id").alias("s"), "first"), "s").join(kept.select(F.col("id").alias("o"), F.col("first").alias("__f")), "o").where(F.col("first") == F.col("__f"))
    counts = inner.groupBy("first", "p").agg(F.count("*").alias("n"))
    predicates = counts.groupBy("first").agg(F.sum("n").alias("internal_triple_count"), F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "p"))), lambda x: F.struct(x["p"].alias("p"), (-x["k"]).alias("count"))).alias("top_predicates"))
    by_degree = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("degree")).alias("k"), order.alias("o"), "id", "label"))), lambda x: F.struct(x["id"].alias("id"), x["label"].alias("label"), (-x["k"]).alias("degree")))
    sorted_ids = F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), "id"))), lambda x: x["id"])
    each = kept.groupBy("first", "size").agg(sorted_ids.alias("members"), by_degree.alias("top_nodes")).join(predicates, "first", "left")
    key = F.substring(F.sha2(F.array_join("members", "\0").cast("binary"), 256), 1, 16)
    numbered = each.withColumn("nth", F.expr("row_number() over (order by size desc, first collate unicode)"))  # one row for each community
    name = F.concat(F.lit("c_"), F.lpad(F.col("nth").cast("string"), 4, "0"))
    long_name = F.when(F.col("nth") > 9999, F.concat(F.lit("c_"), F.col("nth"))).otherwise(name)
    top_label = F.col("top_nodes")[0]["label"]
    return numbered.select(long_name.alias("id"), key.alias("stable_key"), F.when(F.coalesce(top_label, F.lit("")) != "", top_label).otherwise(F.concat(F.lit("Community "), long_name)).alias("label"), "members", "size", F.coalesce("internal_triple_count", F.lit(0)).alias("internal_triple_count"), F.coalesce("top_predicates", F.array().cast("array<struct<p: string, count: bigint>>")).alias("top_predicates"), "top_nodes")


def dropped_small(triples: DataFrame, least_size: int = LEAST_SIZE) -> int:
    return members(triples).groupBy("first").count().where(F.col("count") < least_size).count()


def stable_key(ids: list[str]) -> str:
    return hashlib.sha256("\0".join(ids).encode()).hexdigest()[:16]
