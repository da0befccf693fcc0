"""Operators over a graph of nodes (id, type, label, ...) and triples (id, s, p, o, r, ...), r being the rank of the tier."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindlegraph.components import written
from spindlegraph.functions.text import TIERS, rank, tier, triple_id

MOST_HOPS = 16
#: Tables of ids up to so many rows are sent to all tasks, so that what they are joined with isn't shuffled.
FEW = 500_000


def united(evidence: DataFrame) -> DataFrame:
    """Evidence of one (s, p, o) as one triple: its id, its best tier, its distinct places and how many rows it has."""
    return evidence.groupBy("s", "p", "o").agg(F.max(rank(F.col("tier"))).alias("r"), F.countDistinct("source", "line").alias("sources"), F.count("*").alias("evidence")).select(triple_id(F.col("s"), F.col("p"), F.col("o")).alias("id"), "s", "p", "o", "r", "sources", "evidence")


def cited(evidence: DataFrame) -> DataFrame:
    """Every triple with its best tier, the number of its distinct places and a row for each; a triple without a place has one row without."""
    place = F.when(F.col("source") != "", F.struct(F.col("source").alias("source_path"), F.col("line").alias("start_line")))
    found = evidence.groupBy("s", "p", "o").agg(F.max(rank(F.col("tier"))).alias("r"), F.collect_set(place).alias("places"))
    rows = found.select("s", "p", "o", "r", F.size("places").alias("source_count"), F.explode_outer("places").alias("at"))
    return rows.select(triple_id(F.col("s"), F.col("p"), F.col("o")).alias("triple_id"), "s", "p", "o", tier(F.col("r")).alias("confidence"), "source_count", "at.source_path", "at.start_line")


def filtered(triples: DataFrame, predicates: Sequence[str] = (), least_tier: str | None = None) -> DataFrame:
    if predicates:
        triples = triples.where(F.col("p").isin(*predicates))
    return triples.where(F.col("r") >= TIERS.index(least_tier)) if least_tier else triples


def of_types(nodes: DataFrame, triples: DataFrame, types: Sequence[str]) -> DataFrame:
    """Triples with both ends of these types."""
    kept = nodes.where(F.col("type").isin(*types)).select("id")
    return triples.join(kept.withColumnRenamed("id", "s"), "s", "left_semi").join(kept.withColumnRenamed("id", "o"), "o", "left_semi")


def matches(term: str) -> Column:
    """Whether id or label holds the term; an empty term matches nothing."""
    t = term.strip().lower()
    return (F.lower("id").contains(t) | F.lower("label").contains(t)) if t else F.lit(False)


def few(ids: DataFrame) -> DataFrame:
    """ids, a table that is cheap to count, to be sent to all tasks if it is small."""
    return F.broadcast(ids) if ids.limit(FEW + 1).count() <= FEW else ids


def adjacent(triples: DataFrame) -> DataFrame:
    """(u, v, p, id) of every triple, both ways."""
    return triples.select(F.inline(F.array(F.struct(F.col("s").alias("u"), F.col("o").alias("v"), "p", "id"), F.struct(F.col("o").alias("u"), F.col("s").alias("v"), "p", "id"))))


def adjacency(nodes: DataFrame, triples: DataFrame) -> DataFrame:
    """(u, v, p, id) of every triple, both ways, and a row without v for each node that has none."""
    both = adjacent(triples)
    alone = nodes.select(F.col("id").alias("u")).join(both.select("u"), "u", "left_anti")
    return both.select("u", "v", "p", "id").unionByName(alone, allowMissingColumns=True)


def hops(depth: float | None, default: int = 2) -> int:
    return default if depth is None or depth != depth else min(MOST_HOPS, max(0, int(depth)))


def incident(triples: DataFrame, ids: DataFrame) -> DataFrame:
    """Triples with an end among ids."""
    keys = few(ids.select("id").distinct())
    found = triples
    for end in "so":
        found = found.join(keys.select(F.col("id").alias(end), F.lit(True).alias(f"__{end}")), end, "left")
    return found.where("__s or __o").select(*triples.columns)


def beyond(triples: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct ids that a triple links with any of ids, in either direction. Both ways are spelled for the triples that have one alone."""
    both = incident(triples.select("s", "o"), ids).select(F.inline(F.array(F.struct(F.col("s").alias("u"), F.col("o").alias("id")), F.struct(F.col("o").alias("u"), F.col("s").alias("id")))))
    return both.join(few(ids.select(F.col("id").alias("u"))), "u").select("id").distinct()


def distances(triples: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """(id, depth) of every node within `most` hops of a seed, in either direction. Each level is written, so a lost executor costs one level."""
    reached = [seeds.select("id").distinct().withColumn("depth", F.lit(0))]
    for depth in range(1, hops(most) + 1):
        level = beyond(triples, reached[-1])
        for before in reached[-2:]:  # a neighbour of the last level is at most one level nearer than it
            level = level.join(few(before.select("id")), "id", "left_anti")
        level = written(level.withColumn("depth", F.lit(depth)))
        reached.append(level)
        if level.isEmpty():
            break
    return reduce(DataFrame.union, reached)


def degrees(nodes: DataFrame, triples: DataFrame) -> DataFrame:
    """Each triple counts at both its ends, a loop twice."""
    ends = triples.select(F.explode(F.array("s", "o")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("degree"))


def community_edges(triples: DataFrame) -> DataFrame:
    """Undirected pairs of different nodes that a triple of INFERRED or better links."""
    return triples.where("r >= 1 and s <> o").select(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")).distinct()


def reciprocal(triples: DataFrame, predicates: Sequence[str]) -> DataFrame:
    """(a, p, b), a < b, of directional triples that hold both ways."""
    one = triples.where(F.col("p").isin(*predicates)).select("s", "p", "o")
    return one.where("s < o").join(one.where("s > o").select(F.col("o").alias("s"), "p", F.col("s").alias("o")), ["s", "p", "o"], "left_semi").select(F.col("s").alias("a"), "p", F.col("o").alias("b"))


def without_sources(evidence: DataFrame, gone: DataFrame) -> DataFrame:
    """Evidence whose (source, line) isn't gone. Much evidence may have one such key, so those of a few are sent to all tasks."""
    return evidence.join(few(written(gone.select("source", "line").distinct())), ["source", "line"], "left_anti")


def difference(before: DataFrame, after: DataFrame, payload: Sequence[str]) -> DataFrame:
    """(id, change) of ids added, removed, or changed in their payload."""
    a, b = (df.select("id", F.sha2(F.to_json(F.struct(*payload)), 256).alias(h)) for df, h in ((before, "h"), (after, "g")))
    change = F.when(F.col("h").isNull(), "added").when(F.col("g").isNull(), "removed").when(F.col("h") != F.col("g"), "changed")
    return a.join(b, "id", "full_outer").select("id", change.alias("change")).where("change is not null")


def changed(evidence: DataFrame, stays: Column) -> DataFrame:
    """(id, change) of triples that are removed, or changed in number of rows and perhaps tier, when of their evidence only what meets `stays` is left: difference() of both by one grouping."""
    counts = evidence.groupBy("s", "p", "o").agg(F.count("*").alias("n"), F.count(F.when(stays, 1)).alias("left")).where(F.col("left") < F.col("n"))
    return counts.select(triple_id(F.col("s"), F.col("p"), F.col("o")).alias("id"), F.when(F.col("left") == 0, "removed").otherwise("changed").alias("change"))


def shortest_path(triples: DataFrame, start: str, end: str, most: int = 6) -> list[tuple[str, str | None]]:
    """(node, predicate to the next) along a shortest path, or nothing; of parents, the one of the first predicate, then id, in the order that people use. The driver holds the path alone.

    Levels are found from both ends, always from that of the smaller last one, until they meet; parents are asked for along the path alone."""
    if start == end:
        return [(start, None)]
    spark = triples.sparkSession
    sides, sizes = [[spark.createDataFrame([(i,)], "id string")] for i in (start, end)], [1, 1]
    while len(sides[0]) + len(sides[1]) - 2 < hops(most, 6):
        k = int(sizes[1] < sizes[0])
        level = beyond(triples, sides[k][-1])
        for before in sides[k][-2:]:
            level = level.join(few(before), "id", "left_anti")
        sides[k].append(written(level))
        sizes[k] = sides[k][-1].count()
        if not sizes[k]:
            return []
        met = written(sides[k][-1].join(few(sides[1 - k][-1]), "id", "left_semi"))
        if not met.isEmpty():
            break
    else:
        return []
    # levels from the start: whole ones as far as they were found from there, then nodes on shortest paths
    levels = [*sides[0][:-1], met]
    for there in sides[1][-2:0:-1]:
        levels.append(written(beyond(triples, levels[-1]).join(few(there), "id", "left_semi")))
    if len(sides[1]) == 1:
        levels.pop()
    path: list[tuple[str, str | None]] = [(end, None)]
    for level in levels[::-1]:
        at = path[-1][0]
        into = adjacent(triples.where((F.col("s") == at) | (F.col("o") == at))).where(F.col("v") == at).join(few(level.select(F.col("id").alias("u"))), "u")
        found = into.agg(F.min(F.struct(F.expr("p collate unicode").alias("pk"), F.expr("u collate unicode").alias("uk"), "p", "u")).alias("m")).first()["m"]
        path.append((found["u"], found["p"]))
    return path[::-1]
