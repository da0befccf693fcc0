"""Approximate nearest neighbours by cosine distance, on a robust-pruned directed graph for each shard.

Vectors are dealt to shards by a hash of their id. A shard's graph grows in batches: a greedy search over the graph so far
proposes neighbours for each new vector, and a candidate stays only if no neighbour kept before it is `relax` times nearer to
the candidate than the vector is, so edges are few and point in different ways; edges back are pruned alike. All vectors are
indexed; queries are those whose vec_id is divisible by `every`. A beam search of width `beam` asks each shard for each query,
and the answers of all shards are merged. Distances are exact; which neighbours are found is approximate. There are about
sqrt(n / 2048) shards, so a shard of 10 ** 9 vectors in all holds some 1.4 million. A graph goes through the shuffle once for
each PART queries, and queries once for each shard; a task reads one graph and streams its queries.

Rows without vec_id are left out, and vectors that are null, empty, of zero length or hold a null or anything not finite.
Vectors are compared with those of as many numbers only. Of rows that repeat a vec_id the least vector counts. Equal vectors
are one point of the graph, and its ids are all found; equal distances (to 6 decimals) are in order of id. A vector alone has no
neighbour. Columns besides vec_id and embedding are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlegraph.llm.shared import staged

PER_ROW, PART = 4096, 2_000_000
#: Places of a query's memory of points it has met; a point that another one displaced is looked at again.
MET, BATCH = 8192, 1024


def search(x: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int, step: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The beam of each query (points by distance, -1 where none), its distances, and the points it went through with theirs.

    A point that left a beam is no nearer than the beam's last from then on, so only those in the beam must be told from new ones;
    what a query has met lately is remembered to save distances."""
    n_q, width = len(queries), edges.shape[1] * step
    ids, dist = np.full((n_q, beam), -1, np.int32), np.full((n_q, beam), np.inf, np.float32)
    done = np.zeros((n_q, beam), bool)
    ids[:, 0], dist[:, 0] = start, 1 - queries @ x[start]
    mask = min(MET, 1 << max(0, len(x) - 1).bit_length()) - 1
    met = np.full((n_q, mask + 1), -1, np.int32)
    met[:, start & mask] = start
    through: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    active = np.arange(n_q)
    while len(active):
        ready = ~done[active] & (ids[active] >= 0)
        nth = np.cumsum(ready, 1)
        pick = ready & (nth <= step)
        some = pick.any(1)
        active, pick, nth = active[some], pick[some], nth[some]
        if not len(active):
            break
        r, c = np.nonzero(pick)
        near, near_dist = np.full((len(active), step), -1, np.int32), np.full((len(active), step), np.inf, np.float32)
        near[r, nth[r, c] - 1], near_dist[r, nth[r, c] - 1] = ids[active[r], c], dist[active[r], c]
        done[active[r], c] = True
        through.append((active, near, near_dist))
        next_ = np.where(near[:, :, None] >= 0, edges[near], -1).reshape(len(active), width)
        r, c = np.nonzero(next_ >= 0)
        to, q = next_[r, c], active[r]
        fresh = met[q, to & mask] != to
        r, c, to, q = r[fresh], c[fresh], to[fresh], q[fresh]
        one = np.sort(np.unique(r.astype(np.int64) * len(x) + to, return_index=True)[1])
        r, c, to, q = r[one], c[one], to[one], q[one]
        met[q, to & mask] = to
        d = 1 - np.einsum("ij,ij->i", x[to], queries[q])
        better = d < dist[q, -1]
        r, c, to, q, d = r[better], c[better], to[better], q[better], d[better]
        new = (ids[q] != to[:, None]).all(1)
        r, c, to, d = r[new], c[new], to[new], d[new]
        new_ids, new_dist = np.full((len(active), width), -1, np.int32), np.full((len(active), width), np.inf, np.float32)
        new_ids[r, c], new_dist[r, c] = to, d
        all_ids, all_dist = np.concatenate([ids[active], new_ids], 1), np.concatenate([dist[active], new_dist], 1)
        all_done = np.concatenate([done[active], np.zeros_like(new_ids, bool)], 1)
        by = np.argsort(all_dist, 1, kind="stable")[:, :beam]
        ids[active], dist[active], done[active] = np.take_along_axis(all_ids, by, 1), np.take_along_axis(all_dist, by, 1), np.take_along_axis(all_done, by, 1)
    shape = (n_q, step * len(through))
    past, past_dist = np.full(shape, -1, np.int32), np.full(shape, np.inf, np.float32)
    for k, (rows, near, near_dist) in enumerate(through):
        past[rows, k * step : (k + 1) * step], past_dist[rows, k * step : (k + 1) * step] = near, near_dist
    return ids, dist, past, past_dist


def pruned(x: np.ndarray, candidates: np.ndarray, dist: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """For each row of candidates (-1 where none) the neighbours that robust pruning keeps, nearest first."""
    by = np.argsort(dist, 1, kind="stable")
    candidates, dist = np.take_along_axis(candidates, by, 1), np.take_along_axis(dist, by, 1)
    last = int((candidates >= 0).sum(1).max(initial=0))
    candidates, dist = candidates[:, :last], dist[:, :last]
    out = np.full((len(candidates), degree), -1, np.int32)
    alive, vectors, rows = candidates >= 0, x[candidates], np.arange(len(candidates))
    for k in range(min(degree, last)):
        at = alive.argmax(1)
        some = np.flatnonzero(alive[rows, at])
        if not len(some):
            break
        out[some, k] = candidates[some, at[some]]
        between = 1 - (vectors @ vectors[rows, at][:, :, None])[:, :, 0]
        alive &= relax * between > dist
        alive[rows, at] = False
    return out


def graph(x: np.ndarray, degree: int = 32, beam: int = 64, relax: float = 1.2) -> tuple[np.ndarray, int]:
    """Edges of each point (-1 where none) and where searches start, over distinct unit vectors."""
    n = len(x)
    edges = np.full((n, degree), -1, np.int32)
    start = int((x @ x.mean(0)).argmax())
    order = np.random.default_rng(n).permutation(n)
    order = order[order != start]
    at, size = 0, 1
    while at < len(order):
        batch = order[at : at + size]
        at, size = at + size, min(2 * size, max(1, n // 40), 2048)
        for some in np.array_split(batch, math.ceil(len(batch) / BATCH)):
            ids, dist, past, past_dist = search(x, edges, start, x[some], beam)
            fresh = np.where(np.isin(ids, past) & (ids[:, :, None] == past[:, None, :]).any(2), -1, ids) if past.size else ids
            edges[some] = pruned(x, np.concatenate([past, fresh], 1), np.concatenate([past_dist, np.where(fresh >= 0, dist, np.inf)], 1), degree, relax)
        k = np.nonzero(edges[batch] >= 0)
        source, to = batch[k[0]].astype(np.int32), edges[batch][k]
        by = np.argsort(to, kind="stable")
        source, to = source[by], to[by]
        targets, first, many = np.unique(to, return_index=True, return_counts=True)
        have = (edges[targets] >= 0).sum(1)
        wide = np.full((len(targets), degree + int(many.max())), -1, np.int32)
        wide[:, :degree] = edges[targets]
        row = np.repeat(np.arange(len(targets)), many)
        wide[row, have[row] + np.arange(len(to)) - first[row]] = source
        fits = have + many <= degree
        edges[targets[fits]] = wide[fits, :degree]
        for some in np.array_split(np.flatnonzero(~fits), max(1, math.ceil((~fits).sum() / 512))):
            d = np.where(wide[some] >= 0, 1 - (x[wide[some]] @ x[targets[some]][:, :, None])[:, :, 0], np.inf)
            edges[targets[some]] = pruned(x, wide[some], d, degree, relax)
    return edges, start


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


KIND = "dims int, shard int, asks boolean, ids binary, vectors binary, edges binary, many binary, start int"
PACKED = pa.schema([("dims", pa.int32()), ("shard", pa.int32()), ("asks", pa.bool_()), ("ids", pa.binary()), ("vectors", pa.binary()), ("edges", pa.binary()), ("many", pa.binary()), ("start", pa.int32())])
ANSWERS = pa.schema([("vec_id", pa.int64()), ("found", pa.list_(pa.struct([("distance", pa.float64()), ("neighbour_id", pa.int64())])))])


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(PACKED)], schema=PACKED)


def _build(degree: int, beam: int, relax: float):
    """A shard's points with their edges, some at a time."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("vec_id")
        dims, shard = group["dims"][0].as_py(), group["shard"][0].as_py()
        ids = group["vec_id"].to_numpy()
        x = _unit(group["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
        _, first, point = np.unique(x.view(f"V{4 * dims}").ravel(), return_index=True, return_inverse=True)
        edges, start = graph(np.ascontiguousarray(x[first]), degree, beam, relax)
        by = np.argsort(point, kind="stable")
        many = np.bincount(point)
        ends = np.cumsum(many)
        rows = []
        for a in range(0, len(first), PER_ROW):
            b = min(a + PER_ROW, len(first))
            rows.append((dims, shard, False, ids[by[ends[a] - many[a] : ends[b - 1]]].tobytes(), x[first[a:b]].tobytes(), edges[a:b].tobytes(), many[a:b].astype(np.int32).tobytes(), start))
        return pa.Table.from_batches([_table(rows)])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries of one number of dimensions, some at a time."""
    for batch in batches:
        dims, ids = np.asarray(batch.column(1)), np.asarray(batch.column(0))
        rows = []
        for n in np.unique(dims).tolist():
            at = np.flatnonzero(dims == n)
            x = _unit(batch.column(2).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n))
            rows += [(n, 0, True, ids[at[a : a + PER_ROW]].tobytes(), x[a : a + PER_ROW].tobytes(), b"", b"", 0) for a in range(0, len(at), PER_ROW)]
        yield _table(rows)


class Shard:
    """A graph that is read row by row, and then asked."""

    def __init__(self, dims: int, degree: int):
        self.dims, self.degree, self.rows = dims, degree, []

    def add(self, row: dict) -> None:
        self.rows.append(row)

    def ready(self) -> bool:
        if self.rows:
            join = lambda c, kind: np.frombuffer(b"".join(r[c] for r in self.rows), kind)
            self.x, self.edges = join("vectors", np.float32).reshape(-1, self.dims), join("edges", np.int32).reshape(-1, self.degree)
            self.many, self.owner, self.start = join("many", np.int32), join("ids", np.int64), self.rows[0]["start"]
            self.rows = []
        return hasattr(self, "x")

    def answers(self, asked: np.ndarray, v: np.ndarray, k: int, beam: int) -> pa.RecordBatch:
        # k + 1 ids of a point are enough: they are in order, and one of them may be the query
        begin, held = np.cumsum(self.many, dtype=np.int64) - self.many, np.minimum(self.many, k + 1)
        out = []
        for some in np.array_split(np.arange(len(asked)), max(1, math.ceil(len(asked) / BATCH))):
            ids = search(self.x, self.edges, self.start, v[some], beam)[0][:, : k + 1]
            r, c = np.nonzero(ids >= 0)
            point = ids[r, c]
            d = np.round(1 - np.einsum("ij,ij->i", self.x[point].astype(np.float64), v[some[r]].astype(np.float64)), 6) + 0.0
            each = np.repeat(np.arange(len(r)), held[point])
            nth = np.arange(len(each)) - np.repeat(np.cumsum(held[point]) - held[point], held[point])
            to, r, d = self.owner[begin[point[each]] + nth], some[r[each]], d[each]
            ok = to != asked[r]
            to, r, d = to[ok], r[ok], d[ok]
            by = np.lexsort((to, d, r))
            to, r, d = to[by], r[by], d[by]
            keep = np.arange(len(r)) - np.searchsorted(r, r) < k
            out.append((asked[r[keep]], to[keep], d[keep]))
        a, b, d = (np.concatenate(z) for z in zip(*out))
        ends = np.flatnonzero(np.concatenate([a[1:] != a[:-1], [True]])) + 1 if len(a) else np.zeros(0, np.int64)
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        found = pa.StructArray.from_arrays([pa.array(d), pa.array(b)], ["distance", "neighbour_id"])
        return pa.RecordBatch.from_arrays([pa.array(a[ends - 1]), pa.ListArray.from_arrays(offsets, found)], schema=ANSWERS)


def _ask(k: int, degree: int, beam: int):
    """Rows come by part and shard, a shard's graph before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("dims", "shard", "part", "asks", "ids", "vectors", "edges", "many", "start")}
                if (row["dims"], row["part"], row["shard"]) != key:
                    key, shard = (row["dims"], row["part"], row["shard"]), Shard(row["dims"], degree)
                if not row["asks"]:
                    shard.add(row)
                elif shard.ready():  # else no vector of this length is in the shard
                    yield shard.answers(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.float32).reshape(-1, row["dims"]), k, beam)

    return run


def neighbours(vectors: DataFrame, k: int = 10, degree: int = 32, beam: int = 64, relax: float = 1.2, every: int = 50) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance): the k nearest of all vectors to each whose vec_id is divisible by every, rank from 1."""
    e = F.col("embedding").cast("array<float>")
    length = F.aggregate(e, F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"))
    rows = rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & length.isNotNull() & ~F.isnan(length) & (length > 0) & (length < float("inf")))
    rows = staged(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dims", F.size("embedding")))
    n, n_asked = rows.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    shards, parts = max(1, math.ceil(math.sqrt(n / 2048))), max(1, math.ceil(n_asked / PART))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    made = staged(dealt.groupBy("dims", "shard").applyInArrow(_build(degree, beam, relax), KIND))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "dims", "embedding").mapInArrow(_packed, KIND)
    asked = asked.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int")).withColumn("shard", each(shards))
    both = made.withColumn("part", each(parts)).unionByName(asked)
    tasks = both.repartition(shards * parts, "part", "shard").sortWithinPartitions("dims", "part", "shard", "asks")
    answers = tasks.mapInArrow(_ask(k, degree, beam), "vec_id long, found array<struct<distance: double, neighbour_id: long>>")
    best = answers.groupBy("vec_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k).alias("found"))
    return best.select("vec_id", F.posexplode("found").alias("nth", "f")).select("vec_id", (F.col("nth") + 1).cast("int").alias("rank"), F.col("f.neighbour_id").alias("neighbour_id"), F.col("f.distance").alias("distance"))
