"""Sharding along a Hilbert curve, for shards that readers can skip by any of several metadata columns.

Each column is quantised to 2 ** bits steps: numbers by octaves and their quarters, which for 8 bits reach to the end of the
integers, other values by the share of rows before theirs, in order of value, so that common values are wide apart. The steps
are a cell of a cube; cells are ordered along the Hilbert curve, which always moves to a neighbouring cell. Cells get a place
on a line by the size of what comes before; within a cell, rows are spread by a hash of doc_id. The line is cut into runs of
`shard_chars` characters, so a shard is a range of the curve, and a cell that is too large for one shard is divided. Rows are
neither sorted nor collected to find their shard; values and cells are summed by ranges in parallel.

Shards of one divided cell have the same ranges of all columns, a quarter of an octave of numbers, and can't be told apart by
these; others can.

A null number counts as 0, a negative one too, and a null value is a value of its own, the first. Rows without n_chars have the
size 1, as do empty ones. Rows that repeat a doc_id have their own places; without doc_id they are spread as one. Columns besides those named
are carried along by written_shards() and otherwise ignored; the column it adds is `shard`, with underscores after it where docs
has one of that name. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlegraph.components import sums_before
from spindlegraph.llm.shared import staged


def curve_index(steps: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of steps (one column a dimension), by Skilling's transform."""
    x = steps.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def quarters(bits: int) -> list[int]:
    """Where the steps of a number begin: the quarters of octaves."""
    return sorted({round(2 ** (i / 4)) for i in range(4 * 62)})[: (1 << bits) - 1]


def _number_step(column: str, bits: int):
    """Steps by comparison with the ends, as a tree of CASEs."""
    ends, value = quarters(bits), F.greatest(F.lit(0), F.coalesce(F.col(column).cast("long"), F.lit(0)))

    def between(a: int, b: int):
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(value < ends[m], between(a, m)).otherwise(between(m + 1, b))

    return between(0, len(ends)).cast("int")


def _place(n: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = np.stack([np.asarray(batch.column(i)) for i in range(n)], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(curve_index(steps, bits))], names=[*batch.schema.names, "hilbert"])

    return run


def placed(docs: DataFrame, values: Sequence[str] = ("lang", "source"), numbers: Sequence[str] = ("n_chars",), bits: int = 8, size: str = "n_chars", shard_chars: int = 1 << 27) -> DataFrame:
    """docs with the columns __hilbert and __shard."""
    steps: list[str] = []
    rows, total = docs, max(1, docs.count())
    for i, c in enumerate(values):
        counts = docs.groupBy(F.col(c).alias("__v")).agg(F.count("*").alias("__n"))
        codes = sums_before(counts, ["__v"], "__n", "__start").select(F.col("__v").alias(f"__v{i}"), F.floor(F.col("__start") * F.lit(1 << bits) / F.lit(total)).cast("int").alias(f"__s{i}"))
        rows = rows.join(staged(codes), F.col(c).eqNullSafe(F.col(f"__v{i}"))).drop(f"__v{i}")
        steps.append(f"__s{i}")
    for i, c in enumerate(numbers):
        rows = rows.withColumn(f"__q{i}", _number_step(c, bits))
        steps.append(f"__q{i}")
    length = F.greatest(F.lit(1), F.coalesce(F.col(size).cast("long"), F.lit(1)))
    cells = staged(rows.groupBy(*steps).agg(F.sum(length).alias("__size")))
    kinds = ", ".join([*(f"{s} int" for s in steps), "__size long", "hilbert long"])
    line = cells.mapInArrow(_place(len(steps), bits), kinds)
    line = staged(sums_before(line, ["hilbert"], "__size", "__start")).withColumnRenamed("hilbert", "__hilbert")
    for s in steps:
        line = line.withColumnRenamed(s, "c" + s)
    on = [F.col(s) == F.col("c" + s) for s in steps]
    inside = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 7), 16, 10).cast("long")
    at = F.col("__start") + F.floor(inside * F.col("__size") / F.lit(1 << 28)).cast("long")
    return rows.join(line, on).withColumn("__shard", F.floor(at / F.lit(shard_chars)).cast("long")).select(*docs.columns, "__hilbert", "__shard")


def shards(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, hilbert, shard) of every row."""
    return placed(docs, **options).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__hilbert").alias("hilbert"), F.col("__shard").alias("shard"))


def written_shards(docs: DataFrame, path: str, **options) -> str:
    """docs as Parquet in a folder for each shard, each file in order of the curve, for its row groups to be narrow too; the name of the column of shards."""
    rows, name = placed(docs, **options), "shard"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    rows.repartition("__shard").sortWithinPartitions("__shard", "__hilbert").withColumnRenamed("__shard", name).drop("__hilbert").write.partitionBy(name).parquet(path)
    return name


def _sql(bits: int = 8, shard_chars: int = 1 << 27) -> str:
    ends = ", ".join(map(str, quarters(bits)))
    ctes = ["d as (select doc_id, lang, source, greatest(0, coalesce(n_chars, 0)) as n, greatest(1, coalesce(n_chars, 1)) as size from documents)"]
    for i, c in enumerate(("lang", "source")):
        ctes.append(f"v{i} as (select {c} as v, floor(coalesce(sum(n) over (order by v nulls first rows between unbounded preceding and 1 preceding), 0) * {1 << bits} / sum(n) over ())::bigint as s from (select {c}, {c} as v, count(*) as n from d group by {c}))")
    ctes.append(f"r as (select d.doc_id, d.size, v0.s as s0, v1.s as s1, len(list_filter([{ends}], lambda e: e <= d.n))::bigint as s2 from d join v0 on v0.v is not distinct from d.lang join v1 on v1.v is not distinct from d.source)")
    ctes.append("k0 as (select s0, s1, s2, sum(size)::bigint as size, s0 as x0, s1 as x1, s2 as x2 from r group by s0, s1, s2)")
    k = 0

    def step(**new: str) -> None:
        nonlocal k
        cols = ", ".join(f"{new.get(c, c)} as {c}" for c in ("x0", "x1", "x2"))
        ctes.append(f"k{k + 1} as (select s0, s1, s2, size, {cols} from k{k})")
        k += 1

    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        step(x0=f"case when x0 & {q} <> 0 then xor(x0, {p}) else x0 end")
        for i in (1, 2):
            t = f"(xor(x0, x{i}) & {p})"
            step(**{"x0": f"case when x{i} & {q} <> 0 then xor(x0, {p}) else xor(x0, {t}) end", f"x{i}": f"case when x{i} & {q} <> 0 then x{i} else xor(x{i}, {t}) end"})
        q >>= 1
    step(x1="xor(x1, x0)")
    step(x2="xor(x2, x1)")
    t = "0"
    q = 1 << (bits - 1)
    while q > 1:
        t = f"xor({t}, case when x2 & {q} <> 0 then {q - 1} else 0 end)"
        q >>= 1
    step(x0=f"xor(x0, {t})", x1=f"xor(x1, {t})", x2=f"xor(x2, {t})")
    index = " + ".join(f"(((x{i} >> {b}) & 1) << {3 * b + 2 - i})" for b in range(bits) for i in range(3))
    ctes.append(f"h as (select s0, s1, s2, size, ({index})::bigint as hilbert from k{k})")
    ctes.append("l as (select *, coalesce(sum(size) over (order by hilbert rows between unbounded preceding and 1 preceding), 0)::bigint as start from h)")
    inside = "('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 7))::bigint"
    return f"with {', '.join(ctes)} select doc_id, hilbert, floor((start + floor({inside} * l.size::double / {1 << 28})::bigint) / {shard_chars})::bigint as shard from r join l using (s0, s1, s2)"


SHARDS_SQL = _sql()
