"""From files to candidates: discovery, the registry of parsers, and extraction by each file's extension."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindlegraph.components import written
from spindlegraph.errors import GraphError
from spindlegraph.functions import plain
from spindlegraph.sources import parsers

MOST_BYTES = 8 << 20
_registry: dict[str, tuple[str, parsers.Parser]] = {}


def register(name: str, extensions: Sequence[str], parser: parsers.Parser, replace: bool = False) -> None:
    """A parser for files of these extensions; parser(path, content, content_hash) returns a parsers.Found."""
    for e in extensions:
        if e.lower() in _registry and not replace:
            raise GraphError("schema_invalid", f"{e} is taken by {_registry[e.lower()][0]}")
    _registry.update({e.lower(): (name, parser) for e in extensions})


def registered() -> dict[str, str]:
    """Name of the parser of each extension."""
    return {e: name for e, (name, _) in sorted(_registry.items())}


for _name, (_extensions, _parser) in parsers.BUILT_IN.items():
    register(_name, _extensions, _parser)


def extension(path) -> F.Column:
    return F.lower(F.regexp_extract(path, r"[^/\\](\.[^./\\]*)$", 1))


def wanted(path, globs: Sequence[str] | None):
    """Whether a path has a wanted extension (a braced list, or a glob that ends in one), or its base name is or holds another glob's text; by default all registered extensions."""
    extensions, names = set(), []
    for g in globs or [f"*{e}" for e in _registry]:
        tail = g.rpartition("/")[2]
        if "{" in tail and "}" in tail:
            extensions |= {"." + e.strip().lstrip(".").lower() for e in tail[tail.index("{") + 1 : tail.index("}")].split(",")}
        elif "." in tail and "*" not in tail.rpartition(".")[2] and tail.startswith(("*", ".")):
            extensions.add("." + tail.rpartition(".")[2].lower())
        elif tail.strip("*"):
            names.append(tail.strip("*"))
    base = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return reduce(lambda a, n: a | base.contains(n), names, extension(path).isin(*extensions))


@dataclass
class Corpus:
    """files: (path, length, modified); diagnostics: (path, code, message)."""

    roots: list[str]
    files: DataFrame
    diagnostics: DataFrame


def _local(path: str) -> str | None:
    return path.removeprefix("file://").removeprefix("file:") if path.startswith("file:") else path if "://" not in path else None


def _escapes(roots: list[str]):
    """Local files that a link leads out of the roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        real = [os.path.realpath(r) for r in roots]
        for batch in batches:
            out = [p for p in batch.column(0).to_pylist() if (at := _local(p)) is not None and not any((q := os.path.realpath(at)) == r or q.startswith(r.rstrip("/") + "/") for r in real)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["path"])

    return run


def discover(spark: SparkSession, roots: str | Sequence[str], globs: Sequence[str] | None = None, most_bytes: int = MOST_BYTES) -> Corpus:
    """Files under the roots (folders or single files). Larger ones than most_bytes are left out, with a diagnostic; their content is never read."""
    roots = [roots] if isinstance(roots, str) else list(roots)
    for r in roots:
        if (at := _local(r)) is not None and not os.path.exists(at):
            raise GraphError("corpus_not_found", f"no such corpus: {r}", path=r)
    listed = _binary(spark, roots).select("path", "length", F.col("modificationTime").alias("modified")).where(wanted(F.col("path"), globs))
    local = [at for r in roots if (at := _local(r)) is not None]
    if local:
        out = listed.select("path").mapInArrow(_escapes(local), "path string").limit(1).collect()
        if out:
            raise GraphError("path_escape", f"a link leads out of the corpus: {out[0].path}", path=out[0].path)
    large = listed.where(F.col("length") > most_bytes)
    note = large.select("path", F.lit("FILE_TOO_LARGE").alias("code"), F.format_string("%d bytes are over the limit of %d", "length", F.lit(most_bytes)).alias("message"))
    return Corpus(roots, listed.where(F.col("length") <= most_bytes), note)


def _binary(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))


_ARRAYS = {"aliases": pa.list_(pa.string())}
_INTS = {"ord": pa.int64(), "start_line": pa.int32(), "end_line": pa.int32()}
FIELDS = ("kind", "path", "content_hash", "ord", "id", "type", "label", "description", "aliases", "s", "p", "o", "extractor", "start_line", "end_line", "code", "message")
SCHEMA = pa.schema([(f, _ARRAYS.get(f) or _INTS.get(f) or pa.string()) for f in FIELDS])
DDL = ", ".join(f"{f} {'array<string>' if f in _ARRAYS else 'long' if f == 'ord' else 'int' if f in _INTS else 'string'}" for f in FIELDS)


#: Rows of so many files as come to this number are sent back together.
ROWS = 8192


def rows_of(found: parsers.Found, kinds: Sequence[str] = ("file", "node", "triple", "diagnostic")) -> Iterator[tuple]:
    """A file's rows of these kinds, by FIELDS."""
    at, hash_ = found.path, found.content_hash
    none = (None,) * len(FIELDS)
    if "file" in kinds:
        yield ("file", at, hash_, *none[3:])
    if "node" in kinds:
        for i, n in enumerate(found.nodes.values()):
            yield ("node", at, hash_, i, n["id"], n["type"], n["label"], n["description"], n["aliases"], *none[9:])
    if "triple" in kinds:
        for i, e in enumerate(found.evidence):
            yield ("triple", at, hash_, i, *none[4:9], e["s"], e["p"], e["o"], e["extractor"], e["line"], e["line"], None, None)
    if "diagnostic" in kinds:
        for i, (c, m) in enumerate(found.diagnostics):
            yield ("diagnostic", at, hash_, i, *none[4:15], c, m)


def parse(path: str, data: bytes, registry: dict[str, tuple[str, parsers.Parser]] | None = None) -> parsers.Found:
    """One file by its extension. A file that can't be parsed gives a diagnostic alone, and no `file` row, so that it isn't taken as done."""
    known = (registry or _registry).get(os.path.splitext(path)[1].lower())
    if known is None:
        found = parsers.Found(path, plain.content_hash(data))
        found.note("UNSUPPORTED_EXTENSION", "no parser for this extension")
        return found
    return known[1](path, data.decode("utf-8", "replace"), plain.content_hash(data))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)


def _extract(registry: dict[str, tuple[str, parsers.Parser]], kinds: Sequence[str] = ("file", "node", "triple", "diagnostic")):
    """Rows of these kinds of each file (path, content)."""

    def of_file(path: str, data: bytes) -> Iterator[tuple]:
        name = _local(path) or path
        try:
            found = parse(name, data, registry)
        except Exception as why:  # one file's error is that file's diagnostic
            found = parsers.Found(name, plain.content_hash(data))
            found.note("EXTRACT_FAILED", f"{type(why).__name__}: {why}")
            return rows_of(found, [k for k in kinds if k == "diagnostic"])
        return rows_of(found, kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for i in range(batch.num_rows):
                for row in of_file(batch.column(0)[i].as_py(), batch.column(1)[i].as_py()):
                    rows.append(row)
                    if len(rows) >= ROWS:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)

    return run


def spread(files: DataFrame) -> DataFrame:
    """Files over many tasks: a parser takes much longer than reading what a task of Spark's reads at once."""
    spark = files.sparkSession
    return files.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


@dataclass
class Extracted:
    """files: (path, content_hash); nodes, evidence: as normalize takes them; diagnostics: (path, code, message)."""

    files: DataFrame
    nodes: DataFrame
    evidence: DataFrame
    diagnostics: DataFrame


def extract(spark: SparkSession, corpus: Corpus, only: Sequence[str] | None = None, phase: int = 1) -> Extracted:
    """Nodes and evidence of the corpus's files, or of `only` these paths. Each file is parsed once and the rows are staged."""
    content = _binary(spark, only if only is not None else corpus.roots)
    kept = content.join(corpus.files.select("path"), "path", "left_semi") if only is None else content
    rows = written(kept.select("path", "content").mapInArrow(_extract(dict(_registry)), DDL))
    order = F.struct(F.lit(phase).alias("phase"), F.col("path").alias("path"), F.col("ord").alias("n")).alias("ord")
    nodes = rows.where("kind = 'node'").select("id", "type", "label", "description", "aliases", order)
    none = lambda kind: F.lit(None).cast(kind)
    evidence = rows.where("kind = 'triple'").select("s", "p", "o", F.col("path").alias("source_path"), "extractor", "content_hash", F.lit("EXTRACTED").alias("confidence"), "start_line", "end_line", none("string").alias("first_seen"), none("string").alias("last_seen"), none("double").alias("score"), none("array<string>").alias("supersedes"), none("array<string>").alias("superseded_by"), order)
    return Extracted(rows.where("kind = 'file'").select("path", "content_hash"), nodes, evidence, rows.where("kind = 'diagnostic'").select("path", "code", "message"))
