"""Embeddings beside a graph: built in batches by a function from elsewhere, reused where a node's text is the same, and asked for seeds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlegraph.functions import text

BATCH = 100
VECTORS = "id string, text_hash string, model string, vector array<double>"


def node_texts(nodes: DataFrame) -> DataFrame:
    """(id, text, text_hash): label and aliases."""
    whole = F.concat_ws(" · ", F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))
    return nodes.select("id", whole.alias("text")).withColumn("text_hash", F.concat(F.lit("sha256:"), F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 12)))


def _embedded(embed: Callable[[list[str]], list[list[float]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                vectors = embed(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(vectors, pa.list_(pa.float64()))], names=["id", "text_hash", "vector"])

    return run


def build(nodes: DataFrame, embed: Callable[[list[str]], list[list[float]]], model: str, prior: DataFrame | None = None) -> DataFrame:
    """(id, text_hash, model, vector) of every node. embed(texts) runs in tasks; vectors of prior stay where model and text are the same."""
    wanted = node_texts(nodes)
    if prior is None:
        new, kept = wanted, None
    else:
        same = prior.where(F.col("model") == model).select("id", "text_hash", "model", "vector")
        kept = same.join(wanted.select("id", "text_hash"), ["id", "text_hash"], "left_semi")
        new = wanted.join(same.select("id", "text_hash"), ["id", "text_hash"], "left_anti")
    made = new.select("id", "text", "text_hash").mapInArrow(_embedded(embed), "id string, text_hash string, vector array<double>").select("id", "text_hash", F.lit(model).alias("model"), "vector")
    return made if kept is None else kept.unionByName(made)


def candidates(vectors: DataFrame, query: list[float], k: int = 5, least: float = 0.25) -> DataFrame:
    """(id, score) of the k nodes of the greatest cosine, least or more; of equal ones the first id."""
    q = F.array(*map(F.lit, map(float, query)))
    return vectors.select("id", text.cosine(F.col("vector"), q).alias("score")).where(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(k)


def seed_scorer(vectors: DataFrame, embed: Callable[[list[str]], list[list[float]]]):
    """A scorer for answer_semantic()."""
    return lambda nodes, question, k: candidates(vectors.join(nodes.select("id"), "id", "left_semi"), embed([question])[0], k)
