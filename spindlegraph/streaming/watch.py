"""Changes as they come: a folder watched by Structured Streaming, and evidence kept up to date batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spindlegraph.build import build
from spindlegraph.components import work_dir
from spindlegraph.sources import discover as sources
from spindlegraph.store import Store

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def watch(spark: SparkSession, root: str, corpus: str, globs: Sequence[str] | None = None, seconds: float | None = 2.0, report: Callable[[dict], None] | None = None, **options) -> StreamingQuery:
    """Builds what changed whenever files are written under corpus; seconds between looks, or None for one look at what is there.

    Files that come within a look are one build. A build lists the corpus anew, so removed files count with the next one that
    is written. The stream's position is kept under the store."""
    stream = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(corpus)
    seen = stream.select("path", "modificationTime").where(sources.wanted(F.col("path"), globs))
    store = Store(spark, root)

    def sync(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            done = build(spark, root, corpus, globs=globs, **options)
            if report is not None:
                report(done)

    writer = seen.writeStream.foreachBatch(sync).option("checkpointLocation", f"file://{store.path('watch')}")
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def kept_up(events: DataFrame, keys: Sequence[str], value: str, at: str, name: str, one_look: bool = True) -> tuple[StreamingQuery, str]:
    """Streamed events as a table of the last value of each key, and how many events it had, in the folder that is returned.

    Each batch is summed up by key and written as a version of its own, after what was there; a batch that runs again writes the
    same version, and so changes nothing. Keys that a batch doesn't touch are carried along."""
    spark = events.sparkSession
    folder = f"{work_dir(spark)}/stream-{name}"
    whole = F.struct(F.col(at), F.col(value))

    def add(batch: DataFrame, n: int) -> None:
        now = batch.groupBy(*keys).agg(F.max(whole).alias("last"), F.count("*").alias("n"))
        if n > 0:
            before = spark.read.parquet(f"{folder}/v{n - 1}")
            now = now.unionByName(before).groupBy(*keys).agg(F.max("last").alias("last"), F.sum("n").alias("n"))
        now.write.mode("overwrite").parquet(f"{folder}/v{n}")

    writer = events.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/position")
    return (writer.trigger(availableNow=True) if one_look else writer).start(), folder


def newest(spark: SparkSession, folder: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(path)]
    return spark.read.parquet(f"{folder}/v{max(int(n[1:]) for n in names if n[:1] == 'v' and n[1:].isdigit())}")
