"""Tables staged in the shared folder, sums along an order, and connected components by alternating large and small stars; every round is written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only local mode may go without and gets a temporary one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spindle-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again."""
    path = f"{work_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes a table that written() made and nothing reads any more."""
    spark, root = df.sparkSession, work_dir(df.sparkSession)
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if path.rpartition("/")[2].startswith("table-"):
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{path.rpartition('/')[2]}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def sums_before(df: DataFrame, order: Sequence[str], size: str, name: str) -> DataFrame:
    """df with the sum of `size` over the rows that come before in `order` (nulls first), whose values differ. Ranges are summed apart; only their sums, one for each partition, go through one task."""
    by = [F.asc_nulls_first(c) for c in order]
    parts = written(df.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()))
    ahead = lambda column, w: F.coalesce(F.sum(column).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = parts.groupBy("__part").agg(F.sum(size).alias("__sum")).withColumn("__base", ahead("__sum", Window.orderBy("__part"))).select("__part", "__base")
    return parts.join(sums, "__part").withColumn(name, F.col("__base") + ahead(size, Window.partitionBy("__part").orderBy(*by))).drop("__part", "__base")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in an edge; component is the smallest id that can be reached. Nulls and loops are ignored."""
    links = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    for _ in range(most_rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near, "u").select(F.inline(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
        small = small.where("u <> v").distinct()
        new = written(small)
        # done when every id has one link, and no link's lower end has a link itself
        more = new.groupBy("u").count().where("count > 1").limit(1).count() or new.select("v").join(new.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        dropped(links)
        links = new
        if not more:
            break
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).union(links.select(F.col("v"), F.col("v")).distinct())
