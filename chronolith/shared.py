"""Steps in the folder that all executors share: written tables and ranks without a single task."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@lru_cache(8)
def _own_dir(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="chronolith-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset and all runs on this machine, as in
    tests, a temporary one. Unset on a cluster is an error, as executors wouldn't see one another's files."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_dir(spark.sparkContext.applicationId)


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write to the shared folder as Parquet and read again.

    Cuts the lineage: a lost executor costs one reread of a file, and what follows sees one fixed set of rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def global_rank(df: DataFrame, keys: list[str], out: str = "rank", partitions: int | None = None) -> DataFrame:
    """Each row's place from 0 in the order of ``keys`` and the ``total`` of rows, without a single-task window.

    Rows are range-partitioned on the keys and written once; each part is numbered by itself and shifted by the
    rows of the parts before it. Ties get places in any order, so end the keys with a tie-breaker.
    Only as many counts as there are partitions are gathered into one task.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(n, *keys).withColumn("__part", F.spark_partition_id()), "rank")
    counts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"), F.sum("__n").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("__part").orderBy(*keys)
    numbered = dealt.withColumn("__row", F.row_number().over(inside) - 1)
    joined = numbered.join(F.broadcast(shifts), "__part")
    return joined.withColumn(out, F.col("__row") + F.col("__shift")).drop("__part", "__row", "__shift")
