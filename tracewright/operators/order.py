"""Written intermediate tables, and the place of rows in a total order."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, the folder that the driver and all executors share.

    Where it is unset a local master (tests) gets a temporary folder; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tracewright-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again, without their lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def numbered(df: DataFrame, *order, name: str = "place") -> DataFrame:
    """The rows with their place (long, from 1) in an order.

    The sorted rows are written once; a place is that inside its partition and the number of rows in
    those before, so no task sees all rows.
    """
    at = F.monotonically_increasing_id()
    rows = cut(df.orderBy(*order)).select("*", F.shiftright(at, 33).cast("int").alias("__part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("__at"))
    sizes = rows.groupBy(F.col("__part").alias("__p")).agg(F.count(F.lit(1)).alias("__n"))  # a row a partition
    before = sizes.select("__p", (F.sum("__n").over(W.orderBy("__p")) - F.col("__n")).alias("__before"))
    out = rows.join(F.broadcast(before), F.col("__part") == F.col("__p"))
    return out.select(*df.columns, (F.col("__before") + F.col("__at") + 1).alias(name))
