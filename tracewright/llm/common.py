"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word alphabet of every operator here: maximal runs of anything but ASCII white space.
ASCII_SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: str) -> list[str]:
    """Words of a text: runs of characters other than space and tab to carriage return.

    ``str.split()`` also cuts at other white space, so it serves only texts without any.
    """
    if text.isascii():
        if not any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return text.split()
    for c in "\t\n\x0b\x0c\r":
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master (tests) gets a temporary folder; on a cluster that is an error,
    because a folder of the driver's machine would be lost with it and unseen by executors.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tracewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: What this driver has written for its own use and not yet dropped: folders, and tables as (name,).
_written: list[str | tuple[str]] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage and pins results that must not be computed twice (row keys, batches); a
    lost executor costs nothing that is already written.  ``drop_written`` removes the folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written_table(name: str) -> None:
    _written.append((name,))


def drop_written(spark: SparkSession, keep: int = 0) -> None:
    """Remove the intermediate tables written so far, but for the last ``keep``.

    For callers that have stored the results: a result that was not yet computed needs its
    intermediate tables, so no operator drops them itself.
    """
    gone, _written[:] = _written[: len(_written) - keep], _written[len(_written) - keep :]
    for x in gone:
        if isinstance(x, tuple):
            spark.sql(f"DROP TABLE IF EXISTS `{x[0]}`")
        else:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_id(df: DataFrame, id_col: str) -> DataFrame:
    """``__id`` under its own name; a result column of that name gives way to it."""
    return df.select(F.col("__id").alias(id_col), *[c for c in df.columns if c not in ("__id", id_col)])


def lowest_hashes(df: DataFrame, id_col: str, n: int, *ties: str) -> DataFrame:
    """The ``n`` rows with the smallest hash of their id; ties go by id, then by ``ties``.

    Rows are counted, and all but the lowest hashes, twice as many as wanted, go before the ordering, so
    what the ordering gathers does not grow with the number of tasks.
    """
    key = F.xxhash64(F.col(id_col).cast("string"))
    rows = df.count()
    if rows > 4 * n:
        low = df.where(key < int(-(2**63) + 2**64 * (2 * n / rows)))
        df = low if low.count() >= n else df
    return df.orderBy(key, F.col(id_col), *ties).limit(n)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Bounded slices of Arrow batches, so that Python objects of few rows live at a time.

    After the last one, memory that the task no longer uses goes back to the system: the worker
    stays for other operators' tasks.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release()


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
