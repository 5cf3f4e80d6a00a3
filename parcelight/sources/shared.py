"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset, and on one machine (tests), a new folder is set."""
    held = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        held = "file://" + tempfile.mkdtemp(prefix="parcelight-")
        spark.sparkContext.setCheckpointDir(held)
    return held.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def _conf(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    held = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, held) if held else spark.conf.unset(name)


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, by: str) -> DataFrame:
    """``df`` in as many partitions of ``by`` as a table stored by it has buckets."""
    return df.repartition(buckets(df.sparkSession), by)


def stored(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """``df`` written once and read again, so that what follows neither recomputes nor replans it.

    With ``by`` the table is bucketed by that column: joins and groups on it need no shuffle.  ``df`` should be :func:`dealt` by it, as
    each task writes a file for every bucket that it has rows of.  Times are written as whole microseconds, in 8 bytes rather than 12.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    with _conf(spark, "spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS"):
        out = df.write.option("compression", "zstd")
        if by is None:
            out.parquet(path)
            return spark.read.schema(df.schema).parquet(path)
        name = path.rsplit("/", 1)[1].replace("-", "_")
        out.bucketBy(buckets(spark), by).option("path", path).saveAsTable(name, format="parquet")
    return spark.table(name)


def numbered(df: DataFrame, keys: list[str], order: list[str], rows: int, chunk_rows: int = 50_000) -> DataFrame:
    """``df`` of about ``rows`` rows with ``place``: gapless from 0 within ``keys``, by chunks of a hash of ``order`` and by ``order``
    in each, so that no task holds all rows of a key.  Rows of equal ``order`` may stand either way."""
    chunk = F.pmod(F.xxhash64(F.lit(17), *order), F.lit(max(1, math.ceil(rows / chunk_rows)))).cast("int")
    df = df.withColumn("chunk", chunk)
    counts = df.groupBy(*keys, "chunk").agg(F.count(F.lit(1)).alias("k"))
    past = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "chunk", F.coalesce(F.sum("k").over(past), F.lit(0)).alias("before"))
    at = F.row_number().over(Window.partitionBy(*keys, "chunk").orderBy(*order)) - 1
    out = df.withColumn("at", at).join(starts, [*keys, "chunk"])
    return out.withColumn("place", (F.col("before") + F.col("at")).cast("long")).drop("at", "before", "chunk")
