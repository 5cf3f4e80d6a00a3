"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def take(df: DataFrame, *names: str) -> DataFrame:
    """The columns ``names`` and no others, chosen by position.

    Extra columns may have any name, even one that differs from a wanted one by case alone: an exact
    match wins, then the first match without case.
    """
    return positional(df).select(*(F.col(f"_c{position(df, n)}").alias(n) for n in names))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a new one is set; on a cluster that is an error.
    """
    held = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        held = spark.sparkContext.getCheckpointDir()
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        held = "file://" + tempfile.mkdtemp(prefix="parcelight-")
        spark.sparkContext.setCheckpointDir(held)
    return held.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: its lineage ends there, so a lost
    executor costs no recomputation beyond the stage that is running."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def annotated(df: DataFrame, name: str, make: Callable[[], Callable[[list], list]], added: str) -> DataFrame:
    """All rows with their columns under positional names ``_c0``, ``_c1``, ... and one more, ``added`` (name and
    type), that ``make()`` computes in each task from the values of column ``name``.

    Rows pass through as Arrow batches, so no value changes and no join brings the answer back.
    """
    at = position(df, name)
    plain = positional(df)
    schema = T.StructType([*plain.schema.fields, *T._parse_datatype_string(added).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        f, field = make(), schema.fields[-1]
        for b in batches:
            more = pa.array(f(b.column(at).to_pylist()), to_arrow_type(field.dataType))
            yield pa.RecordBatch.from_arrays([*b.columns, more], names=[x.name for x in schema.fields])

    return plain.mapInArrow(run, schema)


def position(df: DataFrame, name: str) -> int:
    """Where column ``name`` stands: an exact match, else the first without case."""
    return df.columns.index(name) if name in df.columns else [c.lower() for c in df.columns].index(name.lower())


def positional(df: DataFrame) -> DataFrame:
    return df.toDF(*(f"_c{i}" for i in range(len(df.columns))))


def restored(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns ``_c0``, ``_c1``, ... under ``names`` again."""
    return df.select(*(F.col(f"_c{i}") for i in range(len(names)))).toDF(*names)
