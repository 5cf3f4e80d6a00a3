"""Datasets at rest: one Parquet table per data type, partitioned by dataset, control rows, and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import CODES, CONTRACTS

KINDS = tuple(CONTRACTS)
CONTROL = "dataset_id string, kind string, n_rows long, created_at timestamp"


class Store:
    """Tables under ``root``.  A write replaces exactly its dataset's partition; a read prunes to it.

    A dataset has a control row, written after its rows; should that fail, the rows are taken back.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, kind: str) -> str:
        if kind not in KINDS:
            raise ValueError(f"no data type {kind}")
        return f"{self.root}/{kind}"

    def _file(self, path: str):
        """A path and its file system."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _drop(self, path: str) -> bool:
        p, fs = self._file(path)
        return bool(fs.delete(p, True))

    def _write(self, df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id").parquet(path)

    def register(self, kind: str, dataset_id: str, rows: DataFrame, created_at: str | None = None) -> None:
        """Replace the dataset's rows and its control row."""
        self._write(rows.withColumn("dataset_id", F.lit(dataset_id)), self._path(kind))
        n = self.load(kind, dataset_id).count()
        when = F.lit(created_at).cast("timestamp") if created_at else F.current_timestamp()
        control = self.spark.range(1).select(F.lit(kind).alias("kind"), F.lit(n).cast("long").alias("n_rows"), when.alias("created_at"), F.lit(dataset_id).alias("dataset_id"))
        try:
            self._write(control, f"{self.root}/_datasets_{kind}")
        except Exception:
            self._drop(f"{self._path(kind)}/dataset_id={dataset_id}")
            raise

    def load(self, kind: str, dataset_id: str) -> DataFrame:
        """Rows of the contract in the order of their source_index; a column of another type than the contract's is an error."""
        df = self.spark.read.parquet(self._path(kind)).where(F.col("dataset_id") == dataset_id)
        fields = [f for f in CONTRACTS[kind].schema.fields if f.name in df.columns]
        for f in fields:
            if df.schema[f.name].dataType != f.dataType and f.name not in CONTRACTS[kind].times:
                raise ValueError(f"{kind}.{f.name} is no {f.dataType.simpleString()}")
        return df.select(*(f.name for f in fields)).orderBy("source_index")

    def control(self, kind: str) -> DataFrame:
        """Control rows of a data type, the newest first."""
        path = f"{self.root}/_datasets_{kind}"
        p, fs = self._file(path)
        rows = self.spark.read.parquet(path) if fs.exists(p) else self.spark.createDataFrame([], CONTROL)
        return rows.select("dataset_id", "kind", "n_rows", "created_at").orderBy(F.desc("created_at"), "dataset_id")

    def list(self, kind: str) -> DataFrame:
        return self.control(kind).select("dataset_id", F.col("n_rows").alias("n"))

    def get(self, kind: str, dataset_id: str) -> DataFrame:
        return self.control(kind).where(F.col("dataset_id") == dataset_id)

    def bind(self, dataset_id: str, name: str, rows: DataFrame) -> None:
        """Keep a result that belongs to a dataset (a scenario, a report) until the dataset goes."""
        self._write(rows.withColumn("dataset_id", F.lit(dataset_id)), f"{self.root}/_bound/{name}")

    def save_status_mappings(self, kind: str, mappings: dict[str, str]) -> None:
        """Add to a data type's own status words; a word given again gets the new code.  A code that the type does not have is an error."""
        unknown = sorted({c for c in mappings.values() if c not in CODES[kind]})
        if unknown:
            raise ValueError(f"{kind} has no status {', '.join(unknown)}")
        held = self.status_mappings(kind) | mappings
        rows = self.spark.createDataFrame([(raw, code, kind) for raw, code in sorted(held.items())], "raw string, code string, dataset_id string")
        self._write(rows.coalesce(1), f"{self.root}/_status_mappings")

    def status_mappings(self, kind: str) -> dict[str, str]:
        """A data type's own status words, as :func:`..operators.ingest.validate` takes them: a few a type."""
        self._path(kind)
        path = f"{self.root}/_status_mappings"
        p, fs = self._file(path)
        if not fs.exists(p):
            return {}
        rows = self.spark.read.schema("raw string, code string, dataset_id string").parquet(path).where(F.col("dataset_id") == kind)
        return {r["raw"]: r["code"] for r in rows.collect()}

    def delete(self, dataset_id: str) -> dict[str, int]:
        """Drop the dataset's rows of every type, its control rows and what is bound to it; how many rows each type had, and how many
        bound results there were (``bound``)."""
        out = {}
        for kind in KINDS:
            row = self.get(kind, dataset_id).first()
            out[kind] = row["n_rows"] if row else 0
            self._drop(f"{self._path(kind)}/dataset_id={dataset_id}")
            self._drop(f"{self.root}/_datasets_{kind}/dataset_id={dataset_id}")
        p, fs = self._file(f"{self.root}/_bound")
        names = [str(x.getPath()) for x in fs.listStatus(p)] if fs.exists(p) else []
        out["bound"] = sum(self._drop(f"{n}/dataset_id={dataset_id}") for n in names)
        return out


def read_jsonl(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(CONTRACTS[kind].schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)
