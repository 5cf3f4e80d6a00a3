"""Corpus pipeline: language ID, near-duplicate removal, decontamination, secret redaction, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read as the next one's
docs.  All but the last return the columns of documents.  A language model's reject, a second
member of a near-duplicate class and a contaminated document go; secrets are replaced where they stand.
Rows are judged one by one, also where they repeat an id or have none; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parcelight.llm import language, neardup, secrets
from parcelight.llm.common import read, stored
from parcelight.llm.decontaminate import drop_contaminated
from parcelight.llm.queries import packed_digest


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows whose text has a letter and a language that leads the others; null and empty texts go."""
    return language.keep_identified(docs, language.train_on_documents(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each class of near copies: that of the smallest id, rows without an id last.  A null text stays."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows of which a twentieth of the words or more lies in windows of benchmark items; a null text stays."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret where it stands and count ``n_chars`` of changed texts anew; all rows stay."""
    return secrets.redact(docs, secrets.train(secrets.default_samples(spark)))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows' token ids, placed in sequences of 1,024; a null text is empty, a row without an id keeps none."""
    return packed_digest(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Trained models and a genetic search have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
