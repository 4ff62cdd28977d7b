"""The corpus pipeline: documents through the text-preparation operators, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor
kept, and returns a DataFrame, which is written as Parquet and read again as
the next stage's documents.  All stages but the last return the columns of
documents; ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablekeeper.llm.decontaminate import remove_contaminated
from tablekeeper.llm.kneser_ney import keep_good
from tablekeeper.llm.lines import drop_repeated_lines
from tablekeeper.llm.minhash import drop_near_duplicates
from tablekeeper.llm.packing import pack
from tablekeeper.llm.queries import importable, table
from tablekeeper.session import materialize


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the n-gram model of trusted text does not reject."""
    importable(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier line is alike; rows that lose all their lines go.

    Each row keeps its own text, whatever its doc_id; rows without such a line pass as they are.
    """
    importable(spark)
    return drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one of the smallest doc_id."""
    importable(spark)
    return drop_near_duplicates(docs, shingle=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth stand in passages of the benchmark."""
    importable(spark)
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left and their places in sequences of at most 1024 tokens."""
    importable(spark)
    return pack(docs).drop("ids")


STAGES = [("quality_classifier", quality_classifier), ("line_dedup", dedup_lines), ("near_duplicates", near_duplicates),
          ("benchmark_decontamination", benchmark_decontamination), ("best_fit_packing", best_fit_packing)]

#: SQL can't express the model, the suffix arrays or the packing; tests hold each stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
