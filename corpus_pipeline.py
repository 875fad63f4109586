"""A training corpus in five stages, each of them one operator over all documents that the stage before kept.

Every stage's result is written as Parquet to the folder that the executors share and read back, so a lost executor
costs no earlier stage.  The last stage returns packed sequences; the others return the columns of ``documents``.

Defined cases: documents without a word go in the first stage; a null language is a language of its own; rows that
repeat, share a doc_id or have none stay or go by their own text in each stage (rows without a doc_id are never near
duplicates); texts of any length are handled in whole; an empty table gives no sequences; columns besides doc_id,
text, lang and n_chars pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, linededup, packing, perplexity, simhash
from quern.llm.common import column, delete, own_folder, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their language's perplexity bands."""
    return perplexity.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines whose templates recur across documents; n_chars follows the text."""
    cleaned = linededup.clean(docs)
    lengths = {"n_chars": F.length(column(cleaned, "text")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return cleaned.withColumns(lengths)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test string of the benchmark."""
    return decontaminate.keep(docs, read(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in bins: (bin_id, doc_ids, pieces, sizes, filled)."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: The stages can't be expressed in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of all stages over documents."""
    folder, before = own_folder(spark, "pipeline"), None
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
