"""The corpus pipeline: five stages, each an operator of gradecube.llm applied to what the stage before has kept.

A stage is a function of (spark, docs, sf_dir). All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradecube.llm import decontamination, mixing, pii, quality_lm, simhash
from gradecube.llm.common import stored, table
from gradecube.llm.queries import KEY


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose Kneser-Ney perplexity is under the limit of their language; the others go.

    Null and empty texts go. The verdict depends on text and lang alone, so repeated rows and ties share it. Without
    labelled rows all documents with a text stay; empty tables give no rows.
    """
    return quality_lm.kept_only(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates: that with the least doc_id.

    Rows without a doc_id come last, of equal rows one stays; null and empty texts are alike. Empty tables give no rows.
    """
    return simhash.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    The verdict depends on the text alone: documents that share a doc_id, or have none, go only for their own text.
    Null and empty texts stay, repeated rows go together. An empty benchmark leaves all; empty tables give no rows.
    """
    digest = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    found = decontamination.decontaminate(docs.select(digest.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    leaks = stored(found.select(F.col("doc_id").alias("_leak")).distinct())
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), digest.alias("_digest"))
    return marked.join(leaks, F.col("_digest") == F.col("_leak"), "left_anti").select("_row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in place of personal data; n_chars follows the new text.

    Null texts stay null, with a null n_chars, and empty ones empty; repeated rows get equal texts. Empty tables give
    no rows.
    """
    out = pii.pseudonymised(docs, KEY, only_text=True)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their rate and number of copies; those drawn no copy go.

    Null and empty texts have rates too; repeated rows, and all rows without a doc_id, round alike. Without labelled
    rows all rates are one. Empty tables give no rows.
    """
    return mixing.mixed(docs, mixing.domain_of(table(spark, sf_dir, "labels")))


STAGES = [
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("personal data", personal_data),
    ("source mixing", source_mixing),
]

#: No stage can be written in SQL: they train models, walk strings and settle surrogates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
