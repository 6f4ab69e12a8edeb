"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, license_scan, manifest, mixing, packing, pii, quality_lm, quality_rules, simhash, spelling, suffix_dedup, toxicity, url_filters
from .common import table

#: The key of the surrogates; a production job passes its own secret.
KEY = b"gradecube demonstration key"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, within=2)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"), size=200)
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return out.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


def op6_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.quality_lm(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing(table(spark, sf_dir, "documents"), mixing.domain_of(table(spark, sf_dir, "labels")), mixing.TARGETS)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_filter(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymised(table(spark, sf_dir, "documents"), KEY)
    return out.select("doc_id", "text", F.size("entities").alias("n_replaced"), "entities")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), slip_every=199)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.op13_rows(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_toxicity, op3_simhash, op4_decontamination, op5_suffix_dedup, op6_quality_lm, op7_quality_rules, op8_mixing, op9_url_filters, op10_pii, op11_spelling, op12_packing, op13_manifest)}
ORACLE_SQL = {"op1_license_scan": license_scan.ORACLE, "op7_quality_rules": quality_rules.ORACLE, "op9_url_filters": url_filters.ORACLE, "op11_spelling": spelling.ORACLE, "op13_manifest": manifest.ORACLE}
