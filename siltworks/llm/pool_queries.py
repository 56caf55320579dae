"""Queries of problems 4, 5 and 6."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm.bagminhash import NearDuplicates, conversation_text
from siltworks.llm.calibrated import CalibratedSample
from siltworks.llm.langid import document_languages, fit_languages
from siltworks.llm.mixing import SourceMix
from siltworks.session import table


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = [table(spark, sf_dir, t).select(F.lit(t).alias("src"), F.col("row_id").alias("id"), conversation_text().alias("text")) for t in ("sft_train", "scored_pool")]
    return each[0].unionByName(each[1])


def _near(spark: SparkSession, sf_dir: str, weighted: bool) -> NearDuplicates:
    return NearDuplicates(_conversations(spark, sf_dir), threshold=0.6, shingle=3, weighted=weighted)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # sets of word sequences, as TESTDATA.md defines the similarity of p5_found
    return _near(spark, sf_dir, False).pairs().select(F.col("src").alias("src_table"), "id_a", "id_b")


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    # multisets: a sequence counts as often as it stands in a conversation
    return _near(spark, sf_dir, True).groups().select(F.col("src").alias("src_table"), F.col("id").alias("row_id"), "group_id", "links")


def plain_source(column: str = "source") -> Column:
    """One spelling for sources that differ in case, blanks at the ends or `_` for `-`."""
    return F.regexp_replace(F.lower(F.trim(column)), "_", "-")


def _calibrated(spark: SparkSession, sf_dir: str) -> CalibratedSample:
    rows = table(spark, sf_dir, "scored_pool").select("row_id", plain_source().alias("source"), "pass_count")
    targets = table(spark, sf_dir, "tier_targets").select(plain_source().alias("source"), "pass_count", "target_share", "min_rows")
    return CalibratedSample(rows, targets, ["source", "pass_count"], "row_id", fraction=0.2)


def p4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrated(spark, sf_dir).sample()


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrated(spark, sf_dir).report()


def _mixed(spark: SparkSession, sf_dir: str) -> SourceMix:
    pool = table(spark, sf_dir, "scored_pool")
    said = pool.select("row_id", conversation_text().alias("text"), F.lit(None).cast("string").alias("lang"))
    language = document_languages(said, fit_languages(table(spark, sf_dir, "documents")), key="row_id").select("row_id", F.col("lang").alias("language"))
    text = F.aggregate(F.filter("messages", lambda m: ~F.coalesce(m["role"] == "system", F.lit(False))), F.lit(0), lambda n, m: n + F.coalesce(F.length(m["content"]), F.lit(0)))
    rows = pool.select("row_id", plain_source().alias("source"), F.coalesce("question_chars", text).alias("chars"), F.col("pass_count").alias("topic")).join(language, "row_id", "left")
    weights = table(spark, sf_dir, "mix_weights").select(plain_source().alias("source"), "target_weight", "max_repeats")
    return SourceMix(rows, weights, "row_id", "source", "chars", ["language", "topic"])


def p6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).mix().select("row_id", "source", "chars", "language", "topic", "repeats")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).report()


QUERIES = (p4_sample, p4_report, p5_found, p5_groups, p6_mix, p6_report)
