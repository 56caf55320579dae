"""Queries of the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm import pool_queries
from siltworks.session import table


#: Providers that stop at the closing submit tag, as TESTDATA.md says.
TAGLESS = ("skygate",)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltworks.llm.truncation import cut_outputs

    found = cut_outputs(*(table(spark, sf_dir, t) for t in ("turns", "traces", "generations")), tagless=TAGLESS)
    return found.where("cut").select(F.col("src").alias("src_table"), F.col("id").alias("record_id"))


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltworks.llm.truncation import cut_rates

    return cut_rates(*(table(spark, sf_dir, t) for t in ("turns", "traces", "generations")), tagless=TAGLESS)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltworks.llm.langid import fit_languages
    from siltworks.llm.pairs import defective_answers, stored_pairs

    pairs = stored_pairs(*(table(spark, sf_dir, t) for t in ("sft_train", "eval_samples", "func_tasks")))
    found = defective_answers(pairs, fit_languages(table(spark, sf_dir, "documents")))
    return found.select(F.col("src").alias("src_table"), F.col("id").alias("record_id"), "field", "defect")


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltworks.llm.langid import fit_languages
    from siltworks.llm.pairs import defect_rates, defective_answers, stored_pairs

    pairs = stored_pairs(*(table(spark, sf_dir, t) for t in ("sft_train", "eval_samples", "func_tasks")))
    return defect_rates(pairs, defective_answers(pairs, fit_languages(table(spark, sf_dir, "documents"))))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltworks.llm.syntax import check_syntax, stored_files

    files = stored_files(table(spark, sf_dir, "turns"), table(spark, sf_dir, "code_instruct"))
    return check_syntax(files).where("not valid").select(F.col("src").alias("src_table"), F.col("id").alias("record_id")).distinct()


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltworks.llm.syntax import invalid_rates

    return invalid_rates(*(table(spark, sf_dir, t) for t in ("turns", "traces", "code_instruct")))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltworks.llm.encode import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltworks.llm.leaks import leaked_documents

    return leaked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_questions"))


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltworks.llm.leaks import leak_spans

    return leak_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_questions"))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltworks.llm.leaks import leaked_items

    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_questions"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltworks.llm.langid import fit_languages, unnamed_languages

    docs = table(spark, sf_dir, "documents")
    return unnamed_languages(docs, fit_languages(docs))


def p9_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltworks.llm.langid import document_languages, fit_languages

    docs = table(spark, sf_dir, "documents")
    return document_languages(docs, fit_languages(docs))


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltworks.llm.langid import fit_languages, language_segments

    docs = table(spark, sf_dir, "documents")
    return language_segments(docs, fit_languages(docs)).select("doc_id", "segment", "start", "end", "lang", F.round("confidence", 6).alias("confidence"), "prose")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p1_found, p1_rates, p2_found, p2_rates, p3_found, p3_rates, p7_ids, p8_found, p8_spans, p8_items, p9_found, p9_documents, p9_segments)
    return {f.__name__: f for f in own + pool_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {}
