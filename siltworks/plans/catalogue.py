"""All queries outside the llm subpackage, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltworks.functions.text import fingerprint
from siltworks.plans import pipelines
from siltworks.plans import queries as inventory
from siltworks.session import table


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "eval_questions").where("question_content is not null").select(fingerprint("question_content").alias("fp"))
    return pipelines.curated(table(spark, sf_dir, "documents"), known, 100)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return inventory.QUERIES | {"pipeline_curated": flagship}


_FLAGSHIP = f"""WITH d AS (SELECT doc_id, source, text, coalesce(nullif(trim(lang), ''), '__missing__') || '|' || coalesce(nullif(trim(kind), ''), '__missing__') AS stratum FROM documents),
f AS (SELECT doc_id, source, stratum, {inventory.fp('text')} AS fp FROM d WHERE length(text) BETWEEN 200 AND 12000),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY doc_id) AS n FROM f) WHERE n = 1 AND fp NOT IN (SELECT {inventory.fp('question_content')} FROM eval_questions WHERE question_content IS NOT NULL)),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) - 1 AS k, count(*) OVER (PARTITION BY stratum) AS size, count(*) OVER () AS total FROM o), g AS (SELECT count(DISTINCT stratum) AS groups FROM o)
SELECT doc_id, source, stratum, fp FROM r, g ORDER BY CASE WHEN k = 0 AND groups <= 100 THEN 1 ELSE 0 END DESC, size / total * 100 - k DESC, size - k DESC, stratum DESC LIMIT 100"""


def oracle_sql() -> dict[str, str]:
    return inventory.SQL | {"pipeline_curated": _FLAGSHIP}
