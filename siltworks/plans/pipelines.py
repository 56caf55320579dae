"""Pipelines made of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.functions import arrays as A
from siltworks.functions import text as X
from siltworks.operators import dedup as D
from siltworks.operators import sampling as S
from siltworks.operators.filters import Rule, apply_rules
from siltworks.session import materialise


def instruction_mix(rows: DataFrame, question: str, answer: str, key: str, target: int, longest: int = 12_000, shortest: int = 50, seed: int = 42) -> DataFrame:
    """Question and answer rows to chats: both filled, within lengths, exact copies of the question once, an exact sample."""
    q, a = F.length(question), F.length(answer)
    kept = rows.where((q > 0) & (a >= shortest) & (q + a <= longest))
    once = D.keep_first(kept, [question], [key])
    return S.sample_rows(once, target, key, seed).select(key, A.chat(("user", F.col(question)), ("assistant", F.col(answer))).alias("messages"))


def candidate_pool(first: DataFrame, second: DataFrame, known: DataFrame, first_target: int, second_target: int | None = None, min_tests: int = 2, longest: int = 16_000, seed: int = 42) -> DataFrame:
    """Two sources (uid, source, question, tests) to a pool: filters, decontamination, dedup, sample, the second without the first.

    known: (fp) of evaluation and earlier training questions.
    """

    def cleaned(df: DataFrame, target: int | None) -> DataFrame:
        t = df.withColumn("tests", A.visible_tests("tests")).withColumn("question", X.truthy_strip("question"))
        t = t.where((F.col("question") != "") & (F.length("question") <= longest) & (F.size("tests") >= min_tests)).withColumn("fp", X.fingerprint("question"))
        t = D.keep_first(D.remove_known(t, known, ["fp"]), ["fp"], ["uid"])
        return S.sample_rows(t, target, "uid", seed) if target else t

    a = cleaned(first, first_target)
    b = D.remove_known(cleaned(second, second_target), a, ["fp"])
    both = a.unionByName(b)
    return both.select("uid", "source", A.chat(("user", F.col("question"))).alias("messages"), "tests", F.size("tests").alias("num_tests"), F.length("question").alias("question_chars"), F.col("fp").alias("fingerprint"))


def curated(docs: DataFrame, known: DataFrame, target: int, seed: int = 42) -> DataFrame:
    """The flagship: length rules, fingerprint dedup, decontamination, a stratified sample by language and kind."""
    rules = [Rule("no_text", F.coalesce(F.length("text") == 0, F.lit(True))), Rule("short", F.length("text") < 200), Rule("long", F.length("text") > 12_000)]
    marked, _ = S.strata(docs, ["lang", "kind"])
    kept = apply_rules(marked, rules).where("charged_to = 'kept'").select("doc_id", "source", "stratum", X.fingerprint("text").alias("fp"))
    once = materialise(D.remove_known(D.keep_first(kept, ["fp"], ["doc_id"]), known, ["fp"]), "once")  # counted and ranked
    return S.greedy_stratified(once, "stratum", target, "doc_id", seed).select("doc_id", "source", "stratum", "fp")
