"""Rollouts scored against their tests, turns judged again, rewards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions import code as C
from siltworks.functions.text import lenient_code, standard_format
from siltworks.session import materialise


def _spread(programs: DataFrame) -> DataFrame:
    """Programs over four tasks for every core: a stated number, which adaptive execution does not merge because the rows are small."""
    return programs.repartition(4 * programs.sparkSession.sparkContext.defaultParallelism, "task_id", "program")


def score_rollouts(rollouts: DataFrame, tests: DataFrame) -> DataFrame:
    """rollouts (task_id, rollout, completion), tests (task_id, tests) -> (task_id, rollout, passed, status, output_chars, code_chars, elapsed).

    Equal programs of a task run once; a task of a thousand rollouts is spread over all workers, as work is cut by program, not by task.
    Status: no_code, pass or fail. Rollouts of unknown tasks have no tests and fail.
    """
    work = rollouts.withColumn("code", lenient_code("completion")).withColumn("program", F.md5(F.coalesce("code", F.lit(""))))
    programs = work.where("code is not null").groupBy("task_id", "program").agg(F.first("code").alias("code")).join(tests.select("task_id", "tests"), "task_id", "left")
    ran = _spread(programs).select("task_id", "program", C.timed_run("code", "tests").alias("r"))
    ran = materialise(ran.select("task_id", "program", "r.passed", "r.elapsed"), "ran")
    joined = work.join(ran, ["task_id", "program"], "left")
    status = F.when(F.col("code").isNull(), "no_code").when(F.col("passed"), "pass").otherwise("fail")
    return joined.select("task_id", "rollout", F.coalesce("passed", F.lit(False)).alias("passed"), status.alias("status"), F.length("completion").alias("output_chars"), F.coalesce(F.length("code"), F.lit(0)).alias("code_chars"), F.coalesce("elapsed", F.lit(0.0)).alias("elapsed"))


def rollout_summary(scored: DataFrame) -> DataFrame:
    """(task_id, n_samples, pass_count, pass_rate, passed_indices, slowest) of scored rollouts (task_id, rollout, passed, elapsed)."""
    passed = F.array_sort(F.collect_list(F.when(F.col("passed"), F.col("rollout"))))  # the passes of one task
    return scored.groupBy("task_id").agg(F.count("*").alias("n_samples"), F.count_if("passed").alias("pass_count"), F.avg(F.col("passed").cast("double")).alias("pass_rate"), passed.alias("passed_indices"), F.max("elapsed").alias("slowest"))


def execution_reward(passed: Column) -> Column:
    return F.when(F.coalesce(passed, F.lit(False)), 1.0).otherwise(0.0)


def format_reward(completion: Column) -> Column:
    """0.5 for a thought and a Python fence, 0.3 for the fence alone."""
    fence = completion.contains("```python")
    return F.when(fence & completion.contains("<think>") & completion.contains("</think>"), 0.5).when(fence, 0.3).otherwise(0.0)


def gated_reward(passed: Column, completion: Column) -> Column:
    """0 for what does not pass, 2 for what does, 2.5 if its format is the standard one too."""
    return F.when(~F.coalesce(passed, F.lit(False)), 0.0).when(standard_format(completion), 2.5).otherwise(2.0)


def rejudged(turns: DataFrame, tests: DataFrame) -> DataFrame:
    """Turns (run_id, turn_index, task_id, parsed_submit) judged again by the tests of their tasks: adds status and error_type.

    Equal submissions to a task are judged once; a turn without a submission failed with a format error, one of a task without tests keeps
    no verdict. A submission that passes all tests passes, else its first failure names the error.
    """
    some = F.coalesce(F.col("parsed_submit"), F.lit("")) != ""
    marked = turns.withColumn("program", F.md5("parsed_submit"))
    programs = marked.where(some).groupBy("task_id", "program").agg(F.first("parsed_submit").alias("code")).join(tests.select("task_id", "tests").where(F.size("tests") > 0), "task_id")
    verdicts = _spread(programs).select("task_id", "program", C.function_verdict("code", "tests").alias("v"))
    verdicts = materialise(verdicts.select("task_id", "program", F.col("v.status").alias("again"), F.col("v.error_type").alias("error")), "verdicts")
    joined = marked.join(verdicts, ["task_id", "program"], "left").drop("program")
    return joined.withColumns({"status": F.when(some, F.col("again")).otherwise("fail"), "error_type": F.when(some, F.col("error")).otherwise("format_error")}).drop("again", "error")


def audited(solutions: DataFrame, tasks: DataFrame, feedback: str = "public") -> DataFrame:
    """solutions (key, task_id, code) against the reference solutions of their tasks: (key, status, error_type, base_status, plus_status, base_passed, plus_passed).

    tasks: task_id, canonical_solution, entry_point, base_input, plus_input (JSON lists). A task needs the first two and some input. The
    visible status is that of the base inputs, of all inputs if the feedback is `oracle` or `hidden`. Equal programs of a task run once.
    """
    ready = tasks.where((F.coalesce("canonical_solution", F.lit("")) != "") & (F.coalesce("entry_point", F.lit("")) != "") & (F.length(F.concat_ws("", "base_input", "plus_input")) > 0))
    marked = solutions.where(F.coalesce("code", F.lit("")) != "").withColumn("program", F.md5("code"))
    programs = marked.groupBy("task_id", "program").agg(F.first("code").alias("code")).join(ready.select("task_id", "canonical_solution", "entry_point", "base_input", "plus_input"), "task_id")
    ran = _spread(programs).select("task_id", "program", C.audited("code", "canonical_solution", "entry_point", "base_input", "plus_input").alias("v"))
    ran = materialise(ran, "audited")
    shown = F.col("v.plus" if feedback in ("oracle", "hidden") else "v.base")
    joined = marked.join(ran, ["task_id", "program"])
    return joined.select("key", shown["status"].alias("status"), shown["error_type"].alias("error_type"), F.col("v.base.status").alias("base_status"), F.col("v.plus.status").alias("plus_status"), F.col("v.base.passed").alias("base_passed"), F.col("v.plus.passed").alias("plus_passed"))
