"""Multi-turn traces: assembling, final status, prefixes, slices, tagged text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.functions.text import estimated_tokens, middle_cut, parsed_submission, recovered_submission, submit_summary
from siltworks.operators.dedup import keep_last

CODING_ERRORS = ("wrong_answer", "runtime_error", "syntax_error")
_TURN = ["turn_index", "raw_output", "parsed_think", "parsed_submit", "parse_status", "obs_for_model", "obs_full", "finish_reason", "recovery_used"]


def assembled(traces: DataFrame, turns: DataFrame) -> DataFrame:
    """One row a run with its turns in order; deliveries of the same turn count once, the latest of them."""
    once = turns.groupBy("run_id", "turn_index").agg(F.max_by(F.struct(*_TURN), "logged_at").alias("turn"))
    listed = once.groupBy("run_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))  # a run has a handful of turns
    newest = F.col("created_at") if "created_at" in traces.columns else F.lit(0)
    return keep_last(traces, ["run_id"], newest).select(*traces.columns).join(listed, "run_id", "left").withColumn("turns", F.coalesce("turns", F.array().cast(listed.schema["turns"].dataType)))


def turn_status(turn: Column) -> Column:
    """Status of a turn: a turn without a submission failed; a missing status counts as failed."""
    stored = F.coalesce(F.nullif(F.get_json_object(turn["obs_full"], "$.status"), F.lit("")), F.lit("fail"))
    return F.when(F.coalesce(turn["parsed_submit"], F.lit("")) == "", "fail").otherwise(stored)


def turn_error(turn: Column) -> Column:
    return F.when(F.coalesce(turn["parsed_submit"], F.lit("")) == "", "format_error").otherwise(F.get_json_object(turn["obs_full"], "$.error_type"))


def final_status(turns: Column) -> Column:
    """`pass` if the last turn passed, `fail` if it did not, `running` without a turn."""
    last = F.get_json_object(F.try_element_at(turns, F.lit(-1))["obs_full"], "$.status")
    return F.when(F.size(turns) <= 0, "running").when(last == "pass", "pass").otherwise("fail")


def clean_failure(turn: Column) -> Column:
    return F.coalesce((turn["parse_status"] == "ok") & (turn["parsed_submit"] != "") & (F.coalesce(turn["finish_reason"], F.lit("")) != "length") & ~F.coalesce(turn["recovery_used"], F.lit(False)) & turn_error(turn).isin(*CODING_ERRORS), F.lit(False))


def prefix_choice(turns: Column, low: int = 2, high: int = 3, clean_only: bool = True) -> Column:
    """struct(outcome, keep): whether a run's leading failures make a repair prefix, and of how many turns."""
    failed = F.filter(turns, lambda t: turn_status(t) == "fail")
    n = F.size(failed)
    leading = F.forall(F.slice(turns, 1, F.greatest(n, F.lit(0))), lambda t: turn_status(t) == "fail")
    outcome = F.when(~leading | (n < low), "skipped_pass_or_too_few_failures").when(n > high, "skipped_too_many_failures")
    if clean_only:
        outcome = outcome.when(~F.forall(failed, clean_failure), "skipped_unclean")
    return F.struct(outcome.otherwise("selected").alias("outcome"), F.greatest(F.lit(1), n - 1).alias("keep"))


def sliced(turns: Column, keep: Column) -> Column:
    """The first turns with refreshed observations: their status and error as they are judged now."""

    def refreshed(t: Column) -> Column:
        kept = F.coalesce(F.from_json(t["obs_full"], "map<string,string>"), F.create_map().cast("map<string,string>"))
        rest = F.map_filter(kept, lambda k, _: ~k.isin("status", "error_type"))
        now = F.map_concat(rest, F.create_map(F.lit("status"), turn_status(t), F.lit("error_type"), turn_error(t)))
        return t.withField("obs_full", F.to_json(now))

    return F.transform(F.slice(turns, 1, keep), refreshed)


def _tag(name: str, text: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), text, F.lit(f"</{name}>"))


def tagged_text(prompt: Column, turns: Column) -> Column:
    """Prompt, thoughts, submissions and observations in tags, a line each; empty parts are left out."""
    some = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", _tag(name, c))
    parts = F.flatten(F.transform(turns, lambda t: F.array(some("think", t["parsed_think"]), some("submit", t["parsed_submit"]), some("obs", t["obs_for_model"]))))
    return F.array_join(F.concat(F.array(_tag("input", F.coalesce(prompt, F.lit("")))), F.array_compact(parts)), "\n")


def compact_text(prompt: Column, turns: Column) -> Column:
    """All turns but the last as summaries."""
    empty = F.lit("")
    n = F.size(turns)
    early = F.flatten(
        F.transform(
            F.slice(turns, 1, F.greatest(n - 1, F.lit(0))),
            lambda t: F.array(
                F.concat(F.lit('<submit_summary turn="'), t["turn_index"].cast("string"), F.lit('">'), submit_summary(F.coalesce(t["parsed_submit"], empty)), F.lit("</submit_summary>")),
                F.concat(F.lit('<obs_summary turn="'), t["turn_index"].cast("string"), F.lit('">'), F.coalesce(t["obs_for_model"], empty), F.lit("</obs_summary>")),
            ),
        )
    )
    last = F.try_element_at(turns, F.lit(-1))
    final = F.when(n > 0, F.array(F.when(F.coalesce(last["parsed_think"], empty) != "", _tag("think", last["parsed_think"])), _tag("submit", F.coalesce(last["parsed_submit"], empty)), _tag("obs", F.coalesce(last["obs_for_model"], empty))))
    return F.array_join(F.array_compact(F.concat(F.array(_tag("input", F.coalesce(prompt, empty))), early, F.coalesce(final, F.array().cast("array<string>")))), "\n")


def budgeted_text(prompt: Column, turns: Column, budget_tokens: int = 3000) -> Column:
    """The full text if it fits the budget, else the compact one, else that cut in its middle."""
    full, compact = tagged_text(prompt, turns), compact_text(prompt, turns)
    return F.when(estimated_tokens(full) <= budget_tokens, full).when(estimated_tokens(compact) <= budget_tokens, compact).otherwise(middle_cut(compact, budget_tokens))


def repaired_at(turns: DataFrame, ks: list[int]) -> DataFrame:
    """(k, passed, tasks, rate): tasks with a pass among the first k turns of any run, for several k from one pass."""
    ok = F.get_json_object("obs_full", "$.status") == "pass"
    per = turns.groupBy("task_id").agg(*(F.max(F.coalesce((F.col("turn_index") < k) & ok, F.lit(False))).alias(f"p{k}") for k in ks))
    counts = per.agg(F.count("*").alias("tasks"), *(F.count_if(f"p{k}").alias(f"p{k}") for k in ks))
    rows = counts.select("tasks", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"p{k}").alias("passed")) for k in ks))).alias("r"))
    return rows.select("r.k", "r.passed", "tasks", F.try_divide("r.passed", "tasks").alias("rate"))


def repaired_within(turns: DataFrame, k: int, tasks: DataFrame | None = None) -> DataFrame:
    """(passed, tasks, rate): tasks with a pass among the first k turns of any run; tasks without runs count as failed."""
    status = F.get_json_object("obs_full", "$.status")
    per = turns.where(F.col("turn_index") < k).groupBy("task_id").agg(F.max(F.coalesce(status == "pass", F.lit(False))).alias("passed"))
    every = tasks.select("task_id").distinct() if tasks is not None else turns.select("task_id").distinct()
    joined = every.join(per, "task_id", "left").withColumn("passed", F.coalesce("passed", F.lit(False)))
    return joined.agg(F.count_if("passed").alias("passed"), F.count("*").alias("tasks"), F.avg(F.col("passed").cast("double")).alias("rate"))


def needs_recovery(turn: Column) -> Column:
    """A turn that ran out of length before its submission: its recovery output counts instead."""
    error = parsed_submission(turn["raw_output"])["error_type"]
    return F.coalesce((turn["finish_reason"] == "length") & error.isin("missing_submit", "incomplete_output"), F.lit(False))


def replayed(turns: DataFrame) -> DataFrame:
    """Recorded turns parsed again: (run_id, turn_index, recovered, submit, status, error_type), recoveries included.

    A run ends with the first turn whose recovery holds no submission either: recorded turns after it are left out.
    """
    turn = F.struct("raw_output", "finish_reason")
    again = needs_recovery(turn) & (F.coalesce("recovery_raw_output", F.lit("")) != "")
    parsed = F.when(again, recovered_submission("recovery_raw_output")).otherwise(parsed_submission(F.coalesce("raw_output", F.lit(""))))
    p = turns.select("run_id", "turn_index", again.alias("recovered"), parsed.alias("p")).distinct()
    ended = F.col("recovered") & F.col("p.error_type").isin("missing_submit", "incomplete_output")
    stop = F.min(F.when(ended, F.col("turn_index"))).over(Window.partitionBy("run_id"))  # a run has a handful of turns
    kept = p.withColumn("stop", stop).where(F.col("stop").isNull() | (F.col("turn_index") <= F.col("stop")))
    return kept.select("run_id", "turn_index", "recovered", "p.submit", "p.status", "p.error_type")
