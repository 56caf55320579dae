"""One query for each operator of the inventory, with SQL of the same columns where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltworks.functions import arrays as A
from siltworks.functions import text as X
from siltworks.operators import dedup as D
from siltworks.operators import reports as R
from siltworks.operators import rollouts as RO
from siltworks.operators import sampling as S
from siltworks.operators import tasks as TK
from siltworks.operators import traces as TR
from siltworks.operators.filters import Rule, apply_rules, first_failure, in_half_open, length_window, score_at_least
from siltworks.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# pieces of SQL that several queries share
EDGE = r"'^[\t-\r \x1c-\x1f\x{85}\p{Z}]+|[\t-\r \x1c-\x1f\x{85}\p{Z}]+$'"
NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def norm(c: str) -> str:
    return NORM.format(c)


def fp(c: str) -> str:
    return f"md5(substring({norm(c)}, 1, 200))"


def strip(c: str) -> str:
    return f"regexp_replace({c}, {EDGE}, '', 'g')"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- deduplication ------------------------------------------------------------------------------------------------


@query("dup1_exact_text", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY text ORDER BY doc_id) r FROM documents) WHERE r = 1")
def dup1(spark, d):
    return D.keep_first(table(spark, d, "documents").select("doc_id", "source", "text"), ["text"], ["doc_id"]).select("doc_id", "source")


@query("dup2_fingerprint", f"SELECT doc_id, lang, source, fp FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY doc_id) r FROM (SELECT doc_id, lang, source, {fp('text')} fp FROM documents WHERE text IS NOT NULL)) WHERE r = 1")
def dup2(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "lang", "source", X.fingerprint("text").alias("fp"))
    return D.keep_first(docs, ["fp"], ["doc_id"])


@query("dup4_last_write", "SELECT run_id, turn_index, arg_max(parse_status, logged_at) AS parse_status, arg_max(length(raw_output), logged_at) AS chars FROM (SELECT run_id, turn_index, parse_status, coalesce(raw_output, '') AS raw_output, logged_at FROM turns) GROUP BY ALL")
def dup4(spark, d):
    log = table(spark, d, "turns").select("run_id", "turn_index", "parse_status", F.length(F.coalesce("raw_output", F.lit(""))).cast("long").alias("chars"), "logged_at")
    return D.keep_last(log, ["run_id", "turn_index"], "logged_at").select("run_id", "turn_index", "parse_status", "chars")


@query("dup5_repeated_keys", "SELECT gen_id, count(*) AS rows FROM generations GROUP BY gen_id HAVING count(*) > 1")
def dup5(spark, d):
    return D.repeated_keys(table(spark, d, "generations"), ["gen_id"])


@query("set1_distinct_union", f"SELECT DISTINCT fp FROM (SELECT {fp('prompt')} fp FROM func_tasks WHERE prompt IS NOT NULL UNION ALL SELECT {fp('question_content')} FROM eval_questions WHERE question_content IS NOT NULL)")
def set1(spark, d):
    a = table(spark, d, "func_tasks").where("prompt is not null").select(X.fingerprint("prompt").alias("fp"))
    return a.union(table(spark, d, "eval_questions").where("question_content is not null").select(X.fingerprint("question_content"))).distinct()


@query("set2_bag_union", "SELECT 'problem' AS origin, source, count(*) AS n FROM documents WHERE kind = 'problem' GROUP BY ALL UNION ALL SELECT 'pool', source, count(*) FROM scored_pool GROUP BY ALL")
def set2(spark, d):
    a = table(spark, d, "documents").where("kind = 'problem'").select(F.lit("problem").alias("origin"), "source")
    b = table(spark, d, "scored_pool").select(F.lit("pool").alias("origin"), "source")
    return a.unionByName(b).groupBy("origin", "source").agg(F.count("*").alias("n"))


@query("set3_missing_ids", "SELECT DISTINCT task_id FROM eval_samples WHERE task_id NOT IN (SELECT task_id FROM generations WHERE task_id IS NOT NULL) AND task_id IS NOT NULL")
def set3(spark, d):
    return D.missing_keys(table(spark, d, "eval_samples").where("task_id is not null"), table(spark, d, "generations"), "task_id")


@query("set4_distinct_keys", "SELECT DISTINCT source || ':' || question_id AS uid FROM scored_pool WHERE pass_count BETWEEN 1 AND 2 AND n_samples = 8 AND source IS NOT NULL AND question_id IS NOT NULL")
def set4(spark, d):
    return table(spark, d, "scored_pool").where("pass_count between 1 and 2 and n_samples = 8 and source is not null and question_id is not null").select(F.concat("source", F.lit(":"), "question_id").alias("uid")).distinct()


_FIRST_USER = "list_extract(list_filter(messages, lambda m: m.role = 'user' AND m.content IS NOT NULL AND regexp_replace(m.content, " + EDGE + ", '', 'g') <> ''), 1).content"


@query("set5_prior_questions", f"SELECT DISTINCT {fp('q')} AS fp FROM (SELECT {_FIRST_USER} q FROM sft_train) WHERE q IS NOT NULL")
def set5(spark, d):
    return table(spark, d, "sft_train").select(A.first_content("messages", "user").alias("q")).where("q is not null").select(X.fingerprint("q").alias("fp")).distinct()


# --- joins --------------------------------------------------------------------------------------------------------


@query("join1_decontaminate", f"SELECT row_id FROM (SELECT row_id, {fp(_FIRST_USER)} fp FROM scored_pool) WHERE fp IS NULL OR fp NOT IN (SELECT {fp('q')} FROM (SELECT {_FIRST_USER} q FROM sft_train) WHERE q IS NOT NULL)")
def join1(spark, d):
    rows = table(spark, d, "scored_pool").select("row_id", X.fingerprint(A.first_content("messages", "user")).alias("fp"))
    return D.remove_known(rows, set5(spark, d), ["fp"]).select("row_id")


@query(
    "join2_cross_source",
    f"""WITH f AS (SELECT doc_id, source, kind, {fp('text')} fp FROM documents WHERE text IS NOT NULL), a AS (SELECT * FROM f WHERE kind = 'problem' ORDER BY md5('42:' || doc_id::VARCHAR), doc_id LIMIT 200)
SELECT doc_id, fp FROM f WHERE kind = 'solution' AND fp NOT IN (SELECT fp FROM a)""",
)
def join2(spark, d):
    f = table(spark, d, "documents").where("text is not null").select("doc_id", "kind", X.fingerprint("text").alias("fp"))
    a = S.sample_rows(f.where("kind = 'problem'"), 200, "doc_id")
    return D.remove_known(f.where("kind = 'solution'"), a, ["fp"]).select("doc_id", "fp")


@query("join3_resume", "SELECT DISTINCT t.run_id FROM traces t WHERE t.run_id NOT IN (SELECT run_id FROM turns WHERE parse_status = 'ok' AND turn_index = 0)")
def join3(spark, d):
    done = table(spark, d, "turns").where("parse_status = 'ok' and turn_index = 0")
    return D.remove_known(table(spark, d, "traces").select("run_id").distinct(), done, ["run_id"])


@query("join4_semi_subset", "SELECT sample_id, task_id FROM eval_samples WHERE task_id IN (SELECT task_id FROM func_tasks WHERE canonical_solution IS NOT NULL AND canonical_solution <> '')")
def join4(spark, d):
    wanted = table(spark, d, "func_tasks").where("canonical_solution is not null and canonical_solution <> ''")
    return D.keep_known(table(spark, d, "eval_samples"), wanted, ["task_id"]).select("sample_id", "task_id")


@query("join5_ordered_subset", "WITH ids AS (SELECT question_id, (row_number() OVER (ORDER BY md5('7:' || question_id)) - 1)::INT AS place FROM eval_questions) SELECT q.question_id, q.platform, ids.place FROM eval_questions q JOIN ids USING (question_id)")
def join5(spark, d):
    q = table(spark, d, "eval_questions")
    ids = q.select("question_id", (F.row_number().over(Window.orderBy(S.draw(7, "question_id"))) - 1).alias("place"))
    return D.ordered_subset(q, ids, "question_id").select("question_id", "platform", "place")


@query("join6_last_output", "WITH o AS (SELECT task_id, arg_max(solution, sample_id) AS code, max(sample_id) AS sample_id, count(*) AS outputs FROM eval_samples WHERE task_id IS NOT NULL AND task_id IN (SELECT task_id FROM func_tasks) GROUP BY 1) SELECT task_id, prompt, o.sample_id, o.outputs FROM o JOIN func_tasks t USING (task_id)")
def join6(spark, d):
    tasks = table(spark, d, "func_tasks").select("task_id", "prompt")
    samples = D.keep_known(table(spark, d, "eval_samples").where("task_id is not null"), tasks, ["task_id"])
    last = samples.groupBy("task_id").agg(F.max("sample_id").alias("sample_id"), F.count("*").alias("outputs"))
    return D.inner_or_fail(last, tasks, "task_id").select("task_id", "prompt", "sample_id", "outputs")


@query("join7_positional_zip", "SELECT row_id, (i - 1)::INT AS place, tests[i] AS test, passed_indices[i]::INT AS passed_index FROM (SELECT row_id, tests, passed_indices, unnest(generate_series(1, greatest(coalesce(len(tests), 0), coalesce(len(passed_indices), 0)))) AS i FROM scored_pool)")
def join7(spark, d):
    rows = table(spark, d, "scored_pool").select("row_id", F.posexplode(F.arrays_zip(F.coalesce("tests", F.array().cast("array<string>")), F.coalesce("passed_indices", F.array().cast("array<int>")))).alias("place", "z"))
    return rows.select("row_id", "place", F.col("z")["0"].alias("test"), F.col("z")["1"].alias("passed_index"))


@query("join8_batch_alignment", "SELECT s.sample_id, t.task_id, (unnest(range(len(t.tests))))::INT AS place FROM (SELECT DISTINCT sample_id, task_id FROM eval_samples) s JOIN func_tasks t ON s.task_id = t.task_id WHERE t.tests IS NOT NULL")
def join8(spark, d):
    s = table(spark, d, "eval_samples").select("sample_id", "task_id").distinct()
    return s.join(table(spark, d, "func_tasks").select("task_id", "tests"), "task_id").select("sample_id", "task_id", F.posexplode("tests").alias("place", "t")).drop("t")


@query("join9_latest_status", "WITH l AS (SELECT task.task_id AS task_id, arg_max(final_status, (created_at, run_id)) AS final_status FROM traces WHERE final_status IN ('pass', 'fail') GROUP BY 1) SELECT f.task_id, l.final_status FROM func_tasks f JOIN l ON f.task_id = l.task_id")
def join9(spark, d):
    log = table(spark, d, "traces").where("final_status in ('pass', 'fail')").groupBy(F.col("task.task_id").alias("task_id")).agg(F.max_by("final_status", F.struct("created_at", "run_id")).alias("final_status"))
    return table(spark, d, "func_tasks").select("task_id").join(log, "task_id")


# --- filters ------------------------------------------------------------------------------------------------------

_SCORE = "CASE WHEN row_id % 7 = 0 THEN 'NaN' WHEN row_id % 11 = 0 THEN 'n/a' WHEN row_id % 13 = 0 THEN ' ' || pass_rate::VARCHAR || ' ' ELSE {} END"


@query(
    "flt1_2_score_nan",
    f"SELECT row_id, coalesce(CASE WHEN isnan(x) THEN FALSE ELSE x >= 0.5 END, FALSE) AS drops_nan, coalesce(CASE WHEN isnan(x) THEN TRUE ELSE x >= 0.5 END, FALSE) AS keeps_nan FROM (SELECT row_id, try_cast(trim({_SCORE.format('pass_rate::VARCHAR')}) AS DOUBLE) x FROM scored_pool)",
)
def flt1(spark, d):
    text = F.col("pass_rate").cast("string")
    score = F.when(F.col("row_id") % 7 == 0, "NaN").when(F.col("row_id") % 11 == 0, "n/a").when(F.col("row_id") % 13 == 0, F.concat(F.lit(" "), text, F.lit(" "))).otherwise(text)
    v = table(spark, d, "scored_pool").select("row_id", score.alias("s"))
    return v.select("row_id", score_at_least(F.col("s"), 0.5, False).alias("drops_nan"), score_at_least(F.col("s"), 0.5, True).alias("keeps_nan"))


@query("flt3_6_length_window", "SELECT row_id FROM code_instruct WHERE problem <> '' AND solution <> '' AND length(solution) >= 50 AND length(problem) + length(solution) <= 1200 AND length(problem) <= 16000")
def flt3(spark, d):
    return table(spark, d, "code_instruct").where(length_window(F.col("problem"), F.col("solution"), 50, 1200, 16_000)).select("row_id")


@query("flt7_language", "SELECT row_id, repo FROM code_instruct WHERE lower(lang) = 'python'")
def flt7(spark, d):
    return table(spark, d, "code_instruct").where(F.lower("lang") == "python").select("row_id", "repo")


@query("flt8_minimum_tests", f"SELECT row_id, len(list_filter(coalesce(tests, []), lambda t: coalesce({strip('t')}, '') <> ''))::INT AS n_tests FROM scored_pool WHERE len(list_filter(coalesce(tests, []), lambda t: coalesce({strip('t')}, '') <> '')) >= 2")
def flt8(spark, d):
    return table(spark, d, "scored_pool").select("row_id", F.size(A.visible_tests("tests")).alias("n_tests")).where("n_tests >= 2")


@query("flt9_11_token_rules", "SELECT row_id, total_tokens, thinking_tokens FROM sft_train WHERE total_tokens <= 8192 AND thinking_tokens >= 50")
def flt9(spark, d):
    return table(spark, d, "sft_train").where("total_tokens <= 8192 and thinking_tokens >= 50").select("row_id", "total_tokens", "thinking_tokens")


@query("flt10_12_think_and_fence", r"SELECT gen_id, max(CASE WHEN regexp_matches(text, '(?is)<think>.*?\S.*?</think>') THEN 1 ELSE 0 END) AS thinks, max(CASE WHEN regexp_matches(text, '(?i)```python\b') THEN 1 ELSE 0 END) AS fenced FROM generations WHERE text IS NOT NULL GROUP BY gen_id")
def flt10(spark, d):
    g = table(spark, d, "generations").where("text is not null")
    return g.groupBy("gen_id").agg(F.max(F.col("text").rlike(r"(?is)<think>.*?\S.*?</think>").cast("int")).alias("thinks"), F.max(F.col("text").rlike(r"(?i)```python\b").cast("int")).alias("fenced"))


@query(
    "flt13_ngram_loop",
    r"""WITH w AS (SELECT doc_id, word, (row_number() OVER (PARTITION BY doc_id ORDER BY i)) AS pos FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS words FROM documents WHERE text IS NOT NULL))),
s AS (SELECT a.doc_id, a.pos, a.pos - row_number() OVER (PARTITION BY a.doc_id ORDER BY a.pos) AS island FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.pos = a.pos + 4 AND a.word = b.word),
l AS (SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, island, count(*) AS n FROM s GROUP BY ALL) GROUP BY 1),
c AS (SELECT doc_id, count(*) AS words FROM w GROUP BY 1)
SELECT d.doc_id, (CASE WHEN coalesce(c.words, 0) < 4 THEN 0 ELSE 1 + coalesce(l.longest, 0) // 4 END)::INT AS repeats FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id) WHERE d.text IS NOT NULL""",
)
def flt13(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.ngram_repeats("text", 4).alias("repeats"))


def _rules() -> list[Rule]:
    return [
        Rule("no_text", F.coalesce(F.length("text") == 0, F.lit(True))),
        Rule("short", F.length("text") < 300),
        Rule("long", F.length("text") > 1600),
        Rule("unlabelled", F.coalesce(F.trim("lang") == "", F.lit(True))),
        Rule("old_revision", F.col("revision") > 2),
    ]


@query(
    "flt14_rule_accounting",
    "SELECT CASE WHEN coalesce(length(text) = 0, TRUE) THEN 'no_text' WHEN length(text) < 300 THEN 'short' WHEN length(text) > 1600 THEN 'long' WHEN coalesce(trim(lang) = '', TRUE) THEN 'unlabelled' WHEN revision > 2 THEN 'old_revision' ELSE 'kept' END AS rule, source, count(*) AS n FROM documents GROUP BY ALL",
)
def flt14(spark, d):
    return apply_rules(table(spark, d, "documents"), _rules(), "rule").groupBy("rule", "source").agg(F.count("*").alias("n"))


@query("flt15_rule_rate", "WITH c AS (SELECT count(*) FILTER (WHERE length(text) >= 300) AS reached, count(*) FILTER (WHERE length(text) > 1600) AS dropped FROM documents) SELECT reached, dropped, round(dropped / reached, 6) AS rate, dropped / reached >= 0.05 AS warns FROM c")
def flt15(spark, d):
    c = table(spark, d, "documents").agg(F.count_if(F.length("text") >= 300).alias("reached"), F.count_if(F.length("text") > 1600).alias("dropped"))
    return c.select("reached", "dropped", F.round(F.try_divide("dropped", "reached"), 6).alias("rate"), (F.try_divide("dropped", "reached") >= 0.05).alias("warns"))


@query("flt16_pass_counts", "SELECT row_id, pass_count FROM scored_pool WHERE pass_count IN (1, 2) AND n_samples = 8")
def flt16(spark, d):
    return table(spark, d, "scored_pool").where(F.col("pass_count").isin(1, 2) & (F.col("n_samples") == 8)).select("row_id", "pass_count")


@query("flt17_range_tiers", "SELECT row_id, CASE WHEN pass_rate >= 0.7 AND pass_rate < 0.876 THEN 'warmup' WHEN pass_rate >= 0.15 AND pass_rate < 0.7 THEN 'main' WHEN pass_rate >= 0.05 AND pass_rate < 0.15 THEN 'push' END AS tier FROM scored_pool WHERE pass_rate >= 0.05 AND pass_rate < 0.876")
def flt17(spark, d):
    p = F.col("pass_rate")
    tier = F.when(in_half_open(p, 0.7, 0.876), "warmup").when(in_half_open(p, 0.15, 0.7), "main").when(in_half_open(p, 0.05, 0.15), "push")
    return table(spark, d, "scored_pool").select("row_id", tier.alias("tier")).where("tier is not null")


@query("flt18_date_range", "SELECT question_id, platform FROM eval_questions WHERE try_cast(contest_date AS TIMESTAMP) >= TIMESTAMP '2025-03-01' AND try_cast(contest_date AS TIMESTAMP) <= TIMESTAMP '2025-06-30'")
def flt18(spark, d):
    at = F.col("contest_date").try_cast("timestamp_ntz")
    return table(spark, d, "eval_questions").where((at >= F.lit("2025-03-01").cast("timestamp_ntz")) & (at <= F.lit("2025-06-30").cast("timestamp_ntz"))).select("question_id", "platform")


@query("flt19_equality_with_nulls", "SELECT row_id FROM scored_pool WHERE coalesce(pass_rate >= 0.5, FALSE) AND lower(coalesce(source, '')) = 'kodgarden'")
def flt19(spark, d):
    return table(spark, d, "scored_pool").where(F.coalesce(F.col("pass_rate") >= 0.5, F.lit(False)) & (F.lower(F.coalesce("source", F.lit(""))) == "kodgarden")).select("row_id")


# the turns of each run once, with what failed, how many failures lead and whether all of them are clean
_TURNS_SQL = """WITH o AS (SELECT DISTINCT ON (run_id, turn_index) * FROM turns ORDER BY run_id, turn_index, logged_at DESC),
c AS (SELECT run_id, turn_index, CASE WHEN coalesce(parsed_submit, '') = '' THEN 'fail' ELSE coalesce(nullif(json_extract_string(obs_full, '$.status'), ''), 'fail') END AS status, CASE WHEN coalesce(parsed_submit, '') = '' THEN 'format_error' ELSE json_extract_string(obs_full, '$.error_type') END AS error, parse_status, parsed_submit, finish_reason, recovery_used FROM o),
r AS (SELECT run_id, count(*) FILTER (WHERE status = 'fail') AS fails, coalesce(min(CASE WHEN status <> 'fail' THEN nth END) - 1, count(*)) AS lead, bool_and(CASE WHEN status = 'fail' THEN coalesce(parse_status = 'ok' AND parsed_submit <> '' AND coalesce(finish_reason, '') <> 'length' AND NOT coalesce(recovery_used, FALSE) AND error IN ('wrong_answer', 'runtime_error', 'syntax_error'), FALSE) ELSE TRUE END) AS clean FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY turn_index) AS nth FROM c) GROUP BY 1)
"""

_CASES = "from_json({0}, '[{{\"input\":\"VARCHAR\",\"output\":\"VARCHAR\",\"testtype\":\"VARCHAR\"}}]')"


@query("flt20_case_kinds", f"SELECT question_id, len(c)::INT AS cases, len(list_filter(c, lambda x: lower(coalesce(nullif(x.testtype, ''), 'stdin')) IN ('stdin', 'stdio', 'standard_input')))::INT AS stdin_cases FROM (SELECT question_id, coalesce({_CASES.format('private_test_cases')}, []) c FROM eval_questions)")
def flt20(spark, d):
    q = table(spark, d, "eval_questions").select("question_id", A.cases("private_test_cases").alias("c"))
    return q.select("question_id", F.size("c").alias("cases"), F.size(A.stdin_cases(F.col("c"))).alias("stdin_cases"))


@query("flt21_exclusion_patterns", "SELECT row_id FROM scored_pool WHERE question_chars <= 900 AND len(tests) >= 2 AND lower(trim(source)) IN ('kodgarden', 'opentasks', 'codemint') AND pass_count BETWEEN 0 AND 4 AND NOT regexp_matches(lower(list_extract(list_filter(messages, lambda m: m.role = 'user'), 1).content), 'telescope|two teams|\\bkeeper of the (harbour|quarry)\\b')")
def flt21(spark, d):
    q = F.lower(F.try_element_at(F.filter("messages", lambda m: m["role"] == "user"), F.lit(1))["content"])
    return table(spark, d, "scored_pool").where((F.col("question_chars") <= 900) & (F.size("tests") >= 2) & F.lower(F.trim("source")).isin("kodgarden", "opentasks", "codemint") & F.col("pass_count").between(0, 4) & ~q.rlike(r"telescope|two teams|\bkeeper of the (harbour|quarry)\b")).select("row_id")


@query("flt22_passed_traces", "SELECT DISTINCT run_id, model FROM traces WHERE final_status = 'pass'")
def flt22(spark, d):
    return table(spark, d, "traces").where("final_status = 'pass'").select("run_id", "model").distinct()


# --- projections --------------------------------------------------------------------------------------------------


@query("prj1_chat_assembly", "SELECT row_id, to_json([{'role': 'user', 'content': problem}, {'role': 'assistant', 'content': solution}])::VARCHAR AS messages FROM code_instruct WHERE problem <> '' AND solution <> ''")
def prj1(spark, d):
    c = table(spark, d, "code_instruct").where("problem <> '' and solution <> ''")
    return c.select("row_id", F.to_json(A.chat(("user", F.col("problem")), ("assistant", F.col("solution")))).alias("messages"))


@query("prj3_pool_projection", f"SELECT row_id, source, question_id, coalesce(len(tests), 0)::INT AS num_tests, length(q)::INT AS question_chars, {fp('q')} AS fingerprint FROM (SELECT row_id, source, question_id, tests, {_FIRST_USER} AS q FROM scored_pool) WHERE q IS NOT NULL")
def prj3(spark, d):
    p = table(spark, d, "scored_pool").select("row_id", "source", "question_id", "tests", A.first_content("messages", "user").alias("q")).where("q is not null")
    return p.select("row_id", "source", "question_id", F.size(F.coalesce("tests", F.array().cast("array<string>"))).alias("num_tests"), F.length("q").alias("question_chars"), X.fingerprint("q").alias("fingerprint"))


@query("prj4_stable_uid", f"SELECT row_id, coalesce(nullif({strip('uid')}, ''), coalesce(source, 'unknown') || ':' || coalesce(question_id, fingerprint, 'unknown')) AS uid FROM scored_pool")
def prj4(spark, d):
    fallback = F.concat_ws(":", F.coalesce("source", F.lit("unknown")), F.coalesce("question_id", "fingerprint", F.lit("unknown")))
    return table(spark, d, "scored_pool").select("row_id", F.coalesce(F.nullif(X.strip("uid"), F.lit("")), fallback).alias("uid"))


@query("prj8_first_pair", f"SELECT row_id, {_FIRST_USER} AS question, {_FIRST_USER.replace(chr(39) + 'user' + chr(39), chr(39) + 'assistant' + chr(39))} AS answer FROM sft_train")
def prj8(spark, d):
    return table(spark, d, "sft_train").select("row_id", A.first_content("messages", "user").alias("question"), A.first_content("messages", "assistant").alias("answer"))


@query("prj9_metadata_candidates", "SELECT run_id, max(coalesce(nullif(task.language, ''), nullif(task.dataset, ''), 'unknown')) AS language, max(coalesce(json_extract_string(config, '$.feedback_mode'), json_extract_string(config, '$.mode'), 'none')) AS feedback FROM traces GROUP BY 1")
def prj9(spark, d):
    t = table(spark, d, "traces")
    language = F.coalesce(F.nullif(F.col("task.language"), F.lit("")), F.nullif(F.col("task.dataset"), F.lit("")), F.lit("unknown"))
    feedback = F.coalesce(F.get_json_object("config", "$.feedback_mode"), F.get_json_object("config", "$.mode"), F.lit("none"))
    return t.groupBy("run_id").agg(F.max(language).alias("language"), F.max(feedback).alias("feedback"))


@query("prj10_system_message", "SELECT row_id, len(m)::INT AS messages, m[1].role AS first_role, md5(list_aggregate(list_transform(m, lambda x: x.role || '=' || coalesce(x.content, '')), 'string_agg', '|')) AS digest FROM (SELECT row_id, CASE WHEN len(list_filter(messages, lambda x: x.role = 'system')) > 0 THEN list_transform(messages, lambda x: {'role': x.role, 'content': CASE WHEN x.role = 'system' THEN 'Write code.' ELSE x.content END}) ELSE list_concat([{'role': 'system', 'content': 'Write code.'}], messages) END AS m FROM sft_train WHERE messages IS NOT NULL AND len(list_filter(messages, lambda x: x.role = 'system')) <= 1)")
def prj10(spark, d):
    t = table(spark, d, "sft_train").where(F.size(F.filter("messages", lambda m: m["role"] == "system")) <= 1).where("messages is not null")
    t = t.select("row_id", A.with_system("messages", "Write code.").alias("m"))
    digest = F.md5(F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit("="), F.coalesce(x["content"], F.lit("")))), "|"))
    return t.select("row_id", F.size("m").alias("messages"), F.col("m")[0]["role"].alias("first_role"), digest.alias("digest"))


_STDIN = "list_filter({0}, lambda x: lower(coalesce(nullif(x.testtype, ''), 'stdin')) IN ('stdin', 'stdio', 'standard_input'))"
_TRIMMED = r"regexp_replace({0}, '[\t-\r \x1c-\x1f\x{{85}}\p{{Z}}]+$', '')"


@query(
    "prj12_question_conversion",
    f"SELECT question_id, CASE WHEN s = '' THEN q ELSE {_TRIMMED.format('q')} || chr(10) || chr(10) || 'Starter code:' || chr(10) || s END AS prompt, len(pub)::INT AS public_cases, len(priv)::INT AS private_cases FROM (SELECT question_id, coalesce({strip('starter_code')}, '') AS s, coalesce(question_content, '') AS q, {_STDIN.format('coalesce(' + _CASES.format('public_test_cases') + ', [])')} AS pub, {_STDIN.format('coalesce(' + _CASES.format('private_test_cases') + ', [])')} AS priv FROM eval_questions) WHERE len(pub) > 0",
)
def prj12(spark, d):
    q = TK.question_rows(table(spark, d, "eval_questions"), include_private=True)
    return q.select("question_id", F.col("question_content").alias("prompt"), F.size("public_test_cases").alias("public_cases"), F.size("private_test_cases").alias("private_cases"))


@query("prj14_public_examples", f"SELECT question_id, list_aggregate(list_transform(c[1:3], lambda x, i: 'Example ' || i || chr(10) || 'Input:' || chr(10) || trim(coalesce(x.input, ''), chr(10)) || chr(10) || 'Output:' || chr(10) || trim(coalesce(x.output, ''), chr(10))), 'string_agg', chr(10) || chr(10)) AS examples FROM (SELECT question_id, {_CASES.format('public_test_cases')} c FROM eval_questions) WHERE len(c) > 0")
def prj14(spark, d):
    q = table(spark, d, "eval_questions").select("question_id", A.cases("public_test_cases").alias("c")).where(F.size("c") > 0)
    bare = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"^\n+|\n+$", "")
    one = lambda x, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit("\nInput:\n"), bare(x["input"]), F.lit("\nOutput:\n"), bare(x["output"]))
    return q.select("question_id", F.array_join(F.transform(F.slice("c", 1, 3), one), "\n\n").alias("examples"))


@query("prj15_declarations", "SELECT task_id, prompt || chr(10) || chr(10) || 'Required API:' || chr(10) || entry_point AS prompt FROM func_tasks WHERE prompt IS NOT NULL AND coalesce(entry_point, '') <> ''")
def prj15(spark, d):
    t = table(spark, d, "func_tasks").where(F.col("prompt").isNotNull() & (F.coalesce("entry_point", F.lit("")) != ""))
    return t.select("task_id", F.concat("prompt", F.lit("\n\nRequired API:\n"), "entry_point").alias("prompt"))


@query("prj16_question_summary", "SELECT question_id, question_title, platform, lower(trim(difficulty)) AS difficulty, year(d)::VARCHAR || '-Q' || quarter(d) AS date_bin, coalesce(starter_code, '') <> '' AS has_starter_code FROM (SELECT *, try_cast(contest_date AS TIMESTAMP) d FROM eval_questions)")
def prj16(spark, d):
    q = table(spark, d, "eval_questions").withColumn("d", F.col("contest_date").try_cast("timestamp_ntz"))
    return q.select("question_id", "question_title", "platform", F.lower(F.trim("difficulty")).alias("difficulty"), X.quarter_bin("d").alias("date_bin"), (F.coalesce("starter_code", F.lit("")) != "").alias("has_starter_code"))


@query("prj17_preview", r"SELECT doc_id, CASE WHEN length(p) <= 120 THEN p ELSE regexp_replace(substring(p, 1, 117), ' +$', '') || '...' END AS preview FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '[\t-\r ]+', ' ', 'g'), '^ +| +$', '', 'g') p FROM documents WHERE text IS NOT NULL)")
def prj17(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.preview("text", 120).alias("preview"))


@query("prj18_question_prompt", "SELECT question_id, '### Question:' || chr(10) || question_content || chr(10) || chr(10) || CASE WHEN coalesce(starter_code, '') <> '' THEN '### Format: complete the given code' || chr(10) || '```python' || chr(10) || starter_code || chr(10) || '```' ELSE '### Format: read stdin, write stdout' || chr(10) || '```python' || chr(10) || '# YOUR CODE HERE' || chr(10) || '```' END AS prompt FROM eval_questions WHERE question_content IS NOT NULL")
def prj18(spark, d):
    q = table(spark, d, "eval_questions").where("question_content is not null")
    starter = F.concat(F.lit("### Format: complete the given code\n```python\n"), "starter_code", F.lit("\n```"))
    empty = F.lit("### Format: read stdin, write stdout\n```python\n# YOUR CODE HERE\n```")
    return q.select("question_id", F.concat(F.lit("### Question:\n"), "question_content", F.lit("\n\n"), F.when(F.coalesce("starter_code", F.lit("")) != "", starter).otherwise(empty)).alias("prompt"))


# --- aggregates ---------------------------------------------------------------------------------------------------


@query("agg1_group_count", "SELECT kind, count(*) AS n FROM documents GROUP BY 1")
def agg1(spark, d):
    return table(spark, d, "documents").groupBy("kind").agg(F.count("*").alias("n"))


@query("agg2_rollup", "SELECT source, pass_count, grouping_id(source, pass_count) AS level, count(*) AS n FROM scored_pool GROUP BY ROLLUP (source, pass_count)")
def agg2(spark, d):
    return table(spark, d, "scored_pool").rollup("source", "pass_count").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


@query("agg3_facets", "SELECT platform, difficulty, bin, starter, grouping_id(platform, difficulty, bin, starter) AS facet, count(*) AS n FROM (SELECT platform, lower(trim(difficulty)) AS difficulty, year(d)::VARCHAR || '-Q' || quarter(d) AS bin, coalesce(starter_code, '') <> '' AS starter FROM (SELECT *, try_cast(contest_date AS TIMESTAMP) d FROM eval_questions)) GROUP BY GROUPING SETS ((platform), (difficulty), (bin), (starter), (platform, difficulty), ())")
def agg3(spark, d):
    q = prj16(spark, d).select("platform", "difficulty", F.col("date_bin").alias("bin"), F.col("has_starter_code").alias("starter"))
    return R.facet_counts(q, [["platform"], ["difficulty"], ["bin"], ["starter"], ["platform", "difficulty"]])


@query("agg4_conditional_counts", "SELECT source, count(*) FILTER (WHERE pass_count = 0) AS none, count(*) FILTER (WHERE pass_count BETWEEN 1 AND 7) AS some, count(*) FILTER (WHERE pass_count = 8) AS every, sum(CASE WHEN pass_count IS NULL THEN 1 ELSE 0 END)::BIGINT AS unknown FROM scored_pool GROUP BY 1")
def agg4(spark, d):
    p = F.col("pass_count")
    return table(spark, d, "scored_pool").groupBy("source").agg(F.count_if(p == 0).alias("none"), F.count_if(p.between(1, 7)).alias("some"), F.count_if(p == 8).alias("every"), F.sum(F.when(p.isNull(), 1).otherwise(0)).alias("unknown"))


@query("agg5_pass_rate_bins", "SELECT bin, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM (SELECT CASE WHEN pass_rate < 0.05 THEN 0 WHEN pass_rate < 0.15 THEN 1 WHEN pass_rate < 0.4 THEN 2 WHEN pass_rate < 0.7 THEN 3 WHEN pass_rate <= 1 THEN 4 END AS bin FROM scored_pool WHERE pass_rate BETWEEN 0 AND 1) GROUP BY 1")
def agg5(spark, d):
    b = table(spark, d, "scored_pool").where("pass_rate between 0 and 1").select(R.binned(F.col("pass_rate"), [0, 0.05, 0.15, 0.4, 0.7, 1]).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    return b.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # five rows


@query("agg6_7_length_stats", "SELECT kind, count(length(text)) AS count, round(avg(length(text)), 6) AS mean, median(length(text))::DOUBLE AS median, round(quantile_cont(length(text), 0.25), 6) AS p25, round(quantile_cont(length(text), 0.75), 6) AS p75, round(quantile_cont(length(text), 0.9), 6) AS p90, round(quantile_cont(length(text), 0.95), 6) AS p95, max(length(text))::DOUBLE AS max FROM documents GROUP BY 1")
def agg6(spark, d):
    s = R.length_stats(table(spark, d, "documents"), F.length("text"), ["kind"])
    return s.select("kind", "count", *(F.round(c, 6).alias(c) for c in ("mean", "median", "p25", "p75", "p90", "p95")), "max")


@query("agg8_token_range", "SELECT model, min(prompt_tokens) AS low, sum(prompt_tokens)::BIGINT // count(prompt_tokens) AS mean, max(prompt_tokens) AS high FROM generations GROUP BY 1")
def agg8(spark, d):
    g = table(spark, d, "generations").groupBy("model")
    return g.agg(F.min("prompt_tokens").alias("low"), F.floor(F.sum("prompt_tokens") / F.count("prompt_tokens")).alias("mean"), F.max("prompt_tokens").alias("high"))


_JUDGED = "SELECT run_id, turn_index, arg_max(struct_pack(t := task_id, s := json_extract_string(obs_full, '$.status'), l := latency), logged_at) AS x FROM turns GROUP BY ALL"


@query("agg9_10_rollouts", f"SELECT x.t AS task_id, count(*) AS n_samples, count(*) FILTER (WHERE x.s = 'pass') AS pass_count, round(avg(CASE WHEN x.s = 'pass' THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, round(coalesce(max(x.l), -1), 6) AS slowest, string_agg(CASE WHEN x.s = 'pass' THEN run_id || ':' || turn_index END, ',' ORDER BY run_id || ':' || turn_index) AS passed FROM ({_JUDGED}) GROUP BY 1")
def agg9(spark, d):
    t = D.keep_last(table(spark, d, "turns").select("run_id", "turn_index", "task_id", "obs_full", "latency", "logged_at"), ["run_id", "turn_index"], "logged_at")
    passed = F.coalesce(F.get_json_object("obs_full", "$.status") == "pass", F.lit(False))
    scored = t.select("task_id", F.concat_ws(":", "run_id", F.col("turn_index").cast("string")).alias("rollout"), passed.alias("passed"), F.col("latency").alias("elapsed"))
    out = RO.rollout_summary(scored)
    return out.select("task_id", "n_samples", "pass_count", F.round("pass_rate", 6).alias("pass_rate"), F.round(F.coalesce("slowest", F.lit(-1.0)), 6).alias("slowest"), F.nullif(F.array_join("passed_indices", ","), F.lit("")).alias("passed"))


@query("agg11_mean_by_facet", "SELECT benchmark, dataset, grouping_id(benchmark, dataset) AS facet, count(*) AS n, round(avg(p), 6) AS pass_at_1 FROM (SELECT run_id, any_value(task.benchmark) AS benchmark, any_value(task.dataset) AS dataset, CASE WHEN arg_max(final_status, created_at) = 'pass' THEN 1.0 ELSE 0.0 END AS p FROM traces GROUP BY 1) GROUP BY GROUPING SETS ((benchmark), (dataset), ())")
def agg11(spark, d):
    runs = D.keep_last(table(spark, d, "traces").select("run_id", "task.benchmark", "task.dataset", "final_status", "created_at"), ["run_id"], "created_at")
    means = R.facet_means(runs, F.when(F.col("final_status") == "pass", 1.0).otherwise(0.0), [["benchmark"], ["dataset"]])
    return means.select("benchmark", "dataset", "facet", "n", F.round("mean", 6).alias("pass_at_1"))


@query(
    "agg12_pass_at_k",
    "SELECT row_id, " + ", ".join(f"round(CASE WHEN n < {k} THEN NULL WHEN n - c < {k} THEN 1.0 WHEN c = 0 THEN 0.0 ELSE 1 - list_aggregate(list_transform(range((n - c + 1)::BIGINT, (n + 1)::BIGINT), lambda i: 1 - {k}.0 / i), 'product') END, 6) AS pass_at_{k}" for k in (1, 2, 4)) + " FROM (SELECT row_id, n_samples AS n, pass_count AS c FROM scored_pool WHERE pass_count BETWEEN 0 AND n_samples)",
)
def agg12(spark, d):
    rows = table(spark, d, "scored_pool").where("pass_count between 0 and n_samples")
    return rows.select("row_id", *(F.round(R.pass_at_k(F.col("n_samples"), F.col("pass_count"), k), 6).alias(f"pass_at_{k}") for k in (1, 2, 4)))


@query("agg13_repair_at_k", " UNION ALL ".join(f"SELECT {k} AS k, count(*) FILTER (WHERE p) AS passed, count(*) AS tasks, round(avg(CASE WHEN p THEN 1.0 ELSE 0.0 END), 6) AS rate FROM (SELECT task_id, bool_or(coalesce(turn_index < {k} AND json_extract_string(obs_full, '$.status') = 'pass', FALSE)) AS p FROM turns GROUP BY 1)" for k in (1, 2, 3)))
def agg13(spark, d):
    return TR.repaired_at(table(spark, d, "turns"), [1, 2, 3]).select("k", "passed", "tasks", F.round("rate", 6).alias("rate"))


@query("agg14_missing_as_failed", "SELECT count(*) AS tasks, count(*) FILTER (WHERE p) AS passed, round(avg(CASE WHEN p THEN 1.0 ELSE 0.0 END), 6) AS rate FROM (SELECT f.task_id, coalesce(bool_or(t.final_status = 'pass'), FALSE) AS p FROM func_tasks f LEFT JOIN traces t ON t.task.task_id = f.task_id GROUP BY 1)")
def agg14(spark, d):
    runs = table(spark, d, "traces").groupBy(F.col("task.task_id").alias("task_id")).agg(F.max(F.col("final_status") == "pass").alias("p"))
    p = F.coalesce("p", F.lit(False))
    return table(spark, d, "func_tasks").select("task_id").join(runs, "task_id", "left").agg(F.count("*").alias("tasks"), F.count_if(p).alias("passed"), F.round(R.rate(p), 6).alias("rate"))


@query("agg15_turns_histogram", "SELECT turns, count(*) AS runs FROM (SELECT run_id, count(DISTINCT turn_index) AS turns FROM turns GROUP BY 1) GROUP BY 1")
def agg15(spark, d):
    per = table(spark, d, "turns").select("run_id", "turn_index").distinct().groupBy("run_id").agg(F.count("*").alias("turns"))
    return per.groupBy("turns").agg(F.count("*").alias("runs"))


@query("agg16_test_counts", "SELECT source, coalesce(len(tests), 0)::INT AS tests, count(*) AS rows FROM scored_pool GROUP BY ALL")
def agg16(spark, d):
    return table(spark, d, "scored_pool").groupBy("source", F.size(F.coalesce("tests", F.array().cast("array<string>"))).alias("tests")).agg(F.count("*").alias("rows"))


@query("agg17_skip_reasons", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN pass_count IS NULL THEN 'unscored' WHEN pass_count NOT BETWEEN 0 AND 8 THEN 'bad_count' WHEN question_chars IS NULL THEN 'no_length' WHEN question_chars > 900 THEN 'long' ELSE 'kept' END AS reason FROM scored_pool) GROUP BY 1")
def agg17(spark, d):
    rules = [Rule("unscored", F.col("pass_count").isNull()), Rule("bad_count", ~F.col("pass_count").between(0, 8)), Rule("no_length", F.col("question_chars").isNull()), Rule("long", F.col("question_chars") > 900)]
    return table(spark, d, "scored_pool").groupBy(first_failure(rules).alias("reason")).agg(F.count("*").alias("n"))


@query("agg18_symbol_ranks", "SELECT symbol, n, row_number() OVER (ORDER BY n DESC, symbol) AS place FROM (SELECT symbol, count(*) AS n FROM (SELECT unnest(required_symbols) AS symbol FROM scored_pool) GROUP BY 1)")
def agg18(spark, d):
    counts = table(spark, d, "scored_pool").select(F.explode("required_symbols").alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))
    return S.numbered(counts, F.desc("n"), F.col("symbol")).withColumn("place", F.col("place") + 1)


# --- windows and samples ------------------------------------------------------------------------------------------


@query("smp1_exact_sample", "SELECT doc_id, source FROM documents ORDER BY md5('42:' || doc_id::VARCHAR), doc_id LIMIT 500")
def smp1(spark, d):
    return S.sample_rows(table(spark, d, "documents").select("doc_id", "source"), 500, "doc_id")


@query("smp2_shuffle", "SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) - 1 AS shuffle_pos FROM documents")
def smp2(spark, d):
    return S.shuffle_positions(table(spark, d, "documents").select("doc_id"), "doc_id")


@query(
    "smp3_4_greedy_strata",
    """WITH s AS (SELECT doc_id, coalesce(nullif(trim(lang), ''), '__missing__') || '|' || coalesce(nullif(trim(kind), ''), '__missing__') AS stratum FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) - 1 AS k, count(*) OVER (PARTITION BY stratum) AS size, count(*) OVER () AS total FROM s), g AS (SELECT count(DISTINCT stratum) AS groups FROM s)
SELECT doc_id, stratum FROM r, g ORDER BY CASE WHEN k = 0 AND groups <= 400 THEN 1 ELSE 0 END DESC, size / total * 400 - k DESC, size - k DESC, stratum DESC LIMIT 400""",
)
def smp3(spark, d):
    docs, _ = S.strata(table(spark, d, "documents").select("doc_id", "lang", "kind"), ["lang", "kind"])
    return S.greedy_stratified(docs.select("doc_id", "stratum"), "stratum", 400, "doc_id")


@query(
    "smp5_largest_remainder",
    "WITH g AS (SELECT c_mktsegment, c_nationkey, count(*) AS size FROM customer GROUP BY ALL), i AS (SELECT *, size / sum(size) OVER () * least(600, sum(size) OVER ()) AS ideal FROM g), f AS (SELECT *, greatest(1, least(size, floor(ideal)))::INT AS base FROM i), r AS (SELECT *, row_number() OVER (ORDER BY ideal - floor(ideal) DESC, size DESC, c_mktsegment DESC, c_nationkey DESC) AS place, least(600, sum(size) OVER ()) - sum(base) OVER () AS gap FROM f) SELECT c_mktsegment, c_nationkey, size, (base + CASE WHEN place <= gap THEN 1 ELSE 0 END)::INT AS quota FROM r",
)
def smp5(spark, d):
    return S.group_quotas(table(spark, d, "customer"), ["c_mktsegment", "c_nationkey"], 600)


@query(
    "smp6_win2_round_robin",
    "WITH o AS (SELECT o_orderkey, o_orderpriority, year(o_orderdate)::VARCHAR || '-Q' || quarter(o_orderdate) AS bin FROM orders), t AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, bin ORDER BY md5('42:' || o_orderkey::VARCHAR), o_orderkey) AS turn FROM o) SELECT o_orderkey, o_orderpriority, bin FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY turn, md5('42:' || bin), bin) AS place FROM t) WHERE place <= 50",
)
def smp6(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", X.quarter_bin("o_orderdate").alias("bin"))
    quotas = o.select("o_orderpriority").distinct().withColumn("quota", F.lit(50))
    return S.round_robin(o, ["o_orderpriority"], "bin", quotas, "o_orderkey")


@query(
    "smp7_equal_buckets",
    "WITH r AS (SELECT row_id, pass_count, row_number() OVER (PARTITION BY pass_count ORDER BY md5('42:' || row_id::VARCHAR), row_id) AS k FROM scored_pool WHERE pass_count IN (1, 2, 7)), q AS (SELECT *, k <= 101 - CASE WHEN pass_count = 1 THEN 0 WHEN pass_count = 2 THEN 0 ELSE 1 END AS own FROM r) SELECT row_id, pass_count FROM q ORDER BY own DESC, CASE WHEN own THEN 0 ELSE pass_count END, CASE WHEN own THEN 0 ELSE k END, row_id LIMIT 302",
)
def smp7(spark, d):
    rows = table(spark, d, "scored_pool").select("row_id", "pass_count")
    return S.equal_buckets(rows, "pass_count", [1, 2, 7], 302, "row_id")


@query("smp8_keep_all_shuffled", "SELECT row_id, row_number() OVER (ORDER BY md5('42:' || row_id::VARCHAR), row_id) - 1 AS shuffle_pos FROM scored_pool WHERE pass_count IN (1, 2)")
def smp8(spark, d):
    return S.shuffle_positions(table(spark, d, "scored_pool").where("pass_count in (1, 2)").select("row_id"), "row_id")


@query("smp9_tier_cap", "SELECT row_id, tier FROM (SELECT row_id, tier, row_number() OVER (PARTITION BY tier ORDER BY md5('42:' || row_id::VARCHAR), row_id) k FROM sft_train WHERE tier IS NOT NULL) WHERE k <= 60")
def smp9(spark, d):
    return S.capped(table(spark, d, "sft_train").where("tier is not null").select("row_id", "tier"), ["tier"], 60, "row_id")


@query("smp10_11_tiers_and_targets", "WITH t AS (SELECT CASE WHEN total_tokens < 300 THEN 'short' WHEN total_tokens < 450 THEN 'medium' ELSE 'hard' END AS tier, count(*) AS have FROM sft_train WHERE total_tokens IS NOT NULL GROUP BY 1) SELECT w.tier, w.target, coalesce(t.have, 0) AS have, greatest(w.target - coalesce(t.have, 0), 0) AS shortage FROM (VALUES ('short', 6000), ('medium', 300), ('hard', 100)) w(tier, target) LEFT JOIN t USING (tier)")
def smp10(spark, d):
    t = F.col("total_tokens")
    have = table(spark, d, "sft_train").where(t.isNotNull()).groupBy(F.when(t < 300, "short").when(t < 450, "medium").otherwise("hard").alias("tier")).agg(F.count("*").alias("have"))
    wanted = spark.createDataFrame([("short", 6000), ("medium", 300), ("hard", 100)], "tier string, target int")
    n = F.coalesce("have", F.lit(0))
    return wanted.join(have, "tier", "left").select("tier", "target", n.alias("have"), F.greatest(F.col("target") - n, F.lit(0)).alias("shortage"))


@query("win3_4_stop_after", "WITH b AS (SELECT *, (row_number() OVER (ORDER BY event_id) - 1) // 100 AS batch FROM events), c AS (SELECT batch, coalesce(sum(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b GROUP BY 1) SELECT b.event_id, b.batch FROM b JOIN c USING (batch) WHERE before < 150")
def win3(spark, d):
    e = S.numbered(table(spark, d, "events").select("event_id", "event_type"), "event_id").withColumn("batch", F.floor(F.col("place") / 100))
    return S.stop_after(e, "batch", F.col("event_type") == "error", 150).select("event_id", "batch")


@query("win5_block_interleave", "SELECT row_id, pass_count, place_in_label, block FROM (SELECT row_id, pass_count, k::INT AS place_in_label, ((k - 1) // CASE WHEN pass_count = 1 THEN 4 ELSE 1 END)::INT AS block FROM (SELECT row_id, pass_count, row_number() OVER (PARTITION BY pass_count ORDER BY md5('42:' || row_id::VARCHAR), row_id) k FROM scored_pool WHERE pass_count IN (0, 1))) WHERE block < 10")
def win5(spark, d):
    return S.block_interleave(table(spark, d, "scored_pool").select("row_id", "pass_count"), "pass_count", {1: 4, 0: 1}, "row_id", blocks=10)


@query("win6_turn_sequence", "SELECT run_id, turn_index, (row_number() OVER (PARTITION BY run_id ORDER BY turn_index))::INT AS nth, turn_index = max(turn_index) OVER (PARTITION BY run_id) AS is_last FROM (SELECT DISTINCT run_id, turn_index FROM turns)")
def win6(spark, d):
    w = Window.partitionBy("run_id")
    t = table(spark, d, "turns").select("run_id", "turn_index").distinct()
    return t.select("run_id", "turn_index", F.row_number().over(w.orderBy("turn_index")).alias("nth"), (F.col("turn_index") == F.max("turn_index").over(w)).alias("is_last"))


@query("win7_throughput", "SELECT model, count(*) AS done, round(sum(completion_tokens) / nullif(sum(latency), 0), 6) AS tokens_per_second, any_value(todo) - count(*) AS missing, floor((any_value(todo) - count(*)) * sum(latency) / count(*) + 1e-6)::BIGINT AS eta_seconds FROM (SELECT DISTINCT gen_id, model, completion_tokens, latency FROM generations WHERE completion_tokens IS NOT NULL AND latency IS NOT NULL) JOIN (SELECT model AS m, count(DISTINCT gen_id) AS todo FROM generations GROUP BY 1) ON m = model GROUP BY 1")
def win7(spark, d):
    g = table(spark, d, "generations")
    todo = g.groupBy("model").agg(F.countDistinct("gen_id").alias("todo"))
    done = g.where("completion_tokens is not null and latency is not null").select("gen_id", "model", "completion_tokens", "latency").distinct()
    per = done.groupBy("model").agg(F.count("*").alias("done"), F.round(F.try_divide(F.sum("completion_tokens"), F.sum("latency")), 6).alias("tokens_per_second"), F.sum("latency").alias("took"))
    left = F.col("todo") - F.col("done")
    return per.join(todo, "model").select("model", "done", "tokens_per_second", left.alias("missing"), F.floor(left * F.col("took") / F.col("done") + 1e-6).alias("eta_seconds"))


@query("srt1_3_sorts", "SELECT source, n, arg_max_kind FROM (SELECT source, sum(n)::BIGINT AS n, arg_max(kind, (n, kind)) AS arg_max_kind FROM (SELECT source, kind, count(*) AS n FROM documents GROUP BY ALL) GROUP BY 1) ORDER BY n DESC, source")
def srt1(spark, d):
    per = table(spark, d, "documents").groupBy("source", "kind").agg(F.count("*").alias("n"))
    return per.groupBy("source").agg(F.sum("n").alias("n"), F.max_by("kind", F.struct("n", "kind")).alias("arg_max_kind")).orderBy(F.desc("n"), "source")


@query("lim1_first_rows", "SELECT row_id, repo FROM code_instruct WHERE lower(lang) = 'go' ORDER BY row_id, repo LIMIT 25")
def lim1(spark, d):
    return table(spark, d, "code_instruct").where(F.lower("lang") == "go").select("row_id", "repo").orderBy("row_id", "repo").limit(25)


# --- text ---------------------------------------------------------------------------------------------------------


@query("txt1_2_normalise", f"SELECT doc_id, {norm('text')} AS norm, {fp('text')} AS fp FROM documents WHERE text IS NOT NULL")
def txt1(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.normalized("text").alias("norm"), X.fingerprint("text").alias("fp"))


@query("txt3_think_spans", f"SELECT DISTINCT gen_id, list_aggregate(list_filter(list_transform(regexp_extract_all(text, '(?is)<think>(.*?)</think>', 1), lambda s: {strip('s')}), lambda s: s <> ''), 'string_agg', chr(10) || chr(10)) AS thoughts FROM generations WHERE text LIKE '%<think>%'")
def txt3(spark, d):
    g = table(spark, d, "generations").where(F.col("text").contains("<think>"))
    return g.select("gen_id", F.nullif(X.think_spans("text"), F.lit("")).alias("thoughts")).distinct()


@query("txt4_without_thoughts", f"SELECT DISTINCT gen_id, {strip('CASE WHEN contains(text, ' + chr(39) + '</think>' + chr(39) + ') THEN regexp_replace(text, ' + chr(39) + '(?s)<think>.*?</think>' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ') ELSE regexp_replace(text, ' + chr(39) + '(?s)<think>.*' + chr(39) + ', ' + chr(39) * 2 + ') END')} AS answer FROM generations WHERE text IS NOT NULL")
def txt4(spark, d):
    return table(spark, d, "generations").where("text is not null").select("gen_id", X.without_thoughts("text").alias("answer")).distinct()


_TAIL = strip("CASE WHEN contains(raw_output, '</think>') THEN regexp_replace(raw_output, '(?s)^.*?</think>', '') ELSE raw_output END")


@query("txt5_fenced_code", f"SELECT DISTINCT sample_id, CASE WHEN regexp_matches(t, '(?s)```python\\s*(.*?)```') THEN {strip('regexp_extract(t, ' + chr(39) + '(?s)```python\\s*(.*?)```' + chr(39) + ', 1)')} WHEN regexp_matches(t, '(?s)(def\\s+\\w+.*)') THEN {strip('regexp_extract(t, ' + chr(39) + '(?s)(def\\s+\\w+.*)' + chr(39) + ', 1)')} END AS code FROM (SELECT sample_id, {_TAIL} t FROM eval_samples WHERE raw_output IS NOT NULL)")
def txt5(spark, d):
    return table(spark, d, "eval_samples").where("raw_output is not null").select("sample_id", X.fenced_code("raw_output").alias("code")).distinct()


_W = "string_split_regex({0}, '\\s+')"
_OPENS = "list_contains(list_transform([{w}], lambda w: (w[1] IN ('def', 'class') AND regexp_matches(coalesce(w[2], ''), '^\\w')) OR (w[1] = 'import' AND coalesce(w[2], '') <> '') OR (w[1] = 'from' AND coalesce(w[2], '') <> '' AND coalesce(w[3], '') = 'import' AND len(w) > 3)), TRUE)"


def _opens(line: str) -> str:
    return _OPENS.format(w=_W.format(line))


def _from_line(text: str, begins: str) -> str:
    """The text from the first line l for which `begins` holds."""
    lines = f"string_split({text}, chr(10))"
    return f"list_aggregate({lines}[nullif(list_position(list_transform({lines}, lambda l: {begins}), TRUE), 0):], 'string_agg', chr(10))"


_FENCED, _PLAIN = r"'(?is)```python\s*(.*?)```'", r"'(?s)```\s*(.*?)```'"
_PLAIN_CODE = f"regexp_extract(t, {_PLAIN}, 1)"
_HOLDS = f"list_contains(list_transform(list_zip(list_transform({_W.format(_PLAIN_CODE)}, lambda w: regexp_replace(w, '^\\W+', '')), list_transform({_W.format(_PLAIN_CODE)}, lambda w: regexp_replace(w, '^\\W+', ''))[2:]), lambda z: (z[1] IN ('def', 'class') AND regexp_matches(coalesce(z[2], ''), '^\\w')) OR (z[1] = 'import' AND coalesce(z[2], '') <> '')), TRUE)"


@query(
    "txt6_lenient_code",
    f"SELECT DISTINCT sample_id, nullif(CASE WHEN regexp_matches(t, {_FENCED}) THEN {strip(f'regexp_extract(t, {_FENCED}, 1)')} WHEN regexp_matches(t, {_PLAIN}) AND {_HOLDS} THEN {strip(_PLAIN_CODE)} ELSE {strip(_from_line('t', _opens('l')))} END, '') AS code FROM (SELECT sample_id, {_TAIL} t FROM eval_samples WHERE raw_output IS NOT NULL)",
)
def txt6(spark, d):
    return table(spark, d, "eval_samples").where("raw_output is not null").select("sample_id", X.lenient_code("raw_output").alias("code")).distinct()


_BARE = strip("CASE WHEN contains(raw_output, '</think>') THEN regexp_replace(raw_output, '(?s)<think>.*?</think>', '', 'g') ELSE regexp_replace(raw_output, '(?s)<think>.*', '') END")
_ANY_FENCE = r"'(?is)```(?:python|py)?\s*\n?(.*?)(?:```|$)'"


@query(
    "txt8_last_fence",
    f"SELECT DISTINCT sample_id, CASE WHEN len(blocks) > 0 THEN replace(blocks[-1], chr(13) || chr(10), chr(10)) ELSE coalesce({strip(_from_line('t', _opens('ltrim(l)') + " OR regexp_matches(ltrim(l), '^if\\s+__name__\\s*==')"))}, t) END AS code FROM (SELECT sample_id, t, list_filter(list_transform(regexp_extract_all(t, {_ANY_FENCE}, 1), lambda s: {strip('s')}), lambda s: s <> '') AS blocks FROM (SELECT sample_id, {_BARE} AS t FROM eval_samples WHERE raw_output IS NOT NULL))",
)
def txt8(spark, d):
    return table(spark, d, "eval_samples").where("raw_output is not null").select("sample_id", X.last_fence("raw_output").alias("code")).distinct()


_CALLS = r"""WITH c AS (SELECT task_id, generate_subscripts(name, 1) AS i, unnest(head) AS head, unnest(wrap) AS wrap, unnest(name) AS name FROM (SELECT task_id, regexp_extract_all(prompt, p, 1) AS head, regexp_extract_all(prompt, p, 2) AS wrap, regexp_extract_all(prompt, p, 3) AS name FROM func_tasks, (SELECT '\b(?:(def)\s+|assert\s+((?:not\s+|math\.\w+\s*\(\s*|\(\s*)?))(\w+)\s*\(' AS p))),
k AS (SELECT *, CASE WHEN coalesce(head, '') <> '' THEN 0 WHEN coalesce(wrap, '') = '' AND name NOT IN ('math', 'not') THEN 1 WHEN coalesce(wrap, '') <> '' THEN 2 END AS kind FROM c)"""


@query("txt9_target_function", _CALLS + " SELECT task_id, first(name ORDER BY kind, i) AS target FROM (SELECT t.task_id, k.name, k.kind, k.i FROM func_tasks t LEFT JOIN k ON t.task_id = k.task_id AND k.kind IS NOT NULL) GROUP BY task_id")
def txt9(spark, d):
    return table(spark, d, "func_tasks").select("task_id", X.target_function("prompt").alias("target"))


_NAMES = r"regexp_extract_all({0}, 'def\s+(\w+)\s*\(', 1)"


def _defined(code: str) -> str:
    return f"CASE WHEN target IS NOT NULL THEN list_contains({_NAMES.format(code)}, target) ELSE starts_with({strip(code)}, 'def ') END"


@query(
    "txt10_11_solutions",
    _CALLS
    + f""", w AS (SELECT t.task_id, any_value(t.prompt) AS prompt, first(k.name ORDER BY k.kind, k.i) AS target FROM func_tasks t LEFT JOIN k ON t.task_id = k.task_id AND k.kind IS NOT NULL GROUP BY 1),
x AS (SELECT sample_id, prompt, target, txt, string_split(txt, '```') AS parts FROM (SELECT DISTINCT sample_id, task_id, {_BARE} AS txt FROM eval_samples WHERE raw_output IS NOT NULL) JOIN w USING (task_id)),
y AS (SELECT *, parts[2:greatest(len(parts) - 1, 1)] AS closed FROM x),
z AS (SELECT *, list_filter(closed, lambda b: starts_with(b, 'python' || chr(10))) AS python, list_filter(closed, lambda b, i: i % 2 = 1) AS alternate FROM y),
b AS (SELECT sample_id, prompt, target, txt, unnest(blocks) AS block, generate_subscripts(blocks, 1) AS i FROM (SELECT *, CASE WHEN len(python) > 0 THEN list_transform(python, lambda b: {strip('substring(b, 8)')}) ELSE list_transform(alternate, lambda b: {strip('b')}) END AS blocks FROM z)),
best AS (SELECT sample_id, prompt, arg_max(block, (coalesce(({_defined('block')})::INT, 0) * 2 + least(len({_NAMES.format('block')}), 1)) * 1000000 + i) AS block FROM b GROUP BY ALL),
made AS (SELECT x.sample_id, x.prompt, x.target, coalesce(nullif(best.block, ''), x.txt) AS code FROM x LEFT JOIN best ON x.sample_id = best.sample_id AND x.prompt = best.prompt)
SELECT DISTINCT sample_id, CASE WHEN {_defined('code')} THEN code ELSE coalesce(prompt, '') || code END AS solution FROM made""",
)
def txt10(spark, d):
    s = table(spark, d, "eval_samples").where("raw_output is not null").select("sample_id", "task_id", "raw_output").distinct()
    return s.join(table(spark, d, "func_tasks").select("task_id", "prompt"), "task_id").select("sample_id", X.assembled_solution("raw_output", "prompt").alias("solution")).distinct()


@query(
    "txt13_parsed_submission",
    """WITH t AS (SELECT DISTINCT run_id, turn_index, raw_output AS x FROM turns WHERE raw_output IS NOT NULL),
a AS (SELECT *, regexp_matches(x, '(?is)<think>.*?</think>') AS tagged, regexp_matches(x, '(?i)</think>') AS bare FROM t),
b AS (SELECT *, CASE WHEN tagged THEN regexp_extract(x, '(?is)^.*?<think>(.*?)</think>', 1) WHEN bare THEN regexp_extract(x, '(?is)^(.*?)</think>', 1) ELSE '' END AS th, CASE WHEN tagged THEN regexp_replace(x, '(?is)^.*?<think>.*?</think>', '') WHEN bare THEN regexp_replace(x, '(?is)^.*?</think>', '') ELSE x END AS rest FROM a),
c AS (SELECT *, regexp_matches(rest, '(?is)<submit>.*?</submit>') AS has, regexp_matches(regexp_replace(rest, '(?is)^.*?<submit>.*?</submit>', ''), '(?i)</?obs>') AS seen, {raw} AS raw, {think} AS think FROM b),
d AS (SELECT *, regexp_matches(raw, '(?is)^```(?:python|py)?\\s*\\n(.*?)\\n```$') AS fence FROM c),
e AS (SELECT *, CASE WHEN NOT has THEN '' WHEN fence THEN {inner} ELSE raw END AS submit FROM d),
f AS (SELECT *, CASE WHEN NOT has AND regexp_matches(rest, '(?i)<submit>') AND NOT regexp_matches(rest, '(?i)</submit>') THEN 'incomplete_output' WHEN NOT has THEN 'missing_submit' WHEN seen THEN 'model_generated_obs' WHEN submit = '' THEN 'empty_submit' END AS error_type FROM e)
SELECT run_id, turn_index, CASE WHEN has THEN think ELSE '' END AS think, submit, CASE WHEN error_type IS NULL THEN 'ok' ELSE 'format_error' END AS status, error_type, concat_ws(',', CASE WHEN has AND fence THEN 'stripped_markdown_fence' END, CASE WHEN has AND seen THEN 'model output contained obs tag after submit' END, CASE WHEN has AND NOT seen AND regexp_matches(think, '(?i)</?obs>') THEN 'think_mentioned_obs_tag' END) AS warnings FROM f""".format(
        raw=strip("regexp_extract(rest, '(?is)<submit>(.*?)</submit>', 1)"), think=strip("th"), inner=strip("regexp_extract(raw, '(?is)^```(?:python|py)?\\s*\\n(.*?)\\n```$', 1)")
    ),
)
def txt13(spark, d):
    t = table(spark, d, "turns").where("raw_output is not null").select("run_id", "turn_index", X.parsed_submission("raw_output").alias("p")).distinct()
    return t.select("run_id", "turn_index", "p.think", "p.submit", "p.status", "p.error_type", F.array_join("p.warnings", ",").alias("warnings"))


_RECOVERED = r"'(?is)^\s*```(?:python|py)?\s*\n(.*?)\n```\s*$'"
_PYTHON = r"(contains({0}, 'sys.stdin') OR regexp_matches({0}, '\bprint\s*\(') OR list_contains(list_transform(string_split({0}, chr(10)), lambda l: {1} OR regexp_matches(ltrim(l), '^if\s+__name__\s*==')), TRUE))"
_RECOVERY = (
    SQL["txt13_parsed_submission"].split("SELECT run_id, turn_index, CASE WHEN has")[0].replace("raw_output AS x FROM turns WHERE raw_output IS NOT NULL", "coalesce(recovery_raw_output, raw_output) AS x FROM turns WHERE coalesce(recovery_raw_output, raw_output) IS NOT NULL")
    + f""", g AS (SELECT *, {strip('x')} AS p FROM f),
h AS (SELECT *, CASE WHEN regexp_matches(x, {_RECOVERED}) THEN {strip(f'regexp_extract(x, {_RECOVERED}, 1)')} WHEN NOT regexp_matches(p, '(?i)</?(?:think|obs|submit)>') AND {_PYTHON.format('p', _opens('ltrim(l)'))} THEN p ELSE '' END AS code FROM g),
j AS (SELECT *, coalesce(error_type IN ('missing_submit', 'incomplete_output') AND code <> '', FALSE) AS again FROM h)
SELECT run_id, turn_index, CASE WHEN again THEN code ELSE coalesce(submit, '') END AS submit, CASE WHEN again OR error_type IS NULL THEN 'ok' ELSE 'format_error' END AS status, CASE WHEN NOT again THEN error_type END AS error_type FROM j"""
)


@query("txt14_recovered_submission", _RECOVERY)
def txt14(spark, d):
    said = F.coalesce("recovery_raw_output", "raw_output")
    t = table(spark, d, "turns").where(said.isNotNull()).select("run_id", "turn_index", X.recovered_submission(said).alias("p")).distinct()
    return t.select("run_id", "turn_index", "p.submit", "p.status", "p.error_type")


@query("txt15_standard_format", r"SELECT gen_id, bool_or(regexp_matches(" + strip("text") + r", '(?is)^\s*<think>\s*(.*?)\s*</think>\s*```python\s*(.*?\S.*?)```\s*$')) AS standard FROM generations WHERE text IS NOT NULL GROUP BY 1")
def txt15(spark, d):
    return table(spark, d, "generations").where("text is not null").groupBy("gen_id").agg(F.max(X.standard_format("text")).alias("standard"))


@query("txt16_token_estimate", "SELECT doc_id, (CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(1, (length(text) + 3) // 4) END)::INT AS tokens FROM documents")
def txt16(spark, d):
    return table(spark, d, "documents").select("doc_id", X.estimated_tokens("text").alias("tokens"))


@query("txt17_18_cuts", "SELECT doc_id, right(text, 40) AS tail, CASE WHEN length(text) <= 1000 THEN text ELSE substring(text, 1, 667) || chr(10) || '... [prompt truncated to fit budget]' || chr(10) || right(text, 333) END AS middle FROM documents WHERE text IS NOT NULL")
def txt17(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.tail("text", 40).alias("tail"), X.middle_cut("text", 100).alias("middle"))


@query("txt19_plain_output", rf"SELECT DISTINCT sample_id, {strip('regexp_replace(solution, ' + chr(39) + '(?m)[ \t\r]+$' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')} AS plain FROM eval_samples WHERE solution IS NOT NULL")
def txt19(spark, d):
    return table(spark, d, "eval_samples").where("solution is not null").select("sample_id", X.plain_output("solution").alias("plain")).distinct()


@query("txt20_21_error_lines", "SELECT run_id, turn_index, kind, concat_ws(' ', 'status=fail', 'error_type=' || kind, CASE WHEN turn_index > 0 THEN 'case_index=' || turn_index END) AS line FROM (SELECT DISTINCT run_id, turn_index, CASE WHEN contains(e, 'SyntaxError') OR contains(e, 'IndentationError') THEN 'syntax_error' WHEN contains(e, 'AssertionError') THEN 'wrong_answer' ELSE 'runtime_error' END AS kind FROM (SELECT run_id, turn_index, coalesce(obs_for_model, '') || CASE json_extract_string(obs_full, '$.error_type') WHEN 'syntax_error' THEN ' SyntaxError' WHEN 'wrong_answer' THEN ' AssertionError' ELSE '' END AS e FROM turns))")
def txt20(spark, d):
    error = F.get_json_object("obs_full", "$.error_type")
    e = F.concat(F.coalesce("obs_for_model", F.lit("")), F.when(error == "syntax_error", " SyntaxError").when(error == "wrong_answer", " AssertionError").otherwise(""))
    v = table(spark, d, "turns").select("run_id", "turn_index", X.error_class(e).alias("kind")).distinct()
    return v.select("run_id", "turn_index", "kind", X.failure_line("kind", F.when(F.col("turn_index") > 0, F.concat(F.lit("case_index="), F.col("turn_index").cast("string")))).alias("line"))


@query("txt22_23_contract", "SELECT row_id, CASE WHEN coalesce(len(required_symbols), 0) = 0 OR contains(q, 'Your solution must define') THEN q ELSE regexp_replace(q, '\\s+$', '') || chr(10) || chr(10) || 'Your solution must define these top-level names: ' || list_aggregate(list_transform(required_symbols, lambda x: '`' || x || '`'), 'string_agg', ', ') || '.' END AS prompt, CASE WHEN coalesce(len(passed_indices), 0) = 0 THEN '-' ELSE list_aggregate(list_transform(passed_indices[1:3], lambda x: x::VARCHAR), 'string_agg', ',') || CASE WHEN len(passed_indices) > 3 THEN ',...' ELSE '' END END AS shown FROM (SELECT *, list_extract(list_filter(messages, lambda m: m.role = 'user'), 1).content AS q FROM scored_pool) WHERE q IS NOT NULL")
def txt22(spark, d):
    p = table(spark, d, "scored_pool").withColumn("q", F.try_element_at(F.filter("messages", lambda m: m["role"] == "user"), F.lit(1))["content"]).where("q is not null")
    return p.select("row_id", X.with_contract("q", "required_symbols").alias("prompt"), X.shown_indices(F.coalesce("passed_indices", F.array().cast("array<int>")), 3).alias("shown"))


# --- arrays, dates, rewards ---------------------------------------------------------------------------------------

_LISTED = "CASE WHEN json_valid(s) AND json_type(s) = 'ARRAY' THEN from_json(s, '[\"VARCHAR\"]') ELSE [] END"


@query(
    "arr1_test_lists",
    f"SELECT row_id, coalesce(list_aggregate(list_filter(list_transform(l, lambda t: {strip('t')}), lambda t: starts_with(t, 'assert')), 'string_agg', '|'), '') AS starting, coalesce(list_aggregate(list_transform(list_filter(l, lambda t: contains(t, 'assert')), lambda t: {strip('t')}), 'string_agg', '|'), '') AS containing FROM (SELECT row_id, {_LISTED} AS l FROM (SELECT row_id, CASE WHEN row_id % 5 = 0 THEN 'nonsense' WHEN row_id % 7 = 0 THEN NULL ELSE to_json(tests)::VARCHAR END AS s FROM scored_pool))",
)
def arr1(spark, d):
    text = F.when(F.col("row_id") % 5 == 0, "nonsense").when(F.col("row_id") % 7 == 0, None).otherwise(F.to_json("tests"))
    v = table(spark, d, "scored_pool").select("row_id", text.alias("s"))
    return v.select("row_id", F.array_join(A.asserts_at_start("s"), "|").alias("starting"), F.array_join(A.asserts_anywhere("s"), "|").alias("containing"))


@query("arr4_5_cases", f"SELECT question_id, len(pub)::INT AS public_cases, len(list_concat(pub, priv))::INT AS all_cases, (CASE WHEN len(priv) > 0 THEN priv ELSE pub END)[1].output AS first_hidden FROM (SELECT question_id, coalesce({_CASES.format('public_test_cases')}, []) pub, coalesce({_CASES.format('private_test_cases')}, []) priv FROM eval_questions)")
def arr4(spark, d):
    q = table(spark, d, "eval_questions").select("question_id", A.cases("public_test_cases").alias("pub"), A.cases("private_test_cases").alias("priv"))
    hidden = A.chosen_cases(F.col("pub"), F.col("priv"), "hidden")
    return q.select("question_id", F.size(A.chosen_cases(F.col("pub"), F.col("priv"), "public")).alias("public_cases"), F.size(A.chosen_cases(F.col("pub"), F.col("priv"), "all")).alias("all_cases"), F.try_element_at(hidden, F.lit(1))["output"].alias("first_hidden"))


@query("arr7_json_properties", "SELECT event_type, (json_extract_string(props, '$.k'))::BIGINT AS k, count(*) AS n FROM events GROUP BY ALL")
def arr7(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("arr8_usage_totals", "SELECT run_id, sum(u)::BIGINT AS tokens FROM (SELECT DISTINCT run_id, turn_index, coalesce(list_sum(map_values(token_usage)), 0) AS u FROM turns WHERE token_usage IS NOT NULL) GROUP BY 1")
def arr8(spark, d):
    t = table(spark, d, "turns").where("token_usage is not null").select("run_id", "turn_index", A.usage_total("token_usage").alias("u")).distinct()
    return t.groupBy("run_id").agg(F.sum("u").alias("tokens"))


@query("arr9_explode_recollect", "SELECT row_id, string_agg(i::VARCHAR, ',' ORDER BY i) AS passed FROM (SELECT row_id, unnest(passed_indices) AS i FROM scored_pool) GROUP BY 1")
def arr9(spark, d):
    x = table(spark, d, "scored_pool").select("row_id", F.explode("passed_indices").alias("i"))
    return x.groupBy("row_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("i")), lambda v: v.cast("string")), ",").alias("passed"))


@query("arr10_budget_ladder", None)
def arr10(spark, d):
    t = TR.assembled(table(spark, d, "traces"), table(spark, d, "turns"))
    return t.select("run_id", TR.budgeted_text(F.col("task.prompt"), F.col("turns"), 500).alias("text"))


@query("dtm1_4_dates", "SELECT gen_id, year(requested_at)::VARCHAR || '-Q' || quarter(requested_at) AS bin, CASE WHEN s >= 3600 THEN (s // 3600)::VARCHAR || 'h ' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || 'm' ELSE (s // 60)::VARCHAR || 'm ' || lpad((s % 60)::VARCHAR, 2, '0') || 's' END AS took FROM (SELECT DISTINCT gen_id, requested_at, floor(greatest(latency * 100, 0))::BIGINT AS s FROM generations WHERE latency IS NOT NULL)")
def dtm1(spark, d):
    g = table(spark, d, "generations").where("latency is not null").select("gen_id", "requested_at", "latency").distinct()
    return g.select("gen_id", X.quarter_bin("requested_at").alias("bin"), X.duration_text(F.col("latency") * 100).alias("took"))


@query("dtm3_epoch_seconds", "SELECT run_id, max(date_trunc('day', to_timestamp(created_at) AT TIME ZONE 'UTC'))::DATE AS day FROM traces WHERE created_at IS NOT NULL GROUP BY 1")
def dtm3(spark, d):
    return table(spark, d, "traces").where("created_at is not null").groupBy("run_id").agg(F.max(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("created_at") / 86400).cast("int"))).alias("day"))


@query("mth1_2_shares", "SELECT source, n, round(n / nullif(sum(n) OVER (), 0), 6) AS share, floor(n / sum(n) OVER () * 100)::BIGINT AS floor_quota FROM (SELECT source, count(*) AS n FROM scored_pool GROUP BY 1)")
def mth1(spark, d):
    c = table(spark, d, "scored_pool").groupBy("source").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # one row a source
    return c.select("source", "n", F.round(F.try_divide(F.col("n"), total), 6).alias("share"), F.floor(F.col("n") / total * 100).alias("floor_quota"))


@query("mth3_tolerance", "SELECT row_id, abs(a - b) <= greatest(1e-6 * greatest(abs(a), abs(b)), 1e-6) AS equal FROM (SELECT row_id, pass_rate AS a, pass_count::DOUBLE / nullif(n_samples, 0) + CASE WHEN row_id % 3 = 0 THEN 1e-5 ELSE 1e-9 END AS b FROM scored_pool)")
def mth3(spark, d):
    b = F.try_divide(F.col("pass_count").cast("double"), F.col("n_samples")) + F.when(F.col("row_id") % 3 == 0, 1e-5).otherwise(1e-9)
    return table(spark, d, "scored_pool").select("row_id", X.nearly_equal("pass_rate", b).alias("equal"))


_FENCE_THINK = "CASE WHEN contains(x, '```python') AND contains(x, '<think>') AND contains(x, '</think>') THEN 0.5 WHEN contains(x, '```python') THEN 0.3 ELSE 0.0 END"


@query("mth4_rewards", "SELECT run_id, turn_index, (CASE WHEN ok THEN 1.0 ELSE 0.0 END)::DOUBLE AS execution, (" + _FENCE_THINK + ")::DOUBLE AS format, (CASE WHEN NOT ok THEN 0.0 WHEN regexp_matches(" + strip("x") + r", '(?is)^\s*<think>\s*(.*?)\s*</think>\s*```python\s*(.*?\S.*?)```\s*$') THEN 2.5 ELSE 2.0 END)::DOUBLE AS gated FROM (SELECT run_id, turn_index, r.x AS x, coalesce(r.s = 'pass', FALSE) AS ok FROM (SELECT run_id, turn_index, arg_max(struct_pack(x := raw_output, s := json_extract_string(obs_full, '$.status')), logged_at) AS r FROM turns GROUP BY ALL)) WHERE x IS NOT NULL")
def mth4(spark, d):
    t = D.keep_last(table(spark, d, "turns").select("run_id", "turn_index", "raw_output", "obs_full", "logged_at"), ["run_id", "turn_index"], "logged_at").where("raw_output is not null")
    passed, text = F.get_json_object("obs_full", "$.status") == "pass", F.col("raw_output")
    return t.select("run_id", "turn_index", RO.execution_reward(passed).alias("execution"), RO.format_reward(text).alias("format"), RO.gated_reward(passed, text).alias("gated"))


# --- traces -------------------------------------------------------------------------------------------------------


@query("trc1_repair_prefixes", _TURNS_SQL + """SELECT run_id, CASE WHEN lead < fails OR fails < 2 THEN 'skipped_pass_or_too_few_failures' WHEN fails > 3 THEN 'skipped_too_many_failures' WHEN NOT clean THEN 'skipped_unclean' ELSE 'selected' END AS outcome, greatest(1, fails - 1)::INT AS keep FROM r""")
def trc1(spark, d):
    t = TR.assembled(table(spark, d, "traces"), table(spark, d, "turns")).where(F.size("turns") > 0)
    return t.select("run_id", TR.prefix_choice(F.col("turns")).alias("p")).select("run_id", "p.outcome", "p.keep")


@query(
    "trc2_prj20_export",
    """WITH o AS (SELECT DISTINCT ON (run_id, turn_index) * FROM turns ORDER BY run_id, turn_index, logged_at DESC),
p AS (SELECT run_id, count(*) AS turns, string_agg(nullif(concat_ws(chr(10), CASE WHEN parsed_think <> '' THEN '<think>' || parsed_think || '</think>' END, CASE WHEN parsed_submit <> '' THEN '<submit>' || parsed_submit || '</submit>' END, CASE WHEN obs_for_model <> '' THEN '<obs>' || obs_for_model || '</obs>' END), ''), chr(10) ORDER BY turn_index) AS parts FROM o GROUP BY 1),
t AS (SELECT DISTINCT ON (run_id) run_id, task.task_id AS task_id, model, task.prompt AS prompt FROM traces WHERE final_status = 'pass' ORDER BY run_id)
SELECT t.run_id, t.task_id, t.model, coalesce(p.turns, 0)::INT AS turns, concat_ws(chr(10), '<input>' || coalesce(t.prompt, '') || '</input>', p.parts) AS text FROM t LEFT JOIN p USING (run_id)""",
)
def trc2(spark, d):
    t = TR.assembled(table(spark, d, "traces").where("final_status = 'pass'"), table(spark, d, "turns"))
    return t.select("run_id", F.col("task.task_id").alias("task_id"), "model", F.size("turns").alias("turns"), TR.tagged_text(F.col("task.prompt"), F.col("turns")).alias("text"))


@query("trc4_final_status", "WITH o AS (SELECT DISTINCT ON (run_id, turn_index) run_id, turn_index, json_extract_string(obs_full, '$.status') AS s FROM turns ORDER BY run_id, turn_index, logged_at DESC) SELECT run_id, CASE WHEN arg_max(coalesce(s, ''), turn_index) = 'pass' THEN 'pass' ELSE 'fail' END AS final_status FROM o GROUP BY 1")
def trc4(spark, d):
    t = TR.assembled(table(spark, d, "traces"), table(spark, d, "turns")).where(F.size("turns") > 0)
    return t.select("run_id", TR.final_status(F.col("turns")).alias("final_status"))


@query("prj19_trace_slice", _TURNS_SQL + "SELECT run_id, greatest(1, fails - 1)::INT AS kept, 'fail' AS final_status FROM r WHERE lead >= fails AND fails BETWEEN 2 AND 3 AND clean")
def prj19(spark, d):
    t = TR.assembled(table(spark, d, "traces"), table(spark, d, "turns")).where(F.size("turns") > 0).withColumn("p", TR.prefix_choice(F.col("turns")))
    kept = TR.sliced(F.col("turns"), F.col("p.keep"))
    return t.where("p.outcome = 'selected'").select("run_id", F.size(kept).alias("kept"), TR.turn_status(F.try_element_at(kept, F.lit(-1))).alias("final_status"))


@query("trc5_replay", None)
def trc5(spark, d):
    return TR.replayed(table(spark, d, "turns"))


@query("prj2_11_training_rows", "SELECT row_id, uid, CASE WHEN pass_count IS NULL THEN NULL ELSE 'pass_count_' || pass_count END AS tier, len(messages)::INT AS messages, coalesce(list_aggregate(required_symbols, 'string_agg', ','), '') AS symbols FROM scored_pool WHERE messages IS NOT NULL")
def prj11(spark, d):
    p = table(spark, d, "scored_pool").where("messages is not null")
    return p.select("row_id", "uid", F.concat(F.lit("pass_count_"), F.col("pass_count").cast("string")).alias("tier"), F.size("messages").alias("messages"), F.coalesce(F.array_join("required_symbols", ","), F.lit("")).alias("symbols"))


@query("prj6_7_layout_pairs", "SELECT row_id, trim(problem) AS question, length(" + strip("coalesce(solution, '')") + ")::INT AS answer_chars FROM code_instruct WHERE problem IS NOT NULL")
def prj7(spark, d):
    c = table(spark, d, "code_instruct").where("problem is not null")
    question, answer = A.text_pair(A.detect_layout(c.columns))
    return c.select("row_id", question.alias("question"), F.length(answer).alias("answer_chars"))


@query("prj13_filtered_conversion", f"SELECT task_id AS question_id, prompt AS question, test FROM func_tasks WHERE coalesce({strip('prompt')}, '') <> '' AND coalesce({strip('test')}, '') <> '' AND NOT starts_with(prompt, 'def ') AND length(prompt) <= 400 AND length(canonical_solution) % 10 >= 3")
def prj13(spark, d):
    # the fields of such rows that the table lacks are worked out of its texts
    subset = F.when(F.col("prompt").startswith("def "), "stub").otherwise("plain")
    level = F.when(F.length("prompt") <= 400, "easy").otherwise("hard")
    rows = table(spark, d, "func_tasks").select(F.col("task_id").alias("question_id"), F.col("prompt").alias("question"), "test", subset.alias("subset"), level.alias("gpt_difficulty"), (F.length("canonical_solution") % 10 / 10).alias("gpt_pass_percentage"))
    return TK.module_rows(rows, "plain", "easy", 0.3).select("question_id", "question", "test")


@query("prj5_stringified", "SELECT row_id, coalesce(CASE WHEN sampling IS NOT NULL THEN json_merge_patch('{}', json_object('enable_thinking', sampling.enable_thinking, 'max_tokens', sampling.max_tokens, 'system_prompt_mode', sampling.system_prompt_mode, 'temperature', sampling.temperature, 'top_k', sampling.top_k, 'top_p', sampling.top_p))::VARCHAR END, '') AS sampling, coalesce(" + strip("source") + ", '') AS source FROM scored_pool")
def prj5(spark, d):
    return table(spark, d, "scored_pool").select("row_id", A.stringified(F.col("sampling"), False).alias("sampling"), A.stringified(F.col("source"), True).alias("source"))


@query("flt23_25_clean_failures", _TURNS_SQL + "SELECT run_id, fails::INT AS failed, clean FROM r")
def flt23(spark, d):
    t = TR.assembled(table(spark, d, "traces"), table(spark, d, "turns")).where(F.size("turns") > 0)
    failed = F.filter("turns", lambda x: TR.turn_status(x) == "fail")
    return t.select("run_id", F.size(failed).alias("failed"), F.forall(failed, TR.clean_failure).alias("clean"))


@query("mth5_token_lengths", "SELECT row_id, list_sum(list_transform(messages, lambda m: CASE WHEN coalesce(length(m.content), 0) = 0 THEN 0 ELSE greatest(1, (length(m.content) + 3) // 4) END))::INT AS tokens FROM sft_train WHERE messages IS NOT NULL")
def mth5(spark, d):
    t = table(spark, d, "sft_train").where("messages is not null")
    return t.select("row_id", F.aggregate("messages", F.lit(0), lambda s, m: s + X.estimated_tokens(m["content"])).alias("tokens"))


# --- sources and streams ------------------------------------------------------------------------------------------


@query("src6_subset_scan", "SELECT question_id, platform, contest_date FROM eval_questions WHERE question_id IN (SELECT question_id FROM eval_questions WHERE platform = 'arenabits') AND contest_date >= '2025-03-01' ORDER BY question_id")
def src6(spark, d):
    q = table(spark, d, "eval_questions")
    wanted = q.where("platform = 'arenabits'").select("question_id")
    return D.keep_known(q, wanted, ["question_id"]).where("contest_date >= '2025-03-01'").select("question_id", "platform", "contest_date").orderBy("question_id")


@query("src7_metadata_scan", "SELECT question_id, question_title, platform, difficulty, contest_date FROM eval_questions")
def src7(spark, d):
    return table(spark, d, "eval_questions").select("question_id", "question_title", "platform", "difficulty", "contest_date")


@query("src8_split_union", "SELECT 'sft' AS origin, row_id, tier, NULL::INT AS pass_count FROM sft_train UNION ALL SELECT 'pool', row_id, NULL, pass_count FROM scored_pool")
def src8(spark, d):
    a = table(spark, d, "sft_train").select(F.lit("sft").alias("origin"), "row_id", "tier")
    return a.unionByName(table(spark, d, "scored_pool").select(F.lit("pool").alias("origin"), "row_id", "pass_count"), allowMissingColumns=True)


@query("src12_task_adapter", "SELECT task_id, coalesce(prompt, '') AS prompt, 'python' AS language, coalesce(base_input, '') AS base_input, coalesce(len(tests), -1)::INT AS tests FROM func_tasks")
def src12(spark, d):
    t = TK.ADAPTERS["functions"](table(spark, d, "func_tasks"), "functions", "all")
    held = F.from_json("tests_metadata", "base_input string, tests array<string>")
    return t.select("task_id", "prompt", "language", F.coalesce(held["base_input"], F.lit("")).alias("base_input"), F.coalesce(F.size(held["tests"]), F.lit(-1)).alias("tests"))


_EXAMPLES = "list_aggregate(list_transform({0}[1:3], lambda x, i: 'Example ' || i || chr(10) || 'Input:' || chr(10) || trim(coalesce(x.input, ''), chr(10)) || chr(10) || 'Output:' || chr(10) || trim(coalesce(x.output, ''), chr(10))), 'string_agg', chr(10) || chr(10))"


@query("src12_case_tasks", f"SELECT question_id AS task_id, CASE WHEN len(c) > 0 THEN {_TRIMMED.format('q')} || chr(10) || chr(10) || 'Public examples:' || chr(10) || {_EXAMPLES.format('c')} ELSE q END AS prompt FROM (SELECT question_id, coalesce(question_content, '') AS q, coalesce({_CASES.format('public_test_cases')}, []) AS c FROM eval_questions)")
def src12_cases(spark, d):
    return TK.ADAPTERS["cases"](table(spark, d, "eval_questions"), "questions", "held-out").select("task_id", "prompt")


@query("src12_module_tasks", f"SELECT task_id, coalesce({strip('prompt')}, '') AS prompt, 'module_tests' AS scenario, test FROM func_tasks WHERE test IS NOT NULL")
def src12_module(spark, d):
    t = TK.ADAPTERS["module"](table(spark, d, "func_tasks").where("test is not null"), "modules", "all")
    return t.select("task_id", "prompt", "scenario", F.from_json("tests_metadata", "test string")["test"].alias("test"))


@query("src14_preview", "SELECT row_id, substring(solution, 1, 700) AS head FROM code_instruct ORDER BY row_id, head LIMIT 3")
def src14(spark, d):
    return table(spark, d, "code_instruct").select("row_id", F.substring("solution", 1, 700).alias("head")).orderBy("row_id", "head").limit(3)


@query("snk7_histogram", "WITH v AS (SELECT length(text)::DOUBLE x FROM documents WHERE text IS NOT NULL), s AS (SELECT min(x) lo, (max(x) - min(x)) / 20 w FROM v) SELECT least(floor((x - lo) / w), 19)::INT AS bin, count(*) AS n FROM v, s GROUP BY 1")
def snk7(spark, d):
    from siltworks.sources.io import histogram

    return histogram(table(spark, d, "documents"), F.length("text"), 20).select("bin", "n")


@query("str2_event_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def str2(spark, d):
    from siltworks.streaming.incremental import event_windows

    return event_windows(table(spark, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


# --- code ---------------------------------------------------------------------------------------------------------

@query("udf3_6_symbols", None)
def udf3(spark, d):
    from siltworks.functions import code as C

    pool = table(spark, d, "scored_pool").select("row_id", "tests")
    return pool.select("row_id", F.array_join(C.required_symbols("tests"), ",").alias("symbols"), F.size(C.self_contained("tests")).alias("self_contained"))


@query("arr2_3_pytest_blocks", None)
def arr2(spark, d):
    from siltworks.functions import code as C

    t = table(spark, d, "func_tasks").where("test is not null").select("task_id", C.pytest_asserts("test").alias("a"), C.pytest_blocks("test").alias("b"))
    return t.select("task_id", F.size("a").alias("asserts"), F.size("b").alias("blocks"))


@query("txt12_code_candidate", None)
def txt12(spark, d):
    from siltworks.functions import code as C

    return table(spark, d, "eval_samples").where("raw_output is not null").select("sample_id", C.code_candidate("raw_output").alias("code")).distinct()


@query("udf1_2_rollouts", None)
def udf1(spark, d):
    rollouts = table(spark, d, "eval_samples").where("task_id is not null and raw_output is not null").select("task_id", F.col("sample_id").alias("rollout"), F.col("raw_output").alias("completion")).distinct()
    return RO.score_rollouts(rollouts, table(spark, d, "func_tasks")).select("task_id", "rollout", "passed", "status", "output_chars", "code_chars")


@query("udf7_12_14_rejudged", None)
def udf14(spark, d):
    t = D.keep_last(table(spark, d, "turns").select("run_id", "turn_index", "task_id", "parsed_submit", "logged_at"), ["run_id", "turn_index"], "logged_at")
    return RO.rejudged(t, table(spark, d, "func_tasks")).select("run_id", "turn_index", "status", "error_type")


@query("udf11_differential_audit", None)
def udf11(spark, d):
    solutions = table(spark, d, "eval_samples").select(F.col("sample_id").alias("key"), "task_id", F.col("solution").alias("code")).distinct()
    return RO.audited(solutions, table(spark, d, "func_tasks")).withColumnRenamed("key", "sample_id")
