import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from siltworks.operators import dedup as D
from siltworks.operators import rollouts as RO
from siltworks.operators import sampling as S
from siltworks.operators import tasks as TK
from siltworks.operators import traces as TR
from siltworks.operators.filters import Rule, length_window, rule_counts
from siltworks.plans import catalogue, pipelines
from siltworks.sources import io
from siltworks.streaming import incremental as I


def test_rule_counts_add_up(spark):
    df = spark.createDataFrame([(1,), (5,), (50,), (None,), (500,)], "x int")
    got = {r.rule: (r.reached, r.dropped) for r in rule_counts(df, [Rule("null", F.col("x").isNull()), Rule("small", F.col("x") < 10), Rule("never", F.col("x") < 0)]).collect()}
    assert got == {"null": (5, 1), "small": (4, 2), "never": (2, 0), "kept": (2, 2)}


def test_keep_and_check(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 3), (None, 4)], "k string, v int")
    assert {(r.k, r.v) for r in D.keep_first(df, ["k"], ["v"]).collect()} == {("a", 1), (None, 3)}
    assert {(r.k, r.v) for r in D.keep_last(df, ["k"], "v").collect()} == {("a", 2), (None, 4)}
    with pytest.raises(ValueError):
        D.require_unique(df, ["k"])
    with pytest.raises(ValueError):
        D.require_all(df, df.where("v = 0"), "k")


def _greedy(sizes, target):
    if sum(sizes.values()) <= target:
        return dict(sizes)
    total = sum(sizes.values())
    got = {g: int(len(sizes) <= target) for g in sizes}
    while sum(got.values()) < target:
        g = max((g for g in sizes if got[g] < sizes[g]), key=lambda g: (sizes[g] / total * target - got[g], sizes[g] - got[g], g))
        got[g] += 1
    return got


def test_greedy_strata_against_the_loop(spark):
    rng = random.Random(8)
    for _ in range(6):
        sizes = {f"s{i}": rng.randint(1, 20) for i in range(rng.randint(1, 6))}
        target = rng.randint(1, 40)
        rows = [(i, s) for i, s in enumerate(itertools.chain.from_iterable([g] * n for g, n in sizes.items()))]
        got = S.greedy_stratified(spark.createDataFrame(rows, "id long, stratum string"), "stratum", target, "id").groupBy("stratum").count().collect()
        assert {r.stratum: r["count"] for r in got} == {g: n for g, n in _greedy(sizes, target).items() if n}


def test_largest_remainder_golden():
    # fixed values: sizes and places of nine groups of contest questions
    sizes = {("a", "easy"): 183, ("a", "medium"): 174, ("a", "hard"): 245, ("l", "easy"): 135, ("l", "medium"): 207, ("l", "hard"): 102, ("c", "easy"): 4, ("c", "medium"): 2, ("c", "hard"): 3}
    assert list(S.largest_remainder(sizes, 50).values()) == [8, 8, 11, 6, 9, 5, 1, 1, 1]
    with pytest.raises(ValueError):
        S.largest_remainder(sizes, 5)


def test_quotas_fill_up(spark):
    df = spark.createDataFrame([(i, "a" if i < 70 else "b", i % 3) for i in range(100)], "id long, g string, b int")
    q = S.group_quotas(df, ["g"], 10)
    assert {(r.g, r.quota) for r in q.collect()} == {("a", 7), ("b", 3)}
    picked = S.round_robin(df, ["g"], "b", q, "id").collect()
    assert len(picked) == 10 and {sum(r.g == "b" and r.b == k for r in picked) for k in range(3)} == {1}


def test_shuffle_is_a_permutation(spark):
    got = {r.id: r.shuffle_pos for r in S.shuffle_positions(spark.range(500), "id").collect()}
    assert sorted(got.values()) == list(range(500)) and any(i != p for i, p in got.items())


def test_equal_buckets_fill_in_order(spark):
    df = spark.createDataFrame([(i, 1) for i in range(20)] + [(100 + i, 2) for i in range(2)] + [(200 + i, 3) for i in range(20)], "id long, b int")
    got = S.equal_buckets(df, "b", [1, 2, 3], 16, "id").groupBy("b").count().collect()
    assert {r.b: r["count"] for r in got} == {1: 9, 2: 2, 3: 5}


TURN = "run_id string, turn_index int, raw_output string, parsed_think string, parsed_submit string, parse_status string, obs_for_model string, obs_full string, finish_reason string, recovery_used boolean, logged_at int"


def _turn(run, i, status, error="wrong_answer", submit="x", parse="ok", finish="stop", recovery=False, at=0):
    return (run, i, "", "t" if i else "", submit, parse, f"o{i}", json.dumps({"status": status, "error_type": error}), finish, recovery, at)


def test_traces(spark):
    turns = [
        *(_turn("good", i, s) for i, s in enumerate(["fail", "fail", "pass"])),
        _turn("good", 2, "fail", at=-1),  # an older delivery
        *(_turn("late", i, s) for i, s in enumerate(["pass", "fail", "fail"])),
        *(_turn("unclean", i, "fail", finish="length") for i in range(2)),
        *(_turn("many", i, "fail") for i in range(4)),
        _turn("few", 0, "fail"),
        _turn("empty", 0, "pass", submit=""),
        _turn("empty", 1, "fail"),
    ]
    runs = spark.createDataFrame([(r, ("p",), "pass") for r in ("good", "late", "unclean", "many", "few", "empty", "none")], "run_id string, task struct<prompt:string>, final_status string")
    t = TR.assembled(runs.union(runs.limit(2)), spark.createDataFrame(turns, TURN))
    got = {r.run_id: r for r in t.select("run_id", TR.prefix_choice(F.col("turns")).alias("p"), TR.final_status(F.col("turns")).alias("f"), TR.tagged_text(F.col("task.prompt"), F.col("turns")).alias("x"), TR.compact_text(F.col("task.prompt"), F.col("turns")).alias("c")).collect()}
    assert len(got) == 7
    assert {k: r.p.outcome for k, r in got.items()} == {"good": "selected", "late": "skipped_pass_or_too_few_failures", "unclean": "skipped_unclean", "many": "skipped_too_many_failures", "few": "skipped_pass_or_too_few_failures", "empty": "skipped_unclean", "none": "skipped_pass_or_too_few_failures"}
    assert got["good"].p.keep == 1 and got["good"].f == "pass" and got["none"].f == "running"
    assert got["few"].x == "<input>p</input>\n<submit>x</submit>\n<obs>o0</obs>" and got["none"].x == "<input>p</input>"
    assert got["good"].c.startswith('<input>p</input>\n<submit_summary turn="0">x</submit_summary>') and got["good"].c.endswith("<obs>o2</obs>")


def test_json_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1, "y": "a"}\nbroken\n\n{"x": 2}\n')
    schema = "x int, y string"
    assert io.read_json_lines(spark, str(tmp_path / "a.jsonl"), schema).where("x is not null").count() == 2
    with pytest.raises(Exception):
        io.read_json_lines(spark, str(tmp_path / "a.jsonl"), schema, strict=True).collect()
    (tmp_path / "list.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "object.json").write_text('{"x": 1}')
    assert io.read_json_document(spark, str(tmp_path / "list.json"), schema).count() == 2
    with pytest.raises(ValueError):
        io.read_json_document(spark, str(tmp_path / "object.json"), schema)
    df = spark.createDataFrame([(1, "é", "pass"), (2, "b", "fail")], "x int, y string, s string")
    io.write_json_lines(df, str(tmp_path / "out"))
    io.write_json_lines(df, str(tmp_path / "out"), append=True)
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    io.write_fan_out(df, {str(tmp_path / "p1"): ["x"], str(tmp_path / "p2"): ["y", "s"]})
    assert spark.read.json(str(tmp_path / "p2")).columns == ["s", "y"]
    io.write_routed(df, str(tmp_path / "routed"), F.col("s"))
    assert (tmp_path / "routed" / "route=fail").is_dir()
    df.write.parquet(str(tmp_path / "one"))
    both = io.read_splits(spark, [str(tmp_path / "one"), str(tmp_path / "missing")])
    assert both.count() == 2
    with pytest.raises(FileNotFoundError):
        io.read_splits(spark, [str(tmp_path / "missing")])
    io.write_json_atomically(str(tmp_path / "r.json"), {"a": "é"})
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": "é"} and not list(tmp_path.glob("*.tmp"))
    names = {r.path for r in io.file_manifest(spark, str(tmp_path / "routed")).collect()}
    assert any(n.startswith("route=fail/") for n in names)


def test_complex_round_trip(spark):
    df = spark.createDataFrame([((1.0, -2.0),), (None,)], "c struct<real:double,imag:double>")
    got = df.select(io.decode_complex(io.encode_complex(F.col("c"))).alias("c")).collect()
    assert got[0].c.imag == -2.0 and got[1].c is None


def test_subset_ids_and_config(spark, tmp_path):
    assert io.subset_ids({"question_ids": [1, 2]}) == io.subset_ids({"questions": [{"question_id": 1}, {"question_id": 2}]}) == io.subset_ids(["1", {"question_id": 2}]) == ["1", "2"]
    with pytest.raises(ValueError):
        io.subset_ids([1, 1])
    assert io.subset_frame(spark, ["b", "a"]).orderBy("place").first().question_id == "b"
    for name, text in {"c.json": '{"max_turns": 5, "compact": false}', "c.toml": "max_turns = 5\ncompact = false", "c.yaml": "# c\nmax_turns: 5 # five\ncompact: false\n"}.items():
        (tmp_path / name).write_text(text)
        c = io.read_config(str(tmp_path / name))
        assert (c.max_turns, c.compact, c.feedback) == (5, False, "public")
    (tmp_path / "bad.json").write_text('{"nope": 1}')
    with pytest.raises(ValueError):
        io.read_config(str(tmp_path / "bad.json"))


def test_scoring_resumes_and_stops(spark, tmp_path):
    pool = spark.range(100).withColumnRenamed("id", "uid")
    seen = []

    def score(df):
        seen.append(df.count())
        return df.select("uid", (F.col("uid") % 2 == 0).alias("ok"))

    log = str(tmp_path / "log")
    n = I.score_incrementally(pool, log, "uid", score, F.col("ok"), wanted=10, batch_rows=20)
    assert 10 <= n < 50 and len(seen) < 5
    assert I.score_incrementally(pool, log, "uid", score, F.col("ok"), batch_rows=20) == 50
    rows = spark.read.parquet(log)
    assert rows.count() == rows.select("uid").distinct().count() == 100


def test_streams(spark, tmp_path):
    src = str(tmp_path / "src")
    events = spark.createDataFrame([(1, "2025-01-01 00:00:00", 1, "a", 1.0), (2, "2025-01-01 00:10:00", 1, "a", 2.0), (3, "2025-01-02 03:00:00", 1, "b", 4.0), (3, "2025-01-02 03:00:00", 1, "b", 4.0)], "event_id long, ts string, user_id long, event_type string, value double")
    events.write.parquet(src)
    stream = I.replay(spark, src, events.schema)
    for _ in range(2):  # the second run finds nothing new
        q = I.append_new(stream, str(tmp_path / "log"), "event_id", str(tmp_path / "ck"))
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3
    assert {(r.event_type, r.n, r.total) for r in I.event_windows(events).collect()} == {("a", 2, 3.0), ("b", 2, 8.0)}
    assert sorted(r.n for r in I.sessions(events).collect()) == [2, 2]
    q = I.event_windows(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").count() == 2


def test_pipelines(spark):
    rows = spark.createDataFrame([(i, f"question {i // 2}", "a" * (30 + i)) for i in range(60)], "id long, q string, a string")
    mix = pipelines.instruction_mix(rows, "q", "a", "id", 10)
    assert mix.count() == 10 and mix.first().messages[1].role == "assistant"
    a = spark.createDataFrame([(f"a{i}", "A", f"Question number {i}", ["assert 1", "assert 2"]) for i in range(20)] + [("a99", "A", "Question number 3", ["assert 1", " "])], "uid string, source string, question string, tests array<string>")
    b = a.selectExpr("concat('b', uid) uid", "'B' source", "question", "tests")
    known = a.where("uid = 'a1'").select(pipelines.X.fingerprint("question").alias("fp"))
    pool = pipelines.candidate_pool(a, b, known, 5).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in pool} == {"A": 5, "B": 14}


def test_flagship(spark):
    got = catalogue.flagship(spark, "/root/testdata/sf0.001").collect()
    assert 0 < len(got) <= 100 and len({r.fp for r in got}) == len(got)


def test_top_rows_by_steps(spark):
    df = spark.range(5000).withColumn("x", F.col("id") % 97)
    want = [r.id for r in df.orderBy(F.desc("x"), "id").limit(777).collect()]
    got = S.top_rows(df, 777, F.col("x").cast("double"), [F.desc("x"), F.col("id")], few=10, steps=50)
    assert sorted(r.id for r in got.collect()) == sorted(want)
    assert S.top_rows(df, 9999, F.col("x").cast("double"), [F.desc("x"), F.col("id")], few=10).count() == 5000
    assert S.top_rows(df.limit(0), 20, F.col("x").cast("double"), [F.desc("x")], few=10).count() == 0


def test_numbered(spark):
    got = S.numbered(spark.createDataFrame([(i * 7 % 101,) for i in range(100)], "k int"), "k").collect()
    assert [r.place for r in sorted(got, key=lambda r: r.k)] == list(range(100))


def test_missing_keys_fail_the_job(spark):
    ids, rows = spark.createDataFrame([(1, 0), (3, 1)], "k int, place int"), spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert D.ordered_subset(rows, ids, "k", tolerant=True).count() == 1
    with pytest.raises(Exception, match="missing k 3"):
        D.ordered_subset(rows, ids, "k").collect()
    assert [r.v for r in D.ordered_subset(rows, ids.where("k = 1"), "k").collect()] == ["a"]


def test_rollouts_and_rejudged_turns(spark):
    fence = "```python\ndef f(x):\n    return x + {}\n```"
    rows = [("t", 0, fence.format(1)), ("t", 1, fence.format(2)), ("t", 2, "no code"), ("t", 3, fence.format(1)), ("u", 0, fence.format(1))]
    scored = RO.score_rollouts(spark.createDataFrame(rows, "task_id string, rollout int, completion string"), spark.createDataFrame([("t", ["assert f(1) == 2"])], "task_id string, tests array<string>"))
    got = {(r.task_id, r.rollout): (r.passed, r.status, r.code_chars > 0) for r in scored.collect()}
    assert got == {("t", 0): (True, "pass", True), ("t", 1): (False, "fail", True), ("t", 2): (False, "no_code", False), ("t", 3): (True, "pass", True), ("u", 0): (False, "fail", True)}
    t = {r.task_id: r for r in RO.rollout_summary(scored).collect()}["t"]
    assert (t.pass_count, t.pass_rate, t.passed_indices) == (2, 0.5, [0, 3]) and t.slowest > 0
    turns = spark.createDataFrame([("a", 0, "t", "def f(x): return x + 1"), ("a", 1, "t", "def f(x): return x"), ("a", 2, "t", None), ("a", 3, "v", "x")], "run_id string, turn_index int, task_id string, parsed_submit string")
    again = RO.rejudged(turns, spark.createDataFrame([("t", ["assert f(1) == 2"]), ("v", [])], "task_id string, tests array<string>")).collect()
    assert {r.turn_index: (r.status, r.error_type) for r in again} == {0: ("pass", None), 1: ("fail", "wrong_answer"), 2: ("fail", "format_error"), 3: (None, None)}


def test_slices_carry_refreshed_observations(spark):
    turns = [_turn("r", 0, "fail"), _turn("r", 1, "pass", submit="")]
    runs = spark.createDataFrame([("r", ("p",), "pass")], "run_id string, task struct<prompt:string>, final_status string")
    kept = TR.assembled(runs, spark.createDataFrame(turns, TURN)).select(TR.sliced(F.col("turns"), F.lit(2)).alias("t")).select(F.col("t"), TR.final_status(F.col("t")).alias("f")).first()
    assert json.loads(kept.t[1].obs_full) == {"status": "fail", "error_type": "format_error"} and kept.f == "fail"


def test_evaluation_files_and_versions(spark, tmp_path):
    graded = spark.createDataFrame([("q1", ["x"], [True], "easy"), ("q2", ["y", "z"], [True, False], "hard")], "id string, codes array<string>, passed array<boolean>, level string")
    summary = io.write_evaluation(graded, str(tmp_path / "run"), "id", "codes", "passed", ["level"])
    assert summary == {"items": 2, "pass_at_1": 0.75, "by_level": {"easy": 1.0, "hard": 0.5}}
    assert json.loads((tmp_path / "run_score_summary.json").read_text()) == summary
    assert spark.read.json(str(tmp_path / "run_eval")).count() == 2 and {p.name for p in tmp_path.iterdir()} == {"run_output", "run_eval", "run_eval_all", "run_score_summary.json"}
    graded.write.parquet(str(tmp_path / "v5.parquet"))
    assert io.read_version(spark, str(tmp_path), "named", "v5", limit=1).count() == 1
    with pytest.raises(FileNotFoundError):
        io.resolve_version(spark, str(tmp_path), "named", "v6")


def test_length_window_without_bounds(spark):
    df = spark.createDataFrame([("q", "a"), ("", "a"), (None, "a"), ("q" * 90, "a" * 60)], "q string, a string")
    assert df.where(length_window(F.col("q"), F.col("a"), 0, 0, -1)).count() == 2 and df.where(length_window(F.col("q"), F.col("a"), 2, 150)).count() == 1


def test_task_adapters(spark):
    case = '[{"input": "1\\n", "output": "2"}, {"input": "3", "output": "4", "testtype": "functional"}]'
    rows = spark.createDataFrame([("q", " Ask \n", case, "[]", " def f(): ", "{}"), ("p", "x", "junk", None, None, None)], "question_id string, question_content string, public_test_cases string, private_test_cases string, starter_code string, metadata string")
    t = {r.task_id: r for r in TK.ADAPTERS["cases"](rows, "b", "d").collect()}
    assert t["q"].prompt == " Ask\n\nPublic examples:\nExample 1\nInput:\n1\nOutput:\n2\n\nExample 2\nInput:\n3\nOutput:\n4" and t["p"].prompt == "x" and t["q"].language == "python"
    kept = TK.question_rows(rows).collect()
    assert [(r.question_id, r.question_content, len(r.public_test_cases)) for r in kept] == [("q", " Ask\n\nStarter code:\ndef f():", 1)] and "private_test_cases" not in kept[0]
    assert len(TK.question_rows(rows, stdin_only=False, include_private=True).first().public_test_cases) == 2
    modules = spark.createDataFrame([("a", "q", "t", "s", "easy", 0.5), ("b", "q", "t", "s", "easy", None), ("c", "q", " ", "s", "easy", 0.9), ("d", "q", "t", "z", "hard", 0.9)], "id string, question string, test string, subset string, gpt_difficulty string, gpt_pass_percentage double")
    assert [r.id for r in TK.module_rows(modules, "s", "easy", 0.4).collect()] == ["a"] and TK.module_rows(modules).count() == 3
    m = TK.ADAPTERS["module"](modules, "b", "d").first()
    assert m.scenario == "module_tests" and json.loads(m.tests_metadata) == {"test": "t", "subset": "s", "difficulty": "easy"}
    assert TK.ADAPTERS["functions"](modules, "b", "d").first().prompt == "q"


def test_differential_audit(spark):
    tasks = spark.createDataFrame([("t", "def f(x): return abs(x)", "f", "[[1], [2]]", "[[-3]]"), ("n", None, "f", "[[1]]", None)], "task_id string, canonical_solution string, entry_point string, base_input string, plus_input string")
    solutions = spark.createDataFrame([(1, "t", "def f(x): return x"), (2, "t", "def f(x): return abs(x)"), (3, "t", None), (4, "n", "def f(x): return x"), (5, "t", "def f(x): return x")], "key int, task_id string, code string")
    got = {r.key: (r.status, r.base_status, r.plus_status, r.base_passed, r.plus_passed) for r in RO.audited(solutions, tasks).collect()}
    assert got == {1: ("pass", "pass", "fail", 2, 2), 2: ("pass", "pass", "pass", 2, 3), 5: ("pass", "pass", "fail", 2, 2)}
    assert {r.key: (r.status, r.error_type) for r in RO.audited(solutions, tasks, "hidden").collect()}[1] == ("fail", "wrong_answer")


def test_replay_stops_after_a_failed_recovery(spark):
    ok = "<submit>x = 1</submit>"
    rows = [("a", 0, ok, "stop", None), ("a", 1, "<submit>cut", "length", "still nothing"), ("a", 2, ok, "stop", None), ("b", 0, "<submit>cut", "length", "x = 1\nprint(x)"), ("b", 1, ok, "stop", None)]
    got = {(r.run_id, r.turn_index): (r.recovered, r.status) for r in TR.replayed(spark.createDataFrame(rows, "run_id string, turn_index int, raw_output string, finish_reason string, recovery_raw_output string")).collect()}
    assert got == {("a", 0): (False, "ok"), ("a", 1): (True, "format_error"), ("b", 0): (True, "ok"), ("b", 1): (False, "ok")}
