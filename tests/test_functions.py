import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from siltworks.functions import arrays as A
from siltworks.functions import code as C
from siltworks.functions import text as X
from siltworks.operators import reports as R


def one(spark, c, /, **values):
    kinds = {str: "string", int: "long", float: "double", bool: "boolean"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string') if not isinstance(v, list) else 'array<' + kinds[type(v[0])] + '>' if v else 'array<string>'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema or "x string").select(c.alias("r")).first()["r"]


def test_normalise_and_fingerprint(spark):
    text = "  Ünï_code, (TEXT)!\n\n42  ok "
    norm = " ".join(re.sub(r"[^\w\s]", " ", text.lower()).split())
    assert one(spark, X.normalized("t"), t=text) == norm
    assert one(spark, X.fingerprint("t"), t="Ab " * 300) == hashlib.md5(("ab " * 300)[:200].encode()).hexdigest()
    assert one(spark, X.fingerprint("t"), t=None) is None


def test_strip_takes_all_white_space(spark):
    assert one(spark, X.strip("t"), t="\n\t\xa0 a b 　\r") == "a b"


def test_thoughts(spark):
    t = "<think> a </think>x<THINK></THINK> y<think>\nb\n</think>"
    assert one(spark, X.think_spans("t"), t=t) == "a\n\nb"
    assert one(spark, X.without_thoughts("t"), t="<think>a</think> code") == "code"
    assert one(spark, X.without_thoughts("t"), t="pre <think>open") == "pre"
    assert one(spark, X.after_thoughts("t"), t="a</think> b </think> c") == "b </think> c"


def test_code_extraction(spark):
    fenced = "<think>x</think>text\n```python\nprint(1)\n```\n```\nz\n```"
    assert one(spark, X.fenced_code("t"), t=fenced) == "print(1)"
    assert one(spark, X.fenced_code("t"), t="so def f():\n  pass ") == "def f():\n  pass"
    assert one(spark, X.fenced_code("t"), t="nothing") is None
    assert one(spark, X.lenient_code("t"), t="```PYTHON\nx=1\n```") == "x=1"
    assert one(spark, X.lenient_code("t"), t="```python\n```\ndef f(): pass") is None
    assert one(spark, X.lenient_code("t"), t="```\nprose only\n```\nimport os\nx = 1") == "import os\nx = 1"
    assert one(spark, X.last_fence("t"), t="```py\na\n```\nmore\n```python\nb\r\nc\n```") == "b\nc"
    assert one(spark, X.last_fence("t"), t="see\n  from a import b\nx") == "from a import b\nx"
    assert one(spark, X.last_fence("t"), t="plain") == "plain"


def test_targets_and_solutions(spark):
    for prompt, name in {"def foo(a):": "foo", "assert bar(1) == 2": "bar", "assert not baz(1)": "baz", "assert math.isclose(qux(1), 2)": "qux", "assert (quux (1))": "quux", "nothing": None}.items():
        assert one(spark, X.target_function("p"), p=prompt) == name
    out = "```python\ndef foo(x):\n  return 1\n```\n```python\nfoo(2)\n```"
    assert one(spark, X.assembled_solution("o", "p"), o=out, p="def foo(x):\n") == "def foo(x):\n  return 1"
    assert one(spark, X.assembled_solution("o", "p"), o="  return 1", p="def foo(x):\n") == "def foo(x):\nreturn 1"


@pytest.mark.parametrize(
    "text,think,submit,status,error,warnings",
    [
        ("<think>a</think><submit>x = 1</submit>", "a", "x = 1", "ok", None, []),
        ("<submit> y </submit>", "", "y", "ok", None, []),
        ("no tags", "", "", "format_error", "missing_submit", []),
        ("<submit>open", "", "", "format_error", "incomplete_output", []),
        ("<submit>x</submit><obs>z</obs>", "", "x", "format_error", "model_generated_obs", ["model output contained obs tag after submit"]),
        ("<think>the <obs> tag</think><submit>x</submit>", "the <obs> tag", "x", "ok", None, ["think_mentioned_obs_tag"]),
        ("<submit>```python\nx\n```</submit>", "", "x", "ok", None, ["stripped_markdown_fence"]),
        ("native</think>\n<submit>x</submit>", "native", "x", "ok", None, []),
        ("<submit></submit>", "", "", "format_error", "empty_submit", []),
        ("<think>in <submit>no</submit></think> out", "", "", "format_error", "missing_submit", []),
    ],
)
def test_parsed_submission(spark, text, think, submit, status, error, warnings):
    r = one(spark, X.parsed_submission("t"), t=text)
    assert (r.think, r.submit, r.status, r.error_type, r.warnings) == (think, submit, status, error, warnings)


def test_recovered_submission(spark):
    assert one(spark, X.recovered_submission("t"), t="```python\nx = 1\n```").submit == "x = 1"
    assert one(spark, X.recovered_submission("t"), t="import os\nprint(1)").warnings == ["recovery_code_without_submit_tag"]
    assert one(spark, X.recovered_submission("t"), t="just words").error_type == "missing_submit"


def test_standard_format(spark):
    assert one(spark, X.standard_format("t"), t=" <think>a</think>\n```python\nx\n``` ")
    assert not one(spark, X.standard_format("t"), t="<think>a</think>\n```python\n```")
    assert not one(spark, X.standard_format("t"), t="<think>a</think> so ```python\nx\n```")


def test_small_text_functions(spark):
    assert [one(spark, X.estimated_tokens("t"), t=t) for t in ("", "a", "a" * 9)] == [0, 1, 3]
    assert one(spark, X.preview("t", 10), t="a  b\n" * 9) == "a b a b..."
    assert one(spark, X.middle_cut("t", 1), t="x" * 1200).startswith("x" * 667 + "\n...")
    assert one(spark, X.submit_summary("t", 5), t="a  \n\n b\ncccc") == "a\n b\n" + "\n... [truncated previous submit]"
    assert one(spark, X.duration_text("s"), s=3725) == "1h 02m" and one(spark, X.duration_text("s"), s=63) == "1m 03s"
    assert one(spark, X.shown_indices("i", 2), i=[1, 2, 3]) == "1,2,..."
    assert one(spark, X.with_contract("p", "n"), p="Do it. ", n=["f", "g"]).endswith("`f`, `g`.")
    assert one(spark, X.with_contract("p", "n"), p="Do it.", n=[]) == "Do it."
    assert one(spark, X.quarter_bin(F.lit("2025-05-02").cast("date")), x="") == "2025-Q2"


def _repeats(text, n):
    w = re.findall(r"\w+", text.lower())
    if len(w) < n:
        return 0
    best = 1
    for s in range(len(w) - n + 1):
        k = 1
        while w[s + k * n : s + (k + 1) * n] == w[s : s + n]:
            k += 1
        best = max(best, k)
    return best


def test_ngram_repeats_against_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(30))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for n in (2, 4):
        assert {r.i: r.r for r in df.select("i", X.ngram_repeats("t", n).alias("r")).collect()} == {i: _repeats(t, n) for i, t in enumerate(texts)}


def test_test_lists_and_cases(spark):
    s = '["assert f(1)", " assert g()", "x = 1; assert x", "y"]'
    assert one(spark, A.asserts_at_start("s"), s=s) == ["assert f(1)", "assert g()"]
    assert len(one(spark, A.asserts_anywhere("s"), s=s)) == 3
    for bad in ("nonsense", None, '{"a": 1}'):
        assert one(spark, A.asserts_at_start("s"), s=bad) == [] and one(spark, A.cases("s"), s=bad) == []
    assert one(spark, A.cases("s"), s='[["1", "2"]]')[0].output == "2"
    both = '[{"input": "1", "output": "2", "testtype": " STDIN"}, {"input": "3", "output": "4", "testtype": "functional"}, {"input": "5", "output": "6"}]'
    assert [c.input for c in one(spark, A.stdin_cases(A.cases("s")), s=both)] == ["1", "5"]
    assert [c.input for c in one(spark, A.functional_cases(A.cases("s")), s=both)] == ["3"]


def test_contents(spark):
    for v, text in {'"plain"': "plain", '["a", {"text": "b"}, {"content": "c"}]': "a\nb\nc", '{"text": "d"}': "d", "raw words": "raw words"}.items():
        assert one(spark, A.flattened_content("s"), s=v) == text


def test_pass_at_k_against_counting(spark):
    from math import comb

    for n, c, k in [(8, 0, 1), (8, 8, 4), (8, 3, 1), (8, 3, 2), (8, 3, 4), (5, 4, 3), (2, 1, 3)]:
        want = None if n < k else 1 - comb(n - c, k) / comb(n, k)
        got = one(spark, R.pass_at_k(F.col("n"), F.col("c"), k), n=n, c=c)
        assert got == (pytest.approx(want) if want is not None else None)


def test_length_stats_of_nothing(spark):
    r = R.length_stats(spark.createDataFrame([], "x int"), F.col("x")).first()
    assert r["count"] == 0 and r["mean"] is None and r["max"] is None


PYTEST = """from solution import f
import pytest

def test_one():
    x = 1
    assert f(x) == 2
    pass

def helper():
    return 1

def test_two():
    assert f(0) == 1, \\
        "text"

def test_none():
    x = 3
"""


def test_pytest_modules():
    assert C.assert_lines(PYTEST) == ["assert f(x) == 2", 'assert f(0) == 1, \\']
    assert C.test_blocks(PYTEST) == ["x = 1\nassert f(x) == 2", 'assert f(0) == 1, \\\n    "text"']


def test_symbols():
    tests = ["assert f(1) == g(2)", "x = math.sqrt(2)\nassert f(x)", "assert len(y)", "broken ("]
    assert C.symbols_needed(tests) == ["f", "g"]
    assert C.standing_alone(tests) == tests[:2]
    assert C.bound_names("import a.b as c\nfrom d import e\ndef f(p): pass\ntry: pass\nexcept E as g: h = 1") == {"c", "e", "f", "g", "h"}


def test_trimmed_code():
    assert C.trimmed_code("Here it is:\nimport os\ndef f():\n    return 1\n\nThis returns one.") == "import os\ndef f():\n    return 1"
    assert C.trimmed_code("words only") == ""


def test_judges():
    code = "def f(x):\n    return x + 1"
    assert C.passes(code, ["assert f(1) == 2"]) and not C.passes(code, []) and C.passes(code, [], empty_passes=True) and not C.passes("def f(:", ["assert 1"])
    assert C.judge_functions("while True: pass", ["1"], timeout=1)["error_type"] == "timeout"
    assert C.judge_functions(code, ["assert f(1) == 2", "assert f(1) == 3", "1/0"]) == {"status": "fail", "error_type": "wrong_answer", "passed": 1, "failed": 2}
    assert C.judge_stdio("print(int(input()) * 2)", [{"input": "2\n", "output": "4 \n"}, {"input": "3", "output": "7"}])["error_type"] == "wrong_answer"
    assert C.judge_calls("class Solution:\n    def g(self, a, b):\n        return [a, b / 3]", "g", [{"input": "true\n1", "output": "[true, 0.33333333]"}])["status"] == "pass"
    assert C.judge_differential("def f(x): return x", "def f(x): return abs(x)", "f", [1, [2]])["status"] == "pass"
    assert C.judge_differential("def f(x): return x", "def f(x): return abs(x)", "f", [-1])["error_type"] == "wrong_answer"
    module = "from solution import f\nimport pytest\n@pytest.mark.parametrize('a,b', [(1, 2), (2, 3)])\ndef test_a(a, b):\n    assert f(a) == b\ndef test_b():\n    with pytest.raises(TypeError):\n        f('x')\ndef test_c():\n    assert f(0.1) == pytest.approx(1.1)\n"
    assert C.judge_module(code, module) == {"status": "pass", "error_type": None, "passed": 3, "failed": 0}
    assert C.judge_module("def f(x): return x", module)["status"] == "fail"


def test_names_come_from_scopes_and_calls_from_one_walk():
    assert C.bound_names("def (") == set()
    assert C.symbols_needed(["assert a.b(c)(d) and e.f()", "for g in h(): g()"]) == ["a", "e", "h"]
    assert C.symbols_needed(["with tempfile.TemporaryDirectory() as t: unittest.main(); pathlib.Path(t); sqlite3.connect(t)"]) == []


def test_code_is_told_by_lines_and_words(spark):
    for line, yes in {"def f(": True, "class A:": True, "import os": True, "from a import b": True, "from here we import": False, "define x": False, "import": False, " def f": False, "from a import": False}.items():
        assert one(spark, X.opens_code(F.col("s")), s=line) is yes, line
    assert one(spark, X.holds_code(F.col("s")), s="so (import os)") and not one(spark, X.holds_code(F.col("s")), s="a class")
    assert one(spark, X.last_fence("t"), t="```\n\n```\nThen\n```python\nx = 1") == "x = 1"
    assert one(spark, X.last_fence("t"), t="see\n  if __name__ == '__main__':\n    f()").startswith("if __name__")
    block = "```python\ndef g(): pass\n```\n```python\ndef f(): pass\n```\n```python\nx = 1\n```"
    assert one(spark, X.best_block("t", F.lit("f")), t=block) == "def f(): pass" and one(spark, X.best_block("t", F.lit("q")), t=block) == "def f(): pass"
    assert one(spark, X.best_block("t", F.lit("f")), t="```\na\n```\n```\nb\n```") == "b"
    assert one(spark, X.recovered_submission("t"), t="n = int(sys.stdin.read())").status == "ok" and one(spark, X.recovered_submission("t"), t="just words").error_type == "missing_submit"


def test_messages_and_lists(spark):
    m = [("system", "s"), ("user", "ask "), ("user", "more")]
    df = spark.createDataFrame([(m, ["f"], [], None)], "m array<struct<role:string,content:string>>, n array<string>, e array<string>, z array<string>")
    r = df.select(A.with_contract_message("m", "n").alias("m"), A.first_filled(F.col("z"), F.col("e"), F.col("n")).alias("l"), A.first_filled(F.col("z")).alias("none"), A.prompt_messages("sys", F.lit("q"), F.col("n")).alias("p")).first()
    assert r.m[1].content == "ask\n\nYour solution must define these top-level names: `f`." and r.m[2].content == "more"
    assert r.l == ["f"] and r.none == [] and r.p[0].content == "sys" and "`f`" in r.p[1].content
    assert one(spark, A.stringified(F.struct(F.lit(1).alias("b"), F.lit("x").alias("a")), False), q=1) == '{"a":"x","b":1}'


def test_judges_on_frames(spark):
    case = "array<struct<input:string,output:string>>"
    df = spark.createDataFrame(
        [(1, "print(int(input()) * 2)", [("2", "4"), ("3", "6")], "f"), (2, "print(1", [("2", "4")], "f"), (3, "print(0)", [("2", "4")], "f")], f"id int, code string, cases {case}, name string"
    )
    got = {r.id: (r.v.status, r.v.error_type, r.v.passed) for r in df.select("id", C.stdio_verdict("code", "cases").alias("v")).collect()}
    assert got == {1: ("pass", None, 2), 2: ("fail", "syntax_error", 0), 3: ("fail", "wrong_answer", 0)}
    calls = spark.createDataFrame([(1, "def f(a): return a + 1", [("1", "2")], "f"), (2, "class Solution:\n    def f(self, a): return a", [("1", "2")], "f")], f"id int, code string, cases {case}, name string")
    assert {r.id: r.v.status for r in calls.select("id", C.call_verdict("code", "name", "cases").alias("v")).collect()} == {1: "pass", 2: "fail"}
    pair = spark.createDataFrame([(1, "def f(x): return x", "def f(x): return abs(x)", "f", "[1, [2]]"), (2, "def f(x): return x", "def f(x): return abs(x)", "f", "[-1]")], "id int, code string, other string, name string, inputs string")
    assert {r.id: r.v.error_type for r in pair.select("id", C.differential_verdict("code", "other", "name", "inputs").alias("v")).collect()} == {1: None, 2: "wrong_answer"}
    module = spark.createDataFrame([("def f(x): return x + 1", "from solution import f\ndef test_a():\n    assert f(1) == 2\ndef test_b():\n    assert f(1) == 3\n")], "code string, tests string")
    v = module.select(C.module_verdict("code", "tests").alias("v")).first().v
    assert (v.status, v.passed, v.failed) == ("fail", 1, 1)
    C.register_all(spark)
    assert spark.sql("SELECT runs_all('x = 1', array('assert x == 1')) AS ok").first().ok


def test_a_killed_process_is_resumed():
    assert C.judge_functions("def f(x):\n    while x: pass\n    return 1", ["assert f(0) == 1", "f(1)", "assert f(0) == 2"], timeout=1) == {"status": "fail", "error_type": "timeout", "passed": 1, "failed": 2}


def test_tests_of_any_shape(spark):
    assert one(spark, A.normalised_tests(F.col("t"), True), t="assert 1") == ["assert 1"] and one(spark, A.normalised_tests(F.col("t"), True), t=" ") == []
    df = spark.createDataFrame([(["a", " ", None],), (None,)], "t array<string>")
    assert [r.t for r in df.select(A.normalised_tests(F.col("t"), False).alias("t")).collect()] == [["a"], []]
