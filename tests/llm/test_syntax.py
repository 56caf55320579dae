import pytest

from siltworks.llm.grammars import parses, rank_languages
from siltworks.llm.syntax import check_syntax, diagnose, invalid_rates, unwrap

VALID = {
    "python": ["x = 1\n", "async def f():\n    await g()\n", "match x:\n    case 1: pass\n", "type A = int\n"],
    "javascript": [
        "const f = async (a, {b, c = 2}, ...r) => { await g(`x${a}`); };\nfor (const [k, v] of Object.entries(m)) console.log(k, v)\nclass A extends B { #p = 1; static s() { return 1 } get x() { return this.#p } }",
        "let x = a ? b : c ?? d;\nvar r = /ab[/]c/g.test(s) || y / 2;\nif (a) b(); else { c() }\nfor (let i = 0, n = 3; i < n; i++) {}\nexport default function () {}\nimport {a as b} from 'm';",
        "label: while (true) { switch (x) { case 1: break label; default: continue } }\ntry { throw new E() } catch { } finally { }\nx = y => ({a: 1, ...y, [k]: v, m() {}, get z() { return 1 }})\n",
    ],
    "java": [
        "package a.b;\nimport java.util.*;\n@Deprecated public final class A<T extends B & C> extends D<T> implements E {\n  private static final int[] X = {1, 2};\n  A(int... n) throws Ex { this.n = n[0]; }\n  <K> Map<K, List<T>> f(final K k) { for (var e : m.entrySet()) { out.println((int) e.x + \"a\"); } return (a, b) -> a + b; }\n  enum Z { A(1), B { void g() {} }; int q; }\n}\n",
        "class A { int f(Object o) { int r = switch (x) { case 1, 2 -> 3; default -> { yield 4; } }; if (o instanceof String s && s.length() > 2) return 1; try (R q = new R()) { } catch (A | B e) { } List<String>[] l = new List[3]; Runnable z = this::run; do { r++; } while (r < 3); return cond ? 1 : 2; } record P(int a, int b) {} interface I { default void m() {} } }",
    ],
    "cpp": [
        "#include <vector>\n#define MAX(a, b) \\\n  ((a) > (b) ? (a) : (b))\nusing namespace std;\ntemplate <typename T, int N = 3> struct A : public B<T> { A() : x(1), y{2} {} virtual ~A() = default; T operator+(const T& o) const { return x; } private: T x; int y[N]; };\nint main(int argc, char** argv) { std::map<std::string, std::vector<int>> m; for (auto& [k, v] : m) { v.push_back((int)k.size()); } auto f = [&](int a) -> int { return a * 2; }; std::cout << f(3) << R\"(raw ) x)\" << '\\'' << std::endl; int* p = new int[3]; delete[] p; return static_cast<int>(x < 3 ? 1 : 2); }",
        "namespace a { enum class E : int { A, B = 2 }; class C; extern \"C\" { void f(int, ...); } }\nstatic const unsigned long long X = 1'000ULL;\nvoid g() { do { x--; } while (x); switch (x) { case 1: break; default: ; } }",
    ],
    "go": [
        'package main\n\nimport (\n\t"fmt"\n\tm "math"\n)\n\ntype T[K comparable] struct {\n\ta, b int `json:"a"`\n}\n\nfunc (t *T[K]) F(x ...int) (r map[string][]int, err error) {\n\tif v, ok := r["a"]; ok && len(v) > 0 {\n\t\treturn nil, fmt.Errorf("x")\n\t} else if x != nil {\n\t}\n\tfor i, s := range x {\n\t\t_ = []T[int]{{a: 1}, {b: s + i}}\n\t}\n\tgo func() { ch <- <-in }()\n\tdefer t.mu.Unlock()\n\tswitch y := z.(type) {\n\tcase int, *T[int]:\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-c:\n\t\tm.Abs(v)\n\t}\n\treturn\n}\n',
        "package a\n\nvar x, y = 1, 2\nconst (\n\tA = iota\n\tB\n)\n\nfunc f() int { return x[1:2][0] &^ 3 }\n",
    ],
    "rust": [
        "use std::collections::{HashMap, self};\n#[derive(Debug)]\npub struct A<'a, T: Clone + 'a> where T: Copy { pub x: &'a [T], y: Option<Box<dyn Fn(i32) -> i32>> }\nimpl<'a, T> Tr for A<'a, T> { type O = i64; const N: usize = 3; fn f(&mut self, (a, b): (i32, u8)) -> Result<(), String> { let mut v = vec![1, 2]; if let Some(x) = v.get(0) { return Ok(()); } match a { 1..=3 | 7 => {}, n if n > 2 => println!(\"{}\", n), _ => (), } let c = |x: i32| x as f64 * 2.0; for (i, e) in v.iter().enumerate() { *e += 1; } let s = A { x: &[1; 3], ..d }; loop { break 'a'.len_utf8() as i32; }; g::<T>()?; Ok(()) } }\n",
        "fn main() { let x = if a < b { 1 } else { 2 }; while let Some(t) = s.pop() { } let r = &v[1..]; unsafe { f() } }\nmod m { pub(crate) enum E { A(i32), B { x: u8 }, C = 3 } }\ntrait T: Sized { fn f() -> Self; }\n",
    ],
}
INVALID = {
    "python": ["def f(:\n  pass", "print 'x'", "<<<<<<< HEAD\nx = 1"],
    "javascript": ["function f( {", "let x = ;", "if (a { }", "f(a b)", "}", "const x = 'abc", "def f():\n    pass"],
    "java": ["class A { void f() { int x = 1 } }", "class A { void f() { }", "class A { } }", "int x;", "class A { void f() { x + 1; } }", "public static void main() {}"],
    "cpp": ["int f() { return 1 }", "int f() { return (1; }", "int f() {", "int f() { } }", "#inclde <a>\nint x;", "pub fn f() {}"],
    "go": ["func f() {}", "package a\nfunc f() {\n\tx := \n}", "package a\nfunc f() {\n\tif x \n\t{\n\t}\n}", "package a\nfunc f() {", "package a\n}\n"],
    "rust": ["fn f() { let x = 1 let y = 2; }", "fn f( {", "fn f() { x.; }", "fn f() {", "fn f() { } }", "func f() {}"],
}


@pytest.mark.parametrize("lang,text", [(k, t) for k, v in VALID.items() for t in v])
def test_valid(lang, text):
    assert parses(text, lang)


@pytest.mark.parametrize("lang,text", [(k, t) for k, v in INVALID.items() for t in v])
def test_invalid(lang, text):
    assert not parses(text, lang)


def test_deep_nesting_and_odd_input():
    assert not parses("(" * 50_000, "javascript") and not parses("x = " + "(" * 50_000, "python")
    assert parses("", "java") and not parses("\0", "python")


def test_diagnosis():
    go = "package main\n\nfunc f() {\n\tx := 1\n}\n"
    assert diagnose(go, "java") == (False, "go", 1)
    assert diagnose("def f(:", "python") == (False, None, 0)
    js = "function f(a) {\n  let d = 6;\n  return d;\n}\n"
    assert parses(js, "cpp") and diagnose(js, "cpp") == (False, "javascript", 2)
    assert diagnose(js, "JS") == (True, "javascript", 2) and diagnose(js, None) == (True, "javascript", 2)
    assert diagnose("x = 1", "python")[2] > 1
    assert rank_languages(go)[0][0] == "go"


def test_python_is_compiled():
    assert not any(parses(t, "python") for t in ("return 1", "break", "def f():\n    continue", "x = yield", "def f():\n    nonlocal x", "await x"))
    assert parses("x = " + "1 + " * 40_000 + "1", "python") and not parses("x = " + "1 + " * 40_000 + "1)", "python")


@pytest.mark.parametrize("lang,head,tail", [("javascript", "x = ", ";"), ("java", "class A { int x = ", "; }"), ("go", "package a\nvar x = ", "\n"), ("rust", "fn f() { let x = ", "; }"), ("cpp", "int x = ", ";")])
def test_nesting_has_no_limit(lang, head, tail):
    text = head + "(" * 3000 + "1" + ")" * 3000 + tail
    assert parses(text, lang) and not parses(text + ")", lang) and not parses(text.replace("1", "1 1"), lang)


@pytest.mark.parametrize("lang,text", [(k, t) for k, v in (VALID | INVALID).items() for t in v])
def test_first_tokens_decide_nothing_else(lang, text):
    assert all(parses(text, x) == parses(text, x, likely=True) for x in VALID)


def test_unwrap():
    assert unwrap("```python\nx = 1\n```") == "x = 1\n"
    assert unwrap("a ```\nx\n```") == "a ```\nx\n```"
    assert unwrap("```\na\n```\ntext\n```\nb\n```") == "```\na\n```\ntext\n```\nb\n```"


def test_tables(spark):
    rows = [("code_instruct", "1", "PYTHON", "x = 1", "c"), ("code_instruct", "2", "python", "x = = 1", "c"), ("code_instruct", "3", None, None, "c"), ("code_instruct", "4", "go", " \n", "c"), ("code_instruct", "5", "cobol", "x = 1", "c"), ("turns", "a:0", "python", "x = 1\n" * 50_000, "c")]
    df = spark.createDataFrame(rows + rows[:2], "src string, id string, lang string, text string, valid string")
    got = {r.id: r.valid for r in check_syntax(df).collect()}
    assert got == {"1": True, "2": False, "5": True, "a:0": True}
    assert check_syntax(df.limit(0)).count() == 0


def test_rates(spark):
    turns = spark.createDataFrame([("a", 0, "x ="), ("a", 0, "x ="), ("a", 1, "x = 1")], "run_id string, turn_index int, parsed_submit string")
    traces = spark.createDataFrame([("a", ("d",))], "run_id string, task struct<dataset:string>")
    code = spark.createDataFrame([(1, None, "go", "x = 1"), (2, "r", "python", "x = 1")], "row_id long, repo string, lang string, solution string")
    got = {(r.src, r.repo, r.lang): (r.files, r.invalid, r.wrong_language) for r in invalid_rates(turns, traces, code).collect()}
    assert got == {("turns", "d", "python"): (2, 1, 0), ("code_instruct", None, "go"): (1, 1, 1), ("code_instruct", "r", "python"): (1, 0, 0)}
