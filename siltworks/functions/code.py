"""Functions that have to look into Python code, as Arrow UDFs; and a runner for untrusted code.

The runner gives each program a process of its own group in an empty folder, with limits on CPU time, memory and file size and a bare
environment, and kills the group on timeout. The processes are forked from a warm interpreter (`keeper`). It is no hardened sandbox.
"""

from __future__ import annotations

import ast
import builtins
import json
import os
import re
import signal
import subprocess
import symtable
import sys
import tempfile
import textwrap
import time
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions import keeper as K

BUILTINS = frozenset(dir(builtins)) | {"True", "False", "None"}
#: Names that tests may use without importing them.
KNOWN_MODULES = frozenset(
    "collections datetime functools heapq itertools json math np numpy operator os pd pandas pathlib pytest random re sqlite3 statistics sys tempfile unittest".split()
)


def _tree(code: str) -> ast.AST | None:
    try:
        return ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def bound_names(code: str) -> set[str]:
    """Names that a text imports, defines or assigns in any of its scopes, parameters left out; none if it does not compile to scopes."""
    try:
        scopes = [symtable.symtable(code, "text", "exec")]
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return set()
    names: set[str] = set()
    while scopes:
        scope = scopes.pop()
        names.update(s.get_name() for s in scope.get_symbols() if (s.is_assigned() or s.is_imported() or s.is_namespace()) and not s.is_parameter())
        scopes.extend(scope.get_children())
    return names


class _Uses(ast.NodeVisitor):
    """The names that a tree reads and those at the head of what it calls, in one walk."""

    def __init__(self, tree: ast.AST):
        self.read: set[str] = set()
        self.called: Counter[str] = Counter()
        self.visit(tree)

    def visit_Name(self, node: ast.Name) -> None:
        if isinstance(node.ctx, ast.Load):
            self.read.add(node.id)

    def visit_Call(self, node: ast.Call) -> None:
        head = ast.unparse(node.func).partition(".")[0]
        if head.isidentifier():
            self.called[head] += 1
        self.generic_visit(node)


def symbols_needed(tests: list[str]) -> list[str]:
    """Names that tests call but do not bind, most frequent first, then by name; tests that do not parse are passed over."""
    counts: Counter[str] = Counter()
    for test in tests:
        tree = _tree(test)
        if tree is not None:
            own = bound_names(test) | BUILTINS | KNOWN_MODULES
            counts.update({n: k for n, k in _Uses(tree).called.items() if n not in own})
    return sorted(counts, key=lambda n: (-counts[n], n))


def standing_alone(tests: list[str]) -> list[str]:
    """Tests that parse and read no name but their own, the needed symbols, builtins and known modules."""
    needed = set(symbols_needed(tests)) | BUILTINS | KNOWN_MODULES

    def alone(test: str) -> bool:
        tree = _tree(test)
        return tree is not None and _Uses(tree).read <= needed | bound_names(test)

    return [t for t in tests if alone(t)]


_TEST_HEAD = re.compile(r"def test_\w+\s*\(")


def _test_bodies(text: str) -> list[list[str]]:
    """Lines of the body of each test function of a module of tests, imports of the solution left out."""
    bodies: list[list[str]] = []
    inside = False
    for line in text.splitlines():
        bare = line.strip()
        if not bare or bare.startswith(("from solution import", "import solution")):
            continue
        if _TEST_HEAD.match(bare):
            bodies.append([])
            inside = True
        elif inside and not line[0].isspace():
            inside = False
        elif inside:
            bodies[-1].append(line.removeprefix("    ").rstrip())
    return bodies


def assert_lines(text: str) -> list[str]:
    """The assert lines of all test functions, the first line of each."""
    return [b.strip() for body in _test_bodies(text) for b in body if b.strip().startswith("assert")]


def test_blocks(text: str) -> list[str]:
    """The body of each test function that asserts something, with its set-up lines."""
    kept = ([b for b in body if b.strip() not in ("pass", "...")] for body in _test_bodies(text))
    return ["\n".join(body).strip() for body in kept if any(b.strip().startswith("assert") for b in body)]


test_blocks.__test__ = False


def trimmed_code(text: str) -> str:
    """From the first import or definition on, up to the first line outside strings that cannot be code at the top level."""
    lines = text.splitlines()
    start = next((i for i, s in enumerate(lines) if re.match(r"\s*(?:from\s+\S+\s+import|import\s+\S|(?:async\s+)?def\s+\w|class\s+\w|@\w)", s)), None)
    if start is None:
        return ""
    kept: list[str] = []
    quote = ""
    for s in lines[start:]:
        code_like = quote or not s.strip() or s[0].isspace() or re.match(r"(?:from|import|def|class|async|if|elif|else|for|while|try|except|finally|with|return|raise|assert|print|pass|@|#|[)\]}]|\w[\w.,\s\[\]'\"]*\s*(?:[-+*/%|&^]?=|\()|['\"])", s)
        if not code_like:
            break
        kept.append(s)
        for mark in re.findall(r'"""|\'\'\'', s):
            quote = "" if quote == mark else quote or mark
    while kept:
        code = textwrap.dedent("\n".join(kept)).strip()
        if _tree(code) is not None:
            return code
        kept.pop()
    return textwrap.dedent("\n".join(lines[start:])).strip()


def _limits() -> None:
    import resource

    resource.setrlimit(resource.RLIMIT_CPU, (K.CPU, K.CPU))
    resource.setrlimit(resource.RLIMIT_FSIZE, (K.FILE, K.FILE))
    resource.setrlimit(resource.RLIMIT_AS, (K.MEMORY, K.MEMORY))


def _afresh(path: str, folder: str, stdin: str, timeout: float) -> tuple[str, str, str]:
    """A run that starts an interpreter of its own."""
    process = subprocess.Popen(
        [sys.executable, "-I", path], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, cwd=folder, text=True, encoding="utf-8", errors="replace", start_new_session=True, preexec_fn=_limits, env=_ENV | {"HOME": folder}
    )
    try:
        out, err = process.communicate(stdin, timeout=timeout)
        return f"exit {process.returncode}", out[-K.OUT :], err[-K.ERR :]
    except subprocess.TimeoutExpired:
        try:
            os.killpg(process.pid, signal.SIGKILL)
        except ProcessLookupError:
            pass
        out, err = process.communicate()
        return "timeout", out[-K.OUT :], err[-K.ERR :]


_ENV = {"PATH": "/usr/bin:/bin"}
_keepers: list[K.Keeper] = []


def run_python(program: str, stdin: str = "", timeout: float = 5.0) -> tuple[str, str, str]:
    """(ended: 'exit 0' | 'exit n' | 'timeout', stdout, stderr)."""
    ended, out, err = _run(program, stdin, timeout)
    return (ended, "", "") if ended == "timeout" else (ended, out, err)


def _run(program: str, stdin: str, timeout: float) -> tuple[str, str, str]:
    """With the output up to a timeout. A program that ends the warm interpreter is run again without one."""
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "program.py")
        with open(path, "wb") as f:
            f.write(program.encode("utf-8", "surrogatepass"))
        if _keepers and _keepers[0].owner != os.getpid():
            _keepers.clear()
        if not _keepers:
            _keepers.append(K.Keeper(_ENV | {"HOME": "/"}))
        try:
            return _keepers[0].run(path, folder, stdin, timeout)
        except K.Lost:
            _keepers.pop().close()
            return _afresh(path, folder, stdin, timeout)


def passes(code: str | None, tests: list[str] | None, timeout: float = 5.0, empty_passes: bool = False) -> bool:
    """Whether code and all tests run through; without tests only if `empty_passes` and the code runs."""
    if not code or (not tests and not empty_passes):
        return False
    return run_python(code + "\n\n" + "\n".join(tests or []), timeout=timeout)[0] == "exit 0"


def _outcome(ended: str, err: str) -> tuple[str, str | None]:
    if ended == "exit 0":
        return "pass", None
    if ended == "timeout":
        return "fail", "timeout"
    kind = "syntax_error" if "SyntaxError" in err or "IndentationError" in err else "wrong_answer" if "AssertionError" in err else "runtime_error"
    return "fail", kind


_EACH = """
import sys as _sys
_real = _sys.stdout
for _i, _t in enumerate(_TESTS):
    try:
        exec(compile(_CODE + "\\n\\n" + _t, "program", "exec"), {"__name__": "__main__"})
        _e = None
    except SystemExit as x:
        _e = None if not x.code else "runtime_error"
    except BaseException as x:
        _e = "syntax_error" if isinstance(x, SyntaxError) else "wrong_answer" if isinstance(x, AssertionError) else "runtime_error"
    _real.write('\\nVERDICT [%d, %s]\\n' % (_i, '"%s"' % _e if _e else "null"))
    _real.flush()
"""


def errors_of(code: str, tests: list[str], timeout: float = 5.0) -> list[str | None]:
    """The error of each test, null where it passed: all tests in one process, each with the code run afresh.

    If the process is killed, the tests it did not reach are run in processes of their own; one that had all the time to itself is not run twice.
    """
    errors: list[str | None] = []
    ended, out, _ = _run(f"_CODE = {code!r}\n_TESTS = {tests!r}\n{_EACH}", "", timeout)
    for line in re.findall(r"^VERDICT (.*)$", out, re.M):
        try:
            i, error = json.loads(line)
        except ValueError:
            continue
        if i == len(errors):
            errors.append(error)
    if ended == "timeout" and tests and not errors:
        errors.append("timeout")
    for t in tests[len(errors) :]:
        ended, _, err = run_python(code + "\n\n" + t, timeout=timeout)
        errors.append(_outcome(ended, err)[1])
    return errors


def _verdict(errors: list[str | None]) -> dict:
    failures = [e for e in errors if e is not None]
    return {"status": "fail" if failures else "pass", "error_type": failures[0] if failures else None, "passed": len(errors) - len(failures), "failed": len(failures)}


def judge_functions(code: str, tests: list[str], timeout: float = 5.0) -> dict:
    """The first failure names the error."""
    return _verdict(errors_of(code, tests, timeout))


def judge_stdio(code: str, cases: list[dict], timeout: float = 5.0) -> dict:
    """Outputs compared line by line without blanks at line ends; stops at the first failure."""
    clean = lambda s: "\n".join(x.rstrip() for x in (s or "").strip().splitlines())
    for i, c in enumerate(cases):
        ended, out, err = run_python(code, c.get("input") or "", timeout)
        status, error = _outcome(ended, err)
        if status == "pass" and clean(out) != clean(c.get("output")):
            status, error = "fail", "wrong_answer"
        if status != "pass":
            return {"status": "fail", "error_type": error, "passed": i, "failed": 1}
    return {"status": "pass", "error_type": None, "passed": len(cases), "failed": 0}


_CALL = """
import ast as _ast, json as _json, math as _math, sys as _sys
def _value(s):
    for read in (_json.loads, _ast.literal_eval):
        try:
            return read(s)
        except Exception:
            pass
    low = s.strip()
    return {"true": True, "false": False, "none": None, "null": None}.get(low.lower(), low)
def _same(a, b):
    if isinstance(a, bool) or isinstance(b, bool):
        return a == b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return abs(a - b) <= max(1e-6 * max(abs(a), abs(b)), 1e-6)
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(map(_same, a, b))
    return a == b
_f = getattr(Solution(), _sys.argv[1] if len(_sys.argv) > 1 else _NAME) if "Solution" in globals() else globals()[_NAME]
_args = [_value(s) for s in _INPUT.splitlines() if s.strip()]
_got = _f(*_args)
assert _same(_got, _value(_OUTPUT)), repr(_got)
"""


def judge_calls(code: str, name: str, cases: list[dict], timeout: float = 5.0) -> dict:
    """Calls Solution().name or name with one argument a line of the input."""
    units = [f"_NAME = {name!r}\n_INPUT = {(c.get('input') or '')!r}\n_OUTPUT = {(c.get('output') or '')!r}\n{_CALL}" for c in cases]
    return judge_functions(code, units, timeout)


def _against(reference: str, name: str, inputs: list) -> list[str]:
    units = []
    for i in inputs:
        args = i if isinstance(i, list) else [i]
        units.append(f"_own = {name}\n_space = {{}}\nexec({reference!r}, _space)\n_args = {args!r}\nassert _own(*_args) == _space[{name!r}](*_args)")
    return units


def judge_differential(code: str, reference: str, name: str, inputs: list, timeout: float = 5.0) -> dict:
    """The code against a reference solution on the same inputs, a list of argument lists or of single arguments."""
    return judge_functions(code, _against(reference, name, inputs), timeout)


def audit(code: str, reference: str, name: str, base: list, plus: list, timeout: float = 5.0) -> tuple[dict, dict]:
    """Verdicts on the base inputs (the further ones if there are none) and on all inputs, from one run over them."""
    errors = errors_of(code, _against(reference, name, base + plus), timeout)
    return _verdict(errors[: len(base)] if base else errors), _verdict(errors)


_SHIM = """
import sys as _sys, types as _types, traceback as _tb
_m = _types.ModuleType("solution"); exec(compile(_CODE, "solution", "exec"), _m.__dict__); _sys.modules["solution"] = _m
class _Raises:
    def __init__(self, kind): self.kind = kind
    def __enter__(self): return self
    def __exit__(self, kind, value, tb):
        assert kind is not None and issubclass(kind, self.kind), "did not raise"
        self.value = value
        return True
class _Mark:
    def parametrize(self, names, rows):
        names = [n.strip() for n in names.split(",")] if isinstance(names, str) else list(names)
        def wrap(f):
            def run():
                for r in rows:
                    f(**dict(zip(names, r if len(names) > 1 else [r])))
            run.__name__ = f.__name__
            return run
        return wrap
_p = _types.ModuleType("pytest"); _p.raises = lambda kind, **k: _Raises(kind); _p.mark = _Mark()
class _Approx:
    def __init__(self, v, rel=1e-6, abs=1e-12): self.v, self.t = v, max(rel * __builtins__.abs(v) if hasattr(__builtins__, "abs") else rel, abs)
    def __eq__(self, o): return -self.t <= o - self.v <= self.t
_p.approx = _Approx
_sys.modules["pytest"] = _p
_space = dict(_m.__dict__); exec(compile(_TESTS, "tests", "exec"), _space)
_ok = _bad = 0; _first = None
for _n, _f in list(_space.items()):
    if _n.startswith("test_") and callable(_f):
        try: _f(); _ok += 1
        except BaseException as e: _bad += 1; _first = _first or e
print("\\nSUMMARY", _ok, _bad)
if _first: raise _first
assert _ok, "no tests"
"""


def judge_module(code: str, tests: str, timeout: float = 10.0) -> dict:
    """Runs the test functions of a module against the code, with stand-ins for raises, approx and parametrize."""
    ended, out, err = run_python(f"_CODE = {code!r}\n_TESTS = {tests!r}\n{_SHIM}", timeout=timeout)
    status, error = _outcome(ended, err)
    m = re.search(r"SUMMARY (\d+) (\d+)", out)
    return {"status": status, "error_type": error, "passed": int(m[1]) if m else 0, "failed": int(m[2]) if m else int(status != "pass")}


def _series(kind: T.DataType, f: Callable):
    @F.pandas_udf(kind)
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([f(*row) for row in zip(*columns)])

    return run


def _texts(x) -> list[str]:
    return [str(t) for t in x if t is not None] if x is not None else []


VERDICT = T.StructType([T.StructField("status", T.StringType()), T.StructField("error_type", T.StringType()), T.StructField("passed", T.IntegerType()), T.StructField("failed", T.IntegerType())])
TEXTS = T.ArrayType(T.StringType())


def _verdicts(f: Callable):
    @F.pandas_udf(VERDICT)
    def run(*columns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([f(*row) for row in zip(*columns)], columns=["status", "error_type", "passed", "failed"])

    return run.asNondeterministic()


required_symbols = _series(TEXTS, lambda tests: symbols_needed(_texts(tests)))
self_contained = _series(TEXTS, lambda tests: standing_alone(_texts(tests)))
pytest_asserts = _series(TEXTS, lambda t: assert_lines(t) if isinstance(t, str) else [])
pytest_blocks = _series(TEXTS, lambda t: test_blocks(t) if isinstance(t, str) else [])
code_candidate = _series(T.StringType(), lambda t: trimmed_code(t) if isinstance(t, str) else None)
defined_symbols = _series(TEXTS, lambda t: sorted(bound_names(t)) if isinstance(t, str) else [])
runs_all = _series(T.BooleanType(), lambda code, tests: passes(code if isinstance(code, str) else None, _texts(tests))).asNondeterministic()
function_verdict = _verdicts(lambda code, tests: judge_functions(code, _texts(tests)))
stdio_verdict = _verdicts(lambda code, cases: judge_stdio(code, [c if isinstance(c, dict) else c.asDict() for c in cases]))
call_verdict = _verdicts(lambda code, name, cases: judge_calls(code, name, [c if isinstance(c, dict) else c.asDict() for c in cases]))
module_verdict = _verdicts(judge_module)
differential_verdict = _verdicts(lambda code, reference, name, inputs: judge_differential(code, reference, name, json.loads(inputs or "[]")))
@F.pandas_udf(T.StructType([T.StructField("passed", T.BooleanType()), T.StructField("elapsed", T.DoubleType())]))
def _timed(code: pd.Series, tests: pd.Series) -> pd.DataFrame:
    rows = []
    for c, t in zip(code, tests):
        began = time.monotonic()
        rows.append((passes(c if isinstance(c, str) else None, _texts(t)), time.monotonic() - began))
    return pd.DataFrame(rows, columns=["passed", "elapsed"])


timed_run = _timed.asNondeterministic()


def _inputs(text: str | None) -> list:
    try:
        found = json.loads(text) if isinstance(text, str) else []
    except ValueError:
        return []
    return found if isinstance(found, list) else []


@F.pandas_udf(T.StructType([T.StructField("base", VERDICT), T.StructField("plus", VERDICT)]))
def _audited(code: pd.Series, reference: pd.Series, name: pd.Series, base: pd.Series, plus: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([audit(c, r, n, _inputs(b), _inputs(p)) for c, r, n, b, p in zip(code, reference, name, base, plus)], columns=["base", "plus"])


audited = _audited.asNondeterministic()
#: Judging functions by name, for SQL.
REGISTRY = {"timed_run": timed_run, "stdio_verdict": stdio_verdict, "call_verdict": call_verdict, "differential_verdict": differential_verdict, "runs_all": runs_all, "function_verdict": function_verdict, "module_verdict": module_verdict, "required_symbols": required_symbols, "self_contained": self_contained}


def register_all(spark) -> None:
    for name, f in REGISTRY.items():
        spark.udf.register(name, f)
