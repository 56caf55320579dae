"""Programs run by the warm interpreter end as they do in an interpreter of their own."""

import os
import tempfile
import time

import pytest

from siltworks.functions import code as C

LOOP = "def f(a, b):\n    x, y = 39, 5\n    while x > 6:\n        {}\n    return x\nf(7, 3)"


def both(program, stdin="", timeout=10.0):
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "program.py")
        with open(path, "w") as f:
            f.write(program)
        fresh = C._afresh(path, folder, stdin, timeout)
    short = lambda r: (r[0], r[1], (r[2].strip().splitlines() or [""])[-1])
    return short(C.run_python(program, stdin, timeout)), short(fresh)


@pytest.mark.parametrize(
    "program",
    [
        "print(input()); import sys; print(sys.stdin.read())",
        "import sys; sys.exit(3)",
        "raise SystemExit('m')",
        "def f(:",
        "def f(x): assert x, 'y'\nf(0)",
        "import os; os._exit(7)",
        "import os; os.close(1); print('x')",
        "class A:\n    def __del__(self): print('end')\na = A()",
        "import atexit; atexit.register(lambda: print('end'))",
        "f = open(1, 'w', closefd=False); f.write('kept')",
        "def g():\n    try: yield\n    finally: print('end')\nx = g(); next(x)",
        "import threading, time\nthreading.Thread(target=lambda: (time.sleep(0.2), print('end'))).start()",
        "import os; print(sorted(os.environ), os.listdir('.'), sorted(globals()), __name__)",
        "import sys; print([m for m in ('select', 'resource', 'traceback', 'json') if m in sys.modules], sys.argv[0][-10:])",
        "import pickle\nfrom dataclasses import dataclass\n@dataclass\nclass P:\n    a: int\nprint(pickle.loads(pickle.dumps(P(1))))",
        "open('x', 'w').write('a' * (20 << 20))",
    ],
)
def test_a_program_ends_as_in_its_own_interpreter(program):
    warm, fresh = both(program, "a\nb\n")
    assert warm == fresh


@pytest.mark.parametrize(
    "body",
    ["x = x", "x = 90 % (y * 78); x = 88 * x - 4", "x = 88 * (a + x) - 5", "y = b * y; x = y - 2", "x = x - (0 - x) - 1", "x = x + 1 if x < 50 else 7", "pass", "x = -((-x) - 1)", "y = y * y % 10007; x = x + (y % 7)"],
)
def test_loops_that_nothing_leaves_are_told_at_once(body):
    began = time.monotonic()
    assert C.run_python(LOOP.format(body), timeout=9) == ("timeout", "", "") and time.monotonic() - began < 3


#: Growing values, tests that no value meets, and squares whose rounds soon take long.
GROWING = [
    "\n        ".join(["if y == y * 65: y = 2", "y = y + 92", "x = y + y * x - 3"]),
    "\n        ".join(["x = y + 56 * x", "if x == x * 92 and y > 6: x = x % 94", "if x >= y - y: y = x % 101", "x = x - 1"]),
    "\n        ".join(["y = y * a", "x = 43 * x", "y = y * (y + a)", "x = x - 1"]),
    "\n        ".join(["if y != y: y = 87", "else: x = y + x; y = 79 - y", "y = x + a", "x = x - 4"]),
    "\n        ".join(["y = x * y", "if y > y * x: y = 1", "x = y - 1"]),
]


@pytest.mark.parametrize("body", GROWING)
def test_growing_loops_are_told_before_their_time(body):
    began = time.monotonic()
    assert C.judge_functions(LOOP.format(body), ["1", "2"], timeout=9)["error_type"] == "timeout" and time.monotonic() - began < 9


@pytest.mark.parametrize(
    "program",
    [
        LOOP.format("y = y + 1; x = 39 if y < 9000000 else 0"),
        LOOP.format("y = y + 1; x = 3000000 - y"),
        LOOP.format("y = y + 1; x = 7 // (y // 3000000 - 1) + 50") + "",
        LOOP.format("y = y + 1; x = 7 + 5 % (y - 6000000) * 0") + "",
        "import signal\ndef h(*a): raise KeyError\nsignal.signal(signal.SIGALRM, h); signal.alarm(1)\nwhile True: pass",
        "import signal\nsignal.alarm(1)\nwhile True: pass",
        "import threading, os, time\nthreading.Thread(target=lambda: (time.sleep(1), os._exit(5)), daemon=True).start()\nwhile True: pass",
        "import os, time\np = os.getpid()\nif os.fork() == 0:\n    time.sleep(1); os.kill(p, 9); os._exit(0)\nwhile True: pass",
        "class W(int):\n    n = 0\n    def __gt__(s, o):\n        W.n += 1\n        return W.n < 1000000\ndef f(w):\n    while w > 1: z = 2\nf(W(3))\nprint('end')",
        "def f(xs):\n    i = 0\n    while xs:\n        xs.pop(); i = 0\nf(list(range(3000000)))\nprint('end')",
        "def f():\n    for i in iter(range(9000000)): i = 0\nf()\nprint('end')",
        "import time\nt = time.time()\nwhile time.time() - t < 0.6: pass\nprint('end')",
    ],
)
def test_loops_that_end_are_left_alone(program):
    warm, fresh = both(program)
    assert warm == fresh and warm[0] != "timeout"


def test_tests_reached_before_a_timeout_keep_their_verdicts_and_none_waits_twice():
    code = "import time\ndef f(x):\n    if x: time.sleep(30)\n    return 1"
    began = time.monotonic()
    assert C.errors_of(code, ["f(1)", "assert f(0) == 1", "assert f(0) == 2"], timeout=2) == ["timeout", None, "wrong_answer"] and time.monotonic() - began < 3.9
    assert C.errors_of(code, ["assert f(0) == 1", "f(1)"], timeout=1) == [None, "timeout"]


def test_a_program_that_ends_the_warm_interpreter_is_run_without_it():
    assert C.run_python("import os\nif b'-c' in open(f'/proc/{os.getppid()}/cmdline', 'rb').read().split(b'\\0'): os.kill(os.getppid(), 9)\nelse: print('own')")[:2] == ("exit 0", "own\n")
    assert C.run_python("print(1)")[:2] == ("exit 0", "1\n")


def test_audits_of_loops_end_soon():
    began = time.monotonic()
    base, every = C.audit(LOOP.format("x = 88 * (a + x)"), "def f(a, b): return 1", "f", [[1, 2]], [[2, 3], [3, 4], [5, 6]])
    assert (base["error_type"], every["failed"]) == ("timeout", 4) and time.monotonic() - began < 4


def test_many_programs_do_not_start_many_interpreters():
    C.run_python("1")
    began = time.monotonic()
    assert {C.passes(f"def f(x): return x + {i}", ["assert f(1) == 2"]) for i in range(100)} == {True, False}
    warm = time.monotonic() - began
    began = time.monotonic()
    for _ in range(10):
        both_ended = C._afresh(os.devnull, "/tmp", "", 5.0)[0]
    assert both_ended == "exit 0" and warm / 100 < (time.monotonic() - began) / 10 / 2


def test_rollouts_that_loop_do_not_wait(spark):
    from siltworks.operators import rollouts as RO

    fence = "```python\ndef f(n):\n    while n > {0}:\n        n = 88 * (n + {0}) - 5\n    return n\n```"
    rows = [("t", i, fence.format(i)) for i in range(24)]
    tests = spark.createDataFrame([("t", ["assert f(9) == 9"])], "task_id string, tests array<string>")
    got = {r.rollout: (r.status, r.elapsed) for r in RO.score_rollouts(spark.createDataFrame(rows, "task_id string, rollout int, completion string"), tests).collect()}
    assert {i for i, (s, _) in got.items() if s == "pass"} == set(range(9, 24)) and max(e for _, e in got.values()) < 4
