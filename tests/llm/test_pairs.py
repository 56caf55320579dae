import pytest

from siltworks.llm.langid import fit_languages
from siltworks.llm.pairs import COURTESIES, REFUSALS, _common, _templates, defect_rates, defective_answers, is_copy, is_empty, is_refusal, stored_pairs
from siltworks.session import table

Q = "Write a function that takes the scores of a choir and will encode the stale ones in one pass. Two teams share the pump room: one will mark even jobs while the other is counting at the main hall."


def test_empty():
    assert all(map(is_empty, (None, "", " \n", "<think>\n\n</think>", "<think></think>\n<submit>\n</submit>", "```python\n```", "\u200b", "\ufeff \xa0")))
    assert not any(map(is_empty, ("0", "ok", "```python\nx\n```", "<think>a</think>")))


def test_refusals():
    assert is_refusal("I'm sorry, but I can’t help with this request.") and is_refusal("<think>long thoughts. Really.</think>\nApologies! That is something I have to refuse. Please ask something else.")
    assert is_refusal("抱歉，我无法回答这个问题。") and is_refusal("Lo siento, no puedo ayudar con esta petición.")
    for text in ("No, ties are kept.", "Sorry for the long name, but it keeps the intent clear.", "Unfortunately sorting is not allowed, so we decline that route. Use a heap.", "I can't use recursion here, so a stack does it.", "Thanks for understanding.", "Yes."):
        assert not is_refusal(text)
    assert not is_refusal("I cannot fulfil this.\n```python\nx = 1\n```")


def test_copies():
    assert is_copy(Q, Q) and is_copy(Q, "You asked:\n\n> " + Q.upper()) and is_copy(Q, Q.replace(",", "").replace(".", "") + "\n" + Q)
    assert not is_copy(Q, Q + "\n\nYes.") and not is_copy(Q, Q[:80]) and not is_copy(Q, "It returns 0.") and not is_copy("", "")
    stub = 'def f(xs, y):\n    """' + Q + '\n    """\n'
    assert is_copy(stub, stub) and not is_copy(stub, stub + "    return len(xs) + y * 37\n")


@pytest.fixture(scope="module")
def model(spark):
    return fit_languages(table(spark, "/root/testdata/sf0.01", "documents"))


def test_tables(spark, model):
    german = "Die Funktion bekommt viele Knoten und gibt zurück, wie viele davon nach dem Durchlauf noch im Lager liegen."
    good = "The counter keeps the open items, so the loop never reads them twice.\n\n```python\ndef f(x):\n    return x\n```"
    chats = {
        1: [("user", Q), ("assistant", good)],
        2: [("user", Q), ("assistant", None)],
        3: [("user", Q), ("assistant", german)],
        4: [("user", Q + " Answer in German."), ("assistant", german)],
        5: [("user", Q), ("assistant", good[:-12])],
        6: [("user", "x"), ("assistant", good), ("user", Q)],
        7: [("system", "s"), ("user", "old"), ("assistant", ""), ("user", Q), ("assistant", "Yes.")],
        8: [("user", Q), ("assistant", Q)],
        9: None,
        10: [("user", Q), ("assistant", "I must decline this one.")],
        11: [("user", None), ("assistant", good)],
    }
    sft = spark.createDataFrame([(k, v, "x") for k, v in chats.items()] + [(1, chats[1], "x")], "row_id long, messages array<struct<role:string,content:string>>, field string")
    stub = 'def f(xs):\n    """' + Q + '"""\n'
    samples = spark.createDataFrame([(1, "t", good, "def f(x):\n    return x\n"), (2, "t", "```python\ndef f(x):\n    ret", "def f(x):\n    ret("), (3, "t", stub, stub), (4, "gone", None, None), (5, None, good, "\u200b")], "sample_id long, task_id string, raw_output string, solution string")
    tasks = spark.createDataFrame([("t", stub)], "task_id string, prompt string")
    pairs = stored_pairs(sft, samples, tasks)
    found = defective_answers(pairs, model)
    got = {(r.id, r.field): r.defect for r in found.collect()}
    assert got == {
        ("2", "messages"): "empty", ("3", "messages"): "wrong_language", ("5", "messages"): "truncated", ("6", "messages"): "empty", ("8", "messages"): "copy", ("9", "messages"): "empty", ("10", "messages"): "refusal",
        ("2", "raw_output"): "truncated", ("2", "solution"): "truncated", ("3", "raw_output"): "copy", ("3", "solution"): "copy", ("4", "raw_output"): "empty", ("4", "solution"): "empty", ("5", "solution"): "empty",
    }
    rates = {(r.field, r.defect): r.answers for r in defect_rates(pairs, found).collect()}
    assert rates[("messages", "empty")] == 3
    nothing = stored_pairs(sft.limit(0), samples.limit(0), tasks.limit(0))
    assert defective_answers(nothing, model).count() == 0


def test_long_answers_are_read_whole():
    assert is_empty(" " * 500 + "​" * 500 + "<think></think>" * 50) and not is_empty(" " * 500 + "0")
    assert is_refusal("I can't assist with that. " * 40) and is_refusal("I cannot help you with `that`.")
    assert not is_refusal("I can't assist with that. " * 40 + "The loop ends at the first open crate and returns its number.")
    assert is_copy("Sort the odd rows", "Sort the odd rows\n" * 12) and not is_copy("Sort the odd rows", "Sort the odd rows\n" * 12 + "Use a heap")


def test_refusals_of_other_words_align_by_classes():
    for text in ("I refuse to write this code.", "I won't be doing that.", "I am not going to answer this.", "I'm afraid I can't do that.", "We cannot comply with this request."):
        assert is_refusal(text), text
    for text in ("No.", "It cannot be solved.", "This loop does not do it.", "You cannot do this in O(1).", "No, it is not possible.", "I do not use recursion here.", "We do not need this.", "That does not solve it.", "I did not sort the list."):
        assert not is_refusal(text), text


def test_held_out_refusals():
    # without a third of the templates at a time
    found = 0
    for fold in range(3):
        kept = _templates(tuple(t for i, t in enumerate(REFUSALS) if i % 3 != fold), COURTESIES)
        found += sum(is_refusal(t, templates=kept) for i, t in enumerate(REFUSALS) if i % 3 == fold)
    assert found >= 20  # of 37: wordings of which no kept template has the like are missed


@pytest.mark.parametrize("a,b", [("abcde", "xbcye"), ("", "abc"), ("aaab", "aab"), ("abcbdab", "bdcaba"), ("x" * 100, "x" * 70 + "y")])
def test_common_subsequence(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            rows[i][j] = rows[i - 1][j - 1] + 1 if x == y else max(rows[i - 1][j], rows[i][j - 1])
    assert _common(list(a), list(b)) == rows[-1][-1]
