import random

import pyarrow as pa
import pytest

from siltworks.llm.truncation import CUT, LACKS_TAG, OPEN, RUN, WHOLE, _analysed, _counted, aligned_end, cut_outputs, cut_rates, form, judged, spans, tail_shingles, window_bands

CODE = "def f(x):\n    return x\n"


@pytest.mark.parametrize(
    "text,state",
    [
        ("A whole sentence.", WHOLE),
        ("完整的句子。", WHOLE),
        ("He said “yes.”", WHOLE),
        ("A sentence that breaks", OPEN),
        ("A sentence, [truncated]", CUT),
        ("A sent\ufffd", CUT),
        ("<think>never closed. And so", CUT),
        ("<think>a</think>\n<sub", CUT),
        ("Text.\n\n```python\nx = 1", CUT),
        ("Text.\n\n```python\nx = 1\n```", WHOLE),
        ("Sure: ```python\nx = 1\n```\n\nDone.", WHOLE),
        ("Text.\n\n```python\nx = 1\n``", CUT),
        ('{"a": [1, 2]}', WHOLE),
        ('{"a": [1, 2', CUT),
        ("1. one\n2. two\n3.", CUT),
        ("<submit>\n" + CODE + "</submit>", WHOLE),
        ("<submit>\n" + CODE, LACKS_TAG),
        ("<submit>\ndef f(x):\n    retu", CUT),
        ("<submit>\n```python\n" + CODE + "```\n", LACKS_TAG),
        ("<submit>\n```python\n" + CODE, CUT),
        ("   ", WHOLE),
        (CODE, WHOLE),
        ("def f(x):\n    return (x", CUT),
    ],
)
def test_form(text, state):
    assert form(text) == state


def test_parsed_submission_shows_a_cut():
    assert form("<submit>\nx = 1\n", parsed="x = 1\ny = 2") == CUT
    assert form("<submit>\nx = = 1\n", parsed="x = = 1", status="ok") == LACKS_TAG
    assert form("<submit>\nx = = 1\n", parsed="x = = 1", status="partial") == CUT


def _records(spark):
    places = ["main hall", "north gate", "test bench", "far corner"]
    rows = [(f"w{i}", f"The loop number {i} ends at the {places[i % 4]}. It holds for case {i}.\n\n1. sort the odd rows at the {places[i % 4]}\n2. count the {['red', 'old'][i % 2]} cells at the {places[(i + 1) % 4]}") for i in range(40)]
    rows += [(f"s{i}", f"Value {i} is kept in the table for later use by the loop.\n\nHope that helps") for i in range(6)]
    rows += [("c1", "The loop ends at the main"), ("c2", "Value 3 is kept in the tab"), ("c3", rows[0][1][:-8]), ("e", ""), ("n", None), ("b", "  \n"), ("o1", "ok"), ("o2", "ok"), ("o3", "ok")]
    rows.append(("long", "A sentence of the very long text. " * 20_000 + "It stops in the mid"))
    whole = "Both ends move one step at a time over the sorted list of rows and the counter remembers which of them are open while the loop goes on to the next one"
    rows += [("full", whole + " and so forth until it stops."), ("half", whole)]
    return spark.createDataFrame([("t", i, t, None, None, "clash") for i, t in rows], "src string, id string, text string, parsed string, status string, state string")


def test_judged(spark):
    df = _records(spark)
    got = {r.id: r.state for r in judged(df.union(df.limit(5))).collect()}
    assert len(got) == df.count()
    assert {i for i, s in got.items() if s == CUT} == {"c1", "c2", "c3", "long", "half"}
    assert judged(df.limit(0)).count() == 0


def test_cut_outputs_know_the_provider(spark):
    turn = "run_id string, turn_index int, raw_output string, parsed_submit string, parse_status string"
    text = "<submit>\n" + CODE
    turns = spark.createDataFrame([("a", 0, text, CODE.strip(), "ok"), ("b", 0, text, CODE.strip(), "ok"), ("b", 0, text, CODE.strip(), "ok"), (None, 1, text, None, None), ("z", 0, text, CODE.strip(), "ok")], turn)
    traces = spark.createDataFrame([("a", "Skygate ", "m1"), ("b", "other", "m2"), ("b", "other", "m2")], "run_id string, provider string, model string")
    generations = spark.createDataFrame([(1, "A whole one.", None), (2, "```\ncut", "s"), (3, None, "s")], "gen_id long, text string, source string")
    got = {(r.src, r.id): r.cut for r in cut_outputs(turns, traces, generations, tagless=("skygate",)).collect()}
    assert got[("turns", "a:0")] is False and got[("turns", "b:0")] is True and got[("turns", "z:0")] is True
    assert [got[("generations", str(i))] for i in (1, 2, 3)] == [False, True, False]
    rates = {(r.kind, r.name): (r.records, r["cut"]) for r in cut_rates(turns, traces, generations, tagless=("skygate",)).collect()}
    assert rates[("model", "m2")] == (1, 1) and rates[("source", "s")] == (2, 1) and rates[("source", None)] == (1, 0)


FEW = "we keep one counter for the open crates and move it along the shelf while the clerk reads the labels from left to right and notes which crates of the second row"


@pytest.mark.parametrize(
    "text,copy,verdict",
    [
        (FEW, "Well then, " + FEW + " are still to be moved", 1),
        (FEW[:-2], "Well then, " + FEW + " are still to be moved", 1),
        (FEW.replace("clerk", "guard"), FEW + " are still to be moved", 1),
        (FEW, FEW + "\nare still to be moved", -1),
        (FEW, FEW + ".", 0),
        (FEW, FEW.replace("one counter for the open crates and move it along the shelf while", "nothing") + " are", 0),
        (FEW + " 1", FEW.replace("clerk", "guard") + " 17", 0),
        ("so far", "so far we have", 0),
        ("这个函数接收很多车票并返回码头", "首先这个函数接收很多车票并返回码头中唯一元素", 1),
    ],
)
def test_aligned_end(text, copy, verdict):
    assert aligned_end(spans(text), spans(copy), copy) == verdict


def test_edited_copy_with_another_opening_shows_a_cut(spark):
    lines = [("l%d" % i, f"Sort case {i}.\n\n1. stack the red rows at the main hall\n2. count crate {i} at the main hall") for i in range(12)]
    end = "then count the red cells that were left over from the first pass at the main hall"
    whole = "<think>Another thought, much longer than all the rest of it, with its own words throughout.</think>\nOther words open this text and go on for long. " * 3
    whole += f"{FEW}.\n\n1. sort the odd rows\n2. {end} before noon today.\n\nAll is well."
    rows = lines + [("whole", whole), ("cut", f"{FEW.replace('clerk', 'guard')}.\n\n1. sort the odd rows\n2. {end}")]
    got = {r.id: r.state for r in judged(spark.createDataFrame([("t", i, t, None, None) for i, t in rows], "src string, id string, text string, parsed string, status string")).collect()}
    assert {i for i, s in got.items() if s == CUT} == {"cut"}


def test_closing_words_do_not_inherit_the_counts_of_others(spark):
    # the hashes of both closing groups agree in their last 20 bits
    lines = [("l%d" % i, f"Case {i}.\n\n1. move the narrow axle\n2. sort the red rows {'abcdefghijklmnopqrst'[i]}") for i in range(20)]
    rows = lines + [("cut", "1. sort the rows\n2. move the lamp candle"), ("list", "1. sort the rows\n2. move the narrow axle")]
    df = spark.createDataFrame([("t", i, t, None, None) for i, t in rows], "src string, id string, text string, parsed string, status string")
    got = {r.id: r.state for r in judged(df).collect()}
    assert got["cut"] == CUT and got["list"] == WHOLE
    counts = [_analysed(df, flush=f).where("word_group is not null").groupBy("word_group").agg({"runs": "sum", "ends": "sum"}).collect() for f in (1, 1_000_000)]
    assert sorted(counts[0]) == sorted(counts[1])


def test_rare_sign_off_is_scored(spark):
    rows = [(f"r{i}", f"Value {i} is kept in the table.\n\nSee you in the next problem") for i in range(2)] + [("c", "Value 7 is kept in the table.\n\nSee you in the")]
    got = {r.id: r.state for r in judged(spark.createDataFrame([("t", i, t, None, None) for i, t in rows], "src string, id string, text string, parsed string, status string")).collect()}
    assert got == {"r0": WHOLE, "r1": WHOLE, "c": CUT}


def _edited_cuts(n=400):
    """Texts, and copies of them cut at a third with another opening and edits that leave the copies' five-word shingles at 0.8 or more."""
    rng = random.Random(4)
    for _ in range(n):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(90, 400))]
        cut = words[: len(words) // 3]
        for at in rng.sample(range(len(cut) - 1), max(0, min(2, len(cut) // 40))):
            cut[at] = "edit"
        yield " ".join(["Some", "other", "opening", *words]), " ".join(cut)


def test_recall_of_bands_for_copies_cut_at_a_third():
    whole, cut = zip(*_edited_cuts())
    met = total = 0
    for a, b in zip(whole, cut):
        grams, there = tail_shingles(spans(b)), set(zip(*([w for w, _, _ in spans(a)][k:] for k in range(5))))
        if len(grams & there) < 0.8 * len(grams):
            continue  # brute force: not similar enough
        total += 1
        bands, _, late = window_bands(pa.array([b]))
        met += bool(set(bands[late].tolist()) & set(window_bands(pa.array([a]))[0].tolist()))
    assert total > 250 and met / total >= 0.95


def test_crowded_bands_are_counted(spark):
    run = "the clerk reads the labels of the open crates from left to right and then moves the"
    rows = [(f"r{i}", f"Case {i} of all.\nSo {run} red crate {i} away.") for i in range(6)] + [("cut", f"Other words. So {run} red cr"), ("end", f"More words. So {run} blue one")]
    df = spark.createDataFrame([("t", i, t, None) for i, t in rows], "src string, id string, text string, status string")
    got = {r.id: r.verdict for r in _counted(df, df.where("id in ('cut', 'end')")).collect()}
    assert got == {"cut": 6, "end": 0}
    found = [{r.id for r in judged(df.selectExpr("src", "id", "text", "null as parsed", "status"), hot=h).where(f"state = {CUT} and evidence = 'aligned'").collect()} for h in (1, 100)]
    assert found[0] == found[1] == {"cut"} and RUN == 8


def _aligned(spark, rows, **options):
    df = spark.createDataFrame([("t", i, t, None, None) for i, t in rows], "src string, id string, text string, parsed string, status string")
    return {r.id for r in judged(df, **options).where(f"state = {CUT} and evidence = 'aligned'").collect()}


def test_edited_copies_in_crowded_bands_are_aligned(spark):
    run = " ".join(f"{a} {b}" for a in ("we", "they", "others", "some", "many", "all") for b in ("keep one", "move two", "sort three", "read four", "drop five"))
    rows = [(f"r{i}", f"Case {i} of all.\nSo {run} red crate {i} away.") for i in range(6)]
    # one word of the last eight is edited; both end alike, so that one alignment serves both
    rows += [(f"cut{i}", f"Opening {i}.\nSo {run.replace('all drop five', 'all leave five')} red cr") for i in range(2)]
    assert _aligned(spark, rows, hot=1) == _aligned(spark, rows, hot=1000) == {"cut0", "cut1"}


def test_copies_that_share_only_common_bands_are_aligned(spark):
    rng = random.Random(415)
    words = [f"w{rng.randrange(100000)}" for _ in range(64)]
    common, copy = words[38:], words[:38]
    for at in (rng.randrange(8, 14), rng.randrange(22, 30)):
        copy[at] = "edit"
    rows = [("cut", words), ("whole", [*copy, *common, "and", "so", "on"])] + [(f"r{i}", [f"x{i}", *common, "and", "other", "things"]) for i in range(5)]
    grams, there = tail_shingles(spans(" ".join(words))), set(zip(*(rows[1][1][k:] for k in range(5))))
    assert len(grams & there) >= 0.8 * len(grams)
    assert _aligned(spark, [(i, " ".join(w)) for i, w in rows]) == {"cut"}
