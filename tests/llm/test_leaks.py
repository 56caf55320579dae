import random

import numpy as np

from siltworks.functions.vectext import hash_strings
from siltworks.llm.fmindex import FMIndex, WaveletMatrix, suffix_array
from siltworks.llm.leaks import item_phrases, leak_spans, leaked_documents, leaked_items, plain, words_of


def test_suffix_array_against_sorting():
    rng = random.Random(2)
    for _ in range(30):
        s = np.array([rng.randrange(4) for _ in range(rng.randrange(1, 60))] * rng.choice([1, 2]) + [0], np.int32)
        zero = {i: k for k, i in enumerate(np.flatnonzero(s == 0))}
        key = [(zero[i] if v == 0 else int(v) + len(zero)) for i, v in enumerate(s)]
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: key[i:])


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 37, 500).astype(np.int32)
    w = WaveletMatrix(s, 37)
    symbol, at = rng.integers(0, 37, 200), rng.integers(0, 501, 200)
    assert w.rank(symbol, at).tolist() == [int((s[:a] == c).sum()) for c, a in zip(symbol, at)]
    got, before = w.access_rank(np.arange(500))
    assert got.tolist() == s.tolist() and before.tolist() == [int((s[:i] == s[i]).sum()) for i in range(500)]


def test_search_and_locate_against_scan():
    rng = np.random.default_rng(3)
    s = np.append(rng.integers(0, 4, 800), 0).astype(np.int32)
    phrases = np.array(sorted({tuple(s[i : i + 4]) for i in range(0, 700, 3)} | {(1, 1, 1, 1), (3, 2, 1, 3)}), np.int32)
    index = FMIndex(s, 4)
    found, low, high = index.search(phrases)
    at, owner = index.locate(low, high)
    got = sorted((tuple(phrases[found[o]]), int(p)) for p, o in zip(at, owner))
    wanted = sorted((tuple(p), i) for p in map(tuple, phrases) if 0 not in p for i in range(len(s) - 3) if tuple(s[i : i + 4]) == p)
    assert got == wanted


def test_plain_undoes_what_does_not_matter():
    assert words_of("Caf\u00e9 <b>ca</b>st &amp; won&#x27;t") == ["café", "cast", "won", "t"]
    assert words_of("exc\u200bee\u00adds ４５ ﬁne") == ["exceeds", "45", "fine"]
    known = {"loc", "ksmith", "locksmith", "well", "known"}
    assert words_of("> a loc-\n> ksmith", known) == ["a", "locksmith"]
    assert words_of("well-\nknown", known) == ["well", "known"]
    assert plain("load is < 14. and > 3") == "load is < 14. and > 3"
    assert plain(None) == "" and words_of("") == []


W = [f"word{i}" for i in range(60)]
ITEMS = [("q1", "Shared head of all items in one paragraph of more than twelve words here it is.\n\n" + " ".join(W[:20])), ("q2", "Shared head of all items in one paragraph of more than twelve words here it is.\n\n" + " ".join(W[20:45])), ("q3", None), ("q4", " ".join(W[25:40]))]


def test_leaks(spark):
    texts = {
        1: " ".join(W[3:15]).upper(),
        2: " ".join(W[3:14]),
        3: "Shared head of all items in one paragraph of more than twelve words here it is.",
        4: "x\n> " + " ".join(W[20:32]) + " and <i>" + "</i>, ".join(W[0:12]),
        5: " ".join(W[26:39]),
        6: None,
        7: "",
        8: "filler " * 30_000 + " ".join(W[40:45]) + " " + " ".join(W[5:18]),
    }
    docs = spark.createDataFrame([(k, t, "clash", 0) for k, t in texts.items()] + [(1, texts[1], "", 0)], "doc_id long, text string, item string, start int")
    items = spark.createDataFrame(ITEMS, "question_id string, question_content string")
    got = {(r.doc_id, r.question_id) for r in leaked_documents(docs, items).collect()}
    assert got == {(1, "q1"), (4, "q1"), (4, "q2"), (8, "q1")}  # what q2 and q4 share counts for neither
    spans = {(r.doc_id, r.start, r.end) for r in leak_spans(docs, items).collect()}
    assert (8, 30_005, 30_018) in spans and (1, 0, 12) in spans
    report = {r.question_id: (r.documents, r.words) for r in leaked_items(docs, items).collect()}
    assert report["q3"] == (0, 0) and report["q1"][0] == 3
    assert leaked_documents(docs.limit(0), items).count() == 0
    assert leaked_documents(docs, items.limit(0)).count() == 0


def test_shared_phrases_belong_to_nobody(spark):
    items = spark.createDataFrame([("a", " ".join(W[:14])), ("b", " ".join(W[1:15])), ("b", " ".join(W[1:15])), (None, "x"), ("n", None)], "question_id string, question_content string")
    got = {(tuple(r.words), r.item) for r in item_phrases(items).collect()}
    key = lambda words: tuple(hash_strings(words).view(np.int64).tolist())
    assert got == {(key(W[0:12]), "a"), (key(W[3:15]), "b")}


def test_blocks_of_phrases_find_the_same(spark):
    docs = spark.createDataFrame([(i, " ".join(W[i : i + 14])) for i in range(40)], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "question_id string, question_content string")
    spans = [sorted(map(tuple, leak_spans(docs, items, block=b).collect())) for b in (7, 500_000)]
    assert spans[0] == spans[1] and len(spans[0]) > 20

