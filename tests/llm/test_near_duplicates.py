import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltworks.functions.vectext import distinct_per_row
from siltworks.llm.bagminhash import NearDuplicates, bag, bagminhash, overlap
from siltworks.llm.components import connected_components
from siltworks.llm.semijoin import members_of


def _signatures(bags, m):
    elements = np.array([e for b in bags for e in b], np.uint64)
    weights = np.array([w for b in bags for w in b.values()], np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64)
    return bagminhash(elements, weights, offsets, m)


@pytest.mark.parametrize("low,high", [(1, 1), (1, 9)])
def test_signatures_are_unbiased(low, high):
    rng = random.Random(3)
    errors = []
    for trial in range(30):
        a = {rng.getrandbits(60): rng.randint(low, high) for _ in range(60)}
        b = {k: w if rng.random() < 0.7 else rng.randint(low, high) for k, w in a.items() if rng.random() < 0.8} | {rng.getrandbits(60): rng.randint(low, high) for _ in range(10)}
        union = sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
        true = sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b) / union
        s = _signatures([a, b], 256)
        errors.append((s[0] == s[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.02
    assert np.std(errors) < 0.06


def test_empty_row_keeps_infinite_times():
    s = _signatures([{}, {5: 1}], 8)
    assert np.isinf(s[0]).all() and np.isfinite(s[1]).all()


@given(st.lists(st.lists(st.integers(0, 5), max_size=8), max_size=6))
@settings(max_examples=60, deadline=None)
def test_distinct_per_row(rows):
    flat = np.array([v for r in rows for v in r], np.uint64)
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    values, counts, out = distinct_per_row(flat, at)
    for i, r in enumerate(rows):
        own = dict(zip(values[out[i] : out[i + 1]].tolist(), counts[out[i] : out[i + 1]].tolist()))
        assert own == {v: r.count(v) for v in set(r)}


def _words(text):
    return re.findall(r"[^\W_]+", text.lower())


def _brute(rows, shingle, threshold):
    grams = {k: set(zip(*(_words(t or "")[i:] for i in range(shingle)))) for k, t in rows}
    return {(a, b) for a, b in itertools.combinations(sorted(grams), 2) if grams[a] and grams[b] and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= threshold}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(80)]
        for copy in range(rng.choice([1, 1, 2, 3])):
            w = base[:]
            for _ in range(copy):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((k, " ".join(w).upper() if copy == 2 else "  ".join(w)))
            k += 1
    rows += [(k, rows[0][1]), (k + 1, rows[0][1]), (k + 2, None), (k + 3, ""), (k + 4, "two words"), (k + 5, "x" * 200_000)]
    return rows


def test_pairs_match_brute_force(spark, texts):
    df = spark.createDataFrame([("t", i, t, "extra", 1.0) for i, t in texts], "src string, id long, text string, band string, similarity double")
    df = df.union(df.limit(3))  # repeated rows
    got = NearDuplicates(df, threshold=0.6, shingle=3, weighted=False).pairs().collect()
    assert len(got) == len({(r.id_a, r.id_b) for r in got})
    assert {(r.id_a, r.id_b) for r in got} == _brute(texts, 3, 0.6)


def test_groups_cover_every_row(spark, texts):
    df = spark.createDataFrame([("t", i, t) for i, t in texts], "src string, id long, text string")
    got = {r.id: r for r in NearDuplicates(df, threshold=0.6, shingle=3, weighted=False).groups().collect()}
    assert set(got) == {i for i, _ in texts}
    pairs = _brute(texts, 3, 0.6)
    for i, r in got.items():
        assert r.links == sum(i in p for p in pairs)
    for a, b in pairs:
        assert got[a].group_id == got[b].group_id


def test_sources_are_kept_apart_and_hot_copies_count(spark):
    text = "one two three four five six seven eight"
    df = spark.createDataFrame([("a", i, text) for i in range(200)] + [("b", 1, text)], "src string, id long, text string")
    near = NearDuplicates(df)
    assert near.groups().where("links = 199 and group_id = 0").count() == 200
    assert near.links().count() == 0
    assert near.pairs().count() == 200 * 199 // 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "src string, id long, text string")
    near = NearDuplicates(df)
    assert near.pairs().count() == 0 and near.groups().count() == 0


def test_overlap_counts_repeats():
    for weighted, share in ((False, 1 / 3), (True, 1 / 4)):
        assert overlap(bag("a b c a b c", 3, weighted), bag("a b c", 3, weighted)) == pytest.approx(share)
        assert overlap(bag("", 3, weighted), bag("", 3, weighted)) == 0


def test_components_against_union_find(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_crowded_bands_lose_no_pair(spark):
    words = [f"w{i}" for i in range(60)]
    rng = random.Random(8)
    rows = []
    for i in range(60):
        own = words[:]
        own[rng.randrange(60)] = f"x{i}"
        rows.append(("t", i, " ".join(own)))
    df = spark.createDataFrame(rows, "src string, id long, text string")
    pairs = [{tuple(r) for r in NearDuplicates(df, threshold=0.6, shingle=3, weighted=False, hot=h).pairs().select("id_a", "id_b").collect()} for h in (7, 1000)]
    assert pairs[0] == pairs[1] == _brute([(i, t) for _, i, t in rows], 3, 0.6)


def test_weights_count_in_overlap(spark):
    df = spark.createDataFrame([("t", 1, "a b " * 40), ("t", 2, "a b " * 36), ("t", 3, "a b " * 5)], "src string, id long, text string")
    got = {tuple(r) for r in NearDuplicates(df, threshold=0.8, shingle=2, weighted=True).pairs().select("id_a", "id_b").collect()}
    assert got == {(1, 2)}


@pytest.mark.parametrize("largest", [1 << 27, 1])
def test_semi_join_by_bits(spark, largest):
    rows = spark.range(1000).selectExpr("'t' as src", "id", "'clash' as hash", "id as slot")
    wanted = spark.range(0, 1000, 7).selectExpr("'t' as src", "id").union(spark.sql("select 'u', 5L"))
    assert sorted(r.id for r in members_of(rows, wanted, largest=largest).collect()) == list(range(0, 1000, 7))
