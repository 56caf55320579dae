import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltworks.llm.calibrated import CalibratedSample, plan, tilt
from siltworks.llm.mixing import SourceMix, rake, source_totals
from siltworks.llm.pivotal import duel_along, pivotal_sample


@given(st.lists(st.floats(0, 1), min_size=1, max_size=60), st.integers(0, 2**32))
@settings(max_examples=200, deadline=None, derandomize=True)
def test_duels_keep_the_total(probabilities, seed):
    p = np.array(probabilities)
    dice = np.random.default_rng(seed).uniform(1e-9, 1 - 1e-9, len(p))
    out = duel_along(p, dice)
    assert abs(out.sum() - p.sum()) < 1e-6 + 2e-9 * len(p)
    assert ((out > 0) & (out < 1)).sum() <= 1
    assert ((out >= 0) & (out <= 1)).all()


def test_duels_keep_each_probability():
    p = np.array([0.2, 0.7, 0.5, 0.9, 0.3, 0.4])
    rng = np.random.default_rng(5)
    mean = np.mean([duel_along(p, rng.random(6)) for _ in range(20_000)], axis=0)
    assert np.abs(mean - p).max() < 0.015


def test_pivotal_sample_in_blocks_draws_exact_counts(spark):
    units = spark.range(5000).selectExpr("cast(id % 2 as int) as category", "id as key", "case when id % 2 = 0 then 0.2 else 0.64 end as prob", "cast(id % 7 as double) as place", "'x' as salt")
    got = {r.category: r.n for r in pivotal_sample(units, block=300).groupBy("category").agg({"key": "count"}).withColumnRenamed("count(key)", "n").collect()}
    assert got == {0: 500, 1: 1600}


def test_tilt_meets_its_moments():
    base, target = np.array([1000.0, 5.0, 0.0, 70.0]), np.array([3.0, 4.0, 2.0, 60.0])
    assert np.allclose(tilt(base, target), [3, 4, 0, 60])


@given(st.lists(st.tuples(st.integers(0, 500), st.just(0.0) | st.floats(1e-6, 1), st.integers(0, 6)), min_size=1, max_size=12), st.integers(0, 800))
@settings(max_examples=200, deadline=None, derandomize=True)
def test_plan_keeps_floors_and_ceilings(rows, size):
    available, share, floor = (np.array(x) for x in zip(*rows))
    share = share / share.sum() if share.sum() > 0 else np.zeros(len(share))
    expected = plan(available, share, floor, size)
    assert (expected <= available + 1e-6).all()
    if np.minimum(floor, available).sum() <= min(size, available.sum()):
        assert (expected >= np.minimum(floor, available) - 1e-6).all()
    free = (expected > np.minimum(floor, available) + 1e-6) & (expected < available - 1e-6) & (share > 0)
    if free.sum() > 1:  # those that are neither at their floor nor at their ceiling stand in the ratio of their shares
        k = np.flatnonzero(free)[0]
        assert np.allclose(expected[free] * share[k], expected[k] * share[free], rtol=1e-4)


ROWS = "row_id long, source string, pass_count int, probability string, category string"


def test_calibrated_sample_and_report(spark):
    rows = [(i, "a", 1, "p", "c") for i in range(700)] + [(1000 + i, "b", 1, "p", "c") for i in range(20)] + [(2000 + i, "b", None, None, None) for i in range(200)] + [(None, "a", 1, "", "")]
    rows += rows[:5]
    pool = spark.createDataFrame(rows, ROWS)
    targets = spark.createDataFrame([("a", 1, 0.5, 2), ("b", 1, 0.3, 2), ("b", None, 0.1, 2), ("gone", 4, 0.1, 5)], "source string, pass_count int, target_share double, min_rows int")
    c = CalibratedSample(pool, targets, ["source", "pass_count"], "row_id", size=100)
    got = c.sample().collect()
    assert len(got) == len({r.row_id for r in got}) == 100
    assert sum(r.source == "b" and r.pass_count == 1 for r in got) == 20
    report = {(r.source, r.pass_count): r for r in c.report().collect()}
    assert report[("gone", 4)].reason == "no rows" and report[("gone", 4)].drawn == 0
    assert report[("b", 1)].reason == "too few rows" and report[("b", 1)].gap_rows == pytest.approx(10)
    a, none = (sum(r.source == s and r.pass_count == p for r in got) for s, p in (("a", 1), ("b", None)))
    assert a + none == 80 and abs(a / none - 5) < 0.5
    again = CalibratedSample(pool, targets, ["source", "pass_count"], "row_id", size=100).sample()
    assert {r.row_id for r in again.collect()} == {r.row_id for r in got}


def test_floor_is_kept(spark):
    pool = spark.createDataFrame([(i, "big", 1, "", "") for i in range(900)] + [(1000 + i, "small", 1, "", "") for i in range(9)], ROWS)
    targets = spark.createDataFrame([("big", 1, 0.99, 0), ("small", 1, 0.01, 8)], "source string, pass_count int, target_share double, min_rows int")
    got = CalibratedSample(pool, targets, ["source", "pass_count"], "row_id", size=100).sample().groupBy("source").count().collect()
    assert {r.source: r["count"] for r in got} == {"big": 92, "small": 8}


def test_calibrated_empty_pool(spark):
    targets = spark.createDataFrame([("a", 1, 1.0, 2)], "source string, pass_count int, target_share double, min_rows int")
    c = CalibratedSample(spark.createDataFrame([], ROWS), targets, ["source", "pass_count"], "row_id")
    assert c.sample().count() == 0
    assert [r.reason for r in c.report().collect()] == ["no rows"]


def test_source_totals_are_limited_by_repeats():
    size, weight, repeats = np.array([100.0, 10.0, 0.0]), np.array([0.5, 0.4, 0.1]), np.array([1, 2, 4])
    assert np.allclose(source_totals(size, weight, repeats, None), [25, 20, 0])
    assert np.allclose(source_totals(size, weight, repeats, 90.0), [70, 20, 0])


def test_rake_meets_the_sources():
    cells, source, topic = np.array([10.0, 20, 30, 40]), np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])
    w = rake(cells, [(topic, np.array([40.0, 60.0])), (source, np.array([50.0, 50.0]))], np.full(4, 10.0))
    assert np.allclose(np.bincount(source, w * cells), [50, 50]) and np.allclose(np.bincount(topic, w * cells), [40, 60])


def test_mix_meets_weights_and_repeats(spark):
    rng = np.random.default_rng(2)
    rows = [(i, s, int(rng.integers(100, 300)), int(rng.integers(0, 3)), "x") for i, s in enumerate(["a"] * 3000 + ["b"] * 150)]
    rows += [(9001, "a", None, 1, "x"), (9002, None, 50, 1, "x"), (9003, "other", 50, None, "x"), (None, "a", 10, 1, "x")] + rows[:4]
    pool = spark.createDataFrame(rows, "row_id long, source string, chars int, topic int, whole string")
    weights = spark.createDataFrame([("a", 0.7, 1), ("b", 0.25, 3), ("none", 0.05, 4)], "source string, target_weight double, max_repeats int")
    m = SourceMix(pool, weights, "row_id", "source", "chars", ["topic"])
    got = m.mix().collect()
    assert len(got) == len({r.row_id for r in got})
    assert max(r.repeats for r in got if r.source == "b") <= 3 and max(r.repeats for r in got if r.source == "a") == 1
    report = {r.source: r for r in m.report().collect()}
    assert report["none"].reason == "no rows"
    assert report["a"].share == pytest.approx(0.7 / 0.95, abs=0.01) and report["b"].share == pytest.approx(0.25 / 0.95, abs=0.01)


def test_mix_of_nothing(spark):
    pool = spark.createDataFrame([], "row_id long, source string, chars int, topic int")
    weights = spark.createDataFrame([("a", 1.0, 1)], "source string, target_weight double, max_repeats int")
    m = SourceMix(pool, weights, "row_id", "source", "chars", ["topic"])
    assert m.mix().count() == 0 and [r.reason for r in m.report().collect()] == ["no rows"]


def test_rake_meets_three_marginals():
    rng = np.random.default_rng(1)
    of = [rng.integers(0, k, 200) for k in (3, 4, 5)]
    cells = rng.uniform(1, 5, 200)
    marginals = [(x, np.bincount(x, cells * rng.uniform(0.8, 1.2, 200))) for x in of]
    marginals = [(x, t / t.sum() * 500) for x, t in marginals]
    w = rake(cells, marginals, np.full(200, 50.0))
    for x, t in marginals:
        assert np.allclose(np.bincount(x, w * cells), t, rtol=1e-4)


def test_mix_holds_the_language_and_topic_marginals(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "ab"[i % 3 == 0], ["en", "de"][int(rng.random() < (0.1 if i % 3 else 0.5))], int(rng.integers(0, 3)), int(rng.integers(50, 90))) for i in range(6000)] + [(9999, "a", None, None, 60)]
    pool = spark.createDataFrame(rows, "row_id long, source string, language string, topic int, chars int")
    weights = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], "source string, target_weight double, max_repeats int")
    share = lambda df, c: {r[c]: r.n for r in df.groupBy(c).agg(F.sum(F.col("chars") * F.col("repeats")).alias("n")).collect()}
    mix = SourceMix(pool, weights, "row_id", "source", "chars", ["language", "topic"]).mix()
    for c in ("language", "topic"):
        got, base = share(mix, c), share(pool.withColumn("repeats", F.lit(1)), c)
        for v in base:
            assert got.get(v, 0) / sum(got.values()) == pytest.approx(base[v] / sum(base.values()), abs=0.01)
    got = share(mix, "source")
    assert got["a"] / sum(got.values()) == pytest.approx(0.5, abs=0.005)


def test_many_small_categories_draw_the_whole_size(spark):
    units = spark.range(3000).selectExpr("cast(id div 3 as int) as category", "id as key", "0.25 as prob", "0.0 as place")
    assert pivotal_sample(units, block=100).count() == 750
