"""Quantiles, rank statistics, breaks, draws and models against values worked out another way."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvaflow.functions import student
from silvaflow.operators import model, stats, trend, uncertainty, windows


@pytest.mark.parametrize("degrees, want", [(1, 12.7062), (4, 2.7764), (30, 2.0423), (31, 2.0395), (49, 2.0096), (120, 1.9799)])
def test_student_quantiles(spark, degrees, want):
    assert student.quantile(degrees) == pytest.approx(want, abs=5e-5)
    assert student.two_sided(want, degrees) == pytest.approx(0.05, abs=1e-5)
    row = spark.createDataFrame([(degrees,)], "n int").select(student.quantile_of(F.col("n")).alias("q"), student.quantile_of(F.lit(0)).alias("none")).first()
    assert row.q == pytest.approx(student.quantile(degrees), abs=1e-6) and row.none is None
    assert student.normal_quantile() == pytest.approx(1.959963985, abs=1e-8)


def test_bounds_beyond_thirty_degrees(spark):
    low = trend.confidence(F.lit(0.0), F.lit(1.0), F.lit(33))["high"]
    assert spark.range(1).select(low.alias("x")).first().x == pytest.approx(2.0395, abs=5e-5)


def brute_rank_trend(t, v):
    slopes = sorted((v[j] - v[i]) / (t[j] - t[i]) for i, j in itertools.combinations(range(len(t)), 2) if t[i] != t[j])
    con = sum(np.sign(t[j] - t[i]) * np.sign(v[j] - v[i]) for i, j in itertools.combinations(range(len(t)), 2))
    return slopes, con


@pytest.mark.parametrize("seed", range(4))
def test_rank_trend_against_all_pairs(monkeypatch, seed):
    rng = np.random.default_rng(seed)
    t, v = np.sort(rng.integers(0, 25, 40)).astype(float), rng.integers(0, 12, 40).astype(float)
    if seed % 2:  # many slopes: narrowed down by counting
        monkeypatch.setattr(trend, "HELD", 20)
        monkeypatch.setattr(trend, "CELLS", 90)
    slopes, con = brute_rank_trend(t, v)
    n, slope, _, low, high, tau, p, _ = trend.rank_trend(t, v)
    assert n == 40 and slope == pytest.approx(float(np.median(slopes)))
    assert low in slopes and high in slopes and low <= slope <= high
    assert trend.concordance(t, v) == con and 0 <= p <= 1 and abs(tau) <= 1
    assert trend.order_statistics(t, v, (0, 7, len(slopes) - 1), len(slopes)) == pytest.approx([slopes[0], slopes[7], slopes[-1]])


def test_last_break_counts_gaps_as_places():
    v = np.array([1.0] * 15 + [9.0] * 5)
    v[3] = np.nan
    t = np.arange(20.0)
    assert trend.last_break(t, v, 1.0) == (15.0, 8.0, 1)
    # gaps shorten nothing: without them the same break would not lie late enough
    gappy = np.concatenate([np.full(10, np.nan), np.ones(10), np.full(10, 9.0)])
    assert trend.last_break(np.arange(30.0), gappy, 1.0)[2] == 1
    assert trend.last_break(np.arange(30.0), gappy, 1.0)[0] is None  # 20 of 30 is not past 0.7
    assert trend.last_break(np.arange(4.0), np.ones(4)) == (None, None, 0)


def test_converged_leaves_the_latest_nine_out():
    assert not windows.converged([1.0] * 9)
    sds = [2.0] * 21 + [1.0] * 9
    assert not windows.converged(sds, 0.1) and windows.converged(sds, 0.2)
    assert abs(sum(sds) / 30 / 2 - 1) == pytest.approx(0.15)


def test_draws_are_normal_and_independent(spark):
    d = uncertainty.draws(spark.range(200).withColumnRenamed("id", "k"), 100)
    z = lambda stream: uncertainty.hashed_normal([F.col("k")], F.col("sim"), stream)
    r = d.select(z(0).alias("a"), z(1).alias("b")).agg(F.avg("a").alias("m"), F.stddev("a").alias("s"), F.corr("a", "b").alias("r"), F.skewness("a").alias("g"), F.kurtosis("a").alias("k"), F.avg((F.abs("a") > 1.96).cast("int")).alias("tail")).first()
    assert abs(r.m) < 0.03 and abs(r.s - 1) < 0.02 and abs(r.r) < 0.03 and abs(r.g) < 0.06 and abs(r.k) < 0.12 and abs(r.tail - 0.05) < 0.006
    same = d.repartition(7).select("k", "sim", z(0).alias("a")).orderBy("k", "sim").collect()
    assert same == d.select("k", "sim", z(0).alias("a")).orderBy("k", "sim").collect()


def test_accumulation_bounds_use_student(spark):
    df = spark.createDataFrame([(1, 100.0, 10.0, 50.0, 5.0)], "id long, biomass_mean double, biomass_std double, age_mean double, age_std double")
    r = uncertainty.carbon_accumulation(df, ["id"], 5).first()
    assert (r.carbon_high - r.carbon_mean) / (r.carbon_sd / math.sqrt(5)) == pytest.approx(2.776445, abs=1e-5)


def test_quantiles_by_counts(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), float(x)) for g in range(3) for x in rng.integers(0, 9, 5 + 7 * g)] + [(0, None)]
    got = {r.g: r for r in stats.quantiles(spark.createDataFrame(rows, "g int, x double"), ["g"], "x", {"a": 0.0, "b": 0.37, "c": 1.0}).collect()}
    for g in range(3):
        x = [v for k, v in rows if k == g and v is not None]
        assert (got[g].a, got[g].b, got[g].c) == pytest.approx(tuple(np.quantile(x, [0, 0.37, 1])))


def test_replaced_samples_repeat_rows(spark):
    df = spark.range(8).select("id", (F.col("id") * 1.0).alias("x"))
    got = windows.stratified(df, "x", ["id"], 2, 100, replace=True)
    assert got.count() == 8 and got.select("id").distinct().count() < 8  # as many draws as a bin has rows at most


def test_numbers_of_rows_and_chunks(spark):
    df = spark.range(100).select((99 - F.col("id")).alias("k")).repartition(6)
    assert [(r.k, r.fid) for r in windows.row_ids(df, ["k"]).orderBy("k").collect()] == [(k, k + 1) for k in range(100)]
    assert {r.chunk: r["count"] for r in windows.chunks(df, ["k"], 30).groupBy("chunk").count().collect()} == {0: 30, 1: 30, 2: 30, 3: 10}


def test_learners(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 2))
    df = spark.createDataFrame([(i, float(a), float(b), float(3 * a - b + 1)) for i, (a, b) in enumerate(x)], "id long, a double, b double, y double").repartition(2)
    predict = model.neural(df, ["a", "b"], "y", hidden=4, rounds=25, rate=0.2)
    error = predict(df).agg(F.sqrt(F.avg((F.col("prediction") - F.col("y")) ** 2)).alias("e"), F.stddev("y").alias("s")).first()
    assert error.e < 0.4 * error.s
    best = model.randomly_searched(df, ["a", "b"], "y", tries=2, trees=(3, 5), depths=(2, 4), k=2)
    assert len(best.avgMetrics) == 2
    near = model.nearest(df, df, "id", ["a", "b"], "y", k=1).join(df, "id")
    assert near.filter(F.abs(F.col("prediction") - F.col("y")) > 1e-9).count() == 0


def test_correlation_test(spark):
    df = spark.createDataFrame([(float(i), float(i % 5), float(i * i)) for i in range(20)], "a double, b double, y double")
    r = {x.feature: x for x in model.correlations(df, ["a", "b"], "y").collect()}
    assert r["a"].p < 1e-10 < 0.05 < r["b"].p and r["a"].n == 20
    assert r["b"].p == pytest.approx(student.two_sided(abs(r["b"].t), 18))


def test_simulated_totals_are_dealt_out_and_whole(spark):
    rows = [(k % 3, k, 10.0 + k, 4.0) for k in range(50)] + [(3, 50, None, 1.0), (3, 51, 5.0, None), (None, 52, 5.0, 0.0)]
    df = spark.createDataFrame(rows, "g int, k int, m double, s double").coalesce(1)
    out = uncertainty.simulated_totals(df, ["g"], ["k"], "m", "s", 2.0, n=13)
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()  # a file of one piece isn't one task
    got = {r.g: r for r in out.collect()}
    value = F.greatest(F.col("m") + F.col("s") * uncertainty.hashed_normal([F.col("k")], F.col("sim")), F.lit(0.0)) * 2.0
    totals = uncertainty.draws(df, 13).groupBy("g", "sim").agg(F.sum(value).alias("t")).collect()
    for g, r in got.items():
        t = [x.t for x in totals if x.g == g]
        assert r.n_draws == len(t) == 13
        assert (r["mean"], r.sd, r.low, r.high) == pytest.approx((np.mean(t), np.std(t), np.quantile(t, 0.025), np.quantile(t, 0.975)), rel=1e-12)
    assert len(got) == 5


def test_two_band_of_many_pixels_and_nulls(spark):
    import time

    rows = [(k, 10.0 + k, 4.0) for k in range(5)] + [(5, None, 1.0), (6, 5.0, None), (None, 5.0, 1.0), (7, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "k int, m double, s double")
    got = {r.k: r for r in uncertainty.two_band(df, ["k"], "m", "s", n=13).collect()}
    drawn = uncertainty.draws(df, 13).withColumn("v", F.col("m") + F.col("s") * uncertainty.hashed_normal([F.col("k")], F.col("sim"))).collect()
    for k in range(5):
        v = [x.v for x in drawn if x.k == k]
        assert (got[k].sim_mean, got[k].sim_sd) == pytest.approx((np.mean(v), np.std(v)), rel=1e-9)
    assert all(got[k].sim_mean is None and got[k].pi_high is None for k in (5, 6, None)) and math.isnan(got[7].sim_mean)
    assert uncertainty.two_band(df.limit(0), ["k"], "m", "s").count() == 0
    many = spark.range(0, 400_000, 1, 1).select(F.col("id").alias("k"), F.lit(50.0).alias("m"), F.lit(2.0).alias("s"))
    began = time.time()
    uncertainty.two_band(many, ["k"], "m", "s").write.format("noop").mode("overwrite").save()
    assert time.time() - began < 15  # twenty million draws in one task: too many for lambdas


def test_nearest_equals_brute_force(spark):
    import time

    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(3000, 3)).round(1), rng.integers(0, 50, 3000).astype(float)
    z = rng.normal(size=(300, 3)) * 1.5
    z[0] = np.nan
    train = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)] + [(None, 1.0, 1.0, -9.0), (1.0, 1.0, 1.0, None)], "a double, b double, c double, y double")
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(z)], "id long, a double, b double, c double")
    got = {r.id: r.prediction for r in model.nearest(train, rows, "id", ["a", "b", "c"], "y", k=4).collect()}
    low, mid, high = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    far = ((((z - mid) / (high - low))[:, None] - ((x - mid) / (high - low))[None]) ** 2).sum(axis=2).round(9)
    for i in range(300):
        assert got[i] == pytest.approx(y[np.lexsort((y, far[i]))[:4]].mean(), rel=1e-12)
    few = model.nearest(train.limit(2), rows.limit(3), "id", ["a", "b", "c"], "y", k=4).collect()
    assert len(few) == 3 and len({r.prediction for r in few}) == 1
    assert model.nearest(train, rows.limit(0), "id", ["a", "b", "c"], "y").count() == 0
    many = spark.range(60_000).select("id", *[F.randn(k).alias(c) for k, c in enumerate("abcy")])
    began = time.time()
    model.nearest(many, many.filter("id % 2 = 0"), "id", ["a", "b"], "y").write.format("noop").mode("overwrite").save()
    assert time.time() - began < 20  # of 1.8 billion pairs few are looked at
