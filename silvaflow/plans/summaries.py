"""Queries on class tables, quantiles, samples, orders and reshaped tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classes as C
from ..operators import stats
from ..operators import uncertainty as U
from ..operators import windows as W
from .registry import query
from .roles import SEG, chance, number_of, rounded, rounding, segments, table

_AGES = ["young", "middle", "old"]
_AGE = "CASE WHEN age BETWEEN 0 AND 10 THEN 'young' WHEN age BETWEEN 11 AND 60 THEN 'middle' WHEN age BETWEEN 61 AND 90 THEN 'old' END"


@query(f"WITH {SEG}, k AS (SELECT tile_num, kendall, {_AGE} AS label, agb FROM seg), g AS (SELECT * FROM (SELECT DISTINCT tile_num, kendall FROM k), (SELECT unnest({_AGES}) AS label)) SELECT tile_num, kendall, label, count(agb) AS count, round(avg(agb), 10) AS mean, round(stddev_pop(agb), 8) AS std, round(coalesce(sum(agb), 0), 6) AS sum FROM g LEFT JOIN k USING (tile_num, kendall, label) GROUP BY 1, 2, 3")
def age_class_stats(spark, sf_dir):
    """Statistics of each age class of a zone; empty classes have zeros."""
    age = F.col("age")
    k = segments(spark, sf_dir).withColumn("label", F.when(age.between(0, 10), "young").when(age.between(11, 60), "middle").when(age.between(61, 90), "old"))
    out = stats.class_stats(k, ["tile_num", "kendall"], "label", _AGES, "agb")
    return out.withColumns({"mean": F.round("mean", 10), "std": F.round("std", 8), "sum": F.round("sum", 6)})


_ELEVEN = list(range(11))


@query(f"WITH {SEG}, k AS (SELECT tile_num, {_AGE} AS label, kendall FROM seg) SELECT tile_num, label, count(*) AS classed, " + ", ".join(f"count(*) FILTER (kendall = {x}) AS class_{x}_count, round(count(*) FILTER (kendall = {x}) / count(*), 8) AS class_{x}_share" for x in _ELEVEN) + " FROM k GROUP BY 1, 2")
def trend_shares_by_age(spark, sf_dir):
    """Counts and shares of the eleven trend classes by age class."""
    age = F.col("age")
    k = segments(spark, sf_dir).withColumn("label", F.when(age.between(0, 10), "young").when(age.between(11, 60), "middle").when(age.between(61, 90), "old"))
    return rounded(stats.class_shares(k, ["tile_num", "label"], "kendall", _ELEVEN), 8)


@query(f"WITH {SEG}, e AS (SELECT {', '.join(f'quantile_cont(slope, {k / 10}) AS e{k}' for k in range(11))} FROM seg), b AS (SELECT CASE {' '.join(f'WHEN slope > e{k} AND slope <= e{k + 1} THEN {k}' for k in range(10))} END AS bin, agb FROM seg, e) SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(agb), 8) AS mean, round(median(agb), 6) AS median FROM b WHERE bin IS NOT NULL GROUP BY 1")
def decile_bins(spark, sf_dir):
    s = segments(spark, sf_dir)
    return s.transform(lambda d: stats.binned(d, "slope", "agb", stats.decile_edges(d, "slope"))).select("bin", "n", F.round("mean", 8).alias("mean"), F.round("median", 6).alias("median"))


_CHANGE = "w AS (SELECT tile_num, land_cover, age % 5 AS cohort, kendall % 5 AS trend, avg(agb) FILTER (year = 2000) - avg(agb) FILTER (year = 1997) AS change, avg(agb_sd) FILTER (year = 2000) AS sd FROM seg GROUP BY 1, 2, 3, 4)"


def _change(spark, sf_dir):
    at = lambda c, y: F.avg(F.when(F.col("year") == y, F.col(c)))
    by = ["tile_num", "land_cover", (F.col("age") % 5).alias("cohort"), (F.col("kendall") % 5).alias("trend")]
    return segments(spark, sf_dir).groupBy(*by).agg((at("agb", 2000) - at("agb", 1997)).alias("change"), at("agb_sd", 2000).alias("sd"))


@query(f"""WITH {SEG}, {_CHANGE} SELECT cohort, trend, count(*) AS n_total, count(change) AS n_with_data, count(*) - count(change) AS n_without, count(*) FILTER (change > 0) AS n_increase, count(*) FILTER (change < 0) AS n_decrease,
{", ".join(f"round({e}, 9) AS {n}" for n, e in {"mean_change": "avg(change)", "sd_change": "stddev_samp(change)", "total_change": "sum(change)", "median_change": "median(change)", "percent_increasing": "CASE WHEN count(change) > 0 THEN 100.0 * count(*) FILTER (change > 0) / count(change) END", "percent_decreasing": "CASE WHEN count(change) > 0 THEN 100.0 * count(*) FILTER (change < 0) / count(change) END", "mean_uncertainty": "avg(sd)", "median_uncertainty": "median(sd)"}.items())} FROM w GROUP BY 1, 2""")
def age_trend_summary(spark, sf_dir):
    """Changes over landscapes by age and trend."""
    return rounded(stats.change_summary(_change(spark, sf_dir), ["cohort", "trend"], "change", "sd"), 9)


@query(f"WITH {SEG}, {_CHANGE}, s AS (SELECT cohort, trend, sum(change) AS total, count(change) AS n FROM w GROUP BY 1, 2) SELECT cohort, " + ", ".join(f'round(max(CASE WHEN trend = {t} THEN total END), 6) AS "t{t}_total", max(CASE WHEN trend = {t} THEN n END) AS "t{t}_n"' for t in range(5)) + " FROM s GROUP BY 1")
def age_trend_wide(spark, sf_dir):
    """One row a cohort, columns named by trend."""
    s = _change(spark, sf_dir).groupBy("cohort", F.concat(F.lit("t"), F.col("trend").cast("string")).alias("trend")).agg(F.sum("change").alias("total"), F.count("change").alias("n"))
    return rounded(W.widened(s, ["cohort"], "trend", [f"t{t}" for t in range(5)], {"total": F.col("total"), "n": F.col("n")}))


@query(f"WITH {SEG} SELECT granule, line, part, tile_num, unnest(['h_can', 'slope', 'agb']) AS variable, unnest([h_can, slope, agb]) AS value FROM seg")
def melted_segments(spark, sf_dir):
    return W.melted(segments(spark, sf_dir), ["granule", "line", "part", "tile_num"], ["h_can", "slope", "agb"])


@query(f"WITH {SEG} SELECT cohort, trend, CAST(row_number() OVER (ORDER BY CASE cohort WHEN 'non-forest' THEN 1 WHEN 'young' THEN 2 WHEN 'maturing' THEN 3 WHEN 'mature' THEN 4 ELSE 5 END, CASE trend WHEN 'strong_decline' THEN 1 WHEN 'moderate_decline' THEN 2 WHEN 'stable' THEN 3 ELSE 9 END, trend) AS INTEGER) AS place, n FROM (SELECT CASE WHEN age = 0 THEN 'non-forest' WHEN age <= 20 THEN 'young' WHEN age <= 80 THEN 'maturing' ELSE 'mature' END AS cohort, CASE kendall % 5 WHEN 0 THEN 'strong_decline' WHEN 1 THEN 'moderate_decline' WHEN 2 THEN 'stable' WHEN 3 THEN 'moderate_increase' ELSE 'strong_increase' END AS trend, count(*) AS n FROM seg GROUP BY 1, 2)")
def ordered_categories(spark, sf_dir):
    """Rows in the declared order of their categories (two trends aren't declared), numbered."""
    n = segments(spark, sf_dir).groupBy(C.cohort_label(C.age_cohort(F.col("age"))).alias("cohort"), C.trend_label(F.col("kendall") % 5).alias("trend")).agg(F.count("*").alias("n"))
    rows = W.ordered(n, ("cohort", list(C.COHORT_LABELS.values())), ("trend", list(C.TREND_LABELS.values())[:3]))
    return rows.coalesce(1).withColumn("place", (F.monotonically_increasing_id() + 1).cast("int"))


@query(f"SELECT c_custkey FROM customer ORDER BY {chance('c_custkey', 3)}, c_custkey LIMIT 40")
def random_sample(spark, sf_dir):
    return W.hash_sample(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], 40, 3)


@query(f"SELECT o_orderkey, substr({chance('o_orderkey', 5)}, 1, 7) < '{int(0.3 * 16**7):07x}' AS training FROM orders WHERE substr({chance('o_orderkey', 2)}, 1, 7) < '{int(0.6 * 16**7):07x}'")
def fraction_sample(spark, sf_dir):
    """A fraction of the rows, split into those for training and the others."""
    some = W.hash_fraction(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 0.6, 2)
    train, test = W.split(some, ["o_orderkey"], 0.3, 5)
    return train.withColumn("training", F.lit(True)).unionByName(test.withColumn("training", F.lit(False)))


@query(f"SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY {chance('o_orderkey', 7)}, o_orderkey) <= 4")
def sample_per_tile(spark, sf_dir):
    return W.per_group(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], [W.hash_order(["o_orderkey"], 7), F.col("o_orderkey")], 4)


_BINNED = "b AS (SELECT o_orderkey, CAST(CASE WHEN o_totalprice > c3 THEN 3 WHEN o_totalprice > c2 THEN 2 WHEN o_totalprice > c1 THEN 1 ELSE 0 END AS INTEGER) AS bin FROM orders, (SELECT quantile_cont(o_totalprice, 0.25) AS c1, quantile_cont(o_totalprice, 0.5) AS c2, quantile_cont(o_totalprice, 0.75) AS c3 FROM orders))"


@query(f"WITH {_BINNED} SELECT o_orderkey, bin FROM b QUALIFY row_number() OVER (PARTITION BY bin ORDER BY {chance('o_orderkey')}, o_orderkey) <= 25")
def hashed_samples(spark, sf_dir):
    """As many rows of each quarter of the prices."""
    return W.stratified(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"], 4, 25).select("o_orderkey", "bin")


@query(f"WITH {_BINNED}, r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY {chance('o_orderkey')}, o_orderkey) - 1 AS place FROM b), d AS (SELECT bin, CAST(draw AS INTEGER) AS draw, {number_of(chance('bin, draw'))} % n AS place FROM (SELECT bin, n, unnest(generate_series(1, least(25, n))) AS draw FROM (SELECT bin, count(*) AS n FROM b GROUP BY 1))) SELECT o_orderkey, bin, draw FROM r JOIN d USING (bin, place)")
def samples_with_replacement(spark, sf_dir):
    out = W.stratified(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"], 4, 25, replace=True)
    return out.select("o_orderkey", "bin", F.col("draw").cast("int").alias("draw"))


@query(f"WITH l AS (SELECT s_suppkey FROM supplier WHERE s_suppkey <= 7), b AS (SELECT c_custkey FROM customer QUALIFY row_number() OVER (ORDER BY {chance('c_custkey', 1)}, c_custkey) <= 50 - (SELECT count(*) FROM l)) SELECT s_suppkey AS id FROM l UNION ALL SELECT c_custkey FROM b")
def topped_up_sample(spark, sf_dir):
    """Few local rows, made up to fifty from a broader table."""
    local = table(spark, sf_dir, "supplier").filter("s_suppkey <= 7").select(F.col("s_suppkey").alias("id"))
    return W.topped_up(local, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), 50, ["id"], 1)


@query(f"SELECT o_orderkey, CAST({number_of(chance('o_orderkey', 4))} % 5 AS INTEGER) AS fold FROM orders")
def cross_folds(spark, sf_dir):
    return W.folds(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 5, 4)


@query("SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) / 64) AS INTEGER) AS chunk FROM orders")
def work_chunks(spark, sf_dir):
    return W.chunks(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 64).select("o_orderkey", "chunk")


@query("SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer")
def strict_union(spark, sf_dir):
    """Rows of two tables of the same columns, by name."""
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")).unionByName(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")))


@query(f"WITH {SEG}, t AS (SELECT land_cover % 7 AS cohort, kendall % 5 AS trend, sum(agb * 0.09) AS total, sqrt(sum(agb_sd * 0.09 * agb_sd * 0.09)) AS total_sd, count(*) AS n FROM seg WHERE age > 100 AND slope < 6 AND land_cover > 100 GROUP BY 1, 2), g AS (SELECT unnest(generate_series(0, 7)) AS cohort), h AS (SELECT unnest(generate_series(0, 4)) AS trend) SELECT CAST(cohort AS INTEGER) AS cohort, CAST(trend AS INTEGER) AS trend, round(coalesce(total, 0), 9) AS total, round(total_sd, 9) AS total_sd FROM g CROSS JOIN h LEFT JOIN t USING (cohort, trend)")
def uncertainty_by_age_and_trend(spark, sf_dir):
    """Totals of every combination of age and trend, zero where there is none."""
    s = segments(spark, sf_dir).filter("age > 100 AND slope < 6 AND land_cover > 100").withColumns({"cohort": F.col("land_cover") % 7, "trend": F.col("kendall") % 5})
    t = U.analytic_total(s, ["cohort", "trend"], "agb", "agb_sd", 0.09)
    return rounded(U.zero_filled(t, [("cohort", list(range(8))), ("trend", list(range(5)))], ["total"]).select("cohort", "trend", "total", "total_sd"), 9)


@query(f"WITH {SEG}, i AS (SELECT tile_num, year AS iteration, sum(agb) AS value FROM seg GROUP BY 1, 2) SELECT tile_num, {rounding('mean sd p5 p95', 8)} FROM (SELECT tile_num, avg(value) AS mean, stddev_samp(value) AS sd, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.95) AS p95 FROM i GROUP BY 1)")
def over_iterations(spark, sf_dir):
    """Mean, deviation and percentiles of a tile's totals over iterations."""
    i = segments(spark, sf_dir).groupBy("tile_num", F.col("year").alias("iteration")).agg(F.sum("agb").alias("value"))
    return rounded(stats.over_iterations(i, ["tile_num"], "value"), 8)


@query(f"WITH {SEG} SELECT tile_num, 'v1' AS version, 2020 AS made, {', '.join(f'round(quantile_cont(slope, {q}), 8) AS {n}' for n, q in stats.QUANTILES.items())}, count(slope) AS count FROM seg GROUP BY 1")
def versioned_tile_stats(spark, sf_dir):
    """Tile statistics with the columns of the run that made them."""
    out = stats.tile_stats(segments(spark, sf_dir), "tile_num", "slope")
    return rounded(out.select("tile_num", F.lit("v1").alias("version"), F.lit(2020).alias("made"), *stats.QUANTILES, "count"), 8)


@query(f"WITH {SEG}, p AS (SELECT snow, land_cover, agb AS o, h_can * CAST(1.5 AS DOUBLE) + 1 AS f FROM seg) SELECT snow, land_cover, {rounding('rmse bias')} FROM (SELECT snow, land_cover, sqrt(avg((f - o) * (f - o))) AS rmse, avg(f - o) AS bias FROM p GROUP BY 1, 2)")
def map_validation(spark, sf_dir):
    """Errors of a map within classes."""
    from ..operators import model as M

    s = segments(spark, sf_dir).withColumn("predicted", F.col("h_can") * 1.5 + 1)
    return rounded(M.skill_table("agb", "predicted", s, ["snow", "land_cover"]).select("snow", "land_cover", "rmse", "bias"))
