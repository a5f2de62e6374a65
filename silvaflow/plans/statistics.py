"""Queries on statistics, spectra, composites, trends, uncertainty and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classes as C
from ..functions import spectral as P
from ..functions.scalars import decibel, decimal_year
from ..functions.student import normal_quantile
from ..operators import model as M
from ..operators import quality as Q
from ..operators import raster as R
from ..operators import stats, trend, uncertainty
from ..operators import windows as W
from ..streaming import incremental
from .registry import query
from .roles import BEAM, REFL, SEG, SER, rounded, rounding, reflectance, segments, series, table

FIXED = ", ".join(f"round(quantile_cont(agb, {q}), 8) AS {n}" for n, q in stats.QUANTILES.items())
MOMENTS = "round(sum({0}), 6) AS {1}sum, min({0}) AS {1}min, round(avg({0}), 10) AS {1}mean, max({0}) AS {1}max, round(stddev_samp({0}), 8) AS {1}sd, count({0}) AS {1}count"


def _moments(df, *prefixes: str):
    """Digits of the moments' rounding."""
    digits = {p + n: d for p in prefixes for n, d in (("sum", 6), ("mean", 10), ("sd", 8))}
    return df.withColumns({c: F.round(c, d) for c, d in digits.items() if c in df.columns})


@query(f"WITH {SEG} SELECT tile_num, {MOMENTS.format('agb', '')}, {FIXED} FROM seg GROUP BY 1")
def tile_stats_full(spark, sf_dir):
    out = _moments(stats.tile_stats(segments(spark, sf_dir), "tile_num", "agb"), "")
    return out.withColumns({q: F.round(q, 8) for q in stats.QUANTILES})


@query(f"""WITH {SEG}, x AS (SELECT tile_num, agb AS a, CASE WHEN slope < 15 THEN agb END AS b, CASE WHEN month > 12 THEN agb END AS c FROM seg), s AS (SELECT tile_num, {MOMENTS.format('a', 'full_')}, {MOMENTS.format('b', 'boreal_')}, {MOMENTS.format('c', 'none_')} FROM x GROUP BY 1)
SELECT * REPLACE ({", ".join(f"coalesce({p}_{n}, 0) AS {p}_{n}" for p in ("full", "boreal", "none") for n in ("sum", "min", "mean", "max", "sd"))}) FROM s""")
def tile_stats_extents(spark, sf_dir):
    out = stats.extent_stats(segments(spark, sf_dir), "tile_num", "agb", {"full": F.lit(True), "boreal": F.col("slope") < 15, "none": F.col("month") > 12})
    return _moments(out, "full_", "boreal_", "none_")


@query(f"WITH {SEG} SELECT land_cover, n_name, count(*) AS pixels, round(count(*) * CAST(0.09 AS DOUBLE), 6) AS area_ha, round(avg(agb), 10) AS mean, round(stddev_samp(agb), 8) AS sd, round(sum(agb), 6) AS total FROM seg JOIN supplier ON s_suppkey = tile_num JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2")
def class_summary(spark, sf_dir):
    tiles = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("tile_num"), "n_name")
    out = segments(spark, sf_dir).join(tiles, "tile_num").groupBy("land_cover", "n_name")
    return out.agg(F.count("*").alias("pixels"), F.round(F.count("*") * 0.09, 6).alias("area_ha"), F.round(F.avg("agb"), 10).alias("mean"), F.round(F.stddev_samp("agb"), 8).alias("sd"), F.round(F.sum("agb"), 6).alias("total"))


@query(f"""WITH {SEG}, k AS (SELECT CAST(CASE WHEN age <= 0 THEN 0 WHEN age <= 20 THEN 1 WHEN age <= 36 THEN 2 WHEN age <= 60 THEN 3 WHEN age <= 80 THEN 4 WHEN age <= 100 THEN 5 WHEN age <= 150 THEN 6 ELSE 7 END AS INTEGER) AS age_class, land_cover, kendall, agb FROM seg)
SELECT age_class, land_cover, kendall, CAST(grouping(age_class, land_cover, kendall) AS INTEGER) AS level, count(*) AS n, round(sum(agb), 6) AS total FROM k GROUP BY GROUPING SETS ((age_class, land_cover, kendall), (age_class), (age_class, kendall), ())""")
def grouping_sets_summary(spark, sf_dir):
    k = segments(spark, sf_dir).withColumn("age_class", C.age_class(F.col("age")))
    a, lc, t = F.col("age_class"), F.col("land_cover"), F.col("kendall")
    out = k.groupingSets([[a, lc, t], [a], [a, t], []], a, lc, t)
    return out.agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.round(F.sum("agb"), 6).alias("total"))


@query(f"""WITH {SEG}, m AS (SELECT tile_num, median(h_can) AS med FROM seg GROUP BY 1), k AS (SELECT tile_num, h_can AS mode FROM seg GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY tile_num ORDER BY count(*) DESC, h_can) = 1),
d AS (SELECT tile_num, 1.4826 * median(abs(h_can - med)) AS nmad FROM seg JOIN m USING (tile_num) GROUP BY 1)
SELECT tile_num, round(avg(h_can), 10) AS mean, round(stddev_pop(h_can), 8) AS std, min(h_can) AS min, max(h_can) AS max, count(h_can) AS count, sum(h_can) AS sum, median(h_can) AS median, any_value(k.mode) AS mode, round(any_value(CAST(d.nmad AS DOUBLE)), 6) AS nmad FROM seg JOIN k USING (tile_num) JOIN d USING (tile_num) GROUP BY 1""")
def zonal_stats(spark, sf_dir):
    out = stats.zonal_stats(segments(spark, sf_dir), "tile_num", "h_can")
    return out.withColumns({"mean": F.round("mean", 10), "std": F.round("std", 8), "nmad": F.round("nmad", 6)})


@query(f"WITH {SEG}, k AS (SELECT age % 8 AS age, kendall % 5 AS trend, agb FROM seg) SELECT age, trend, CAST(grouping(age, trend) AS INTEGER) AS level, round(sum(agb), 6) AS total, round(avg(agb), 10) AS mean_density, count(agb) AS pixels FROM k GROUP BY CUBE (age, trend)")
def biomass_cube(spark, sf_dir):
    k = segments(spark, sf_dir).select((F.col("age") % 8).alias("age"), (F.col("kendall") % 5).alias("trend"), "agb")
    out = stats.cube_totals(k, ["age", "trend"], "agb")
    return out.select("age", "trend", "level", F.round(F.col("stock_pg") / (0.09 * 1e-9), 6).alias("total"), F.round("mean_density", 10).alias("mean_density"), "pixels")


@query(f"""WITH {SEG}, b AS (SELECT *, CASE WHEN h_can > 0 AND h_can <= 10 THEN 0 WHEN h_can > 10 AND h_can <= 25 THEN 1 WHEN h_can > 25 AND h_can <= 50 THEN 2 END AS bin FROM seg)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(agb), 10) AS mean, round(median(agb), 8) AS median FROM b WHERE bin IS NOT NULL GROUP BY 1""")
def binned_stats(spark, sf_dir):
    out = stats.binned(segments(spark, sf_dir), "h_can", "agb", [0, 10, 25, 50])
    return out.select("bin", "n", F.round("mean", 10).alias("mean"), F.round("median", 8).alias("median"))


@query(f"WITH {SEG}, p AS (SELECT land_cover, agb AS o, h_can * CAST(1.5 AS DOUBLE) + 1 AS f FROM seg) SELECT land_cover, {rounding('rmse rel_rmse bias rel_bias r r2')} FROM (SELECT land_cover, sqrt(avg((f - o) * (f - o))) AS rmse, 100 * sqrt(avg((f - o) * (f - o))) / avg(o) AS rel_rmse, avg(f - o) AS bias, 100 * avg(f - o) / avg(o) AS rel_bias, corr(o, f) AS r, regr_r2(o, f) AS r2 FROM p GROUP BY 1)")
def model_skill(spark, sf_dir):
    return rounded(segments(spark, sf_dir).groupBy("land_cover").agg(*stats.skill(F.col("agb"), F.col("h_can") * 1.5 + 1)))


@query("SELECT o_orderstatus, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM orders), 6) AS percent FROM orders GROUP BY 1")
def percent_of_total(spark, sf_dir):
    return rounded(stats.shares(table(spark, sf_dir, "orders"), "o_orderstatus"))


@query(f"""WITH {REFL} SELECT vec_id, {rounding('ndvi ndsi savi msavi ndmi evi evi2 nbr nbr2 db', 5)} FROM (SELECT vec_id, (nir - red) / (nir + red) AS ndvi, (green - swir) / (green + swir) AS ndsi, 1.5 * (nir - red) / (nir + red + 0.5) AS savi,
(2 * nir + 1 - sqrt((2 * nir + 1) * (2 * nir + 1) - 8 * (nir - red))) / 2 AS msavi, (nir - swir) / (nir + swir) AS ndmi, 2.5 * (nir - red) / (nir + 6 * red - 7.5 * blue + 1) AS evi, 2.5 * (nir - red) / (nir + 2.4 * red + 1) AS evi2,
(nir - swir2) / (nir + swir2) AS nbr, (swir - swir2) / (swir + swir2) AS nbr2, 10 * log10(nir) AS db FROM refl)""")
def spectral_indices(spark, sf_dir):
    r = reflectance(spark, sf_dir)
    return rounded(r.select("vec_id", *[c.alias(n) for n, c in P.indices({b: F.col(b) for b in P.BANDS}).items()], decibel(F.col("nir")).alias("db")), 5)


@query(f"WITH {REFL} SELECT vec_id, " + ", ".join("round(" + " + ".join(f"{b} * CAST({w} AS DOUBLE)" for b, w in list(zip(P.BANDS, ws))[:5]) + f", 6) AS {n}" for n, ws in P.TASSELLED.items()) + " FROM refl")
def tasseled_cap(spark, sf_dir):
    return rounded(reflectance(spark, sf_dir).select("vec_id", *[c.alias(n) for n, c in P.tasselled_cap({b: F.col(b) for b in P.BANDS}).items()]))


@query("WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_partkey % 256 AS INTEGER) AS qa FROM lineitem) SELECT qa, ((qa >> 1) & 1) = 1 OR ((qa >> 2) & 1) = 1 OR ((qa >> 3) & 1) = 1 OR ((qa >> 4) & 1) = 1 OR ((qa >> 5) & 1) = 1 OR (qa & 192) = 192 AS masked, count(*) AS n FROM q GROUP BY 1, 2")
def bitmask_decode(spark, sf_dir):
    q = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 256).cast("int").alias("qa"))
    return q.groupBy("qa", P.qa_masked(F.col("qa")).alias("masked")).agg(F.count("*").alias("n"))


@query("SELECT event_id, round(year(ts) + dayofyear(ts) / 365.25, 8) AS t FROM events")
def decimal_year_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(decimal_year(F.year("ts"), F.dayofyear("ts")), 8).alias("t"))


@query(f"WITH {SEG} SELECT tile_num, month, arg_max(granule, (h_can, -granule, -line, -part)) AS scene, max(h_can) AS h_can, count(*) AS n_valid FROM seg GROUP BY 1, 2")
def max_composite(spark, sf_dir):
    df = segments(spark, sf_dir).withColumn("scene", F.struct("granule", "line", "part"))
    return R.composite(df, ["tile_num", "month"], "h_can", ["agb"], "scene").select("tile_num", "month", F.col("scene.granule").alias("scene"), "h_can", "n_valid")


@query(f"""WITH {SEG}, g AS (SELECT tile_num, month, quantile_cont(h_can, 0.75) AS goal FROM seg GROUP BY 1, 2)
SELECT tile_num, month, granule AS scene, h_can FROM seg JOIN g USING (tile_num, month) QUALIFY row_number() OVER (PARTITION BY tile_num, month ORDER BY abs(h_can - goal), granule, line, part) = 1""")
def pct_composite(spark, sf_dir):
    df = segments(spark, sf_dir).withColumn("scene", F.struct("granule", "line", "part"))
    return R.percentile_composite(df, ["tile_num", "month"], "h_can", ["agb"], "scene", 0.75).select("tile_num", "month", F.col("scene.granule").alias("scene"), "h_can")


@query("SELECT event_type, CAST(dayofyear(ts) AS INTEGER) AS day, round(avg(value), 8) AS mean, round(stddev_pop(value), 6) AS sd, count(*) AS n FROM events GROUP BY 1, 2")
def ensemble_mean_std(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", F.dayofyear("ts").alias("day")).agg(F.round(F.avg("value"), 8).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("sd"), F.count("*").alias("n"))


@query(f"""WITH {SER}, s AS (SELECT pixel, count(*) AS n, regr_slope(v, t) AS slope, regr_intercept(v, t) AS intercept, regr_r2(v, t) AS r2, regr_sxx(v, t) AS sxx, regr_syy(v, t) AS syy, regr_sxy(v, t) AS sxy FROM ser GROUP BY 1)
SELECT pixel, CASE WHEN n >= 3 THEN n ELSE 0 END AS n_obs, round(CASE WHEN n >= 3 THEN slope END, 6) AS slope, round(CASE WHEN n >= 3 THEN intercept END, 6) AS intercept, round(CASE WHEN n >= 3 THEN r2 END, 6) AS r2, round(CASE WHEN n >= 3 THEN sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2) / sxx) END, 6) AS se FROM s""")
def ols_trend(spark, sf_dir):
    return rounded(trend.ols(series(spark, sf_dir), ["pixel"], "t", "v"))


_PAIRS = f"{SER}, p AS (SELECT a.pixel, (b.v - a.v) / (b.t - a.t) AS s FROM ser a JOIN ser b ON a.pixel = b.pixel AND a.t < b.t), m AS (SELECT pixel, count(*) AS n, median(t) AS t, median(v) AS v FROM ser GROUP BY 1)"
_TIES = ", ".join(f"k{c} AS (SELECT pixel, sum(k * (k - 1) * (2 * k + 5)) AS k{c} FROM (SELECT pixel, {c}, count(*) AS k FROM ser GROUP BY 1, 2) GROUP BY 1)" for c in "tv")


@query(f"""WITH {_PAIRS}, {_TIES}, w AS (SELECT pixel, n, t, v, total, slopes, sqrt((n * (n - 1) * (2 * n + 5) - kt - kv) / 18.0) AS spread FROM m JOIN kt USING (pixel) JOIN kv USING (pixel) LEFT JOIN (SELECT pixel, count(*) AS total, list(s ORDER BY s) AS slopes FROM p GROUP BY 1) USING (pixel)),
x AS (SELECT *, list_median(slopes) AS slope, slopes[CAST(greatest(round_even((total + {normal_quantile()} * -1 * spread) / 2, 0) - 1, 0) AS BIGINT) + 1] AS low, slopes[CAST(least(round_even((total + {normal_quantile()} * spread) / 2, 0), total - 1) AS BIGINT) + 1] AS high FROM w),
r AS (SELECT ser.pixel, corr(x.slope * ser.t, ser.v) AS c FROM ser JOIN x USING (pixel) WHERE x.slope <> 0 GROUP BY 1)
SELECT pixel, CASE WHEN n >= 3 AND slope IS NOT NULL THEN n ELSE 0 END AS n_obs, round(CASE WHEN n >= 3 THEN slope END, 6) AS slope, round(CASE WHEN n >= 3 THEN x.v - slope * x.t END, 6) AS intercept, round(CASE WHEN n >= 3 THEN low END, 6) AS slope_low, round(CASE WHEN n >= 3 THEN high END, 6) AS slope_high, round(CASE WHEN n >= 3 THEN c * c END, 6) AS r2 FROM x LEFT JOIN r USING (pixel)""")
def theil_sen(spark, sf_dir):
    """Median slopes, their bounds and how well the line fits."""
    return rounded(trend.theil_sen(series(spark, sf_dir), ["pixel"], "t", "v"))


TAU = f"""{SER}, o AS (SELECT *, row_number() OVER (PARTITION BY pixel ORDER BY t, v, event_id) AS k FROM ser), p AS (SELECT a.pixel, sum(sign(b.t - a.t) * sign(b.v - a.v)) AS con, sum(CASE WHEN a.t = b.t THEN 1 ELSE 0 END) AS n1, sum(CASE WHEN a.v = b.v THEN 1 ELSE 0 END) AS n2, count(*) AS n0 FROM o a JOIN o b ON a.pixel = b.pixel AND a.k < b.k GROUP BY 1),
m AS (SELECT pixel, count(*) AS n FROM ser GROUP BY 1), tau AS (SELECT pixel, CASE WHEN n >= 3 THEN n ELSE 0 END AS n_obs, CASE WHEN n >= 3 AND n0 > n1 AND n0 > n2 THEN con / sqrt(CAST(n0 - n1 AS DOUBLE) * (n0 - n2)) END AS tau FROM m LEFT JOIN p USING (pixel))"""


@query(f"WITH {TAU} SELECT pixel, n_obs, round(tau, 6) AS tau FROM tau")
def kendall_tau(spark, sf_dir):
    return rounded(trend.kendall(series(spark, sf_dir), ["pixel"], "t", "v").withColumn("n_obs", F.col("n_obs").cast("long")))


@query(f"""WITH {TAU}, c AS (SELECT pixel, CAST(CASE WHEN tau IS NULL THEN 0 WHEN pixel % 3 = 0 THEN 5 WHEN tau * 5 >= 0.7 THEN 1 WHEN tau * 5 >= 0.4 THEN 2 WHEN tau * 5 >= 0.2 THEN 3 WHEN tau > 0 THEN 4 WHEN tau * 5 <= -0.7 THEN 10 WHEN tau * 5 <= -0.4 THEN 9 WHEN tau * 5 <= -0.2 THEN 8 WHEN tau < 0 THEN 7 ELSE 5 END AS INTEGER) AS kendall FROM tau)
SELECT kendall, count(*) AS n FROM c GROUP BY 1""")
def kendall_classes(spark, sf_dir):
    """Classes of five times tau with a made-up p, so that all classes occur."""
    t = trend.kendall(series(spark, sf_dir), ["pixel"], "t", "v")
    return t.groupBy(C.kendall_class(F.col("tau") * 5, F.when(F.col("pixel") % 3 == 0, 0.5).otherwise(0.01)).alias("kendall")).agg(F.count("*").alias("n"))


@query(f"WITH {SEG}, a AS (SELECT tile_num, land_cover, avg(agb) AS v FROM seg WHERE year = 1997 GROUP BY 1, 2), b AS (SELECT tile_num, land_cover, avg(agb) AS v FROM seg WHERE year = 2000 GROUP BY 1, 2) SELECT tile_num, land_cover, round(b.v - a.v, 9) AS difference FROM a JOIN b USING (tile_num, land_cover)")
def date_difference(spark, sf_dir):
    at = lambda y: segments(spark, sf_dir).filter(F.col("year") == y).groupBy("tile_num", "land_cover").agg(F.avg("agb").alias(f"v{y}"))
    return at(1997).join(at(2000), ["tile_num", "land_cover"]).select("tile_num", "land_cover", F.round(F.col("v2000") - F.col("v1997"), 9).alias("difference"))


@query(f"""WITH {SEG}, k AS (SELECT CAST(CASE WHEN age <= 0 THEN 0 WHEN age <= 20 THEN 1 WHEN age <= 36 THEN 2 WHEN age <= 60 THEN 3 WHEN age <= 80 THEN 4 WHEN age <= 100 THEN 5 WHEN age <= 150 THEN 6 ELSE 7 END AS INTEGER) AS age_class,
CAST(CASE WHEN age = 0 THEN 0 WHEN age BETWEEN 1 AND 20 THEN 1 WHEN age BETWEEN 21 AND 80 THEN 2 WHEN age BETWEEN 81 AND 200 THEN 3 WHEN age > 201 THEN 4 ELSE -1 END AS INTEGER) AS cohort,
CAST(CASE WHEN slope - 15 < -2 THEN 0 WHEN slope - 15 < -0.5 THEN 1 WHEN slope - 15 <= 0.5 THEN 2 WHEN slope - 15 <= 2 THEN 3 ELSE 4 END AS INTEGER) AS canopy, CAST(CASE WHEN h_can * 2 < 33 THEN 0 WHEN h_can * 2 <= 66 THEN 1 ELSE 2 END AS INTEGER) AS deciduous, agb,
CAST(CASE WHEN age <= 0 THEN 0 WHEN age <= 36 THEN 1 WHEN age <= 100 THEN 2 WHEN age <= 150 THEN 3 ELSE 4 END AS INTEGER) AS stage FROM seg)
SELECT age_class, cohort, canopy, deciduous, stage, count(*) AS n, round(sum(agb * CAST(0.5 AS DOUBLE)), 6) AS carbon FROM k GROUP BY 1, 2, 3, 4, 5""")
def carbon_class(spark, sf_dir):
    df = segments(spark, sf_dir)
    keys = [C.age_class(F.col("age")).alias("age_class"), C.age_cohort(F.col("age")).alias("cohort"), C.canopy_trend(F.col("slope") - 15).alias("canopy"), C.deciduous(F.col("h_can") * 2).alias("deciduous"), C.forest_stage(F.col("age")).alias("stage")]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.sum(F.col("agb") * 0.5), 6).alias("carbon"))


@query("WITH a AS (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_id % 40 END AS age, event_id % 60 AS alt FROM events) SELECT event_id, CASE WHEN (age IS NULL OR age = 0) AND alt > 0 AND alt <= 36 THEN alt WHEN (age IS NULL OR age = 0) AND alt = 50 THEN 100 ELSE age END AS age FROM a")
def age_fill(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", C.filled_age(F.when(e % 3 > 0, e % 40), e % 60).alias("age"))


@query(f"""WITH {SEG}, t AS (SELECT tile_num, sum(agb * CAST(0.09 AS DOUBLE)) AS total, sqrt(sum(agb_sd * CAST(0.09 AS DOUBLE) * (agb_sd * CAST(0.09 AS DOUBLE)))) AS total_sd FROM seg GROUP BY 1)
SELECT tile_num, {rounding('total total_sd low high cv uncertainty', 8)} FROM (SELECT *, total - 1.96 * total_sd AS low, total + 1.96 * total_sd AS high, total_sd / total AS cv, 100 * 1.96 * total_sd / total AS uncertainty FROM t)""")
def analytic_uncertainty(spark, sf_dir):
    return rounded(uncertainty.analytic_total(segments(spark, sf_dir), ["tile_num"], "agb", "agb_sd", 0.09), 8)


@query(f"""WITH {SEG}, a AS (SELECT age % 8 AS age, avg(agb) FILTER (year = 1997) AS m1, avg(agb_sd) FILTER (year = 1997) AS s1, avg(agb) FILTER (year = 2000) AS m2, avg(agb_sd) FILTER (year = 2000) AS s2 FROM seg GROUP BY 1)
SELECT age, {rounding('change change_sd percent z')}, round(p, 6) AS p_increase FROM (SELECT *, CASE WHEN z >= 0 THEN 1 - half ELSE half END AS p FROM (SELECT *, t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-z * z / 2) / 2 AS half FROM (SELECT *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS t FROM (SELECT age, m2 - m1 AS change, sqrt(s1 * s1 + s2 * s2) AS change_sd, 100 * (m2 - m1) / m1 AS percent, (m2 - m1) / sqrt(s1 * s1 + s2 * s2) AS z FROM a))))""")
def analytic_change(spark, sf_dir):
    at = lambda c, y: F.avg(F.when(F.col("year") == y, F.col(c)))
    a = segments(spark, sf_dir).groupBy((F.col("age") % 8).alias("age")).agg(at("agb", 1997).alias("m1"), at("agb_sd", 1997).alias("s1"), at("agb", 2000).alias("m2"), at("agb_sd", 2000).alias("s2"))
    out = uncertainty.analytic_change(F.col("m1"), F.col("s1"), F.col("m2"), F.col("s2"))
    return rounded(a.select("age", *[c.alias(n) for n, c in out.items()]))


COEFFICIENTS = {"m1": (-90.0, 0.9, 0.05), "m3": (-100.0, 1.0, 0.02), "m8": (-95.0, 0.95, 0.03)}
SMEARING = {"m1": 1.05, "m3": 1.1, "m8": 1.02}


@query(f"""WITH {SEG}, m AS (SELECT *, CASE WHEN land_cover IN (111, 113, 121, 123) THEN 'm3' WHEN land_cover IN (112, 114, 122, 124) THEN 'm1' ELSE 'm8' END AS model FROM seg), c(model, a, b, d, s) AS (VALUES {", ".join(f"('{k}', CAST({v[0]} AS DOUBLE), CAST({v[1]} AS DOUBLE), CAST({v[2]} AS DOUBLE), CAST({SMEARING[k]} AS DOUBLE))" for k, v in COEFFICIENTS.items())}),
l AS (SELECT tile_num, model, s, greatest(a + b * (h_can + 100) + d * (h_dif + 100), 0) AS y FROM m JOIN c USING (model)) SELECT tile_num, model, count(*) AS n, round(avg(s * y * y), 6) AS density FROM l GROUP BY 1, 2""")
def allometric_predict(spark, sf_dir):
    out = M.allometric(segments(spark, sf_dir), "land_cover", ["h_can", "h_dif"], COEFFICIENTS, SMEARING)
    return rounded(out.groupBy("tile_num", "model").agg(F.count("*").alias("n"), F.avg("density").alias("density")))


FEATURES = ["h_can", "h_dif", "slope", "doy", "age"]


@query()
def rf_regression(spark, sf_dir):
    """A forest of a hundred trees, its prediction averaged by tile."""
    df = segments(spark, sf_dir).select("tile_num", "agb", *[F.col(c).cast("double") for c in FEATURES])
    model = M.forest(df, FEATURES, "agb", trees=100, depth=5)
    return M.applied([model], df, FEATURES, F.col("slope") >= 3).groupBy("tile_num", "iteration").agg(F.round(F.avg("value"), 2).alias("density"))


@query(f"WITH {SEG} SELECT unnest(['h_can', 'h_dif', 'slope']) AS feature, round(unnest([corr(h_can, agb), corr(h_dif, agb), corr(slope, agb)]), 6) AS r, count(*) AS n FROM seg")
def feature_correlation(spark, sf_dir):
    return rounded(M.correlations(segments(spark, sf_dir), ["h_can", "h_dif", "slope"], "agb").select("feature", "r", "n"))


@query(f"WITH {SEG}, b AS (SELECT *, {BEAM} AS beam FROM seg) SELECT beam, count(*) AS n, count(*) FILTER (h_can < 30) AS low FROM b WHERE beam IS NOT NULL GROUP BY 1")
def beam_counts(spark, sf_dir):
    from ..functions.scalars import beam_strength

    df = segments(spark, sf_dir).withColumn("beam", beam_strength(F.col("orient"), F.col("gt"))).filter("beam IS NOT NULL")
    return Q.audit(df, [("low", F.col("h_can") < 30)], ["beam"]).select("beam", F.col("n_all").alias("n"), F.col("n_low").alias("low"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark, sf_dir):
    """The streaming step, run as a batch."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = incremental.windowed_counts(e, "ts", "event_type", "value")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
