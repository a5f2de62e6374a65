"""Queries on trends with tests, breaks, and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classes as C
from ..functions.student import quantile
from ..operators import model as M
from ..operators import stats, trend
from . import flows
from .registry import query
from .roles import SEG, SER, rounded, rounding, segments, series, table
from .statistics import COEFFICIENTS, SMEARING


def _tau(rows: str, keys: str) -> str:
    """SQL steps that give n, con, tied pairs, tau and p of the series (keys, t, v) in `rows`: the test with ties, or by counting orders of up to seven values without ties."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    mine = ", ".join(f"a.{k}" for k in keys.split(", "))
    ties = ", ".join(f"tie_{c} AS (SELECT {keys}, sum(k * (k - 1)) AS {c}1, sum(k * (k - 1) * (k - 2)) AS {c}2, sum(k * (k - 1) * (2 * k + 5)) AS {c}3 FROM (SELECT {keys}, {c}, count(*) AS k FROM {rows} GROUP BY ALL) GROUP BY ALL)" for c in "tv")
    exact = ", ".join(f"({n}, {con}, {trend.kendall_exact_p(n, con)!r})" for n in range(3, 8) for con in range(-n * (n - 1) // 2, n * (n - 1) // 2 + 1, 2))
    spread = "(n * (n - 1) * (2 * n + 5) - t3 - v3) / 18.0 + t1 * v1 / (2.0 * n * (n - 1)) + t2 * v2 / (9.0 * n * (n - 1) * (n - 2))"
    erf = "2 / sqrt(pi()) * exp(-x * x) * list_sum([exp(2 * i * ln(2) + (2 * i + 1) * ln(x) - lgamma(2 * i + 2) + lgamma(i + 1)) for i in range(0, 120)])"
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY t, v) AS k FROM {rows}), pairs AS (SELECT {mine}, sum(sign(b.t - a.t) * sign(b.v - a.v)) AS con, count(*) AS n0 FROM o a JOIN o b ON {on} AND a.k < b.k GROUP BY ALL), {ties},
sized AS (SELECT {keys}, count(*) AS n FROM {rows} GROUP BY ALL), exact_p(n, con, exact) AS (VALUES {exact}), joined AS (SELECT * FROM sized JOIN pairs USING ({keys}) JOIN tie_t USING ({keys}) JOIN tie_v USING ({keys}) LEFT JOIN exact_p USING (n, con) WHERE n >= 3),
spread AS (SELECT *, CASE WHEN (n0 - t1 / 2) * (n0 - v1 / 2) > 0 THEN con / sqrt((n0 - t1 / 2) * CAST(n0 - v1 / 2 AS DOUBLE)) END AS tau, {spread} AS var FROM joined), scaled AS (SELECT *, CASE WHEN var > 0 THEN abs(con) / sqrt(2 * var) ELSE 0 END AS x FROM spread),
tested AS (SELECT *, CASE WHEN t1 = 0 AND v1 = 0 AND n <= 33 AND n <= 7 THEN exact WHEN x = 0 THEN 1 ELSE 1 - {erf} END AS p FROM scaled)"""


@query(f"WITH {SER}, {_tau('ser', 'pixel')} SELECT pixel, n AS n_obs, round(tau, 6) AS tau, round(p, 6) AS p FROM tested")
def kendall_p_values(spark, sf_dir):
    return rounded(trend.with_kendall_p(series(spark, sf_dir), ["pixel"], "t", "v"))


_CUBE = flows.CUBE + ", cu AS (SELECT tile_num, row, col, year + 200 / 365.25 AS t, v FROM cube)"
_CLASS = "CASE WHEN tau IS NULL OR p IS NULL THEN 0 WHEN p < 0.25 AND tau >= 0.7 THEN 1 WHEN p < 0.25 AND tau >= 0.4 THEN 2 WHEN p < 0.25 AND tau >= 0.2 THEN 3 WHEN p < 0.25 AND tau > 0 THEN 4 WHEN p < 0.25 AND tau <= -0.7 THEN 10 WHEN p < 0.25 AND tau <= -0.4 THEN 9 WHEN p < 0.25 AND tau <= -0.2 THEN 8 WHEN p < 0.25 AND tau < 0 THEN 7 ELSE 5 END"


@query(f"WITH {_CUBE}, {_tau('cu', 'tile_num, row, col')} SELECT CAST({_CLASS} AS INTEGER) AS kendall, count(*) AS n, round(sum(tau), 6) AS tau FROM tested GROUP BY 1")
def trend_classes_flow(spark, sf_dir):
    """Slopes, tests and classes of a cube, counted by class."""
    out = flows.trend_classes(flows.cube(spark, sf_dir), 0.25).filter("n_obs >= 3")
    return out.groupBy("kendall").agg(F.count("*").alias("n"), F.round(F.sum("tau"), 6).alias("tau"))


@query(f"WITH {_CUBE}, {_tau('cu', 'tile_num, row, col')} SELECT round(avg(CASE WHEN p < 0.25 THEN 1.0 ELSE 0.0 END), 6) AS p25, round(avg(CASE WHEN p < 0.1 THEN 1.0 ELSE 0.0 END), 6) AS p10 FROM tested WHERE p IS NOT NULL")
def significant_shares(spark, sf_dir):
    at = flows.cube(spark, sf_dir)
    at = trend.dated(at.withColumnsRenamed({"year": "scene_yearDate", "doy": "JulianDate"}), ["JulianDate", "scene_yearDate", "value"])
    return rounded(stats.significant_shares(trend.with_kendall_p(at, ["tile_num", "row", "col"], "t", "value"), "p", {"p25": 0.25, "p10": 0.1}))


_LISTED = ", ".join(f"({k}, CAST({quantile(k)!r} AS DOUBLE))" for k in range(1, 61))


@query(f"WITH {_CUBE}, q(df, tq) AS (VALUES {_LISTED}), s AS (SELECT tile_num, row, col, count(*) AS n, regr_slope(v, t) AS slope, regr_sxx(v, t) AS sxx, regr_syy(v, t) AS syy, regr_sxy(v, t) AS sxy FROM cu GROUP BY ALL HAVING count(*) >= 3), e AS (SELECT *, tq * sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2) / sxx) AS half FROM s JOIN q ON df = n - 2) SELECT tile_num, row, col, n AS n_obs, {rounding('slope low high', 4)} FROM (SELECT *, slope - half AS low, slope + half AS high FROM e)")
def slope_bounds(spark, sf_dir):
    """Least-squares slopes and their 95 % bounds, the dates found by the names of their columns."""
    at = flows.cube(spark, sf_dir).withColumnsRenamed({"year": "yearDate", "doy": "Band_juliandate"})
    at = trend.dated(at, ["Band_juliandate", "yearDate"])
    out = trend.with_bounds(at, ["tile_num", "row", "col"], "t", "value").filter("n_obs > 0")
    return rounded(out.select("tile_num", "row", "col", "n_obs", "slope", F.col("slope_low").alias("low"), F.col("slope_high").alias("high")), 4)


@query("""WITH RECURSIVE d AS (SELECT event_type, CAST(dayofyear(ts) AS INTEGER) AS day, 3 * avg(value) AS raw FROM events GROUP BY 1, 2), g AS (SELECT *, CASE WHEN day % 11 <> 0 AND day > 1 THEN raw END AS v, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS i FROM d),
w AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN i END) OVER b AS i0, min(CASE WHEN v IS NOT NULL THEN i END) OVER f AS i1 FROM g WINDOW b AS (PARTITION BY event_type ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY event_type ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
k AS (SELECT w.event_type, w.i, coalesce(x.v, y.v) + CASE WHEN w.i1 > w.i0 THEN (y.v - x.v) * (w.i - w.i0) / (w.i1 - w.i0) ELSE 0 END AS v, coalesce(x.day, y.day) + CASE WHEN w.i1 > w.i0 THEN (y.day - x.day) * (w.i - w.i0) / (w.i1 - w.i0) ELSE 0 END AS t FROM w LEFT JOIN g x ON x.event_type = w.event_type AND x.i = w.i0 LEFT JOIN g y ON y.event_type = w.event_type AND y.i = w.i1),
c AS (SELECT *, sum(v) OVER (PARTITION BY event_type ORDER BY i) AS p, sum(v * v) OVER (PARTITION BY event_type ORDER BY i) AS q FROM k),
s AS (SELECT event_type, count(*) AS n, list(v ORDER BY i) AS v, list(t ORDER BY i) AS t, list_prepend(0.0, list(p ORDER BY i)) AS p, list_prepend(0.0, list(q ORDER BY i)) AS q FROM c GROUP BY 1),
e AS (SELECT *, list_append(range(5, n, 5), n) AS ends FROM s),
r AS (SELECT event_type, 0 AS step, [0.0]::DOUBLE[] AS best, [0]::BIGINT[] AS pos, [0]::BIGINT[] AS breaks, 0::BIGINT AS last FROM e UNION ALL SELECT event_type, step + 1, list_append(best, least_), list_append(pos, here), list_append(breaks, breaks[j] + CASE WHEN pos[j] > 0 THEN 1 ELSE 0 END), pos[j] FROM
(SELECT *, list_min(options) AS least_, list_position(options, list_min(options)) AS j FROM (SELECT r.*, ends[step + 1] AS here, [CASE WHEN ends[step + 1] - pos[x] >= 2 THEN best[x] + q[ends[step + 1] + 1] - q[pos[x] + 1] - (p[ends[step + 1] + 1] - p[pos[x] + 1]) * (p[ends[step + 1] + 1] - p[pos[x] + 1]) / (ends[step + 1] - pos[x]) + 10.0 ELSE 'inf'::DOUBLE END for x in range(1, len(pos) + 1)] AS options FROM r JOIN e USING (event_type) WHERE step < len(ends)))),
z AS (SELECT e.*, last, breaks[len(breaks)] AS n_breaks FROM r JOIN e USING (event_type) WHERE step = len(ends))
SELECT event_type, round(CASE WHEN last > 0.7 * n THEN t[last + 1] END, 6) AS break_at, round(CASE WHEN last > 0.7 * n AND last < n - 1 THEN list_avg(v[last + 1:last + 2]) - list_avg(v[greatest(last - 1, 1):last]) END, 6) AS break_size, CAST(n_breaks AS INTEGER) AS n_breaks FROM z""")
def breakpoints(spark, sf_dir):
    """The last late break of daily means with gaps, found in SQL by the same optimum over all partitions."""
    d = table(spark, sf_dir, "events").groupBy("event_type", F.dayofyear("ts").alias("day")).agg((3 * F.avg("value")).alias("raw"))
    d = d.withColumn("v", F.when((F.col("day") % 11 != 0) & (F.col("day") > 1), F.col("raw")))
    return rounded(trend.break_table(d, ["event_type"], "day", "v"))


FEATURES = ["h_can", "h_dif", "slope", "age"]


@query(f"WITH {SEG}, c AS (SELECT count(*) AS n, {', '.join(f'corr({f}, agb) AS {f}' for f in FEATURES)} FROM seg), l AS (SELECT n, unnest({FEATURES}) AS feature, unnest([{', '.join(FEATURES)}]) AS r FROM c) SELECT feature, n, round(r, 6) AS r, round(r * sqrt(n - 2) / sqrt(1 - r * r), 4) AS t FROM l")
def feature_correlations(spark, sf_dir):
    """Each feature's correlation with the stock and its test (the p itself is tested apart)."""
    out = M.correlations(segments(spark, sf_dir), FEATURES, "agb")
    return out.select("feature", "n", F.round("r", 6).alias("r"), F.round("t", 4).alias("t"))


@query(f"WITH {SEG} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM seg" for a in FEATURES for b in FEATURES))
def correlation_matrix(spark, sf_dir):
    return rounded(M.correlation_matrix(segments(spark, sf_dir), FEATURES))


@query(f"""WITH {SEG}, m AS (SELECT *, CASE WHEN land_cover IN (111, 113, 121, 123) THEN 'm3' WHEN land_cover IN (112, 114, 122, 124) THEN 'm1' ELSE 'm8' END AS model FROM seg), c(model, a, b, d, s) AS (VALUES {", ".join(f"('{k}', CAST({v[0]} AS DOUBLE), CAST({v[1]} AS DOUBLE), CAST({v[2]} AS DOUBLE), CAST({SMEARING[k]} AS DOUBLE))" for k, v in COEFFICIENTS.items())}),
l AS (SELECT tile_num, model, s, greatest(a + b * (h_can + 100) + d * (h_dif + 100), 0) AS y FROM m JOIN c USING (model)) SELECT tile_num, model, 0.25 AS variance, count(*) AS n, round(avg(s * y * y), 6) AS density FROM l GROUP BY 1, 2""")
def allometric_by_table(spark, sf_dir):
    """Allometries whose coefficients come from a table, with their residual variance."""
    rows = [(k, *map(float, v), float(SMEARING[k]), 0.25) for k, v in COEFFICIENTS.items()]
    coefficients = spark.createDataFrame(rows, "model string, intercept double, w_h_can double, w_h_dif double, smearing double, variance double")
    out = M.allometric_by_table(segments(spark, sf_dir), "land_cover", ["h_can", "h_dif"], coefficients)
    return rounded(out.groupBy("tile_num", "model", "variance").agg(F.count("*").alias("n"), F.avg("density").alias("density")))


@query(f"WITH {SEG}, p AS (SELECT tile_num, slope, 0 AS iteration, 2.0 * h_can AS value FROM seg UNION ALL SELECT tile_num, slope, 1, 0.5 * h_can + 3 FROM seg) SELECT tile_num, CAST(iteration AS INTEGER) AS iteration, round(sum(CASE WHEN slope >= 3 THEN value ELSE 0 END * 0.09), 5) AS full_total, round(sum(CASE WHEN slope >= 15 THEN value * 0.09 ELSE 0 END), 5) AS boreal_total FROM p GROUP BY 1, 2")
def iteration_totals(spark, sf_dir):
    """Totals of each iteration's model over two extents, masked pixels as 0: two lines fitted to known values."""
    base = segments(spark, sf_dir).select("tile_num", "slope", "h_can")
    lines = [M.linear(base.select("h_can", (F.col("h_can") * a + b).alias("y")).limit(500), ["h_can"], "y") for a, b in ((2.0, 0.0), (0.5, 3.0))]
    mapped = M.applied(lines, base, ["h_can"], F.col("slope") >= 3)
    return rounded(M.iteration_totals(mapped, ["tile_num"], 0.09, {"full": F.lit(True), "boreal": F.col("slope") >= 15}), 5)


@query(f"""WITH {SEG}, t AS (SELECT h_can, slope, agb FROM seg WHERE granule % 23 = 0), b AS (SELECT quantile_cont(h_can, 0.25) AS a0, quantile_cont(h_can, 0.5) AS a1, quantile_cont(h_can, 0.75) AS a2, quantile_cont(slope, 0.25) AS s0, quantile_cont(slope, 0.5) AS s1, quantile_cont(slope, 0.75) AS s2 FROM t),
r AS (SELECT DISTINCT tile_num * 10 + kendall AS id, avg(h_can) AS h_can, avg(slope) AS slope FROM seg GROUP BY 1), f AS (SELECT id, t.agb, pow((r.h_can - t.h_can) / (a2 - a0), 2) + pow((r.slope - t.slope) / (s2 - s0), 2) AS far FROM r, t, b) SELECT id, round(avg(agb), 6) AS prediction FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(far, 9), agb) <= 5) GROUP BY 1""")
def nearest_neighbours(spark, sf_dir):
    """Means of the five training segments nearest to each tile's class."""
    s = segments(spark, sf_dir)
    rows = s.groupBy((F.col("tile_num") * 10 + F.col("kendall")).alias("id")).agg(F.avg("h_can").alias("h_can"), F.avg("slope").alias("slope"))
    return rounded(M.nearest(s.filter("granule % 23 = 0"), rows, "id", ["h_can", "slope"], "agb"))


@query(f"WITH {SEG}, q AS (SELECT {', '.join(f'quantile_cont({f}, 0.25) AS {f}_low, quantile_cont({f}, 0.75) AS {f}_high' for f in ('h_can', 'slope'))}, count(*) AS n FROM seg) SELECT n, round(h_can_high - h_can_low, 3) > 0 AS spread, TRUE AS centred FROM q")
def robust_scaling(spark, sf_dir):
    """Features scaled by their quartiles: the middle half of each is about one wide."""
    from pyspark.ml.functions import vector_to_array

    s = M.robust_scaled(segments(spark, sf_dir), ["h_can", "slope"]).withColumn("z", vector_to_array("scaled"))
    width = F.percentile_approx(F.col("z")[0], 0.75) - F.percentile_approx(F.col("z")[0], 0.25)
    return s.agg(F.count("*").alias("n"), width.between(0.8, 1.2).alias("spread"), (F.abs(F.percentile_approx(F.col("z")[1], 0.5)) < 0.2).alias("centred"))


@query("SELECT * FROM (VALUES (1, 'x1'), (2, 'x2')) t(place, feature)")
def top_importances(spark, sf_dir):
    """The two features that a stock is made of, found by a forest."""
    s = segments(spark, sf_dir).select((F.col("h_can") * 3).alias("x1"), F.col("slope").alias("x2"), (F.col("granule") % 7).alias("x3"), (F.col("part") % 5).alias("x4"))
    s = s.withColumn("y", F.col("x1") * 2 + F.col("x2"))
    found = M.importances(M.forest(s, ["x1", "x2", "x3", "x4"], "y", trees=10, depth=4), ["x1", "x2", "x3", "x4"], 2)
    return spark.createDataFrame([(k, f) for k, (f, _) in enumerate(found, 1)], "place int, feature string")


@query("SELECT CAST(n AS INTEGER) AS n, CASE WHEN n < 10 THEN CAST(0.1 AS DOUBLE) WHEN n < 30 THEN CAST(0.05 AS DOUBLE) ELSE CAST(0.01 AS DOUBLE) END AS alpha FROM (SELECT unnest(generate_series(1, 50)) AS n)")
def suggested_levels(spark, sf_dir):
    return spark.createDataFrame([(n, C.suggested_alpha(n)) for n in range(1, 51)], "n int, alpha double")
