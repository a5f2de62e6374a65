"""Queries on quality cascades, filters and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import beam_strength
from ..operators import quality as Q
from ..operators import windows as W
from .registry import query
from .roles import BEAM, CEILING, PTS, SEG, points, rounded, segments, table

_TABLE = f"q AS (SELECT *, h_can * 0.2 AS unc, slope / 10 AS sig, granule % 12 AS sol, {BEAM} AS beam FROM seg)"
ORDER = ["granule", "line", "part", "tile_num", "h_can", "agb"]


def _segment_table(spark, sf_dir):
    """Segments under the names of the segment table."""
    c = F.col
    s = segments(spark, sf_dir).withColumn("beam_type", beam_strength(c("orient"), c("gt")))
    return s.withColumns({"msw_flg": c("msw"), "seg_snow": c("snow"), "seg_landcov": c("land_cover"), "h_dif_ref": c("h_dif"), "m": c("month"), "h_can_unc": c("h_can") * 0.2, "sig_topo": c("slope") / 10, "sol_el": c("granule") % 12, "seg_cover": F.lit(0), "h_te_unc": c("h_dif"), "ter_slp": c("slope"), "n_toc_ph": c("line")})


def _keys(df):
    return df.select("granule", "line", "part", "tile_num", "h_can")


@query(f"WITH {SEG}, {_TABLE} SELECT granule, line, part, tile_num, h_can FROM q WHERE msw = 0 AND beam = 'Strong' AND snow = 1 AND h_can < 35 AND h_dif < 7 AND month BETWEEN 4 AND 10 AND sig < 2")
def quality_v2(spark, sf_dir):
    return _keys(Q.quality_v2(_segment_table(spark, sf_dir), 35, 7, 2, (4, 10)))


@query(f"WITH {SEG}, {_TABLE}, {CEILING} SELECT granule, line, part, tile_num, h_can FROM q JOIN ceil_ USING (land_cover) WHERE msw = 0 AND beam = 'Strong' AND snow = 1 AND h_can < ceiling AND unc < 5 AND sol < 5 AND sig < 2.5 AND h_dif < 7 AND month BETWEEN 5 AND 10")
def quality_v3(spark, sf_dir):
    return _keys(Q.quality_v3(_segment_table(spark, sf_dir), ORDER, 7, 2.5, (5, 10)))


@query(f"WITH {SEG}, {_TABLE} SELECT granule, line, part, tile_num, h_can FROM q WHERE beam = 'Strong' ORDER BY granule, line, part, tile_num, h_can, agb LIMIT 1")
def quality_v3_fallback(spark, sf_dir):
    """Limits that nothing meets: the first row of a strong beam."""
    return _keys(Q.quality_v3(_segment_table(spark, sf_dir), ORDER, -1, 2.5, (5, 10)))


_SERVICE = "v AS (SELECT *, part % 6 + 1 AS spot, agb / 3 AS sun, slope / 10 AS sig FROM seg)"
_PASS = {"msw_flag": "msw = 0", "beam": "spot IN (1, 3, 5)", "snowcover": "snow = 1", "height": "h_can < (SELECT ceiling FROM ceil_ WHERE ceil_.land_cover = v.land_cover)", "limits": "sun < 12 AND sig < 2.5 AND h_dif < 25", "season": "month BETWEEN 6 AND 9"}


def _service(spark, sf_dir):
    c = F.col
    s = segments(spark, sf_dir)
    return s.withColumns({"spot": c("part") % 6 + 1, "msw_flag": c("msw"), "snowcover": c("snow"), "segment_landcover": c("land_cover"), "h_canopy": c("h_can"), "solar_elevation": c("agb") / 3, "sigma_topo": c("slope") / 10, "h_dif_ref": c("h_dif"), "m": c("month")})


@query(f"WITH {SEG}, {_SERVICE}, {CEILING} SELECT granule, line, part, tile_num, h_can FROM v WHERE " + " AND ".join(_PASS.values()))
def quality_v5(spark, sf_dir):
    return _keys(Q.quality_v5(_service(spark, sf_dir), (6, 9), sun=12)[0])


@query(f"WITH {SEG}, {_SERVICE}, {CEILING} SELECT count(*) AS n_all, " + ", ".join(f"count(*) FILTER ({' AND '.join(list(_PASS.values())[: k + 1])}) AS n_{n}" for k, n in enumerate(_PASS)) + " FROM v")
def quality_v5_audit(spark, sf_dir):
    return Q.quality_v5(_service(spark, sf_dir), (6, 9), sun=12)[1]


@query(f"WITH {SEG} SELECT granule, line, part, tile_num, h_can FROM seg WHERE h_can <= 30 AND line >= 3 AND h_dif <> (SELECT max(h_dif) FROM seg) AND slope <> (SELECT max(slope) FROM seg) AND msw = 0")
def quality_old_rule(spark, sf_dir):
    return _keys(Q.old_rule(_segment_table(spark, sf_dir), 30, 3))


@query("""WITH s AS (SELECT s_suppkey, s_nationkey FROM supplier) SELECT s_suppkey, 'listed' AS how FROM s WHERE s_nationkey IN (1, 5, 9) UNION ALL SELECT s_suppkey, 'not listed' FROM s WHERE s_nationkey NOT IN (1, 5, 9)
UNION ALL SELECT s_suppkey, 'in table' FROM s WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) UNION ALL SELECT s_suppkey, 'not in table' FROM s WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)""")
def membership(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    near = table(spark, sf_dir, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("s_nationkey"))
    ways = {"listed": ([1, 5, 9], True), "not listed": ([1, 5, 9], False), "in table": (near, True), "not in table": (near, False)}
    out = None
    for how, (values, inside) in ways.items():
        part = Q.members(s, "s_nationkey", values, inside).select("s_suppkey", F.lit(how).alias("how"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT page_id, url FROM pages WHERE url NOT LIKE '%feed%' AND url NOT LIKE '%/es/%1%'")
def excluded_names(spark, sf_dir):
    return Q.excluding(table(spark, sf_dir, "pages"), "url", ["feed", "/es/*1"]).select("page_id", "url")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 1000 AND c_mktsegment = 'BUILDING' OR c_nationkey IN (3, 4)")
def predicate_text(spark, sf_dir):
    """A filter that comes as text."""
    return table(spark, sf_dir, "customer").filter("c_acctbal > 1000 AND c_mktsegment = 'BUILDING' OR c_nationkey IN (3, 4)").select("c_custkey")


@query("SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS k FROM customer) WHERE k IN (0, 7, 20, 100)")
def rows_at_places(spark, sf_dir):
    return W.at_places(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"], [0, 7, 20, 100]).select("c_custkey")


@query("SELECT event_id, value FROM events WHERE event_id % 7 <> 0 AND event_id % 5 <> 0 AND value IS NOT NULL")
def complete_cases(spark, sf_dir):
    """Rows without a null or a not-a-number."""
    c = F.col("event_id")
    e = table(spark, sf_dir, "events").select("event_id", "value", F.when(c % 7 != 0, c).alias("a"), F.when(c % 5 != 0, 1.0).otherwise(float("nan")).alias("b"))
    return Q.complete(e, ["value", "a", "b"]).select("event_id", "value")


@query(f"WITH {PTS} SELECT point_id, y FROM pts WHERE abs(y * 90 - (SELECT min(y) * 90 FROM pts WHERE label = 3)) <= 9")
def latitude_band(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("lat", F.col("y") * 90)
    return Q.latitude_band(p, "lat", p.filter("label = 3").agg(F.min("lat").alias("min_lat")), 9.0).select("point_id", "y")


@query(f"WITH {SEG} SELECT granule, line, part, tile_num, h_can FROM seg WHERE abs(h_can - slope) <= 6")
def steady_heights(spark, sf_dir):
    return _keys(Q.steady_heights(segments(spark, sf_dir), "h_can", "slope", 6))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE date_diff('day', CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE)) BETWEEN -40 AND 0")
def highgrade_before(spark, sf_dir):
    """Observations in the forty days up to the reference."""
    both = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    both = both.withColumns({"day": F.datediff("o_orderdate", F.lit("1970-01-01")), "reference": F.datediff("l_shipdate", F.lit("1970-01-01"))})
    return Q.high_grade(both, "day", "reference", 40, before=True).select("l_orderkey", "l_linenumber", "l_partkey")


@query(f"""WITH {SEG}, p AS (SELECT tile_num, kendall, avg(agb) AS mean, stddev_pop(agb) / avg(agb) AS cv, CASE WHEN count(agb) = count(*) THEN regr_slope(agb, year) END AS slope FROM (SELECT tile_num, kendall, year, CASE WHEN part % 50 <> 0 THEN agb END AS agb FROM seg) GROUP BY 1, 2)
SELECT tile_num, kendall, NOT ((mean < 55 AND coalesce(cv, 0) > 0.5) OR (mean < 55 AND coalesce(slope, 0) < -2) OR (mean < 27.5 AND coalesce(slope, 0) < -1)) AS keep FROM p WHERE mean IS NOT NULL""")
def steady_pixels(spark, sf_dir):
    """Pixels whose stocks are low and vary or fall are suspect."""
    s = segments(spark, sf_dir).withColumn("agb", F.when(F.col("part") % 50 != 0, F.col("agb")))
    return Q.keep_steady(s, ["tile_num", "kendall"], "year", "agb", 55).filter("mean IS NOT NULL").select("tile_num", "kendall", "keep")


@query(f"WITH {SEG}, v AS (SELECT DISTINCT year % 3 AS k, part % 40 AS row, line AS col FROM seg WHERE agb > 20) SELECT row, col FROM v GROUP BY 1, 2 HAVING count(DISTINCT k) = 3")
def valid_everywhere(spark, sf_dir):
    s = segments(spark, sf_dir).withColumns({"row": F.col("part") % 40, "col": F.col("line"), "v": F.when(F.col("agb") > 20, F.col("agb"))})
    return Q.valid_everywhere([s.filter(F.col("year") % 3 == k) for k in range(3)], ["row", "col"], "v")


@query(f"WITH {SEG}, g AS (SELECT land_cover, avg(h_can) + 1.5 * stddev_samp(h_can) AS top FROM seg GROUP BY 1) SELECT land_cover, count(*) AS n, count(*) FILTER (h_can <= top) AS kept FROM seg JOIN g USING (land_cover) GROUP BY 1")
def outlier_share(spark, sf_dir):
    """How many of each class the cut leaves."""
    s = segments(spark, sf_dir)
    kept = Q.within_deviations(s, "h_can", ["land_cover"], 1.5).groupBy("land_cover").agg(F.count("*").alias("kept"))
    return rounded(s.groupBy("land_cover").agg(F.count("*").alias("n")).join(kept, "land_cover"))
