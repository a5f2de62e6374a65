"""Queries on segments, names, codes and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import quality as Q
from ..operators import stats
from .registry import query
from .roles import BEAM, CEILING, PTS, SEG, points, rounded, segments, table


def _beam(df):
    return df.withColumn("beam", S.beam_strength(F.col("orient"), F.col("gt")))


def _steps():
    return Q.steps(msw=F.col("msw"), beam=F.col("beam"), snow=F.col("snow"))


@query(f"""WITH {SEG}, {CEILING}, kept AS (SELECT seg.* FROM seg JOIN ceil_ USING (land_cover) WHERE h_can < ceiling AND h_dif < 7)
SELECT r_name, n_name, land_cover, count(*) AS n, avg(h_can) AS mean_height, round(sum(agb), 5) / count(*) AS mean_stock
FROM kept JOIN supplier ON s_suppkey = tile_num JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3""")
def tile_class_means(spark, sf_dir):
    """Mean height and stock by realm, tile group and land cover of segments that pass; dimensions are small and Spark picks their joins."""
    kept = Q.below(Q.below_class_ceiling(segments(spark, sf_dir), "land_cover", "h_can"), {"h_dif": 7})
    tiles = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = kept.join(tiles.select("s_suppkey", "n_name", "r_name"), F.col("tile_num") == F.col("s_suppkey")).groupBy("r_name", "n_name", "land_cover")
    return out.agg(F.count("*").alias("n"), F.avg("h_can").alias("mean_height"), (F.round(F.sum("agb"), 5) / F.count("*")).alias("mean_stock"))


@query(f"WITH {SEG}, b AS (SELECT *, {BEAM} AS beam FROM seg) SELECT granule, line, tile_num, h_can, CAST(year AS INTEGER) AS y, month AS m, CAST(day(seen_at) AS INTEGER) AS d, doy FROM b WHERE msw = 0 AND beam = 'Strong' AND snow = 1 AND h_can < 40 AND h_dif < 6 AND month BETWEEN 6 AND 9")
def quality_filter_static(spark, sf_dir):
    kept = Q.below(Q.passing(_beam(segments(spark, sf_dir)), _steps()), {"h_can": 40, "h_dif": 6}).filter(F.col("month").between(6, 9))
    return kept.select("granule", "line", "tile_num", "h_can", F.col("year").alias("y"), F.col("month").alias("m"), F.dayofmonth("seen_at").alias("d"), "doy")


@query(f"WITH {SEG}, {CEILING} SELECT granule, line, part, land_cover, h_can FROM seg JOIN ceil_ USING (land_cover) WHERE h_can < ceiling")
def quality_filter_by_class(spark, sf_dir):
    return Q.below_class_ceiling(segments(spark, sf_dir), "land_cover", "h_can").select("granule", "line", "part", "land_cover", "h_can")


@query(f"""WITH {SEG}, b AS (SELECT *, {BEAM} AS beam FROM seg) SELECT tile_num, count(*) AS n_all, count(*) FILTER (msw = 0) AS n_msw,
count(*) FILTER (msw = 0 AND beam = 'Strong') AS n_beam, count(*) FILTER (msw = 0 AND beam = 'Strong' AND snow = 1) AS n_snow,
count(*) FILTER (msw = 0 AND beam = 'Strong' AND snow = 1 AND h_can < 30) AS n_height FROM b GROUP BY 1""")
def quality_audit(spark, sf_dir):
    return Q.audit(_beam(segments(spark, sf_dir)), [*_steps(), ("height", F.col("h_can") < 30)], ["tile_num"])


@query(f"""WITH {SEG}, b AS (SELECT *, {BEAM} AS beam FROM seg) SELECT granule, line, part, tile_num, h_can FROM b WHERE beam = 'Strong'
ORDER BY granule, line, part, tile_num, h_can, agb LIMIT 1""")
def empty_fallback(spark, sf_dir):
    out = Q.or_first(_beam(segments(spark, sf_dir)), F.col("h_can") < 0, ["granule", "line", "part", "tile_num", "h_can", "agb"], F.col("beam") == "Strong")
    return out.select("granule", "line", "part", "tile_num", "h_can")


@query(f"WITH {PTS} SELECT point_id, x, y FROM pts WHERE x > -0.1 AND x < 0.15 AND y > -0.12 AND y < 0.1")
def bbox_exclusive(spark, sf_dir):
    return points(spark, sf_dir).filter(Q.in_box(F.col("x"), F.col("y"), (-0.1, 0.15, -0.12, 0.1))).select("point_id", "x", "y")


@query(f"WITH {PTS} SELECT point_id, x, y FROM pts WHERE x BETWEEN -0.1 AND 0.15 AND y BETWEEN -0.12 AND 0.1")
def bbox_inclusive(spark, sf_dir):
    return points(spark, sf_dir).filter(Q.in_box(F.col("x"), F.col("y"), (-0.1, 0.15, -0.12, 0.1), inclusive=True)).select("point_id", "x", "y")


@query(f"WITH {SEG} SELECT {BEAM} AS beam, CASE WHEN line BETWEEN 1 AND 6 THEN CASE WHEN line % 2 = 1 THEN 'strong' ELSE 'weak' END END AS spot_beam, count(*) AS n FROM seg GROUP BY 1, 2")
def beam_type_spot(spark, sf_dir):
    return _beam(segments(spark, sf_dir)).groupBy("beam", S.spot_strength(F.col("line")).alias("spot_beam")).agg(F.count("*").alias("n"))


@query(f"""WITH {SEG}, s(snow, snow_label) AS (VALUES (0, 'ice free water'), (1, 'snow free land'), (2, 'snow'), (3, 'ice')), n(msw, night) AS (VALUES (0, 'day'))
SELECT snow_label, night, count(*) AS n FROM seg LEFT JOIN s USING (snow) LEFT JOIN n USING (msw) GROUP BY 1, 2""")
def code_labels(spark, sf_dir):
    df = segments(spark, sf_dir)
    return df.groupBy(S.labelled(F.col("snow"), S.SNOW).alias("snow_label"), S.labelled(F.col("msw"), {0: S.NIGHT[0]}).alias("night")).agg(F.count("*").alias("n"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, try_cast(event_type AS DOUBLE) AS not_a_number, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS whole FROM events")
def coerce_numeric(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", S.number(k).alias("k"), S.number(F.col("event_type")).alias("not_a_number"), S.number(k, "int").alias("whole"))


@query("SELECT vec_id, " + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS {n}" for n, k in S.HEIGHT_PLACES.items()) + " FROM embeddings")
def array_unpack(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", *[c.cast("double").alias(n) for n, c in S.heights(F.col("embedding")).items()])


@query("SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, string_split(url, '/')[-1] AS file, replace(url, 'https://', 's3://') AS moved, try_cast(regexp_extract(url, '([0-9]+)[^0-9]*$', 1) AS INTEGER) AS number, trim(string_split(url, '_')[1], 'htps:') AS token FROM pages")
def name_token_index(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.split_part(F.split_part(url, F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"), F.element_at(F.split(url, "/"), -1).alias("file"),
        S.swap_root(url, "https://", "s3://").alias("moved"), S.last_token_number(url).alias("number"), S.name_token(url, 0, "htps:").alias("token"),
    )


@query("SELECT o_orderkey, concat_ws('_', CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey AS VARCHAR) END, strftime(o_orderdate, '%m-%d'), lower(o_orderstatus), CAST(year(o_orderdate) AS VARCHAR)) AS run_type, lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS padded, CAST(day(last_day(o_orderdate)) AS INTEGER) AS season_end, 'TRUE' LIKE (upper(o_orderstatus) || '%') AS truth, replace(replace(lower(o_orderpriority), ' ', '_'), '.', '') AS label FROM orders")
def param_concat(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey", S.run_type(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey").cast("string")), F.date_format("o_orderdate", "MM-dd"), F.lower("o_orderstatus"), F.year("o_orderdate").cast("string")).alias("run_type"),
        S.padded(F.col("o_orderkey"), 7).alias("padded"), S.month_end(F.col("o_orderdate")).alias("season_end"), S.truth(F.col("o_orderstatus")).alias("truth"), S.clean_label(F.col("o_orderpriority")).alias("label"),
    )


@query("WITH j AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) SELECT event_type, k, count(*) AS n, min(event_id) AS first_id FROM j GROUP BY 1, 2")
def json_catalog(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "k int").alias("p"))
    return e.groupBy("event_type", F.col("p.k").alias("k")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query(f"""WITH {SEG}, g AS (SELECT land_cover, avg(h_can) + 1.2 * stddev_samp(h_can) AS top FROM seg GROUP BY 1)
SELECT granule, line, part, land_cover, h_can FROM seg JOIN g USING (land_cover) WHERE h_can <= top""")
def outlier_3sd(spark, sf_dir):
    """The cut at 1.2 deviations, as no value of these tables lies beyond three."""
    return Q.within_deviations(segments(spark, sf_dir), "h_can", ["land_cover"], 1.2).select("granule", "line", "part", "land_cover", "h_can")


@query(f"""WITH {SEG}, n AS (SELECT count(*) FILTER (doy BETWEEN 180 AND 181 AND slope <= 3) AS a, count(*) FILTER (doy BETWEEN 150 AND 240 AND slope <= 10) AS b FROM seg),
w AS (SELECT CASE WHEN a >= 500 THEN 0 WHEN b >= 500 THEN 1 ELSE 2 END AS win FROM n)
SELECT granule, line, part, doy, CAST(win AS INTEGER) AS "window" FROM seg, w WHERE (win = 0 AND doy BETWEEN 180 AND 181 AND slope <= 3) OR (win = 1 AND doy BETWEEN 150 AND 240 AND slope <= 10) OR (win = 2 AND doy BETWEEN 120 AND 270 AND slope <= 20)""")
def training_window(spark, sf_dir):
    return Q.training_window(segments(spark, sf_dir), "doy", "slope", [(180, 181, 3), (150, 240, 10), (120, 270, 20)], 500).select("granule", "line", "part", "doy", "window")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER) AS gap FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) <= 30")
def highgrade_days(spark, sf_dir):
    both = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    both = both.withColumns({"day": F.datediff("l_shipdate", F.lit("1970-01-01")), "reference": F.datediff("o_orderdate", F.lit("1970-01-01"))})
    return Q.high_grade(both, "day", "reference", 30, before=False).select("l_orderkey", "l_linenumber", "l_partkey", (F.col("day") - F.col("reference")).alias("gap"))


@query(f"WITH {SEG}, p AS (SELECT tile_num, avg(agb) AS m FROM seg GROUP BY 1) SELECT tile_num, count(*) AS n FROM seg JOIN p USING (tile_num) WHERE NOT (tile_num % 90 > 60 AND slope < 15 AND m < 30) GROUP BY 1")
def moss_mask(spark, sf_dir):
    kept = Q.keep_moss(segments(spark, sf_dir).withColumn("lat", F.col("tile_num") % 90), ["tile_num"], "agb", "lat", "slope", 30, 60, 15)
    return kept.groupBy("tile_num").agg(F.count("*").alias("n"))


@query("WITH v AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS a, CASE WHEN event_id % 5 <> 0 THEN value * 2 END AS b FROM events) SELECT event_id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a END AS a, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b END AS b FROM v")
def common_mask(spark, sf_dir):
    v = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("a"), F.when(F.col("event_id") % 5 != 0, F.col("value") * 2).alias("b"))
    return Q.common(v, ["a", "b"])


@query("WITH v AS (SELECT CASE WHEN event_id % 3 <> 0 THEN value END AS a, CASE WHEN event_id % 5 <> 0 THEN value END AS b FROM events) SELECT round(avg(CASE WHEN a IS NULL THEN 1.0 ELSE 0.0 END), 6) AS a, round(avg(CASE WHEN b IS NULL THEN 1.0 ELSE 0.0 END), 6) AS b FROM v")
def nan_proportion(spark, sf_dir):
    v = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("a"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("b"))
    return rounded(stats.share_missing(v, ["a", "b"]))


@query(f"WITH {PTS} SELECT point_id, round(sign(x) * floor(abs(x) * 10000) / 10000, 6) AS x4, abs(x) > 179.9999 AS near FROM pts")
def truncated_points(spark, sf_dir):
    return points(spark, sf_dir).select("point_id", F.round(S.truncated(F.col("x"), 4), 6).alias("x4"), S.near_antimeridian(F.col("x")).alias("near"))
