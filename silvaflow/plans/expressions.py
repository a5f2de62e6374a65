"""Queries on row expressions: columns, names, dates, masks, classes, units."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classes as C
from ..functions import scalars as S
from ..functions import spectral as P
from ..operators import model as M
from ..operators import quality as Q
from ..operators import raster as R
from ..operators import windows as W
from ..sources import schema, tables
from .registry import query
from .roles import PTS, REFL, SEG, points, reflectance, rounded, rounding, segments, table

_LABELS = ", ".join(f"""({k}, '{v.replace(chr(10), " ")}')""" for k, v in S.LAND_COVER.items())


@query(f"WITH {SEG}, l(land_cover, label) AS (VALUES {_LABELS}) SELECT land_cover, label, count(*) AS n FROM (SELECT CASE WHEN part % 9 = 0 THEN 7 ELSE land_cover END AS land_cover FROM seg) LEFT JOIN l USING (land_cover) GROUP BY 1, 2")
def land_cover_labels(spark, sf_dir):
    """Labels of land cover; a code without one gives null."""
    code = F.when(F.col("part") % 9 == 0, 7).otherwise(F.col("land_cover"))
    return segments(spark, sf_dir).groupBy(code.alias("land_cover"), F.translate(S.labelled(code, S.LAND_COVER), "\n", " ").alias("label")).agg(F.count("*").alias("n"))


@query(f"WITH {PTS} SELECT x AS lon, y AS lat, label * 2 AS label, z AS RH_98, 'g' AS granule_name, CAST(row_number() OVER (ORDER BY point_id) AS INTEGER) AS fid FROM pts")
def model_columns(spark, sf_dir):
    """Columns merged, renamed for models, numbered, and lon and lat first."""
    p = points(spark, sf_dir).withColumnsRenamed({"x": "lon", "y": "lat", "z": "h_can"})
    p = schema.merged(p, {"label": F.col("label"), "granule_name": F.lit("g")}, {"label": F.col("label") * 2})
    return S.leading(schema.model_named(W.row_ids(p, ["point_id"])), "label", "RH_98", "granule_name", "fid")


@query("SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d, CAST(dayofyear(ts) AS INTEGER) AS doy FROM events")
def timestamp_parts(spark, sf_dir):
    """Parts of times that are written as wrapped bytes."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("b'"), F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss"), F.lit("'")).alias("dt"))
    return e.select("event_id", *[c.alias(n) for n, c in S.date_parts(F.col("dt")).items()])


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def expanded_properties(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").alias("p"))
    return tables.expanded(e, "p", ["k", "missing"]).withColumn("k", F.col("k").cast("int"))


@query("""SELECT page_id, 'https://bucket.s3.amazonaws.com/' || 'v006_' || page_id || '.tar.tif' AS https, 'v006_' || page_id || '.tar' AS stem, 'atl_007_' || page_id || '_0065.csv' AS renamed FROM pages""")
def paths_and_versions(spark, sf_dir):
    n = F.col("page_id").cast("string")
    path = F.concat(F.lit("s3://bucket/v006_"), n, F.lit(".tar.tif"))
    return table(spark, sf_dir, "pages").select("page_id", S.to_https(path).alias("https"), S.file_stem(path).alias("stem"), S.version_swapped(F.concat(F.lit("atl_006_"), n, F.lit("_0065.csv")), "006", "007").alias("renamed"))


@query(f"""WITH {REFL}, r AS (SELECT vec_id, red * 10000 AS dn, (nir - red) / (nir + red) AS ndvi, red, CAST(vec_id % 256 AS INTEGER) AS qa FROM refl)
SELECT vec_id, round(dn * CAST(0.0001 AS DOUBLE), 8) AS hls, round(dn * CAST(0.0000275 AS DOUBLE) + CAST(-0.2 AS DOUBLE), 8) AS lc2, CASE WHEN ndvi > 0.25 THEN 1 ELSE 0 END AS vegetated,
round(CASE WHEN NOT ((qa & 2) > 0 OR (qa & 4) > 0 OR (qa & 8) > 0 OR (qa & 16) > 0 OR (qa & 32) > 0 OR (qa & 192) = 192 OR red < 0.02 OR red > 0.6) THEN ndvi END, 8) AS target FROM r""")
def reflectance_masked(spark, sf_dir):
    r, red = reflectance(spark, sf_dir), F.col("red")
    ndvi = P.difference_ratio(F.col("nir"), red)
    return rounded(r.select("vec_id", P.scaled(red * 10000, "HLS").alias("hls"), P.scaled(red * 10000, "LC2").alias("lc2"), P.vegetated(ndvi, 0.25).alias("vegetated"), P.target(ndvi, P.qa_masked((F.col("vec_id") % 256).cast("int")), red, 0.02, 0.6).alias("target")), 8)


@query("""WITH q AS (SELECT CAST(o_orderkey % 65536 AS INTEGER) AS qa FROM orders) SELECT qa, (qa & 8) > 0 OR (qa & 16) > 0 OR (qa & 32) > 0 OR (qa & 128) > 0 AS by_default, (qa & 768) = 768 OR ((qa & 8192) = 0 AND (qa & 4096) > 0) AS by_level, ((qa & 2048) > 0 AND (qa & 1024) = 0) OR (qa & 2) > 0 AS moderate, count(*) AS n FROM q GROUP BY 1, 2, 3, 4""")
def landsat_bits(spark, sf_dir):
    qa = F.col("qa")
    q = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 1 % 65536).cast("int").alias("qa"))
    masks = {"by_default": P.lc2_masked(qa), "by_level": P.lc2_masked(qa, ("cloud confidence high", "snow/ice confidence low")), "moderate": P.lc2_masked(qa, ("cloud shadow confidence moderate", "dilated cloud"))}
    return q.groupBy("qa", *[c.alias(n) for n, c in masks.items()]).agg(F.count("*").alias("n"))


@query(f"""WITH {PTS}, g AS (SELECT point_id, CAST(floor(y * 40) AS INTEGER) AS row, CAST(floor(x * 40) AS INTEGER) AS col, x, y, z FROM pts)
SELECT point_id, round(-8 + (col + 0.5) * 0.025, 8) AS cx, round(8 - (row + 0.5) * 0.025, 8) AS cy, round(111320 * cos(radians(y * 90)), 5) AS metres, CASE WHEN z > 0 THEN 1 ELSE 0 END AS steep, round(0.5 - cos(radians(x * 360 - 30)) / 2, 8) AS tsri, x AS b0, z AS b1, y AS b2 FROM g""")
def pixel_geometry(spark, sf_dir):
    p = points(spark, sf_dir).withColumns({"row": F.floor(F.col("y") * 40).cast("int"), "col": F.floor(F.col("x") * 40).cast("int")})
    centre = R.pixel_centre(F.col("row"), F.col("col"), (-8, 8), 0.025)
    b = S.bounds_as_lon_lat(F.array("x", "y", "z", "z"))
    return p.select(
        "point_id", F.round(centre["x"], 8).alias("cx"), F.round(centre["y"], 8).alias("cy"), F.round(R.metres_a_degree(F.col("y") * 90), 5).alias("metres"), R.steep(F.col("z")).alias("steep"),
        F.round(R.tsri(F.col("x") * 360), 8).alias("tsri"), b[0].alias("b0"), b[1].alias("b1"), b[2].alias("b2"),
    )


@query(f"""WITH {SEG} SELECT granule, line, part, round(CASE WHEN h_can + slope + h_dif > 0 THEN (h_can + slope) / (h_can + slope + h_dif) END, 8) AS cover, round(agb * 0.09 * 1e-9 * 1e12, 6) AS stock, round(agb * 1e9 / 810000.0, 4) AS density, round(agb_sd * agb_sd, 6) AS variance FROM seg""")
def stock_units(spark, sf_dir):
    s = segments(spark, sf_dir)
    return s.select(
        "granule", "line", "part", F.round(S.canopy_cover(F.col("h_can"), F.col("slope"), F.col("h_dif")), 8).alias("cover"), F.round(S.stock_pg(F.col("agb")) * 1e12, 6).alias("stock"),
        F.round(S.tile_density(F.col("agb")), 4).alias("density"), F.round(S.variance(F.col("agb_sd")), 6).alias("variance"),
    )


@query(f"WITH {SEG} SELECT land_cover, round(avg(h_can * h_can) / (avg(sqrt(h_can)) * avg(sqrt(h_can))), 8) AS ratio FROM seg GROUP BY 1")
def smearing_ratios(spark, sf_dir):
    return rounded(segments(spark, sf_dir).groupBy("land_cover").agg(M.smearing_ratio(F.col("h_can"), F.sqrt("h_can")).alias("ratio")), 8)


@query("SELECT * FROM (VALUES (0, 10, 'young'), (11, 60, 'middle'), (61, 120, 'old')) t(low, high, label)")
def class_table(spark, sf_dir):
    return spark.createDataFrame(S.class_ranges("0-10:young,11-60: middle,61-120:old"), "low int, high int, label string")


@query("SELECT event_id, CAST(event_id % 203 AS INTEGER) AS age, CASE WHEN event_id % 203 = 0 THEN 'non-forest' WHEN event_id % 203 <= 20 THEN 'young' WHEN event_id % 203 <= 80 THEN 'maturing' WHEN event_id % 203 <= 200 THEN 'mature' WHEN event_id % 203 > 201 THEN 'old-growth' END AS cohort, CASE event_id % 6 WHEN 0 THEN 'strong_decline' WHEN 1 THEN 'moderate_decline' WHEN 2 THEN 'stable' WHEN 3 THEN 'moderate_increase' WHEN 4 THEN 'strong_increase' END AS trend, CAST(CASE WHEN event_id % 7 = 0 THEN 2 WHEN event_id % 7 * 0.02 < 0.05 THEN 1 ELSE 0 END AS INTEGER) AS p_class FROM events")
def cohort_labels(spark, sf_dir):
    age, p = (F.col("event_id") % 203).cast("int"), F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 7 * 0.02)
    return table(spark, sf_dir, "events").select("event_id", age.alias("age"), C.cohort_label(C.age_cohort(age)).alias("cohort"), C.trend_label((F.col("event_id") % 6).cast("int")).alias("trend"), C.significance(p).alias("p_class"))


@query("SELECT page_id, CAST(2000 + page_id % 25 AS INTEGER) AS year, CAST(page_id % 365 + 1 AS INTEGER) AS doy, CAST(2000 + page_id % 25 AS INTEGER) AS lc_year, CAST(dayofyear(make_date(CAST(2000 + page_id % 25 AS INTEGER), CAST(page_id % 12 + 1 AS INTEGER), CAST(page_id % 28 + 1 AS INTEGER))) AS INTEGER) AS lc_doy FROM pages")
def scene_name_dates(spark, sf_dir):
    """Years and days from the names of scenes of both products."""
    k, n = F.col("page_id"), lambda c, w: F.lpad(c.cast("string"), w, "0")
    hls = F.concat(F.lit("s3://b/HLS.L30.T01ABC."), 2000 + k % 25, n(k % 365 + 1, 3), F.lit("T101112.v2.0.B04.tif"))
    lc = F.concat(F.lit("LC08_L2SP_001002_"), 2000 + k % 25, n(k % 12 + 1, 2), n(k % 28 + 1, 2), F.lit("_20200101_02_T1_SR_B4.TIF"))
    one, two = S.scene_day(hls, "HLS"), S.scene_day(lc, "LC2SR")
    return table(spark, sf_dir, "pages").select("page_id", one["year"].alias("year"), one["doy"].alias("doy"), two["year"].alias("lc_year"), two["doy"].alias("lc_doy"))


@query(f"WITH {SEG} SELECT granule, line, part, CASE WHEN snow <> 0 AND snow <> 2 THEN h_can END AS h_can, CASE WHEN snow <> 0 AND snow <> 2 THEN slope END AS slope, CASE WHEN msw = 0 OR age = 0 THEN 0.0 ELSE agb END AS agb FROM seg")
def masked_layers(spark, sf_dir):
    """Values nulled by a mask's codes, and predictions set to 0 where a mask is 0."""
    s = Q.zeroed(segments(spark, sf_dir), "agb", "msw", "age")
    return Q.masked(s, ["h_can", "slope"], "snow", [0, 2]).select("granule", "line", "part", "h_can", "slope", "agb")
