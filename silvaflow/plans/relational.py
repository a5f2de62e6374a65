"""Queries on file indexes, joins, windows, samples and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classes as C
from ..functions.scalars import class_ranges
from ..operators import joins as J
from ..operators import raster as R
from ..operators import stats
from ..operators import windows as W
from .registry import query
from .roles import CELLS, PTS, SEG, SER, cells, points, rounded, segments, series, table

AGES = "0-10:young,11-60:middle,61-120:old,121-169:ancient"
RANGES = class_ranges(AGES)
AGE_LABEL = "CASE " + " ".join(f"WHEN age BETWEEN {a} AND {b} THEN '{n}'" for a, b, n in RANGES) + " END"


@query("SELECT s_suppkey AS tile_num, n, s_name FROM supplier RIGHT JOIN (SELECT l_suppkey + (CASE WHEN l_suppkey % 4 = 0 THEN 100000 ELSE 0 END) AS s_suppkey, count(*) AS n FROM lineitem GROUP BY 1) USING (s_suppkey)")
def tile_right_join(spark, sf_dir):
    files = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") + F.when(F.col("l_suppkey") % 4 == 0, 100000).otherwise(0)).alias("tile_num")).agg(F.count("*").alias("n"))
    tiles = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tile_num"), "s_name")
    return tiles.join(files, "tile_num", "right")


@query("SELECT c_custkey, status, n FROM customer LEFT JOIN (SELECT o_custkey, o_orderstatus AS status, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY 1, 2) ON c_custkey = o_custkey")
def job_left_join(spark, sf_dir):
    status = table(spark, sf_dir, "orders").filter("o_totalprice > 200000").groupBy(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(status, "c_custkey", "left")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def missing_tiles(spark, sf_dir):
    done = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return J.missing(table(spark, sf_dir, "customer").select("c_custkey"), done, "c_custkey")


@query("SELECT found, count(*) AS n FROM (SELECT p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AS found FROM part) GROUP BY 1")
def found_not_found(spark, sf_dir):
    have = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return J.found_split(table(spark, sf_dir, "part"), have, "p_partkey").groupBy("found").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_quantity < 30 GROUP BY 1, 2), b AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 20) GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b, coalesce(a.n, 0) - coalesce(b.n, 0) AS difference FROM a FULL JOIN b USING (l_orderkey, l_linenumber)""")
def dup_count_compare(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return J.compare_counts(li.filter("l_quantity < 30"), li.filter("l_quantity > 20").select("l_orderkey", "l_linenumber", "l_quantity").distinct(), ["l_orderkey", "l_linenumber"])


@query(f"WITH {SEG} SELECT {AGE_LABEL} AS label, count(*) AS n, round(avg(agb), 10) AS mean, round(stddev_samp(agb), 8) AS sd, round(sum(agb), 6) AS total FROM seg GROUP BY 1")
def interval_class_join(spark, sf_dir):
    df = J.interval_class(segments(spark, sf_dir), "age", RANGES)
    return df.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("agb"), 10).alias("mean"), F.round(F.stddev_samp("agb"), 8).alias("sd"), F.round(F.sum("agb"), 6).alias("total"))


@query("WITH c AS (SELECT CAST(user_id % 12 AS INTEGER) AS kendall FROM events), m(kendall, trend) AS (VALUES " + ", ".join(map(str, C.SIMPLE_TREND.items())) + ") SELECT trend, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM c), 6) AS percent FROM c LEFT JOIN m USING (kendall) GROUP BY 1")
def trend_remap(spark, sf_dir):
    c = table(spark, sf_dir, "events").select(C.simple_trend((F.col("user_id") % 12).cast("int")).alias("trend"))
    return rounded(stats.shares(c, "trend"))


@query("WITH t AS (SELECT n_nationkey AS id, n_nationkey % 5 AS x, n_nationkey // 5 AS y FROM nation) SELECT a.id, b.id AS neighbour FROM t a JOIN t b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.id <> b.id")
def neighbors(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") % 5).alias("x"), F.floor(F.col("n_nationkey") / 5).alias("y"))
    return J.neighbours(n, "id", "x", "y")


@query(f"""WITH {PTS}, px AS (SELECT CAST(floor((x + 8) / 0.5) AS INTEGER) AS col, CAST(floor((8 - y) / 0.5) AS INTEGER) AS row, nullif(avg(CAST(label AS DOUBLE)), 3.0) AS band FROM pts GROUP BY 1, 2)
SELECT point_id, p.row, p.col, round(band, 8) AS band FROM (SELECT point_id, CAST(floor((x + 8) / 0.5) AS INTEGER) AS col, CAST(floor((8 - y) / 0.5) AS INTEGER) AS row FROM pts) p LEFT JOIN px ON px.row = p.row AND px.col = p.col""")
def point_in_cell(spark, sf_dir):
    p = points(spark, sf_dir)
    px = p.withColumns(J.pixel_of(F.col("x"), F.col("y"), (-8, 8), 0.5)).groupBy("row", "col").agg(F.avg(F.col("label").cast("double")).alias("band"))
    out = J.sample_pixels(p, px, "x", "y", (-8, 8), 0.5, nodata=3.0)
    return out.select("point_id", "row", "col", F.round("band", 8).alias("band"))


@query(f"""WITH {PTS}, d(polygon_id, cx, cy, r) AS (VALUES (1, 0.05, 0.03, 0.11), (2, 0.3, -0.2, 0.5), (3, -1.01, 0.52, 0.73))
SELECT point_id, polygon_id FROM pts LEFT JOIN d ON abs(x - cx) + abs(y - cy) < r""")
def polygon_points(spark, sf_dir):
    """Points within diamonds, by grid cell and ring."""
    rows = []
    for i, cx, cy, r in ((1, 0.05, 0.03, 0.11), (2, 0.3, -0.2, 0.5), (3, -1.01, 0.52, 0.73)):
        ring = [(cx - r, cy), (cx, cy + r), (cx + r, cy), (cx, cy - r), (cx - r, cy)]
        rows.append((i, [{"x": x, "y": y} for x, y in ring], cx - r, cx + r, cy - r, cy + r))
    polygons = spark.createDataFrame(rows, "polygon_id int, ring array<struct<x:double,y:double>>, xmin double, xmax double, ymin double, ymax double")
    return J.within_polygons(points(spark, sf_dir), polygons, "x", "y", 0.25).select("point_id", "polygon_id")


@query(f"""WITH {PTS}, a AS (SELECT point_id AS id, x - 0.02 AS x0, x + 0.02 AS x1, y - 0.02 AS y0, y + 0.02 AS y1 FROM pts), b AS (SELECT point_id AS id, x - 0.03 AS x0, x + 0.03 AS x1, y - 0.03 AS y0, y + 0.03 AS y1 FROM pts)
SELECT a.id AS a_id, b.id AS b_id FROM a JOIN b ON a.id <> b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1""")
def grid_spatial_join(spark, sf_dir):
    def boxes(r):
        x, y = F.col("x"), F.col("y")
        return points(spark, sf_dir).select(F.col("point_id").alias("id"), (x - r).alias("xmin"), (x + r).alias("xmax"), (y - r).alias("ymin"), (y + r).alias("ymax"))

    return J.overlapping(boxes(0.02), boxes(0.03), 0.1).filter("a_id <> b_id")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def latest_per_key(spark, sf_dir):
    """By an aggregation, which combines before the shuffle."""
    o = table(spark, sf_dir, "orders").withColumn("age", -F.datediff("o_orderdate", F.lit("1970-01-01")))
    return W.first_of_key(o.select("o_custkey", "age", "o_orderkey", "o_totalprice"), ["o_custkey"], ["age", "o_orderkey"]).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) > 1")
def duplicates_report(spark, sf_dir):
    return W.latest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")], duplicates=True).select("o_orderkey", "o_custkey")


@query("SELECT s_suppkey, s_nationkey, s_nationkey + 1000 * (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) - 1) AS part_id FROM supplier")
def rank_offset_ids(spark, sf_dir):
    return W.offset_ids(table(spark, sf_dir, "supplier"), "s_nationkey", [F.desc("s_acctbal"), F.col("s_suppkey")]).select("s_suppkey", "s_nationkey", F.col("part_id").cast("long").alias("part_id"))


@query("WITH t AS (SELECT p_type, sum(p_retailprice) AS total FROM part GROUP BY 1) SELECT p_type, round(total, 4) AS total, round(sum(total) OVER (ORDER BY total DESC, p_type) / (SELECT sum(total) FROM t), 8) AS share FROM t")
def cumulative_share(spark, sf_dir):
    """The running share of part types: the window is over the few types, not the parts."""
    t = table(spark, sf_dir, "part").groupBy("p_type").agg(F.sum("p_retailprice").alias("total"))
    all_ = t.agg(F.sum("total").alias("all_"))
    out = W.running_sum(t.withColumn("k", F.lit(0)), "total", ["k"], [F.desc("total"), F.col("p_type")]).crossJoin(F.broadcast(all_))
    return out.select("p_type", F.round("total", 4).alias("total"), F.round(F.col("running") / F.col("all_"), 8).alias("share"))


@query("WITH m AS (SELECT l_returnflag AS flag, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS ym, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) SELECT flag, ym, q, round(CASE WHEN row_number() OVER (PARTITION BY flag ORDER BY ym) <= 2 THEN 0.0 ELSE stddev_samp(q) OVER (PARTITION BY flag ORDER BY ym) END, 6) AS sd_so_far FROM m")
def expanding_sd(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), (F.year("l_shipdate") * 100 + F.month("l_shipdate")).alias("ym")).agg(F.sum("l_quantity").alias("q"))
    return rounded(W.expanding_sd(m, "q", ["flag"], [F.col("ym")]))


@query("""WITH d AS (SELECT event_type, CAST(dayofyear(ts) AS INTEGER) AS day, avg(value) AS raw FROM events GROUP BY 1, 2), g AS (SELECT event_type, day, CASE WHEN day % 3 <> 0 AND day > 3 THEN raw END AS v FROM d),
n AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN v IS NOT NULL THEN day END IGNORE NULLS) OVER b AS p0, first_value(v IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN v IS NOT NULL THEN day END IGNORE NULLS) OVER f AS p1 FROM g
WINDOW b AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_type, day, round(CASE WHEN v IS NOT NULL THEN v WHEN p0 IS NULL THEN v1 WHEN p1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (day - p0) / (p1 - p0) END, 6) AS filled FROM n""")
def gap_interpolate(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("event_type", F.dayofyear("ts").alias("day")).agg(F.avg("value").alias("raw"))
    g = d.withColumn("v", F.when((F.col("day") % 3 != 0) & (F.col("day") > 3), F.col("raw")))
    return rounded(W.interpolated(g, ["event_type"], "day", "v").select("event_type", "day", "filled"))


@query(f"WITH {SEG} SELECT tile_num, granule, line, part, agb FROM seg QUALIFY row_number() OVER (PARTITION BY tile_num ORDER BY agb DESC, granule, line, part) <= 3")
def topn_per_tile(spark, sf_dir):
    return W.per_group(segments(spark, sf_dir), ["tile_num"], [F.desc("agb"), F.col("granule"), F.col("line"), F.col("part")], 3).select("tile_num", "granule", "line", "part", "agb")


@query(f"""WITH {SEG}, w AS (SELECT age % 8 AS age, kendall % 5 AS trend, sum(agb) FILTER (year = 1997) AS first, sum(agb) FILTER (year = 2000) AS second FROM seg GROUP BY 1, 2), l AS (SELECT age, trend, unnest(['first', 'second', 'change']) AS measure, unnest([first, second, second - first]) AS value FROM w)
SELECT age, trend, measure, round(value, 6) AS value FROM l""")
def age_trend_long(spark, sf_dir):
    w = segments(spark, sf_dir).groupBy((F.col("age") % 8).alias("age"), (F.col("kendall") % 5).alias("trend")).agg(F.sum(F.when(F.col("year") == 1997, F.col("agb"))).alias("first"), F.sum(F.when(F.col("year") == 2000, F.col("agb"))).alias("second"))
    return rounded(W.long_change(w, ["age", "trend"], "first", "second"), 6)


@query("SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderstatus) AS kinds FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_distinct("o_orderstatus").alias("kinds")).filter("n > 1")


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS failed, count(*) AS n, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS failed_percent FROM orders GROUP BY 1")
def status_tally(spark, sf_dir):
    failed = F.count(F.when(F.col("o_orderstatus") == "F", 1))
    return rounded(table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(failed.alias("failed"), F.count("*").alias("n"), (100.0 * failed / F.count("*")).alias("failed_percent")))


@query(f"WITH {CELLS} SELECT a.row, a.col, round(a.value, 6) AS value, round((SELECT avg(b.value) FROM cells b WHERE abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1), 6) AS focal_mean FROM cells a")
def neighborhood_mean(spark, sf_dir):
    return rounded(R.focal_mean(cells(spark, sf_dir).drop("top"), "value", 1))


@query(f"WITH {CELLS}, m AS (SELECT a.row, a.col, b.top, count(*) AS n FROM cells a JOIN cells b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY 1, 2, 3) SELECT row, col, top AS focal_mode FROM m QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY n DESC, top) = 1")
def neighborhood_mode(spark, sf_dir):
    return R.focal_mode(cells(spark, sf_dir).drop("value"), "top", 1).select("row", "col", "focal_mode")


@query(f"WITH {CELLS}, m AS (SELECT CAST(floor(row / 4) AS INTEGER) AS r, CAST(floor(col / 4) AS INTEGER) AS c, top, value FROM cells), k AS (SELECT r, c, top, count(*) AS n FROM m GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY r, c ORDER BY count(*) DESC, top) = 1) SELECT r AS row, c AS col, round(avg(m.top), 6) AS mean, any_value(k.top) AS mode, count(m.top) AS n FROM m JOIN k USING (r, c) GROUP BY 1, 2")
def reduce_resolution(spark, sf_dir):
    return rounded(R.reduced(cells(spark, sf_dir), "top", 4))


@query("""WITH b(id, xmin, ymin, xmax, ymax) AS (SELECT n_nationkey, CAST(n_nationkey AS DOUBLE), CAST(0 AS DOUBLE), n_nationkey + 2.5, CAST(3 AS DOUBLE) FROM nation)
SELECT id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(xmin + i * 1.0, 6) AS x0, round(ymin + j * 2.0, 6) AS y0, round(least(xmin + i * 1.0 + 1.0, xmax), 6) AS x1, round(least(ymin + j * 2.0 + 2.0, ymax), 6) AS y1 FROM b, generate_series(0, 2) a(i), generate_series(0, 1) c(j)""")
def fishnet(spark, sf_dir):
    k = F.col("n_nationkey")
    b = table(spark, sf_dir, "nation").select(k.alias("id"), k.cast("double").alias("xmin"), F.lit(0.0).alias("ymin"), (k + 2.5).cast("double").alias("xmax"), F.lit(3.0).alias("ymax"))
    return rounded(R.fishnet(b, 1.0, 2.0))


@query(f"WITH {SER}, m AS (SELECT pixel, min(v) AS low, count(*) AS n FROM ser GROUP BY 1) SELECT pixel, round(low, 6) AS low, n FROM m UNION ALL SELECT CAST(NULL AS BIGINT), NULL, count(*) FROM m")
def appended_index(spark, sf_dir):
    m = series(spark, sf_dir).groupBy("pixel").agg(F.min("v").alias("low"), F.count("*").alias("n"))
    return rounded(W.appended(m, m.agg(F.count("*").alias("n"))))
