"""Queries that write files with the library's sinks and read them with its sources, and searches of catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classes as C
from ..operators import joins as J
from ..operators import model as M
from ..sources import granule, tables
from .registry import query
from .roles import PTS, SEG, points, rounded, segments, table
from .scratch import scratch


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def csv_round_trip(spark, sf_dir):
    path = scratch(spark, "csv")
    tables.write_csv(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), path)
    return tables.read_csv(spark, path, "c_custkey long, c_name string, c_nationkey long, c_acctbal double")


@query("SELECT CAST(s_nationkey AS BIGINT) AS tile_num, s_suppkey, s_name FROM supplier WHERE s_nationkey BETWEEN 3 AND 11")
def tiles_round_trip(spark, sf_dir):
    """A sink by tile; the filter on tiles prunes folders."""
    path = scratch(spark, "tiles")
    tables.write_tiles(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("tile_num"), "s_suppkey", "s_name"), path)
    return spark.read.schema("s_suppkey long, s_name string, tile_num long").parquet(path).filter("tile_num BETWEEN 3 AND 11")


_BEAM = "CASE s_suppkey % 6 " + " ".join(f"WHEN {k} THEN '{b}'" for k, b in enumerate(granule.BEAMS)) + " END"


def _granules(spark, sf_dir):
    path = scratch(spark, "granules")
    df = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("g"), (F.col("s_nationkey") % 5).cast("string")).alias("granule"), F.expr(_BEAM).alias("gt"), F.col("s_acctbal").alias("lon"), F.col("s_suppkey").cast("double").alias("lat"),
        (F.col("s_suppkey") % 40).cast("double").alias("h_can"), (F.col("s_suppkey") % 120).cast("double").alias("tcc_prc"),
    )
    df.repartition("granule", "gt").write.partitionBy("granule", "gt").parquet(path)
    spark.dataSource.register(granule.GranuleSource)
    return path


@query(f"SELECT 'g' || CAST(s_nationkey % 5 AS VARCHAR) AS granule_name, {_BEAM} AS gt, s_acctbal AS lon, CAST(s_suppkey AS DOUBLE) AS lat, CAST(s_suppkey % 40 AS DOUBLE) AS h_can FROM supplier")
def granule_scan(spark, sf_dir):
    return spark.read.format("granule").load(_granules(spark, sf_dir))


@query(f"SELECT 'g' || CAST(s_nationkey % 5 AS VARCHAR) AS granule_name, {_BEAM} AS gt, CAST(s_suppkey % 40 AS DOUBLE) AS h_can, CAST(CASE WHEN s_suppkey % 120 BETWEEN 1 AND 100 THEN ((s_suppkey % 120 + 9) // 10) * 10 END AS INTEGER) AS tcc_bin FROM supplier")
def granule_scan_old(spark, sf_dir):
    return spark.read.format("granule").schema("granule_name string, gt string, h_can double, tcc_bin int").option("version", "old").load(_granules(spark, sf_dir))


@query(f"WITH {PTS} SELECT point_id FROM pts WHERE x - 0.01 <= 0.1 AND x + 0.03 >= -0.05 AND y - 0.01 <= 0.08 AND y + 0.02 >= -0.1")
def shapes_in_box(spark, sf_dir):
    """Triangles written with their bounds, read by a box."""
    path, x, y = scratch(spark, "shapes"), F.col("x"), F.col("y")
    corner = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    tables.write_shapes(points(spark, sf_dir).select("point_id", F.array(corner(-0.01, -0.01), corner(0.03, -0.01), corner(0.0, 0.02), corner(-0.01, -0.01)).alias("ring")), path)
    return tables.read_shapes(spark, path, (-0.05, -0.1, 0.1, 0.08)).select("point_id")


_PIXELS = "px AS (SELECT CAST(l_suppkey % 10 AS INTEGER) AS tile_num, CAST(l_partkey % 300 AS INTEGER) AS row, CAST(l_orderkey % 280 AS INTEGER) AS col, max(l_quantity) AS blue, min(l_tax) AS red FROM lineitem GROUP BY 1, 2, 3)"


def _pixels(spark, sf_dir):
    c = F.col
    keys = [(c("l_suppkey") % 10).cast("int").alias("tile_num"), (c("l_partkey") % 300).cast("int").alias("row"), (c("l_orderkey") % 280).cast("int").alias("col")]
    return table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.max("l_quantity").alias("blue"), F.min("l_tax").alias("red"))


@query(f"WITH {_PIXELS} SELECT tile_num, row, col, round(CASE WHEN blue <> 50 THEN blue * CAST(0.0000275 AS DOUBLE) - CAST(0.2 AS DOUBLE) END, 8) AS blue FROM px WHERE row BETWEEN 10 AND 270 AND col BETWEEN 0 AND 120")
def raster_window(spark, sf_dir):
    """A raster in chunks, read back by band and window and scaled."""
    path = scratch(spark, "raster")
    tables.write_raster(_pixels(spark, sf_dir), path, ["blue", "red"], nodata=50.0)
    return rounded(tables.read_raster(spark, path, ["blue"], (10, 270, 0, 120), (0.0000275, -0.2)), 8)


_SCENE = "CASE page_id % 3 WHEN 0 THEN 'HLS.L30.T' WHEN 1 THEN 'HLS.S30.T' ELSE 'LC08_' END || CAST(page_id AS STRING)"


@query(f"""WITH a(product, band, asset) AS (VALUES {", ".join(f"('{p}', '{b}', '{a}')" for p, bands in tables.ASSETS.items() for b, a in bands.items())}),
s AS (SELECT {_SCENE} AS scene, page_id, CASE page_id % 3 WHEN 0 THEN 'HLSL30' WHEN 1 THEN 'HLSS30' ELSE 'LC2SR' END AS product FROM pages), k AS (SELECT *, unnest(['B04', 'B8A', 'SR_B4', 'Fmask', 'thumb']) AS asset FROM s)
SELECT scene, product, band, CASE WHEN page_id % 4 = 0 THEN 'https' ELSE 's3' END || '://b/' || scene || '/' || asset AS href FROM k JOIN a USING (product, asset) WHERE page_id % 4 <> 0""")
def catalogue_scan(spark, sf_dir):
    """Scenes written as lines of JSON and read with their bands."""
    path, scene = scratch(spark, "catalogue"), F.expr(_SCENE)
    link = lambda a: F.struct(F.concat(F.when(F.col("page_id") % 4 == 0, "https").otherwise("s3"), F.lit("://b/"), scene, F.lit(f"/{a}")).alias("href"))
    assets = F.create_map(*[x for a in ("B04", "B8A", "SR_B4", "Fmask", "thumb") for x in (F.lit(a), link(a))])
    feature = F.struct(scene.alias("id"), F.create_map(F.lit("page"), F.col("url")).alias("properties"), assets.alias("assets"))
    table(spark, sf_dir, "pages").select(F.to_json(F.struct(F.array(feature).alias("features")))).write.text(path)
    return tables.catalogue(spark, path, lines=True)


@query("SELECT c_custkey, c_nationkey % 90 AS max_cloud, 'run_' || c_mktsegment AS run_type, TRUE AS from_file FROM customer")
def parameters_scan(spark, sf_dir):
    path = scratch(spark, "parameters")
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 90).alias("max_cloud"), F.concat(F.lit("run_"), "c_mktsegment").alias("run_type"))
    rows.write.json(path)
    return tables.parameters(spark, path, "c_custkey long, max_cloud long, run_type string", lines=True).select("c_custkey", "max_cloud", "run_type", F.col("json_path").contains("/part-").alias("from_file"))


@query("SELECT CAST(n_nationkey AS INTEGER) AS tile_num, count(*) AS n, TRUE AS filled FROM nation GROUP BY 1")
def listed_files(spark, sf_dir):
    """A listing of files by pattern, with the tile that their path names."""
    path = scratch(spark, "listing")
    table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").alias("tile_num")).repartition("tile_num").write.partitionBy("tile_num").csv(path)
    files = tables.list_files(spark, path, "*.csv")
    return files.groupBy(F.regexp_extract("path", "tile_num=([0-9]+)", 1).cast("int").alias("tile_num")).agg(F.count("*").alias("n"), (F.min("size") > 0).alias("filled"))


@query("""WITH o AS (SELECT o_orderkey, CAST(o_custkey % 100 AS INTEGER) AS cloud FROM orders WHERE o_totalprice > 100000), n AS (SELECT * FROM (SELECT unnest(generate_series(20, 90, 5)) AS k)), c AS (SELECT k FROM n WHERE (SELECT count(*) FROM o WHERE cloud <= k) >= 600),
m AS (SELECT CAST(coalesce(min(k), 90) AS INTEGER) AS max_cloud FROM c) SELECT o_orderkey, cloud, max_cloud FROM o, m WHERE cloud <= max_cloud""")
def relaxed_search(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_totalprice > 100000").select("o_orderkey", (F.col("o_custkey") % 100).cast("int").alias("cloud"))
    return tables.relaxed(o, "cloud", 20, 600)


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) BETWEEN 1994 AND 1996 AND strftime(o_orderdate, '%m-%d') BETWEEN '06-01' AND '09-15' AND o_custkey % 90 <= 60 AND o_custkey % 90 + 5 >= 20 AND o_orderkey % 50 <= 40 AND o_orderkey % 50 + 3 >= 10")
def season_search(spark, sf_dir):
    """Granules of a season in some years whose bounds meet a box."""
    c = F.col
    o = table(spark, sf_dir, "orders").withColumns({"xmin": c("o_custkey") % 90, "xmax": c("o_custkey") % 90 + 5, "ymin": c("o_orderkey") % 50, "ymax": c("o_orderkey") % 50 + 3})
    return tables.in_bounds(tables.yearly(o, "o_orderdate", 1994, 1996, "06-01", "09-15"), (20, 10, 60, 40)).select("o_orderkey")


@query("SELECT url AS href, page_id FROM pages WHERE url IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def existing_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return tables.existing(p.select(F.col("url").alias("href"), "page_id"), p.filter("page_id % 3 = 0").select(F.col("url").alias("path")))


@query(f"WITH {PTS} SELECT point_id, x AS lon, y AS lat FROM pts WHERE label = 1 AND x BETWEEN -0.1 AND 0.05 AND y BETWEEN -0.05 AND 0.2")
def ensemble_slice(spark, sf_dir):
    p = points(spark, sf_dir).withColumnsRenamed({"x": "lon", "y": "lat"})
    return tables.sliced(p, "label", 1, (-0.1, 0.05), (-0.05, 0.2)).select("point_id", "lon", "lat")


@query("SELECT CAST(s_suppkey AS INTEGER) AS shot, CAST(s_nationkey AS DOUBLE) AS rh50, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal END AS rh98 FROM supplier")
def fixed_width_scan(spark, sf_dir):
    """Aligned text with comments and a header."""
    path, text = scratch(spark, "lvis"), lambda c: F.lpad(c.cast("string"), 12, " ")
    s = table(spark, sf_dir, "supplier")
    rows = s.select(F.concat(text(F.col("s_suppkey")), text(F.col("s_nationkey")), F.when(F.col("s_suppkey") % 7 != 0, text(F.col("s_acctbal"))).otherwise("          nan?")).alias("value"))
    head = spark.createDataFrame([("# a comment",), ("  SHOT  RH50  RH98",), ("",)], "value string")
    head.unionByName(rows).write.text(path)
    return tables.read_fixed_width(spark, path, [("shot", "int"), ("rh50", "double"), ("rh98", "double")])


@query("SELECT s_nationkey AS tile_group, to_json(list({'path': s_name, 'footprint': s_phone} ORDER BY s_name, s_phone)) AS mosaic FROM (SELECT s_nationkey, s_name, 'f' || CAST(s_suppkey AS VARCHAR) AS s_phone FROM supplier) GROUP BY 1")
def mosaic_index(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "tile_group")
    return tables.mosaic_json(s, F.col("s_name"), F.concat(F.lit("f"), F.col("s_suppkey").cast("string"))).withColumn("mosaic", F.col("mosaic").cast("string"))


@query("SELECT s_nationkey AS tile_group, to_json(list({'path': s_name, 'footprint': f} ORDER BY s_name, f)) AS mosaic FROM (SELECT s_nationkey, s_name, CASE WHEN s_suppkey % 4 = 0 THEN 'new' ELSE 'f' || CAST(s_suppkey AS VARCHAR) END AS f FROM supplier) GROUP BY 1")
def mosaic_update(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "tile_group")
    first = tables.mosaic_json(s, F.col("s_name"), F.concat(F.lit("f"), F.col("s_suppkey").cast("string")))
    return tables.mosaic_updated(first, s.filter("s_suppkey % 4 = 0"), F.col("s_name"), F.lit("new"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE (o_custkey, o_orderstatus) NOT IN (SELECT o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 150000)")
def resume_work(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return tables.remaining(o, o.filter("o_totalprice > 150000"), ["o_custkey", "o_orderstatus"]).select("o_orderkey", "o_custkey")


def _layer(spark, sf_dir, condition, value):
    s = segments(spark, sf_dir).filter(condition)
    return s.groupBy("tile_num", F.col("kendall").alias("row"), F.col("snow").alias("col")).agg(F.max(value).alias(value))


_LAYERS = ", ".join(f"{n} AS (SELECT tile_num, kendall AS row, snow AS col, max({v}) AS {v} FROM seg WHERE {c} GROUP BY 1, 2, 3)" for n, c, v in (("a", "year < 1998", "h_can"), ("b", "year BETWEEN 1997 AND 1998", "slope"), ("d", "year > 1998", "age")))


@query(f"WITH {SEG}, {_LAYERS} SELECT tile_num, row, col, a.h_can AS a_h_can, b.slope AS b_slope, d.age AS d_age FROM a JOIN b USING (tile_num, row, col) JOIN d USING (tile_num, row, col)")
def multiband_merge(spark, sf_dir):
    layers = {"a": _layer(spark, sf_dir, "year < 1998", "h_can"), "b": _layer(spark, sf_dir, "year BETWEEN 1997 AND 1998", "slope"), "d": _layer(spark, sf_dir, "year > 1998", "age")}
    return J.stacked(layers, ["tile_num", "row", "col"])


@query(f"WITH {SEG}, {_LAYERS} SELECT tile_num, row, col, a.h_can AS a_h_can, b.slope AS b_slope FROM a LEFT JOIN b USING (tile_num, row, col)")
def padded_stack(spark, sf_dir):
    return J.stacked({"a": _layer(spark, sf_dir, "year < 1998", "h_can"), "b": _layer(spark, sf_dir, "year BETWEEN 1997 AND 1998", "slope")}, ["tile_num", "row", "col"], pad=True)


@query(f"WITH {SEG} SELECT round(regr_slope(agb, h_can), 5) AS slope, round(regr_intercept(agb, h_can), 4) AS intercept, round(regr_r2(agb, h_can), 5) AS r2, round(100 * sqrt(regr_syy(agb, h_can) * (1 - regr_r2(agb, h_can)) / count(*)) / avg(agb), 4) AS rel_rmse FROM seg")
def model_round_trip(spark, sf_dir):
    """A linear model and its accuracy, saved and loaded."""
    from pyspark.ml.regression import LinearRegressionModel

    path = scratch(spark, "model")
    df = segments(spark, sf_dir).select("agb", "h_can")
    fitted = M.linear(df, ["h_can"], "agb")
    predicted = fitted.transform(M.assembled(df, ["h_can"]))
    M.save(fitted, M.skill_table("agb", "prediction", predicted), path)
    model, accuracy = M.load(spark, LinearRegressionModel, path)
    return accuracy.select(F.round(F.lit(float(model.coefficients[0])), 5).alias("slope"), F.round(F.lit(float(model.intercept)), 4).alias("intercept"), F.round("r2", 5).alias("r2"), F.round("rel_rmse", 4).alias("rel_rmse"))


@query(f"""WITH {SEG}, l(kendall, label, red, alpha) AS (VALUES {", ".join(f"({k}, '{n}', {c[0]}, {c[3]})" for k, (n, c) in C.KENDALL.items())}) SELECT kendall, label, red, alpha, count(*) AS n FROM seg JOIN l USING (kendall) GROUP BY 1, 2, 3, 4""")
def class_legend(spark, sf_dir):
    """A raster of classes with its labels and colours."""
    n = segments(spark, sf_dir).groupBy("kendall").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(C.kendall_legend(spark)), "kendall").select("kendall", "label", "red", "alpha", "n")
