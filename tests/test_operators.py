"""Operators on small tables, with nulls and empty inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvaflow.operators import joins as J
from silvaflow.operators import model as M
from silvaflow.operators import quality as Q
from silvaflow.operators import raster as R
from silvaflow.operators import stats, trend, uncertainty
from silvaflow.operators import windows as W
from silvaflow.sources import schema, tables


def test_class_ceiling(spark):
    df = spark.createDataFrame([(111, 59.9), (111, 60.0), (123, 50.0), (20, 19.9), (100, 5.0), (0, -0.1), (999, 1.0), (111, None)], "lc int, h double")
    assert sorted((r.lc, r.h) for r in Q.below_class_ceiling(df, "lc", "h").collect()) == [(0, -0.1), (20, 19.9), (111, 59.9)]
    assert Q.below_class_ceiling(df.limit(0), "lc", "h").count() == 0


def test_audit_and_fallback(spark):
    df = spark.createDataFrame([(0, "Strong", 1), (0, "Strong", 2), (0, "Weak", 1), (1, "Strong", 1), (None, "Strong", 1)], "msw int, beam string, snow int")
    steps = Q.steps(msw=F.col("msw"), beam=F.col("beam"), snow=F.col("snow"))
    assert Q.audit(df, steps).first().asDict() == {"n_all": 5, "n_msw": 3, "n_beam": 2, "n_snow": 1}
    assert Q.audit(df.limit(0), steps).first().n_all == 0
    strong = F.col("beam") == "Strong"
    assert Q.or_first(df, F.col("msw") == 9, ["msw", "snow"], strong).collect() == [(None, "Strong", 1)]
    assert Q.or_first(df, F.col("msw") == 1, ["msw"], strong).count() == 1
    assert Q.or_first(df.limit(0), F.col("msw") == 1, ["msw"], strong).count() == 0


def test_bounds(spark):
    df = spark.createDataFrame([(0.0, 0.5), (0.5, 0.5)], "x double, y double")
    assert df.filter(Q.in_box(F.col("x"), F.col("y"), (0, 1, 0, 1))).count() == 1
    assert df.filter(Q.in_box(F.col("x"), F.col("y"), (0, 1, 0, 1), inclusive=True)).count() == 2


def test_statistics(spark):
    df = spark.createDataFrame([(1, float(x)) for x in (1, 2, 2, 3, 4, 10)] + [(2, None)], "z int, v double")
    r = {x.z: x for x in stats.zonal_stats(df, "z", "v").collect()}
    one = r[1]
    assert (one["mean"], one["std"], one["median"], one["mode"], one["nmad"]) == pytest.approx((3.666667, 2.981424, 2.5, 2, 1.4826), abs=1e-5)
    assert r[2]["count"] == 0 and r[2]["mean"] is None
    t = {x.z: x for x in stats.tile_stats(df, "z", "v").collect()}[1]
    assert (t.q02, t.q25, t.q50, t.q75, t.q98, t.sd) == pytest.approx((1.1, 2, 2.5, 3.75, 9.4, 3.265986), abs=1e-5)
    assert stats.zonal_stats(df.limit(0), "z", "v").count() == 0


def series(spark, ys, x0=2018.5):
    return spark.createDataFrame([(1, x0 + i, y) for i, y in enumerate(ys)], "px int, t double, v double")


def test_trends(spark):
    df = series(spark, [40.0, 42.0, 41.0, 45.0, 47.0, 46.0])
    o = trend.ols(df, ["px"], "t", "v").first()
    assert (o.slope, o.intercept, o.r2, o.se) == pytest.approx((1.4, -2785.9, 0.8265060, 0.3207135), abs=1e-5)
    c = trend.confidence(F.lit(o.slope), F.lit(o.se), F.lit(6))
    assert [spark.range(1).select(x).first()[0] for x in c.values()] == pytest.approx((0.5095566, 2.2904434), abs=1e-4)
    s = trend.theil_sen(df, ["px"], "t", "v").first()
    assert (s.slope, s.intercept) == pytest.approx((1.6666667, -3324.8333333), abs=1e-6)
    k = trend.with_kendall_p(df, ["px"], "t", "v").first()
    assert (k.tau, k.p) == pytest.approx((0.7333333, 0.0555556), abs=1e-6)


def test_too_few_observations(spark):
    df = series(spark, [1.0, None, 3.0, None])
    o = trend.ols(df, ["px"], "t", "v").first()
    assert (o.n_obs, o.slope) == (0, None)
    assert trend.theil_sen(df, ["px"], "t", "v").first().slope is None
    assert trend.kendall(df, ["px"], "t", "v").first().tau is None
    same = spark.createDataFrame([(1, 1.0, 1.0)] * 4, "px int, t double, v double")
    assert trend.ols(same, ["px"], "t", "v").first().slope is None
    assert trend.kendall(same, ["px"], "t", "v").first().tau is None


def test_kendall_p_agrees_with_counting():
    from itertools import permutations

    n, cons = 5, []
    for p in permutations(range(n)):
        cons.append(sum(np.sign(p[j] - p[i]) for i in range(n) for j in range(i + 1, n)))
    for con in range(0, 11, 2):
        assert trend.kendall_exact_p(n, con) == pytest.approx(min(1.0, sum(abs(c) >= con for c in cons) / len(cons)))


def test_breakpoints_against_all_partitions():
    rng = np.random.default_rng(3)
    for _ in range(20):
        v = np.concatenate([rng.normal(m, 1, 5) for m in rng.choice([0, 6, 12], 4)])
        ends = [5, 10, 15]
        cost = lambda a, b: float(((v[a:b] - v[a:b].mean()) ** 2).sum())

        def total(cuts):
            at = [0, *cuts, 20]
            return sum(cost(a, b) for a, b in zip(at, at[1:])) + 10 * (len(at) - 1)

        options = [[e for k, e in enumerate(ends) if m >> k & 1] for m in range(8)]
        assert total(trend.breakpoints(v)) == pytest.approx(min(map(total, options)))


def test_latest_and_duplicates(spark):
    df = spark.createDataFrame([(7, 1), (7, 3), (8, 2)], "tile int, mtime int")
    assert sorted(map(tuple, W.latest(df, ["tile"], [F.desc("mtime")]).collect())) == [(7, 3), (8, 2)]
    assert [tuple(r) for r in W.latest(df, ["tile"], [F.desc("mtime")], duplicates=True).collect()] == [(7, 1)]


def test_expanding_sd(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate((10, 12, 11, 13, 12))], "k int, i int, v double")
    got = [r.sd_so_far for r in W.expanding_sd(df, "v", ["k"], [F.col("i")]).orderBy("i").collect()]
    assert got == pytest.approx([0, 0, 1, 1.2909944, 1.1401754], abs=1e-6)


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 10)
    a, b = (sorted(r.id for r in W.hash_sample(df.repartition(n), ["id"], 20).collect()) for n in (1, 7))
    assert a == b and len(a) == 20
    assert W.topped_up(df.filter("id < 5"), df.filter("id >= 500"), 12, ["id"]).count() == 12
    assert W.topped_up(df, df, 12, ["id"]).count() == 1000


def test_neighbours(spark):
    grid = spark.createDataFrame([(i + 1, i % 3, i // 3) for i in range(9)], "id int, x int, y int")
    found = {}
    for r in J.neighbours(grid, "id", "x", "y").collect():
        found.setdefault(r.id, set()).add(r.neighbour)
    assert found[5] == {1, 2, 3, 4, 6, 7, 8, 9} and found[1] == {2, 4, 5}


def test_composite(spark):
    df = spark.createDataFrame([(1, "a", 0.4, 1.0), (1, "b", 0.9, 2.0), (1, "c", None, 3.0)], "px int, scene string, ndvi double, red double")
    r = R.composite(df, ["px"], "ndvi", ["red"], "scene").first()
    assert (r.scene, r.red, r.n_valid) == ("b", 2.0, 2)
    assert R.composite(df, ["px"], "ndvi", ["red"], "scene", "min").first().scene == "a"


def test_common_mask(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0), (4.0, None)], "a double, b double")
    assert [tuple(r) for r in Q.common(df, ["a", "b"]).collect()] == [(1.0, 2.0), (None, None), (None, None)]


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(-120.0, 55.0), (30.0, 65.0), (179.9, 51.0)], "lon double, lat double")
    back = df.withColumns(R.to_albers(F.col("lon"), F.col("lat"))).withColumns({k + "2": v for k, v in R.from_albers(F.col("x"), F.col("y")).items()})
    for r in back.collect():
        assert (r.lon2, r.lat2) == pytest.approx((r.lon, r.lat), abs=1e-8)


def test_projected_points_keep_their_turn_and_ties(spark, tmp_path):
    import os

    from parity import TABLES, compare

    from silvaflow.plans import registry

    for t in TABLES:
        os.symlink(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / f"{t}.parquet")
    os.remove(tmp_path / "embeddings.parquet")
    x = [0.52936387, -0.51518393, 0.45, -0.45, 39.55078125 / 400, -21.38671875 / 400, 0.0]
    rows = [(k, [v, 0.1 + k / 64, 0.5], 1) for k, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "written"))
    os.rename(next((tmp_path / "written").glob("*.parquet")), tmp_path / "embeddings.parquet")
    compare(spark, registry.queries()["projected_points"], registry.oracle_sql()["projected_points"], str(tmp_path))


def test_shapes(spark):
    ring = [{"x": float(x), "y": float(y)} for x, y in ((0, 0), (4, 0), (4, 2), (0, 2), (0, 0))]
    df = spark.createDataFrame([(ring,)], "ring array<struct<x:double,y:double>>")
    r = df.select(R.ring_area(F.col("ring")).alias("a"), R.ring_centroid(F.col("ring")).alias("c"), J.in_ring(F.col("ring"), F.lit(1.0), F.lit(1.0)).alias("i"), J.in_ring(F.col("ring"), F.lit(5.0), F.lit(1.0)).alias("o")).first()
    assert (r.a, r.c.x, r.c.y, r.i, r.o) == (8.0, 2.0, 1.0, True, False)
    split = R.at_dateline(spark.createDataFrame([(1, 170.0, -170.0, 0.0, 1.0), (2, 1.0, 2.0, 0.0, 1.0)], "id int, xmin double, xmax double, ymin double, ymax double")).collect()
    assert sorted((r.id, r.xmin, r.xmax) for r in split) == [(100, 170.0, 180.0), (101, -180.0, -170.0), (200, 1.0, 2.0)]


def test_terrain_of_a_plane(spark):
    df = spark.createDataFrame([(r, c, float(c)) for r in range(5) for c in range(5)], "row int, col int, z double")
    t = R.terrain(df, "z", 1.0).filter("row = 2 AND col = 2").first()
    assert (t.slope, t.aspect) == pytest.approx((45.0, 270.0))
    edge = R.terrain(df, "z", 1.0).filter("row = 0 AND col = 0").first()
    assert edge.slope is None


def test_analytic_total_and_change(spark):
    df = spark.createDataFrame([(1, 100.0, 10.0), (1, 50.0, 20.0), (1, 0.0, 5.0)], "g int, m double, s double")
    r = uncertainty.analytic_total(df, ["g"], "m", "s", 0.09 * 1e-9).first()
    assert (r.total, r.total_sd, r.cv, r.uncertainty) == pytest.approx((1.35e-8, 2.0621591e-9, 0.1527525, 29.93949), rel=1e-5)
    c = uncertainty.analytic_change(F.lit(10.0), F.lit(1.5), F.lit(12.0), F.lit(2.0))
    got = spark.range(1).select(*[v.alias(k) for k, v in c.items()]).first()
    assert (got.change, got.change_sd, got.z) == (2.0, 2.5, 0.8)
    assert got.p_increase == pytest.approx(0.5 * (1 + math.erf(0.8 / math.sqrt(2))), abs=1e-6)


def test_simulation_matches_the_analytic_total(spark):
    df = spark.createDataFrame([(1, k, 100.0, 10.0) for k in range(50)], "g int, k int, m double, s double")
    a = uncertainty.simulated_totals(df, ["g"], ["g", "k"], "m", "s", 1.0, n=1000).first()
    b = uncertainty.simulated_totals(df.repartition(5), ["g"], ["g", "k"], "m", "s", 1.0, n=1000).first()
    assert a["mean"] == pytest.approx(5000, rel=0.002) and a.sd == pytest.approx(math.sqrt(50) * 10, rel=0.1)
    assert a["mean"] == pytest.approx(b["mean"], rel=1e-12)


def test_carbon_draws(spark):
    df = spark.createDataFrame([(1, 100.0, 1.0, 50.0, 1.0), (2, 100.0, 1.0, 0.0, 0.0)], "k int, biomass_mean double, biomass_std double, age_mean double, age_std double")
    r = {x.k: x for x in uncertainty.carbon_accumulation(df, ["k"], n=200).collect()}
    assert r[1].carbon_mean == pytest.approx(50, abs=0.2) and r[1].accumulation_mean == pytest.approx(1, abs=0.05)
    assert r[2].accumulation_mean == 0


def test_models(spark):
    df = spark.range(200).select((F.col("id") % 20).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"), (F.col("id") % 20 * 2.0).alias("agb"))
    model = M.forest(df, ["x", "y"], "agb", trees=10, per_split=2, depth=5)
    fit = M.applied([model], df, ["x", "y"])
    assert fit.agg(F.corr("agb", "value")).first()[0] > 0.95
    assert M.importances(model, ["x", "y"])[0][0] == "x"
    assert M.resampled([1.0, 2.0], [[0.1, 0.0], [0.0, 0.1]], 500, 1).mean(axis=0) == pytest.approx([1, 2], abs=0.1)
    assert M.linear(df, ["x", "y"], "agb").coefficients[0] == pytest.approx(2, abs=1e-3)


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 0, 2.0), (2, 0, 0, float("nan"))], "tile_num int, row int, col int, v double")
    assert [r.v for r in schema.nulls(df, {"v": [2.0]}).collect()] == [None, None]
    tables.write_tiles(df, str(tmp_path / "tiles"))
    assert spark.read.parquet(str(tmp_path / "tiles")).count() == 2
    assert tables.list_files(spark, str(tmp_path / "tiles"), "*.parquet").count() == 2
    (tmp_path / "scenes.json").write_text('{"features": [{"id": "HLS.L30.x", "properties": {}, "assets": {"B04": {"href": "s3://a"}, "B05": {"href": "https://b"}}}]}')
    assert [tuple(r) for r in tables.catalogue(spark, str(tmp_path / "scenes.json")).collect()] == [("HLS.L30.x", "HLSL30", "red", "s3://a")]
    (tmp_path / "lvis.txt").write_text("# x\n1 2.5 a\n  3 x b\n")
    assert [tuple(r) for r in tables.read_fixed_width(spark, str(tmp_path / "lvis.txt"), [("a", "int"), ("b", "double")]).collect()] == [(1, 2.5), (3, None)]
    scenes = spark.createDataFrame([(x,) for x in (10, 20, 50, 80)], "cloud int")
    assert tables.relaxed(scenes, "cloud", 10, 3).count() == 3
    assert tables.remaining(scenes, scenes.limit(1), ["cloud"]).count() == 3


def test_granules(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from silvaflow.sources.granule import GranuleSource

    for g, beams in (("a", ("gt1l", "gt2r")), ("b", ("gt3l",))):
        (tmp_path / g).mkdir()
        for b in beams:
            pq.write_table(pa.table({"lon": [1.0, 2.0], "lat": [3.0, 4.0], "h_can": [5.0, None]}), tmp_path / g / f"{b}.parquet")
    spark.dataSource.register(GranuleSource)
    df = spark.read.format("granule").load(str(tmp_path))
    assert sorted({(r.granule_name, r.gt) for r in df.collect()}) == [("a", "gt1l"), ("a", "gt2r"), ("b", "gt3l")]
    assert df.count() == 6


def test_incremental(spark, tmp_path):
    from silvaflow.streaming.incremental import available_now

    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    kept = lambda df: df.filter("h < 10")
    spark.createDataFrame([(1, 5.0), (2, 50.0)], "k int, h double").write.parquet(src)
    available_now(spark, src, "k int, h double", kept, out, check)
    spark.createDataFrame([(3, 6.0)], "k int, h double").write.mode("append").parquet(src)
    available_now(spark, src, "k int, h double", kept, out, check)
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 3]


def test_geometry(spark):
    from silvaflow.operators import geometry as G

    boxes = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, 5.0, 5.0, 6.0, 6.0)], "id int, xmin double, ymin double, xmax double, ymax double")
    assert G.buffered(boxes, 1).first().xmin == -1
    assert [tuple(r) for r in G.clipped(boxes.withColumns({"a": F.lit(0.5), "b": F.lit(0.0), "c": F.lit(3.0), "d": F.lit(3.0)}), ["a", "b", "c", "d"]).select(*G.BOX).collect()] == [(0.5, 0.0, 1.0, 1.0)]
    assert [r.id for r in G.intersecting(boxes, boxes.filter("id = 2"), 0.7).collect()] == [2]
    ring = [{"x": x, "y": y} for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0))]
    polygons = spark.createDataFrame([(7, ring, 0.0, 2.0, 0.0, 2.0)], "polygon_id int, ring array<struct<x:double,y:double>>, xmin double, xmax double, ymin double, ymax double")
    cells = spark.createDataFrame([(r, c) for r in range(4) for c in range(4)], "row int, col int")
    zones = {(r.row, r.col): r.zone for r in G.rasterised(cells, polygons, (0.0, 4.0), 1.0).collect()}
    assert sum(z == 7 for z in zones.values()) == 4 and zones[3, 0] == 7 and zones[0, 0] == 0
    tiles = spark.createDataFrame([(1, 0.0, 1e6, 1000.0, 1.001e6)], "tile_num int, xmin double, ymin double, xmax double, ymax double")
    part = G.tile_parts(tiles, 100.0).first()
    assert part.lat0 < part.lat1 and part.buffered_xmin == -100


def test_flows(spark):
    from silvaflow.plans import flows

    segs = spark.createDataFrame([(1, "gt1r", 0, 1, 111, 10.0, 7, 0.5, 0.5), (1, "gt1l", 0, 1, 111, 10.0, 7, 0.5, 0.5), (1, "gt1r", 0, 1, 111, 90.0, 7, 0.5, 0.5)], "orb_orient int, gt string, msw_flg int, seg_snow int, seg_landcov int, h_can double, month int, x double, y double")
    layer = spark.createDataFrame([(0, 0, 3.5)], "row int, col int, slope double")
    assert [r.topo_slope for r in flows.training_table(segs, {"topo": layer}, (0.0, 1.0), 1.0).collect()] == [3.5]
    scenes = spark.createDataFrame([(1, 0, 0, "a", 200, 2020, 0.04, 0.06, 0.05, 0.30, 0.15, 0.08, 0), (1, 0, 0, "b", 210, 2020, 0.04, 0.06, 0.05, 0.60, 0.15, 0.08, 2), (1, 0, 0, "c", 220, 2021, 0.04, 0.06, 0.05, 0.40, 0.15, 0.08, 0)], "tile_num int, row int, col int, scene_id string, doy int, year int, blue double, green double, red double, nir double, swir double, swir2 double, qa int")
    best = flows.composited(scenes).first()
    assert (best.scene_id, best.doy, best.n_valid) == ("c", 220, 2)
    cube = spark.createDataFrame([(1, 0, 0, 2000 + k, 200, float(k)) for k in range(8)], "tile_num int, row int, col int, year int, doy int, value double")
    assert [(r.kendall, r.trend) for r in flows.trend_classes(cube).collect()] == [(1, 4)]
    train = spark.range(300).select((F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 10 * 3.0).alias("agb"))
    px = spark.createDataFrame([(1, 0, 0, 2.0), (1, 0, 1, 8.0)], "tile_num int, row int, col int, x double")
    got = {r.col: r["mean"] for r in flows.tile_map(train, px, ["x"], "agb", trees=5, most=4).collect()}
    assert got[0] == pytest.approx(6, abs=2) and got[1] == pytest.approx(24, abs=2)
    carbon = spark.createDataFrame([(100.0, 0.0, 30.0, -3.0, 0.01, 10.0)], "biomass_mean double, age_mean double, age_alt double, canopy_trend double, pvalue double, deciduous double")
    c = flows.carbon_classes(carbon).first()
    assert (c.age_class, c.canopy_class, c.p_class, c.deciduous_class, c.carbon_sum, c.area_ha) == (2, 0, 1, 0, 50.0, 0.09)
