"""Whole workflows, composed of the operators: training tables, tile maps, zonal change, trends, carbon."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classes as C
from ..functions import spectral as P
from ..functions.scalars import beam_strength, decimal_year
from ..operators import joins, model, quality, raster, stats, trend, uncertainty, windows
from .registry import query
from .roles import SEG, rounded, segments, table


def training_table(segs: DataFrame, layers: Mapping[str, DataFrame], origin: tuple[float, float], size: float, months: Sequence[int] = (6, 9)) -> DataFrame:
    """Segments (orb_orient, gt, msw_flg, seg_snow, seg_landcov, h_can, month, x, y) that pass, with the values of each pixel layer under them."""
    kept = quality.passing(segs.withColumn("beam", beam_strength(F.col("orb_orient"), F.col("gt"))), quality.steps(msw=F.col("msw_flg"), beam=F.col("beam"), snow=F.col("seg_snow")))
    kept = quality.below_class_ceiling(kept, "seg_landcov", "h_can").filter(F.col("month").between(*months))
    for name, layer in layers.items():
        bands = [c for c in layer.columns if c not in ("row", "col")]
        kept = joins.sample_pixels(kept, layer.select("row", "col", *[F.col(b).alias(f"{name}_{b}") for b in bands]), "x", "y", origin, size).drop("row", "col")
    return kept


def tile_map(train: DataFrame, pixels: DataFrame, features: Sequence[str], label: str, iterations: int = 3, trees: int = 50, tolerance: float = 0.05, most: int = 100) -> DataFrame:
    """Mean, deviation and percentiles of each pixel's prediction over forests, more of them until totals settle.

    Each forest learns from its own sample of the training table, which is kept; the loop on the driver sees one
    total an iteration, and at least ten of them are needed before they can have settled.
    """
    models, totals, train = [], [], train.persist()
    while len(models) < most:
        k = len(models)
        sample = windows.hash_fraction(train, [label, *features], 0.7, seed=k)
        models.append(model.forest(sample, features, label, trees=trees, seed=k + 1, depth=6))
        totals.append(model.applied(models[-1:], pixels, features).agg(F.sum("value")).first()[0] or 0.0)
        sds = [0.0 if i < 2 else float(spread(totals[: i + 1])) for i in range(len(totals))]
        if len(models) >= iterations and windows.converged(sds, tolerance):
            break
    train.unpersist()
    key = [c for c in ("tile_num", "row", "col") if c in pixels.columns]
    return stats.over_iterations(model.applied(models, pixels, features), key, "value")


def spread(x: Sequence[float]) -> float:
    m = sum(x) / len(x)
    return (sum((v - m) ** 2 for v in x) / (len(x) - 1)) ** 0.5


def composited(scenes: DataFrame, stat: str = "max", percentile: float | None = None) -> DataFrame:
    """A composite of scene pixels: masked by quality bits and the range of red, ranked by NDVI, with all indices."""
    bands = {b: F.col(b) for b in P.BANDS}
    rank = P.target(P.indices(bands)["ndvi"], P.qa_masked(F.col("qa")), F.col("red"), 0.0, 0.5)
    ranked = scenes.withColumn("rank", rank)
    carried = [*P.BANDS, "doy", "year"]
    pixel = ["tile_num", "row", "col"]
    out = raster.percentile_composite(ranked, pixel, "rank", carried, "scene_id", percentile) if percentile is not None else raster.composite(ranked, pixel, "rank", carried, "scene_id", stat)
    return out.withColumns({**P.indices(bands), **P.tasselled_cap(bands)})


def trend_classes(cube: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Slope, tau, p and classes of a cube (tile_num, row, col, year, doy, value)."""
    pixel = ["tile_num", "row", "col"]
    at = cube.withColumn("t", decimal_year(F.col("year"), F.col("doy")))
    both = trend.ols(at, pixel, "t", "value").join(trend.with_kendall_p(at, pixel, "t", "value").drop("n_obs"), pixel)
    return both.withColumn("kendall", C.kendall_class(F.col("tau"), F.col("p"), alpha)).withColumn("trend", C.simple_trend(F.col("kendall")))


def zonal_change(pixels: DataFrame, zone: str, first: str, second: str) -> DataFrame:
    """Stock of two dates by zone, age cohort and trend with its change (mean and sd columns `<name>_mean`, `<name>_sd`)."""
    keys = [zone, "cohort", "trend"]
    out = None
    for name in (first, second):
        part = uncertainty.analytic_total(pixels, keys, f"{name}_mean", f"{name}_sd", 0.09 * 1e-9).select(*keys, F.col("total").alias(f"{name}_total"), F.col("total_sd").alias(f"{name}_total_sd"))
        out = part if out is None else out.join(part, keys)
    change = uncertainty.analytic_change(F.col(f"{first}_total"), F.col(f"{first}_total_sd"), F.col(f"{second}_total"), F.col(f"{second}_total_sd"))
    return out.withColumns(change)


def carbon_classes(pixels: DataFrame) -> DataFrame:
    """Class columns of carbon pixels, and their area, mean and total."""
    age = C.filled_age(F.col("age_mean"), F.col("age_alt"))
    classed = pixels.withColumns({"age_class": C.age_class(age), "canopy_class": C.canopy_trend(F.col("canopy_trend")), "p_class": C.significance(F.col("pvalue")), "deciduous_class": C.deciduous(F.col("deciduous"))})
    return classed.groupBy("age_class", "canopy_class", "p_class", "deciduous_class").agg(*stats.moments(0.5 * F.col("biomass_mean"), "carbon_"), (F.count("*") * 0.09).alias("area_ha"))


CUBE = "cube AS (SELECT CAST(l_suppkey AS BIGINT) AS tile_num, CAST(l_partkey % 5 AS INTEGER) AS row, CAST(l_partkey % 3 AS INTEGER) AS col, CAST(year(l_shipdate) AS INTEGER) AS year, round(avg(l_quantity), 6) * CAST(0.7310585 AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2, 3, 4)"


def cube(spark, sf_dir):
    c = F.col
    by = [c("l_suppkey").alias("tile_num"), (c("l_partkey") % 5).cast("int").alias("row"), (c("l_partkey") % 3).cast("int").alias("col"), F.year("l_shipdate").alias("year")]
    return table(spark, sf_dir, "lineitem").groupBy(*by).agg((F.round(F.avg("l_quantity"), 6) * 0.7310585).alias("value")).withColumn("doy", F.lit(200))


@query(f"""WITH {CUBE}, s AS (SELECT tile_num, row, col, count(*) AS n, regr_slope(v, year + 200 / 365.25) AS slope FROM cube GROUP BY 1, 2, 3) SELECT tile_num, row, col, CASE WHEN n >= 3 THEN n ELSE 0 END AS n_obs, round(CASE WHEN n >= 3 THEN slope END, 4) AS slope FROM s""")
def trend_cube(spark, sf_dir):
    at = cube(spark, sf_dir).withColumn("t", decimal_year(F.col("year"), F.col("doy")))
    return rounded(trend.ols(at, ["tile_num", "row", "col"], "t", "value").select("tile_num", "row", "col", "n_obs", "slope"), 4)


@query(f"""WITH {SEG}, k AS (SELECT tile_num % 10 AS zone, CAST(CASE WHEN age = 0 THEN 0 WHEN age BETWEEN 1 AND 20 THEN 1 WHEN age BETWEEN 21 AND 80 THEN 2 WHEN age BETWEEN 81 AND 200 THEN 3 ELSE -1 END AS INTEGER) AS cohort, CAST(CASE kendall WHEN 0 THEN -1 WHEN 1 THEN 4 WHEN 2 THEN 4 WHEN 3 THEN 3 WHEN 4 THEN 3 WHEN 5 THEN 2 WHEN 6 THEN 2 WHEN 7 THEN 1 WHEN 8 THEN 1 ELSE 0 END AS INTEGER) AS trend, agb AS am, agb_sd AS asd, agb * 1.1 AS bm, agb_sd * 2 AS bsd FROM seg),
t AS (SELECT zone, cohort, trend, sum(am) AS a, sqrt(sum(asd * asd)) AS sa, sum(bm) AS b, sqrt(sum(bsd * bsd)) AS sb FROM k GROUP BY 1, 2, 3) SELECT zone, cohort, trend, round(100 * (b - a) / a, 6) AS percent, round((b - a) / sqrt(sa * sa + sb * sb), 6) AS z FROM t""")
def zonal_change_flow(spark, sf_dir):
    df = segments(spark, sf_dir).select((F.col("tile_num") % 10).alias("zone"), C.age_cohort(F.col("age")).alias("cohort"), C.simple_trend(F.col("kendall")).alias("trend"), F.col("agb").alias("a_mean"), F.col("agb_sd").alias("a_sd"), (F.col("agb") * 1.1).alias("b_mean"), (F.col("agb_sd") * 2).alias("b_sd"))
    return rounded(zonal_change(df, "zone", "a", "b").select("zone", "cohort", "trend", "percent", "z"))
