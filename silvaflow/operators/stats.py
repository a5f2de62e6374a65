"""Group statistics of tiles, zones and classes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Quantiles of a tile's statistics.
QUANTILES = {"q02": 0.02, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q98": 0.98}


def moments(x: str | Column, prefix: str = "", where: Column | None = None) -> list[Column]:
    """sum, min, mean, max, sd and count, perhaps only of rows that meet a condition."""
    v = F.col(x) if isinstance(x, str) else x
    v = v if where is None else F.when(where, v)
    return [f(v).alias(prefix + name) for name, f in (("sum", F.sum), ("min", F.min), ("mean", F.avg), ("max", F.max), ("sd", F.stddev_samp), ("count", F.count))]


def quantiles(df: DataFrame, by: Sequence[str], value: str | Column, wanted: Mapping[str, float]) -> DataFrame:
    """Exact interpolated quantiles by group, one row a group.

    Equal values are counted first, combined before the shuffle; the running counts then come from a sorted
    window, which spills, so that no group's values have to fit a task's memory.
    """
    v = F.col(value) if isinstance(value, str) else value
    counts = df.select(*by, v.alias("_v")).filter("_v IS NOT NULL").groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    ranked = counts.withColumn("_upto", upto)
    ranked = ranked.join(total, list(by)) if by else ranked.crossJoin(F.broadcast(total))  # one row without groups
    at = {name: F.lit(float(q)) * (F.col("_total") - 1) for name, q in wanted.items()}
    ends = [f(F.when(F.col("_upto") > g(x), F.col("_v"))).alias(f"_{p}_{n}") for n, x in at.items() for p, f, g in (("low", F.min, F.floor), ("high", F.min, F.ceil))]
    out = ranked.groupBy(*by).agg(F.max("_total").alias("_total"), *ends)
    return out.select(*by, *[(F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * (x - F.floor(x))).alias(n) for n, x in at.items()])


def tile_stats(df: DataFrame, tile: str, value: str) -> DataFrame:
    """Moments and quantiles by tile."""
    return df.groupBy(tile).agg(*moments(value)).join(quantiles(df, [tile], value, QUANTILES), tile, "left")


def extent_stats(df: DataFrame, tile: str, value: str, extents: Mapping[str, Column]) -> DataFrame:
    """Moments for several extents side by side in one scan; zero where nothing overlaps."""
    out = df.groupBy(tile).agg(*[c for name, where in extents.items() for c in moments(value, f"{name}_", where)])
    return out.na.fill(0)


def mode(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The most frequent value by group, the least on ties, from counts of values."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*by).agg(F.min(F.struct(-F.col("_n"), F.col(value).alias("v"))).alias("_m")).select(*by, F.col("_m.v").alias("mode"))


def zonal_stats(df: DataFrame, zone: str, value: str) -> DataFrame:
    """mean, std (population), min, max, count, sum, median, mode (least on ties) and NMAD by zone.

    Median, mode and NMAD come from counts of equal values; the median is joined back to them, so neither
    a window over a zone's rows nor a buffer of its values is needed.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(zone, value).agg(F.count("*").alias("_n"))
    first = df.groupBy(zone).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("count"), F.sum(value).alias("sum"))
    median = weighted_median(counts, [zone], value, "_n").withColumnRenamed("median", "_median")
    away = counts.join(median, zone).groupBy(zone, F.abs(F.col(value) - F.col("_median")).alias("_away")).agg(F.sum("_n").alias("_n"))
    nmad = weighted_median(away, [zone], "_away", "_n").select(zone, (1.4826 * F.col("median")).alias("nmad"))
    most = counts.groupBy(zone).agg(F.min(F.struct(-F.col("_n"), F.col(value).alias("v"))).alias("_m")).select(zone, F.col("_m.v").alias("mode"))
    return first.join(median.withColumnRenamed("_median", "median"), zone, "left").join(most, zone, "left").join(nmad, zone, "left")


def weighted_median(counts: DataFrame, by: Sequence[str], value: str, n: str) -> DataFrame:
    """The median by group of values that occur n times each."""
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("_upto", F.sum(n).over(w)).join(counts.groupBy(*by).agg(F.sum(n).alias("_total")), list(by))
    low, high = (F.min(F.when(F.col("_upto") > f((F.col("_total") - 1) / 2), F.col(value))) for f in (F.floor, F.ceil))
    return ranked.groupBy(*by).agg(((low + high) / 2).alias("median"))


def class_stats(df: DataFrame, by: Sequence[str], label: str, labels: Sequence, value: str) -> DataFrame:
    """Count, mean, deviation and sum of each class of each group; classes without rows have a count and sum of 0."""
    groups = df.select(*by).distinct()
    grid = groups.withColumn(label, F.explode(F.array(*[F.lit(x) for x in labels])))
    found = df.groupBy(*by, label).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.sum(value).alias("sum"))
    return grid.join(found, [*by, label], "left").na.fill(0, ["count", "sum"])


def class_shares(df: DataFrame, by: Sequence[str], label: str, labels: Sequence) -> DataFrame:
    """Counts of each given class of each group side by side, and their share of the group's classed rows, in one pass."""
    n = F.count(F.when(F.col(label).isin(*labels), 1))
    counts = [F.count(F.when(F.col(label) == x, 1)).alias(f"class_{x}_count") for x in labels]
    shares = [F.try_divide(F.count(F.when(F.col(label) == x, 1)), n).alias(f"class_{x}_share") for x in labels]
    return df.groupBy(*by).agg(n.alias("classed"), *counts, *shares)


def decile_edges(df: DataFrame, x: str, bins: int = 10) -> list[float]:
    """The edges of equally filled bins: a handful of numbers for binned()."""
    row = quantiles(df, [], x, {f"e{k}": k / bins for k in range(bins + 1)}).first()
    return [] if row is None else list(row)


def change_summary(df: DataFrame, by: Sequence[str], change: str, sd: str) -> DataFrame:
    """Over landscapes: how many there are, have data or none, moments and median of the change, risers and fallers, mean and median uncertainty."""
    v, ok = F.col(change), F.count(change)
    up, down = F.count(F.when(v > 0, 1)), F.count(F.when(v < 0, 1))
    out = df.groupBy(*by).agg(
        F.count("*").alias("n_total"), ok.alias("n_with_data"), (F.count("*") - ok).alias("n_without"), F.avg(v).alias("mean_change"), F.stddev_samp(v).alias("sd_change"), F.sum(v).alias("total_change"),
        up.alias("n_increase"), down.alias("n_decrease"), F.try_divide(100.0 * up, ok).alias("percent_increasing"), F.try_divide(100.0 * down, ok).alias("percent_decreasing"), F.avg(sd).alias("mean_uncertainty"),
    )
    medians = quantiles(df, by, change, {"median_change": 0.5}).join(quantiles(df, by, sd, {"median_uncertainty": 0.5}), list(by), "full_outer")
    return out.join(medians, list(by), "left")


def significant_shares(df: DataFrame, p: str, levels: Mapping[str, float]) -> DataFrame:
    """The share of rows with a p below each level, of those that have one."""
    return df.agg(*[F.avg((F.col(p) < x).cast("double")).alias(n) for n, x in levels.items()])


def over_iterations(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, deviation, 5th and 95th percentile over a group's iterations, which are few."""
    q = F.percentile(value, F.array(F.lit(0.05), F.lit(0.95)))
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), q.alias("_q")).select(*by, "mean", "sd", F.col("_q")[0].alias("p5"), F.col("_q")[1].alias("p95"))


def shares(df: DataFrame, by: str) -> DataFrame:
    """Counts by class and percent of all; the total is one row."""
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("_total"))
    return n.crossJoin(F.broadcast(total)).select(by, "n", (100.0 * F.col("n") / F.col("_total")).alias("percent"))


def binned(df: DataFrame, x: str, value: str, edges: Sequence[float]) -> DataFrame:
    """Statistics of value in bins (low, high] of x; rows outside of all bins go."""
    place = F.lit(None).cast("int")
    for k in reversed(range(len(edges) - 1)):
        place = F.when((F.col(x) > edges[k]) & (F.col(x) <= edges[k + 1]), k).otherwise(place)
    return df.withColumn("bin", place).filter(F.col("bin").isNotNull()).groupBy("bin").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"))


def skill(observed: Column, predicted: Column) -> list[Column]:
    """RMSE, bias, both relative to the mean observation (percent), correlation and r squared."""
    e = predicted - observed
    rmse, bias, mean = F.sqrt(F.avg(e * e)), F.avg(e), F.avg(observed)
    return [rmse.alias("rmse"), (100 * rmse / mean).alias("rel_rmse"), bias.alias("bias"), (100 * bias / mean).alias("rel_bias"), F.corr(observed, predicted).alias("r"), F.regr_r2(observed, predicted).alias("r2")]


def cube_totals(df: DataFrame, keys: Sequence[str], density: str, pixel_ha: float = 0.09) -> DataFrame:
    """Stock (Pg), mean density and pixels overall, by each key and by both, in one pass."""
    return df.cube(*keys).agg(F.grouping_id().cast("int").alias("level"), (F.sum(density) * pixel_ha * 1e-9).alias("stock_pg"), F.avg(density).alias("mean_density"), F.count(density).alias("pixels"))


def share_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
