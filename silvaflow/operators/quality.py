"""Segment quality: filters, thresholds by class, the audit of survivors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import HEIGHT_CEILING


def steps(*, msw: Column, beam: Column, snow: Column) -> list[tuple[str, Column]]:
    """The fixed cascade of flags."""
    return [("msw", msw == 0), ("beam", beam == "Strong"), ("snow", snow == 1)]


def passing(df: DataFrame, conditions: Sequence[tuple[str, Column]]) -> DataFrame:
    for _, c in conditions:
        df = df.filter(c)
    return df


def audit(df: DataFrame, conditions: Sequence[tuple[str, Column]], by: Sequence[str] = ()) -> DataFrame:
    """Rows, and survivors after each step, in one aggregation."""
    so_far, counts = F.lit(True), [F.count("*").alias("n_all")]
    for name, c in conditions:
        so_far = so_far & F.coalesce(c, F.lit(False))
        counts.append(F.count(F.when(so_far, 1)).alias(f"n_{name}"))
    return df.groupBy(*by).agg(*counts)


def ceilings(spark, values: Mapping[int, float] = HEIGHT_CEILING) -> DataFrame:
    return spark.createDataFrame([(int(k), float(v)) for k, v in values.items()], "land_cover int, ceiling double")


def below_class_ceiling(df: DataFrame, land_cover: str, height: str, values: Mapping[int, float] = HEIGHT_CEILING) -> DataFrame:
    """Rows whose height is below their class's ceiling; unknown classes and null heights go.

    The table of ceilings is a handful of classes, so it is broadcast.
    """
    table = F.broadcast(ceilings(df.sparkSession, values).withColumnRenamed("land_cover", "_lc"))
    return df.join(table, F.col(land_cover) == F.col("_lc")).filter(F.col(height) < F.col("ceiling")).drop("_lc", "ceiling")


def below(df: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    """Rows below every limit; null counts as not below."""
    for c, limit in limits.items():
        df = df.filter(F.col(c) < limit)
    return df


def or_first(df: DataFrame, kept: Column, order: Sequence[str], fallback: Column) -> DataFrame:
    """The kept rows, or if there are none the first row that meets fallback.

    Kept rows are not moved: one aggregated row says whether any exists, and only the candidate
    for the fallback is sorted for (a top-1).
    """
    chosen = df.filter(kept)
    none = chosen.limit(1).groupBy().agg((F.count("*") == 0).alias("_none"))
    first = df.filter(fallback).orderBy(*order).limit(1)
    return chosen.unionByName(first.join(F.broadcast(none), F.col("_none"), "inner").drop("_none"))


def in_box(x: Column, y: Column, box: Sequence[float], inclusive: bool = False) -> Column:
    """box: least x, most x, least y, most y."""
    x0, x1, y0, y1 = box
    return x.between(x0, x1) & y.between(y0, y1) if inclusive else (x > x0) & (x < x1) & (y > y0) & (y < y1)


def within_deviations(df: DataFrame, value: str, by: Sequence[str], n: float = 3.0) -> DataFrame:
    """Rows at most n sample deviations above their group's mean.

    Group moments are aggregated and joined back, so that no group has to fit one task; a group of
    one row has no deviation and its row goes, as the comparison is null.
    """
    limits = df.groupBy(*by).agg((F.avg(value) + n * F.stddev_samp(value)).alias("_limit"))
    return df.join(limits, list(by)).filter(F.col(value) <= F.col("_limit")).drop("_limit")


def training_window(df: DataFrame, doy: str, elevation: str, windows: Sequence[tuple[int, int, float]], least: int) -> DataFrame:
    """The rows of the first window (first day, last day, highest sun) with enough of them, or of the last.

    One aggregation counts all windows.
    """
    inside = [F.col(doy).between(a, b) & (F.col(elevation) <= sun) for a, b, sun in windows]
    counts = df.agg(*[F.count(F.when(c, 1)).alias(f"_n{k}") for k, c in enumerate(inside)])
    which = F.lit(len(windows) - 1)
    for k in reversed(range(len(windows))):
        which = F.when(F.col(f"_n{k}") >= least, k).otherwise(which)
    chosen = counts.select(which.alias("window"))
    keep = F.lit(False)
    for k, c in enumerate(inside):
        keep = keep | ((F.col("window") == k) & c)
    return df.crossJoin(F.broadcast(chosen)).filter(keep)  # one row on the right


def high_grade(df: DataFrame, day: str, reference: str, n: int, before: bool) -> DataFrame:
    """Observations in the n days before a reference day, or within n days of it."""
    gap = F.col(day) - F.col(reference)
    return df.filter(gap.between(-abs(n), 0) if before else F.abs(gap) <= abs(n))


def latitude_band(df: DataFrame, lat: str, tile_lat: DataFrame, half: float = 5.0) -> DataFrame:
    """Rows within half degrees of the tile's least latitude (tile_lat: one row, column min_lat)."""
    return df.crossJoin(F.broadcast(tile_lat.limit(1))).filter(F.abs(F.col(lat) - F.col("min_lat")) <= half).drop("min_lat")


def keep_moss(df: DataFrame, pixel: Sequence[str], value: str, latitude: str, slope: str, most: float, north: float, steep: float) -> DataFrame:
    """Drops pixels that look like moss or lichen: far north, flat and with a low mean.

    Means are aggregated and joined back, so that no pixel's rows have to meet in a window.
    """
    means = df.groupBy(*pixel).agg(F.avg(value).alias("_mean"))
    return df.join(means, list(pixel)).filter(~((F.col(latitude) > north) & (F.col(slope) < steep) & (F.col("_mean") < most))).drop("_mean")


def keep_steady(df: DataFrame, pixel: Sequence[str], time: str, value: str, threshold: float) -> DataFrame:
    """Each pixel with whether it is kept: low stocks that vary much, or decline, are suspect.

    Suspect are means below the threshold with a coefficient of variation above 0.5 or a yearly slope below -2,
    and means below half of it with a slope below -1. A pixel with a gap has no slope.
    """
    s = df.groupBy(*pixel).agg(F.avg(value).alias("mean"), F.try_divide(F.stddev_pop(value), F.avg(value)).alias("cv"), F.when(F.count(value) == F.count("*"), F.regr_slope(value, time)).alias("slope"))
    low, very_low, fall = F.col("mean") < threshold, F.col("mean") < threshold / 2, F.coalesce("slope", F.lit(0.0))
    suspect = (low & (F.coalesce("cv", F.lit(0.0)) > 0.5)) | (low & (fall < -2)) | (very_low & (fall < -1))
    return s.withColumn("keep", ~F.coalesce(suspect, F.lit(False)))


def cascade(flags: Sequence[tuple[str, Column]], height: Column, limits: Mapping[str, tuple[Column, float]], months: tuple[int, int], month: Column, land_cover: Column | None = None, ceiling: Mapping[int, float] | float = HEIGHT_CEILING) -> list[tuple[str, Column]]:
    """Named steps: flags, the height's ceiling (of the land cover, or one for all), limits, months; for passing() and audit()."""
    if isinstance(ceiling, Mapping):
        pairs = [F.lit(x) for k, v in ceiling.items() for x in (int(k), float(v))]
        below_ceiling = height < F.try_element_at(F.create_map(*pairs), land_cover)
    else:
        below_ceiling = height < ceiling
    rest = F.lit(True)
    for c, most in limits.values():
        rest = rest & (c < most)
    return [*flags, ("height", below_ceiling), ("limits", rest), ("season", month.between(*months))]


def quality_v1(df: DataFrame, height: float, difference: float, months: tuple[int, int]) -> DataFrame:
    """Flags, a ceiling for all heights, the difference from the reference surface, months (columns of the segment table)."""
    return passing(df, cascade(_segment_flags(), F.col("h_can"), {"h_dif": (F.col("h_dif_ref"), difference)}, months, F.col("m"), ceiling=height))


def quality_v2(df: DataFrame, height: float, difference: float, topography: float, months: tuple[int, int]) -> DataFrame:
    """The same with a limit on the topography's deviation."""
    return quality_v1(df, height, difference, months).filter(F.col("sig_topo") < topography)


def quality_v3(df: DataFrame, order: Sequence[str], difference: float, topography: float, months: tuple[int, int], ceiling: Mapping[int, float] | float = HEIGHT_CEILING, cover: float = 32767, sun: float = 5, uncertainty: float = 5) -> DataFrame:
    """Flags, the land cover's ceiling, five limits and months; if nothing passes, the first row of a strong beam in order."""
    limits = {"h_can_unc": uncertainty, "seg_cover": cover, "sol_el": sun, "sig_topo": topography, "h_dif_ref": difference}
    steps_ = cascade(_segment_flags(), F.col("h_can"), {c: (F.col(c), x) for c, x in limits.items()}, months, F.col("m"), F.col("seg_landcov"), ceiling)
    kept = all_hold(steps_)
    return or_first(df, kept, order, F.col("beam_type") == "Strong")


def quality_v5(df: DataFrame, months: tuple[int, int], ceiling: Mapping[int, float] | float = HEIGHT_CEILING, sun: float = 5, topography: float = 2.5, difference: float = 25) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, the audit row) for the service's columns: strong spots, flags, ceilings, three limits, months."""
    flags = [("msw_flag", F.col("msw_flag") == 0), ("beam", (F.col("spot") % 2 == 1) & F.col("spot").between(1, 6)), ("snowcover", F.col("snowcover") == 1)]
    limits = {"solar_elevation": sun, "sigma_topo": topography, "h_dif_ref": difference}
    steps_ = cascade(flags, F.col("h_canopy"), {c: (F.col(c), x) for c, x in limits.items()}, months, F.col("m"), F.col("segment_landcover"), ceiling)
    return passing(df, steps_), audit(df, steps_)


def _segment_flags() -> list[tuple[str, Column]]:
    return steps(msw=F.col("msw_flg"), beam=F.col("beam_type"), snow=F.col("seg_snow"))


def all_hold(conditions: Sequence[tuple[str, Column]]) -> Column:
    out = F.lit(True)
    for _, c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def old_rule(df: DataFrame, most: float = 30.0, photons: int = 1) -> DataFrame:
    """The older rule: heights to a limit, enough photons, no moving weather, and neither the uncertainty nor the slope at its fill value, the table's greatest."""
    tops = df.agg(F.max("h_te_unc").alias("_unc"), F.max("ter_slp").alias("_slp"))
    kept = (F.col("h_can") <= most) & (F.col("n_toc_ph") >= photons) & (F.col("h_te_unc") != F.col("_unc")) & (F.col("ter_slp") != F.col("_slp")) & (F.col("msw_flg") == 0)
    return df.crossJoin(F.broadcast(tops)).filter(kept).drop("_unc", "_slp")  # one row on the right


def steady_heights(df: DataFrame, top: str, mean: str, most: float) -> DataFrame:
    """Rows whose greatest and mean heights differ by at most so much."""
    return df.filter(F.abs(F.col(top) - F.col(mean)) <= most)


def excluding(df: DataFrame, name: str, patterns: Sequence[str]) -> DataFrame:
    """Rows whose name holds none of the patterns, in which * stands for anything."""
    for p in patterns:
        df = df.filter(~F.col(name).contains(p) if "*" not in p else ~F.col(name).like("%" + p.replace("*", "%") + "%"))
    return df


def members(df: DataFrame, column: str, values: Sequence | DataFrame, inside: bool = True) -> DataFrame:
    """Rows whose value is (or isn't) among the given ones: a short list, or a table's column of the same name."""
    if isinstance(values, DataFrame):
        return df.join(values.select(column).distinct(), column, "left_semi" if inside else "left_anti")
    found = F.col(column).isin(*values)
    return df.filter(found if inside else ~found)


def complete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without a gap, not-a-number being one."""
    names = list(columns or df.columns)
    kinds = dict(df.dtypes)
    for c in names:
        df = df.filter(F.col(c).isNotNull() & (~F.isnan(c) if kinds[c] in ("double", "float") else F.lit(True)))
    return df


def masked(df: DataFrame, values: Sequence[str], mask: str, drop: Sequence) -> DataFrame:
    """Null values where the mask layer has one of the given values."""
    return df.withColumns({c: F.when(~F.coalesce(F.col(mask).isin(*drop), F.lit(False)), F.col(c)) for c in values})


def zeroed(df: DataFrame, value: str, *masks: str) -> DataFrame:
    """0 instead of the value where any mask is 0."""
    off = F.lit(False)
    for m in masks:
        off = off | (F.col(m) == 0)
    return df.withColumn(value, F.when(off, F.lit(0.0)).otherwise(F.col(value)))


def valid_everywhere(layers: Sequence[DataFrame], pixel: Sequence[str], value: str) -> DataFrame:
    """Pixels with a value in every layer: one union and a count, not a join for each."""
    out = None
    for k, layer in enumerate(layers):
        part = layer.filter(F.col(value).isNotNull()).select(*pixel, F.lit(k).alias("_k"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*pixel).agg(F.count_distinct("_k").alias("_n")).filter(F.col("_n") == len(layers)).drop("_n")


def common(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls all of the columns where any of them is null."""
    some = F.lit(False)
    for c in columns:
        some = some | F.col(c).isNull()
    return df.withColumns({c: F.when(~some, F.col(c)) for c in columns})
