"""Totals and changes with their uncertainty: analytic, and by reproducible simulation."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.student import quantile, quantile_of

Z95 = 1.96


def analytic_total(df: DataFrame, by: Sequence[str], mean: str, sd: str, factor: float) -> DataFrame:
    """Sum of independent values: mean, sd, 95 % bounds, coefficient of variation, uncertainty (%)."""
    out = df.groupBy(*by).agg(F.sum(F.col(mean) * factor).alias("total"), F.sqrt(F.sum(F.col(sd) * factor * (F.col(sd) * factor))).alias("total_sd"))
    t, s = F.col("total"), F.col("total_sd")
    return out.withColumns({"low": t - Z95 * s, "high": t + Z95 * s, "cv": F.try_divide(s, t), "uncertainty": F.try_divide(100 * Z95 * s, t)})


def normal_cdf(z: Column) -> Column:
    """By a rational approximation of the error function, with an error below 2e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = (1 - poly * F.exp(-x * x)) / 2
    return F.when(z >= 0, 0.5 + half).otherwise(0.5 - half)


def analytic_change(mean1: Column, sd1: Column, mean2: Column, sd2: Column) -> dict[str, Column]:
    sd = F.sqrt(sd1 * sd1 + sd2 * sd2)
    change = mean2 - mean1
    z = F.try_divide(change, sd)
    return {"change": change, "change_sd": sd, "percent": F.try_divide(100 * change, mean1), "z": z, "p_increase": normal_cdf(z)}


def draws(df: DataFrame, n: int) -> DataFrame:
    """Each row n times, numbered by sim."""
    return df.withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(n))))


#: Fixed values of the random numbers: a prime, and the multipliers of the key, the draw and the stream.
PRIME, BY_KEY, BY_DRAW, BY_STREAM = 2_147_483_647, 48_271, 69_621, 16_807


def seed_of(key: Sequence[Column]) -> Column:
    """A number below PRIME from whole-number keys."""
    seed = F.lit(0).cast("long")
    for k in key:
        seed = (seed * 31 + F.pmod(k.cast("long"), F.lit(PRIME))) % PRIME
    return seed


def uniform(seed: Column, sim: Column, stream: int) -> Column:
    """A number between 0 and 1 from seed_of() a key, a draw's number and a stream.

    Squares and products modulo a prime: the same whatever the partitions and reruns, and in any engine
    with 64-bit integers.
    """
    draw = sim.cast("long")
    x = (seed * BY_KEY + draw * BY_DRAW + stream * BY_STREAM + 1) % PRIME
    x = (x * x + seed) % PRIME
    x = (x * BY_KEY + draw) % PRIME
    x = (x * x + stream) % PRIME
    return (x + 0.5) / float(PRIME)


def hashed_normal(key: Sequence[Column], sim: Column, stream: int = 0) -> Column:
    """A standard normal number for each key and draw (Box and Muller)."""
    return seeded_normal(seed_of(key), sim, stream)


def seeded_normal(seed: Column, sim: Column, stream: int = 0) -> Column:
    """hashed_normal() of a key whose seed_of() is known, so that it is worked out once for all draws."""
    return F.sqrt(-2 * F.log(uniform(seed, sim, 2 * stream + 1))) * F.cos(2 * math.pi * uniform(seed, sim, 2 * stream + 2))


def _uniforms(seed: np.ndarray, draw: int, stream: int) -> np.ndarray:
    """uniform() of an array of seeds."""
    x = (seed * BY_KEY + (draw * BY_DRAW + stream * BY_STREAM + 1)) % PRIME
    x = (x * x + seed) % PRIME
    x = (x * BY_KEY + draw) % PRIME
    x = (x * x + stream) % PRIME
    return (x + 0.5) / float(PRIME)


def normals(seed: np.ndarray, draw: int, stream: int = 0) -> np.ndarray:
    """seeded_normal() of an array of seeds."""
    return np.sqrt(-2 * np.log(_uniforms(seed, draw, 2 * stream + 1))) * np.cos(2 * math.pi * _uniforms(seed, draw, 2 * stream + 2))


#: Draws of a pixel that a row of simulated_totals() sums side by side; parts that a group's pixels are dealt to; tasks a core.
SIDE_BY_SIDE, SPREAD, WAVES = 8, 16, 4


def simulated_totals(df: DataFrame, by: Sequence[str], key: Sequence[str], mean: str, sd: str, factor: float, n: int = 1000, truncate: bool = True) -> DataFrame:
    """Totals of n draws by group: mean, population sd, percentile bounds, quartile range, cv, uncertainty (%).

    key: whole numbers that tell pixels apart. Pixels are dealt out by group, a group's to several tasks, and a
    task sums its draws, SIDE_BY_SIDE in a row, so few rows meet in the second shuffle however large a group is.
    """

    def value(k: int) -> Column:
        drawn = F.col(mean) + F.col(sd) * seeded_normal(F.col("_seed"), F.col("_block") * SIDE_BY_SIDE + (k + 1))
        return (F.greatest(drawn, F.lit(0.0)) if truncate else drawn) * factor

    tasks = WAVES * df.sparkSession.sparkContext.defaultParallelism
    pixels = df.select(*dict.fromkeys([*by, mean, sd]), seed_of([F.col(k) for k in key]).alias("_seed")).repartition(tasks, *by, F.pmod(F.xxhash64("_seed"), F.lit(SPREAD)))
    blocks = pixels.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((n - 1) // SIDE_BY_SIDE).cast("long"))))
    sums = blocks.groupBy(*by, "_block").agg(*[F.sum(value(k)).alias(f"_t{k}") for k in range(SIDE_BY_SIDE)])
    sums = sums.select(*by, "_block", F.posexplode(F.array(*[f"_t{k}" for k in range(SIDE_BY_SIDE)])).alias("_k", "t")).filter(F.col("_block") * SIDE_BY_SIDE + F.col("_k") < n)
    q = F.percentile("t", F.array(*[F.lit(x) for x in (0.025, 0.25, 0.5, 0.75, 0.975)]))  # of n totals
    out = sums.groupBy(*by).agg(F.avg("t").alias("mean"), F.stddev_pop("t").alias("sd"), q.alias("q"), F.count("*").alias("n_draws"))
    half = (F.col("q")[4] - F.col("q")[0]) / 2
    return out.select(*by, "mean", "sd", F.col("q")[2].alias("median"), F.col("q")[0].alias("low"), F.col("q")[4].alias("high"), (F.col("q")[3] - F.col("q")[1]).alias("iqr"), F.try_divide("sd", "mean").alias("cv"), F.try_divide(100 * half, F.col("mean")).alias("uncertainty"), "n_draws")


def class_totals(df: DataFrame, by: Sequence[str], key: Sequence[str], mean: str, sd: str, pixel_ha: float = 0.09, n: int = 50) -> DataFrame:
    """Carbon (half the biomass) in Pg of each class by n draws a pixel, with t-based bounds of the mean and of a new total."""
    value = 0.5 * (F.col(mean) + F.col(sd) * hashed_normal([F.col(k) for k in key], F.col("sim")))
    sums = draws(df.select(*dict.fromkeys([*by, *key, mean, sd])), n).groupBy(*by, "sim").agg(F.sum(value * pixel_ha * 1e-9).alias("t"))
    out = sums.groupBy(*by).agg(F.avg("t").alias("mean"), F.stddev_samp("t").alias("sd"))
    t, m, s = quantile(n - 1), F.col("mean"), F.col("sd")
    return out.withColumns({"ci_low": m - t * s / math.sqrt(n), "ci_high": m + t * s / math.sqrt(n), "pi_low": m - t * s, "pi_high": m + t * s})


def class_sums(totals: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Class totals summed over fewer classes, or over all: bounds become sums of bounds."""
    return totals.groupBy(*by).agg(*[F.sum(c).alias(c) for c in columns])


#: Pixels whose draws are worked on at a time.
AT_ONCE = 4096


def _moments(n: int):
    """An Arrow function of seed, mean and deviation: mean and population deviation of n draws; null where any of the three is."""

    @F.arrow_udf("sim_mean double, sim_sd double")
    def run(seed: pa.Array, mean: pa.Array, sd: pa.Array) -> pa.Array:
        missing = np.zeros(len(seed), bool)
        for x in (seed, mean, sd):
            missing |= x.is_null().to_numpy(zero_copy_only=False)
        seeds, means, sds = (x.fill_null(0).to_numpy(zero_copy_only=False) for x in (seed, mean, sd))
        average, deviation = np.empty(len(seed)), np.empty(len(seed))
        with np.errstate(invalid="ignore", over="ignore"):
            for a in range(0, len(seed), AT_ONCE):
                part = slice(a, a + AT_ONCE)
                drawn = [means[part] + sds[part] * normals(seeds[part], k) for k in range(1, n + 1)]
                average[part] = sum(drawn) / n
                deviation[part] = np.sqrt(sum((d - average[part]) ** 2 for d in drawn) / n)
        return pa.StructArray.from_arrays([pa.array(average, mask=missing), pa.array(deviation, mask=missing)], names=["sim_mean", "sim_sd"])

    return run


def two_band(df: DataFrame, key: Sequence[str], mean: str, sd: str, n: int = 50) -> DataFrame:
    """Each pixel's mean and deviation over n draws, with t-based bounds of the mean and of an observation. Draws stay within an array of pixels."""
    out = df.withColumn("_m", _moments(n)(seed_of([F.col(k) for k in key]), F.col(mean).cast("double"), F.col(sd).cast("double")))
    out = out.withColumns({c: F.col("_m")[c] for c in ("sim_mean", "sim_sd")}).drop("_m")
    t, sem = quantile(n - 1), F.col("sim_sd") / math.sqrt(n)
    wide = F.sqrt(F.col(sd) * F.col(sd) + sem * sem)
    return out.withColumns({"ci_low": F.col("sim_mean") - t * sem, "ci_high": F.col("sim_mean") + t * sem, "pi_low": F.col("sim_mean") - t * wide, "pi_high": F.col("sim_mean") + t * wide})


def two_band_total(df: DataFrame, key: Sequence[str], mean: str, sd: str, pixel_ha: float = 0.09, n: int = 50) -> DataFrame:
    """The table's total (Pg) over n draws, with t-based bounds; a new total's spread is the pixels' own and the mean's error."""
    factor = pixel_ha * 1e-9
    value = (F.col(mean) + F.col(sd) * hashed_normal([F.col(k) for k in key], F.col("sim"))) * factor
    spread = F.col(sd) * factor
    own = df.agg(F.sum(spread * spread).alias("_own"))
    sums = draws(df.select(*dict.fromkeys([*key, mean, sd])), n).groupBy("sim").agg(F.sum(value).alias("t"))
    out = sums.agg(F.avg("t").alias("mean"), F.stddev_samp("t").alias("sd")).crossJoin(F.broadcast(own))  # one row each
    t, m, sem = quantile(n - 1), F.col("mean"), F.col("sd") / math.sqrt(n)
    wide = F.sqrt(F.col("_own") + sem * sem)
    return out.withColumns({"ci_low": m - t * sem, "ci_high": m + t * sem, "pi_low": m - t * wide, "pi_high": m + t * wide}).drop("_own")


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def _squares(x: Column, mean: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean))


def carbon_accumulation(df: DataFrame, key: Sequence[str], n: int = 5, skip_young: bool = False) -> DataFrame:
    """Carbon (half the biomass) and its yearly accumulation of each pixel by n draws of biomass and age.

    Columns biomass_mean, biomass_std, age_mean, age_std; key: whole numbers. Draws with an age of 0 or less
    accumulate 0, or are left out. The draws live in arrays within a row, so pixels don't shuffle. Bounds use
    Student's t of the draws less one; prediction bounds the root of sd squared plus the mean's error squared.
    """
    sims = F.sequence(F.lit(1), F.lit(n))
    at = lambda stream, s: hashed_normal([F.col(k) for k in key], s, stream)
    carbon = F.transform(sims, lambda s: 0.5 * (F.col("biomass_mean") + F.col("biomass_std") * at(1, s)))
    age = F.transform(sims, lambda s: F.col("age_mean") + F.col("age_std") * at(2, s))
    rate = F.zip_with(carbon, age, lambda c, a: F.when(a > 0, c / a).otherwise(F.lit(None).cast("double") if skip_young else F.lit(0.0)))
    out = df.withColumns({"_c": carbon, "_r": F.filter(rate, lambda x: x.isNotNull())})
    for name, draw in (("carbon", "_c"), ("accumulation", "_r")):
        mean, sd, size = F.col(f"{name}_mean"), F.col(f"{name}_sd"), F.size(draw)
        out = out.withColumn(f"{name}_mean", F.try_divide(_total(F.col(draw)), size))
        out = out.withColumn(f"{name}_sd", F.sqrt(F.try_divide(_squares(F.col(draw), mean), size - 1)))
        t = F.lit(quantile(n - 1)) if not skip_young else quantile_of(size - 1)
        sem = sd / F.sqrt(size)
        wide = F.sqrt(sd * sd + sem * sem)
        out = out.withColumns({f"{name}_low": mean - t * sem, f"{name}_high": mean + t * sem, f"{name}_pi_low": mean - t * wide, f"{name}_pi_high": mean + t * wide})
    return out.drop("_c", "_r")


def place_of(sorted_: Column, q: float) -> Column:
    """The interpolated quantile of a sorted array."""
    at = F.lit(q) * (F.size(sorted_) - 1)
    low, high = F.get(sorted_, F.floor(at).cast("int")), F.get(sorted_, F.ceil(at).cast("int"))
    return low + (high - low) * (at - F.floor(at))


def simulated_change(df: DataFrame, key: Sequence[str], n: int = 10_000) -> DataFrame:
    """Change between two dates (mean1, sd1, mean2, sd2) by n draws a row, none below 0; no standard deviation counts as 0.

    The draws are sorted within their row: nothing is exploded or shuffled. key: whole numbers.
    """
    sims = F.sequence(F.lit(1), F.lit(n))
    one = lambda m, s, stream, k: F.greatest(F.col(m) + F.coalesce(s, F.lit(0.0)) * hashed_normal([F.col(c) for c in key], k, stream), F.lit(0.0))
    out = df.withColumn("_d", F.array_sort(F.transform(sims, lambda k: one("mean2", "sd2", 2, k) - one("mean1", "sd1", 1, k))))
    d = F.col("_d")
    out = out.withColumn("change", _total(d) / n).withColumn("change_sd", F.sqrt(_squares(d, F.col("change")) / (n - 1)))
    low, high = place_of(d, 0.025), place_of(d, 0.975)
    share = lambda f: F.size(F.filter(d, f)) / n
    out = out.withColumns({"median": place_of(d, 0.5), "low": low, "high": high, "p_increase": share(lambda x: x > 0), "p_decrease": share(lambda x: x < 0), "percent": F.try_divide(100 * F.col("change"), F.col("mean1"))})
    return out.select(*key, "change", "change_sd", "median", "low", "high", "percent", "p_increase", "p_decrease", ((F.col("low") > 0) | (F.col("high") < 0)).alias("significant"))


def zero_filled(df: DataFrame, dims: Sequence[tuple[str, Sequence]], values: Sequence[str]) -> DataFrame:
    """A row for each combination of the given classes, with zeros where df has none."""
    grid = None
    for name, members in dims:
        d = df.sparkSession.createDataFrame([(m,) for m in members], df.select(name).schema)
        grid = d if grid is None else grid.crossJoin(F.broadcast(d))  # short lists of classes
    return grid.join(df, [d for d, _ in dims], "left").na.fill(0, list(values))
