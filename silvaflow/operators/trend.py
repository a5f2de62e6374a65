"""Trends of a series per pixel: least squares, Theil-Sen, Kendall, breakpoints."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import decimal_year
from ..functions.student import normal_quantile, quantile_of

LEAST = 3


def ols(df: DataFrame, by: Sequence[str], t: str, v: str, least: int = LEAST) -> DataFrame:
    """Slope, intercept, r squared and the slope's standard error; null and n_obs 0 below `least` values."""
    ok = df.filter(F.col(t).isNotNull() & F.col(v).isNotNull())
    sums = ok.groupBy(*by).agg(
        F.count("*").alias("n"), F.regr_slope(v, t).alias("slope"), F.regr_intercept(v, t).alias("intercept"), F.regr_r2(v, t).alias("r2"),
        F.regr_sxx(v, t).alias("sxx"), F.regr_syy(v, t).alias("syy"), F.regr_sxy(v, t).alias("sxy"),
    )
    enough = (F.col("n") >= least) & (F.col("sxx") > 0)
    rest = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0))
    error = F.sqrt(rest / (F.col("n") - 2) / F.col("sxx"))
    out = df.select(*by).distinct().join(sums, list(by), "left")
    return out.select(*by, F.when(enough, F.col("n")).otherwise(F.lit(0)).cast("long").alias("n_obs"), *[F.when(enough, c).alias(n) for n, c in (("slope", F.col("slope")), ("intercept", F.col("intercept")), ("r2", F.col("r2")), ("se", error))])


def with_bounds(df: DataFrame, by: Sequence[str], t: str, v: str, least: int = LEAST) -> DataFrame:
    """ols() with the slope's 95 % bounds."""
    out = ols(df, by, t, v, least)
    return out.withColumns({f"slope_{n}": c for n, c in confidence(F.col("slope"), F.col("se"), F.col("n_obs")).items()})


def date_column(columns: Sequence[str], wanted: str, place: int, tags: Mapping[str, str] | None = None) -> str:
    """The column that holds a date part: by its exact name, a name or a tag that contains it in any case, or its usual place (from 0)."""
    low = wanted.lower()
    ways = ([c for c in columns if c == wanted], [c for c in columns if low in c.lower()], [c for c in columns if low in (tags or {}).get(c, "").lower()])
    return next((found[0] for found in ways if found), columns[place])


def dated(df: DataFrame, columns: Sequence[str], year: str = "yearDate", day: str = "JulianDate", tags: Mapping[str, str] | None = None, name: str = "t") -> DataFrame:
    """The decimal year from the columns that hold the year and the day of the year, wherever they are."""
    return df.withColumn(name, decimal_year(F.col(date_column(columns, year, 1, tags)), F.col(date_column(columns, day, 0, tags))))


def series(df: DataFrame, by: Sequence[str], t: str, v: str, gaps: bool = False) -> DataFrame:
    """One row per pixel with its observations in order of time; with gaps also those without a value."""
    ok = F.col(t).isNotNull() if gaps else F.col(t).isNotNull() & F.col(v).isNotNull()
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(ok, F.struct(F.col(t).cast("double").alias("t"), F.col(v).cast("double").alias("v"))))).alias("s"))


#: Cells of pairs that the kernel looks at, and slopes that it holds, at a time.
CELLS, HELD = 4_000_000, 8_000_000


def blocks(n: int):
    """Ranges of rows of an n x n table of pairs, about CELLS pairs each."""
    step = max(1, CELLS // max(1, n))
    return ((a, min(n, a + step)) for a in range(0, n, step))


def pair_slopes(t: np.ndarray, v: np.ndarray, low: float = -np.inf, high: float = np.inf):
    """Slopes of pairs at different times that lie in (low, high], block by block."""
    for a, b in blocks(len(t)):
        dt, dv = t[None, :] - t[a:b, None], v[None, :] - v[a:b, None]
        later = (np.arange(len(t))[None, :] > np.arange(a, b)[:, None]) & (dt != 0)
        x = dv[later] / dt[later]
        yield x[(x > low) & (x <= high)]


def order_statistics(t: np.ndarray, v: np.ndarray, places: Sequence[int], total: int) -> list[float]:
    """Slopes at the given places of their order; many are narrowed down by counting before any are sorted."""
    out = []
    if total <= HELD:
        found = np.sort(np.concatenate(list(pair_slopes(t, v))))
        return [float(found[k]) for k in places]
    least, most = min(x.min() for x in pair_slopes(t, v) if len(x)), max(x.max() for x in pair_slopes(t, v) if len(x))
    for k in places:
        low, high, before, inside = -np.inf, float(most), 0, total
        while inside > HELD:
            at = (max(low, float(least)) + high) / 2
            if not max(low, float(least)) < at < high:
                break
            n = sum(len(x) for x in pair_slopes(t, v, low, at))
            if before + n > k:
                high, inside = at, n
            else:
                low, before, inside = at, before + n, inside - n
        out.append(high if inside > HELD else float(np.sort(np.concatenate(list(pair_slopes(t, v, low, high))))[k - before]))
    return out


def tie_sums(x: np.ndarray) -> tuple[float, float, float]:
    """Over groups of equal values of size k: sums of k (k - 1), k (k - 1) (k - 2) and k (k - 1) (2 k + 5)."""
    k = np.unique(x, return_counts=True)[1].astype(float)
    return float((k * (k - 1)).sum()), float((k * (k - 1) * (k - 2)).sum()), float((k * (k - 1) * (2 * k + 5)).sum())


def concordance(t: np.ndarray, v: np.ndarray) -> int:
    """Concordant less discordant pairs."""
    out = 0
    for a, b in blocks(len(t)):
        later = np.arange(len(t))[None, :] > np.arange(a, b)[:, None]
        out += int((np.sign(t[None, :] - t[a:b, None]) * np.sign(v[None, :] - v[a:b, None]) * later).sum())
    return out


def rank_trend(t: np.ndarray, v: np.ndarray, least: int = LEAST) -> tuple:
    """(n, slope, intercept, low, high, tau, p, r2 of the line): Theil-Sen with Sen's bounds, and Kendall's tau-b.

    The intercept is median(v) - slope * median(t); bounds are slopes at places by the normal approximation of
    the concordance's spread.
    """
    n = len(t)
    if n < least:
        return (0, None, None, None, None, None, None, None)
    pairs = n * (n - 1) // 2
    (same_t, _, odd_t), (same_v, _, odd_v) = tie_sums(t), tie_sums(v)
    total = pairs - int(same_t // 2)
    slope = intercept = low = high = r2 = None
    if total:
        spread = math.sqrt(max(0.0, (n * (n - 1) * (2 * n + 5) - odd_t - odd_v) / 18))
        z = -normal_quantile(0.95)
        first, last = max(round((total + z * spread) / 2) - 1, 0), min(round((total - z * spread) / 2), total - 1)
        low, high, a, b = order_statistics(t, v, (first, last, (total - 1) // 2, total // 2), total)
        slope = (a + b) / 2
        intercept = float(np.median(v) - slope * np.median(t))
        fit = slope * t + intercept
        if np.ptp(fit) > 0 and np.ptp(v) > 0:
            r2 = float(np.corrcoef(fit, v)[0, 1] ** 2)
    con = concordance(t, v)
    free = (pairs - same_t / 2) * (pairs - same_v / 2)
    tau = con / math.sqrt(free) if free > 0 else None
    return (n, slope, intercept, low, high, tau, kendall_p(t, v, con), r2)


RANKED = "n_obs long, slope double, intercept double, slope_low double, slope_high double, tau double, p double, r2 double"


def ranked(df: DataFrame, by: Sequence[str], t: str, v: str, least: int = LEAST) -> DataFrame:
    """rank_trend() of each pixel: all rank statistics from one look at its pairs, in an Arrow kernel with bounded memory."""

    @F.pandas_udf(RANKED)
    def run(ts, vs):
        import pandas as pd

        rows = [rank_trend(np.asarray(a, float), np.asarray(b, float), least) for a, b in zip(ts, vs)]
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in RANKED.split(", ")])
        return out.astype({c: float for c in out.columns if c != "n_obs"})

    found = series(df, by, t, v).select(*by, run(F.col("s.t"), F.col("s.v")).alias("r")).select(*by, "r.*")
    return found.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in found.columns[len(by) + 1 :]})


def theil_sen(df: DataFrame, by: Sequence[str], t: str, v: str, least: int = LEAST) -> DataFrame:
    """The median slope of all pairs, its intercept and bounds, and r squared of the line."""
    out = ranked(df, by, t, v, least).select(*by, "n_obs", "slope", "intercept", "slope_low", "slope_high", "r2")
    return out.withColumn("n_obs", F.when(F.col("slope").isNotNull(), F.col("n_obs")).otherwise(F.lit(0).cast("long")))


def kendall(df: DataFrame, by: Sequence[str], t: str, v: str, least: int = LEAST) -> DataFrame:
    """Kendall's tau-b."""
    return ranked(df, by, t, v, least).select(*by, "n_obs", "tau")


def kendall_exact_p(n: int, con: int) -> float:
    """Two-sided p of concordant minus discordant pairs without ties, by counting permutations."""
    most = n * (n - 1) // 2
    ways = [1]
    for k in range(2, n + 1):  # permutations by inversions
        ways = [sum(ways[max(0, i - k + 1) : i + 1]) for i in range(len(ways) + k - 1)]
    inversions = (most - abs(con)) // 2
    return min(1.0, 2 * sum(ways[: inversions + 1]) / math.factorial(n))


def kendall_normal_p(t: np.ndarray, v: np.ndarray, con: int | None = None) -> float:
    """Two-sided p by the normal approximation with ties."""
    n, con = len(t), concordance(t, v) if con is None else con
    (a, c, v1), (b, d, v2) = tie_sums(t), tie_sums(v)
    var = (n * (n - 1) * (2 * n + 5) - v1 - v2) / 18 + a * b / (2 * n * (n - 1)) + (c * d / (9 * n * (n - 1) * (n - 2)) if n > 2 else 0)
    return math.erfc(abs(con) / math.sqrt(2 * var)) if var > 0 else 1.0


def kendall_p(t: np.ndarray, v: np.ndarray, con: int | None = None) -> float:
    """Exact for short series without ties, otherwise normal."""
    n = len(t)
    if n < 2:
        return float("nan")
    con = concordance(t, v) if con is None else con
    if n <= 33 and len(set(t)) == n and len(set(v)) == n:
        return kendall_exact_p(n, con)
    return kendall_normal_p(np.asarray(t, float), np.asarray(v, float), con)


def with_kendall_p(df: DataFrame, by: Sequence[str], t: str, v: str, least: int = LEAST) -> DataFrame:
    """tau-b with its p."""
    return ranked(df, by, t, v, least).select(*by, "n_obs", "tau", "p")


def confidence(slope: Column, se: Column, n: Column) -> dict[str, Column]:
    """95 % bounds by Student's t with two degrees of freedom less than observations."""
    t = quantile_of(n - 2)
    return {"low": slope - t * se, "high": slope + t * se}


def breakpoints(values: np.ndarray, penalty: float = 10.0, least: int = 2, jump: int = 5) -> list[int]:
    """Ends of segments with the least squared deviations plus a penalty each, the last end left out.

    Optimal partitioning with pruning; ends are multiples of jump.
    """
    n = len(values)
    s1, s2 = np.concatenate([[0.0], np.cumsum(values)]), np.concatenate([[0.0], np.cumsum(np.square(values))])
    cost = lambda a, b: s2[b] - s2[a] - (s1[b] - s1[a]) ** 2 / (b - a)
    ends = [k for k in range(jump, n, jump) if k >= least] + [n]
    best: dict[int, tuple[float, int]] = {0: (0.0, 0)}
    open_: list[int] = [0]
    for end in ends:
        options = [(best[a][0] + cost(a, end) + penalty, a) for a in open_ if end - a >= least]
        if not options:
            continue
        best[end] = min(options)
        open_ = [a for a in open_ if end - a < least or best[a][0] + cost(a, end) <= best[end][0]] + [end]
    out, at = [], n
    while at and at in best:
        at = best[at][1]
        if at:
            out.append(at)
    return out[::-1]


def last_break(t: np.ndarray, v: np.ndarray, penalty: float = 10.0, least: int = 5, share: float = 0.7) -> tuple[float | None, float | None, int]:
    """(time and size of the last break if it lies late in the series, number of breaks).

    Gaps in the series are filled linearly by place, values and times alike, and count as places. The size is the
    mean of two values after less that of two before; a break at the last place has none.
    """
    ok = ~np.isnan(v)
    if ok.sum() < least:
        return None, None, 0
    at, n = np.arange(len(v)), len(v)
    v, t = np.interp(at, at[ok], v[ok]), np.interp(at, at[ok], t[ok])
    found = breakpoints(v, penalty)
    if not found or found[-1] <= share * n:
        return None, None, len(found)
    k = found[-1]
    return float(t[k]), float(v[k : k + 2].mean() - v[max(0, k - 2) : k].mean()) if k < n - 1 else None, len(found)


def break_table(df: DataFrame, by: Sequence[str], t: str, v: str) -> DataFrame:
    """The last late break of each pixel, by an Arrow kernel over its series."""

    @F.pandas_udf("at double, size double, n_breaks int")
    def run(ts, vs):
        import pandas as pd

        found = [last_break(np.asarray(a, float), np.asarray(b, float)) for a, b in zip(ts, vs)]
        return pd.DataFrame({"at": [f[0] for f in found], "size": [f[1] for f in found], "n_breaks": [f[2] for f in found]}).astype({"at": float, "size": float, "n_breaks": "int32"})

    found = series(df, by, t, v, gaps=True).select(*by, run(F.col("s.t"), F.transform("s.v", lambda x: F.coalesce(x, F.lit(float("nan"))))).alias("b"))
    clean = lambda c: F.nanvl(c, F.lit(None).cast("double"))
    return found.select(*by, clean(F.col("b.at")).alias("break_at"), clean(F.col("b.size")).alias("break_size"), F.col("b.n_breaks").alias("n_breaks"))
