"""Latest per key, running values, gaps, samples and reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], duplicates: bool = False) -> DataFrame:
    """The first row of each key in the given order (a full one), or all but the first."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    out = df.withColumn("_rank", rank)
    return out.filter(F.col("_rank") > 1 if duplicates else F.col("_rank") == 1).drop("_rank")


def first_of_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The least row of each key by an aggregation, which combines before the shuffle: for keys with very many rows."""
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*order, *[c for c in rest if c not in order])
    return df.groupBy(*keys).agg(F.min(ranked).alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def offset_ids(df: DataFrame, key: str, order: Sequence[Column], step: int = 1000) -> DataFrame:
    """An id for each part of a key: key + step * (place in order, from 0)."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return df.withColumn("part_id", F.col(key) + step * place)


def running_sum(df: DataFrame, value: str, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("running", F.sum(value).over(w))


def expanding_sd(df: DataFrame, value: str, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Standard deviation of the values so far; 0 for the first two."""
    w = Window.partitionBy(*by).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("sd_so_far", F.when(F.row_number().over(w) <= 2, 0.0).otherwise(F.stddev_samp(value).over(so_far)))


#: Fixed value: how many of the latest deviations the baseline leaves out.
LATEST = 9


def converged(sds: Sequence[float], share: float = 0.05) -> bool:
    """Has the deviation stopped changing? The mean over all against that over all but the latest nine."""
    cut = len(sds) - LATEST
    if cut < 1:
        return False
    before = sum(sds[:cut]) / cut
    return before > 0 and abs(sum(sds) / len(sds) / before - 1) <= share


def interpolated(df: DataFrame, by: Sequence[str], place: str, value: str) -> DataFrame:
    """Gaps filled linearly by place; before the first and after the last value it is held."""
    w = Window.partitionBy(*by).orderBy(place)
    back = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(place))
    near = df.withColumns({"_v0": F.last(value, True).over(back), "_p0": F.last(at, True).over(back), "_v1": F.first(value, True).over(ahead), "_p1": F.first(at, True).over(ahead)})
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col(place) - F.col("_p0")) / (F.col("_p1") - F.col("_p0"))
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_p0").isNull(), F.col("_v1")).when(F.col("_p1").isNull(), F.col("_v0")).otherwise(line)
    return near.withColumn("filled", filled).drop("_v0", "_p0", "_v1", "_p1")


def hash_order(key: Sequence[str | Column], seed: int = 0) -> Column:
    """A text by which rows come in an order of chance that depends on their key alone: any engine with MD5 gives the same."""
    return F.md5(F.concat_ws(":", F.lit(seed), *key))


def hash_sample(df: DataFrame, key: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """n rows, the same ones whatever the partitions; a top-n, not a full sort."""
    return df.orderBy(hash_order(key, seed), *key).limit(n)


def hash_fraction(df: DataFrame, key: Sequence[str], share: float, seed: int = 0) -> DataFrame:
    """About a share of the rows, decided row by row."""
    return df.filter(F.substr(hash_order(key, seed), F.lit(1), F.lit(7)) < f"{int(share * 16**7):07x}") if share < 1 else df


def split(df: DataFrame, key: Sequence[str], share: float = 0.7, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Rows for training and the others."""
    low = F.substr(hash_order(key, seed), F.lit(1), F.lit(7)) < f"{int(share * 16**7):07x}"
    return df.filter(low), df.filter(~low)


def per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank")


def in_equal_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Each row's bin (from 0) among equally filled ones; the cuts are exact and come from counts of the values."""
    from .stats import quantiles

    cuts = quantiles(df, [], value, {f"_c{k}": k / bins for k in range(1, bins)})
    place = F.size(F.filter(F.array(*[f"_c{k}" for k in range(1, bins)]), lambda c: F.col(value) > c))
    return df.crossJoin(F.broadcast(cuts)).withColumn("bin", place).drop(*[f"_c{k}" for k in range(1, bins)])  # one row of cuts


def stratified(df: DataFrame, value: str, key: Sequence[str], bins: int, n: int, seed: int = 0, replace: bool = False) -> DataFrame:
    """n rows from each of equally filled bins of value; with replacement a row may come several times."""
    binned = in_equal_bins(df, value, bins)
    order = [hash_order(key, seed), *[F.col(c) for c in key]]
    if not replace:
        return per_group(binned, ["bin"], order, n)
    # the k-th draw takes the row whose place in the order is a hash of (bin, draw) modulo the bin's rows
    sizes = binned.groupBy("bin").agg(F.count("*").alias("_size"))
    draws = sizes.withColumn("draw", F.explode(F.sequence(F.lit(1), F.least(F.lit(n).cast("long"), "_size"))))
    place = F.conv(F.substr(hash_order([F.col("bin").cast("string"), F.col("draw").cast("string")], seed), F.lit(1), F.lit(13)), 16, 10).cast("long") % F.col("_size")
    ranked = binned.withColumn("_place", F.row_number().over(Window.partitionBy("bin").orderBy(*order)).cast("long") - 1)
    return ranked.join(draws.select("bin", "draw", place.alias("_place")), ["bin", "_place"]).drop("_place")


def topped_up(local: DataFrame, broad: DataFrame, least: int, key: Sequence[str], seed: int = 0) -> DataFrame:
    """local, with rows sampled from broad as far as they are needed to have `least` rows."""
    have = local.agg(F.count("*").alias("_have"))
    sample = hash_sample(broad, key, least, seed)
    ranked = sample.withColumn("_rank", F.row_number().over(Window.orderBy(hash_order(key, seed), *key)))  # `least` rows at most
    more = ranked.crossJoin(F.broadcast(have)).filter(F.col("_rank") <= least - F.col("_have")).drop("_rank", "_have")
    return local.unionByName(more)


def folds(df: DataFrame, key: Sequence[str], k: int, seed: int = 0) -> DataFrame:
    """A fold from 0 to k - 1 for each row."""
    return df.withColumn("fold", (F.conv(F.substr(hash_order(key, seed), F.lit(1), F.lit(13)), 16, 10).cast("long") % k).cast("int"))


def chunks(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """Work lists of `size` rows, numbered from 0 by a distributed sort: counts by partition give the offsets.

    The sorted rows are kept on disk, as both the counts and the numbers must see the same partitions.
    """
    sorted_ = df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()).persist(StorageLevel.DISK_ONLY)
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    counts = sorted_.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # a row for each partition
    return sorted_.withColumn("_p", part).join(F.broadcast(before), "_p").withColumn("chunk", F.floor((F.col("_before") + place) / size).cast("int")).drop("_p", "_m", "_before")


def row_ids(df: DataFrame, order: Sequence[str], name: str = "fid") -> DataFrame:
    """1 to n in the given order."""
    return chunks(df, order, 1).withColumn(name, F.col("chunk") + 1).drop("chunk")


def ordered(df: DataFrame, *orders: tuple[str, Sequence]) -> DataFrame:
    """Rows sorted by categories in their declared order; values that aren't declared come last."""
    return df.orderBy(*[F.coalesce(F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c)).cast("int"), F.lit(0)) + F.when(F.col(c).isin(*values), 0).otherwise(len(values) + 1) for c, values in orders], *[c for c, _ in orders])


def at_places(df: DataFrame, order: Sequence[str], places: Sequence[int]) -> DataFrame:
    """The rows at the given places (from 0) of an order."""
    return row_ids(df, order, "_place").filter(F.col("_place").isin(*[p + 1 for p in places])).drop("_place")


def melted(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Wide to long: (ids, variable, value)."""
    return df.unpivot(list(ids), list(values), "variable", "value")


def widened(df: DataFrame, ids: Sequence[str], name: str, names: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """Long to wide, with generated names <name>_<value>; the names are given, so no pass looks for them."""
    return df.groupBy(*ids).agg(*[f_where(F.col(name) == n, v).alias(f"{n}_{k}") for n in names for k, v in values.items()])


def f_where(condition: Column, value: Column) -> Column:
    return F.max(F.when(condition, value))


def appended(index: DataFrame, new: DataFrame) -> DataFrame:
    """By name; columns that one side lacks are null."""
    return index.unionByName(new, allowMissingColumns=True)


def long_change(df: DataFrame, keys: Sequence[str], first: str, second: str) -> DataFrame:
    """Wide values of two dates as rows: the first, the second and their change."""
    rows = F.array(*[F.struct(F.lit(n).alias("measure"), v.alias("value")) for n, v in (("first", F.col(first)), ("second", F.col(second)), ("change", F.col(second) - F.col(first)))])
    return df.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.measure", "_r.value")
