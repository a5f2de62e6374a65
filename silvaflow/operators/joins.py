"""Joins of tiles, files, classes, points and pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def found_split(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """wanted with a flag whether the key is there; copies on the other side don't multiply rows."""
    return wanted.join(have.select(key).distinct().withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def missing(expected: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return expected.join(done.select(key).distinct(), key, "left_anti")


def interval_class(df: DataFrame, value: str, ranges: Sequence[tuple], label: str = "label") -> DataFrame:
    """Each row with the class whose inclusive range holds its value (null if none does).

    Ranges are a short list given in the call, so they become one expression and nothing is joined.
    """
    out = F.lit(None).cast("string")
    for low, high, name in reversed(list(ranges)):
        out = F.when(F.col(value).between(low, high), F.lit(name)).otherwise(out)
    return df.withColumn(label, out)


def neighbours(tiles: DataFrame, ident: str, col: str, row: str) -> DataFrame:
    """Pairs of tiles of a regular grid that touch, by an equi-join on shifted places."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    shifted = tiles.select(F.col(ident), F.col(col).alias("_c"), F.col(row).alias("_r"), F.explode(steps).alias("_s"))
    at = shifted.select(ident, (F.col("_c") + F.col("_s.i")).alias("_x"), (F.col("_r") + F.col("_s.j")).alias("_y"))
    other = tiles.select(F.col(ident).alias("neighbour"), F.col(col).alias("_x"), F.col(row).alias("_y"))
    return at.join(other, ["_x", "_y"]).select(ident, "neighbour")


def pixel_of(x: Column, y: Column, origin: tuple[float, float], size: float) -> dict[str, Column]:
    """Column and row of the pixel under a point, from the grid's upper left corner."""
    return {"col": F.floor((x - origin[0]) / size).cast("int"), "row": F.floor((origin[1] - y) / size).cast("int")}


def sample_pixels(points: DataFrame, pixels: DataFrame, x: str, y: str, origin: tuple[float, float], size: float, nodata: float | None = None) -> DataFrame:
    """Points with the values of the pixels under them: a left equi-join on the pixel's place."""
    bands = [c for c in pixels.columns if c not in ("row", "col")]
    clean = pixels.withColumns({b: F.when(F.col(b) != nodata, F.col(b)) for b in bands}) if nodata is not None else pixels
    return points.withColumns(pixel_of(F.col(x), F.col(y), origin, size)).join(clean, ["row", "col"], "left")


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Is a point inside a closed ring of (x, y) structures? Counts the edges that a ray crosses."""
    edges = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def crosses(e):
        a, b = e["a"], e["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

    return F.size(F.filter(edges, crosses)) % 2 == 1


def within_polygons(points: DataFrame, polygons: DataFrame, x: str, y: str, cell: float) -> DataFrame:
    """Points with the polygons (polygon_id, ring, xmin, xmax, ymin, ymax) that hold them, left outer.

    Both sides are cut to grid cells; points meet only the polygons of their cell, and the ring
    decides. Points outside of every polygon stay with a null polygon_id. Points need a unique
    point_id.
    """
    cut = lambda v: F.floor(v / cell).cast("long")
    covers = polygons.withColumn("_cx", F.explode(F.sequence(cut(F.col("xmin")), cut(F.col("xmax"))))).withColumn("_cy", F.explode(F.sequence(cut(F.col("ymin")), cut(F.col("ymax")))))
    at = points.withColumns({"_cx": cut(F.col(x)), "_cy": cut(F.col(y))})
    hit = at.join(covers, ["_cx", "_cy"]).filter(in_ring(F.col("ring"), F.col(x), F.col(y))).select("point_id", "polygon_id")
    return points.join(hit, "point_id", "left")


def overlapping(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """Pairs (a_id, b_id) of boxes (id, xmin, xmax, ymin, ymax) that overlap or touch.

    Boxes meet by grid cell; of the cells that both cover, the one with their common lower left
    corner reports the pair, so none comes twice.
    """
    cut = lambda v: F.floor(v / cell).cast("long")

    def spread(df, p):
        df = df.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "xmin", "xmax", "ymin", "ymax")])
        return df.withColumn("_cx", F.explode(F.sequence(cut(F.col(f"{p}_xmin")), cut(F.col(f"{p}_xmax"))))).withColumn("_cy", F.explode(F.sequence(cut(F.col(f"{p}_ymin")), cut(F.col(f"{p}_ymax")))))

    pairs = spread(a, "a").join(spread(b, "b"), ["_cx", "_cy"])
    touch = (F.col("a_xmin") <= F.col("b_xmax")) & (F.col("b_xmin") <= F.col("a_xmax")) & (F.col("a_ymin") <= F.col("b_ymax")) & (F.col("b_ymin") <= F.col("a_ymax"))
    once = (F.col("_cx") == cut(F.greatest("a_xmin", "b_xmin"))) & (F.col("_cy") == cut(F.greatest("a_ymin", "b_ymin")))
    return pairs.filter(touch & once).select("a_id", "b_id")


def compare_counts(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of both sides by keys, full outer, and their difference."""
    one = a.groupBy(*keys).agg(F.count("*").alias("n_a"))
    two = b.groupBy(*keys).agg(F.count("*").alias("n_b"))
    both = one.join(two, list(keys), "full_outer").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_a", "n_b")})
    return both.withColumn("difference", F.col("n_a") - F.col("n_b"))


def suffixed(a: DataFrame, b: DataFrame, keys: Sequence[str], suffixes: tuple[str, str] = ("_x", "_y"), decimals: int | None = None, how: str = "inner") -> DataFrame:
    """Join on keys; other columns that both sides have get a suffix. decimals: keys are numbers that meet when they agree so far."""
    both = (set(a.columns) & set(b.columns)) - set(keys)
    a, b = (df.select(*[F.col(c).alias(c + s if c in both else c) for c in df.columns]) for df, s in zip((a, b), suffixes))
    if decimals is None:
        return a.join(b, list(keys), how)
    names = [f"_{k}" for k in keys]
    a, b = (df.withColumns({n: F.round(k, decimals) for n, k in zip(names, keys)}) for df in (a, b))
    return a.join(b.drop(*keys), names, how).drop(*names)


def crossing(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """Pairs of boxes whose insides meet while neither holds the other: touching edges and containment don't count."""
    pairs = overlapping(a, b, cell)
    for df, p in ((a, "a"), (b, "b")):
        pairs = pairs.join(df.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "xmin", "xmax", "ymin", "ymax")]), f"{p}_id")
    c = F.col
    inside = (c("a_xmin") < c("b_xmax")) & (c("b_xmin") < c("a_xmax")) & (c("a_ymin") < c("b_ymax")) & (c("b_ymin") < c("a_ymax"))
    holds = lambda p, q: (c(f"{p}_xmin") <= c(f"{q}_xmin")) & (c(f"{p}_xmax") >= c(f"{q}_xmax")) & (c(f"{p}_ymin") <= c(f"{q}_ymin")) & (c(f"{p}_ymax") >= c(f"{q}_ymax"))
    return pairs.filter(inside & ~holds("a", "b") & ~holds("b", "a")).select("a_id", "b_id")


def latest_file(index: DataFrame, tile: str, path: str, time: str) -> DataFrame:
    """The most recent file of each tile (the first path on ties), by an aggregation; tiles without one have no row."""
    newest = index.groupBy(tile).agg(F.max(time).alias(time))
    return index.join(newest, [tile, time]).groupBy(tile).agg(F.min(path).alias(path))


def sample_layers(points: DataFrame, layers: dict[str, DataFrame], x: str, y: str, origin: tuple[float, float], size: float, nodata: float | None = None) -> DataFrame:
    """Points with the bands of several layers under them, each band named <layer>_<band>; one place is worked out for all."""
    out = points.withColumns(pixel_of(F.col(x), F.col(y), origin, size))
    for name, layer in layers.items():
        bands = [c for c in layer.columns if c not in ("row", "col")]
        clean = layer.select("row", "col", *[(F.when(F.col(b) != nodata, F.col(b)) if nodata is not None else F.col(b)).alias(f"{name}_{b}") for b in bands])
        out = out.join(clean, ["row", "col"], "left")
    return out


def stacked(layers: dict[str, DataFrame], pixel: Sequence[str], pad: bool = False) -> DataFrame:
    """Bands of several layers side by side, named <layer>_<band>: pixels that all have, or (pad) all of the first layer's."""
    out = None
    for name, layer in layers.items():
        part = layer.select(*pixel, *[F.col(c).alias(f"{name}_{c}") for c in layer.columns if c not in pixel])
        out = part if out is None else out.join(part, list(pixel), "left" if pad else "inner")
    return out


def tile_files(indices: dict[str, DataFrame], tile: str, path: str) -> DataFrame:
    """For tiles that are in every index, their file in each (columns <index>_<path>)."""
    out = None
    for name, index in indices.items():
        part = index.select(tile, F.col(path).alias(f"{name}_{path}"))
        out = part if out is None else out.join(part, tile)
    return out
