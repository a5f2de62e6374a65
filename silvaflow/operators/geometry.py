"""Boxes, tiles and rings: buffers, overlaps, clipping and rasterising."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import joins, raster

BOX = ("xmin", "ymin", "xmax", "ymax")


def buffered(df: DataFrame, by: float) -> DataFrame:
    """Boxes wider by a distance on every side."""
    return df.withColumns({c: F.col(c) + (by if c.endswith("max") else -by) for c in BOX})


def tile_parts(tiles: DataFrame, by: float) -> DataFrame:
    """A tile's projected box, the same buffered, and the lon/lat box of the buffered one's corners."""
    wide = buffered(tiles, by)
    corners = [raster.from_albers(F.col(x), F.col(y)) for x in ("xmin", "xmax") for y in ("ymin", "ymax")]
    lon, lat = [c["lon"] for c in corners], [c["lat"] for c in corners]
    parts = wide.select("tile_num", *[F.col(c).alias(f"buffered_{c}") for c in BOX], F.least(*lon).alias("lon0"), F.greatest(*lon).alias("lon1"), F.least(*lat).alias("lat0"), F.greatest(*lat).alias("lat1"))
    return tiles.join(parts, "tile_num")


def clipped(df: DataFrame, other: Sequence[str]) -> DataFrame:
    """Boxes cut to the box in the columns `other`; those outside of it go."""
    cut = {"xmin": F.greatest("xmin", other[0]), "ymin": F.greatest("ymin", other[1]), "xmax": F.least("xmax", other[2]), "ymax": F.least("ymax", other[3])}
    return df.withColumns(cut).filter((F.col("xmin") < F.col("xmax")) & (F.col("ymin") < F.col("ymax")))


def intersecting(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """The boxes of a (id and bounds) that meet any of b."""
    return a.join(joins.overlapping(a, b, cell).select(F.col("a_id").alias("id")).distinct(), "id", "left_semi")


def rasterised(cells: DataFrame, polygons: DataFrame, origin: tuple[float, float], size: float) -> DataFrame:
    """Pixels (row, col) with the polygon that holds their centre, 0 if none does; the least id wins overlaps."""
    centres = cells.withColumns({"x": origin[0] + (F.col("col") + 0.5) * size, "y": origin[1] - (F.col("row") + 0.5) * size, "point_id": F.concat_ws("_", "row", "col")})
    hits = joins.within_polygons(centres.select("point_id", "row", "col", "x", "y"), polygons, "x", "y", size * 16)
    return hits.groupBy("row", "col").agg(F.coalesce(F.min("polygon_id"), F.lit(0)).alias("zone"))


def ring_points(ring: Column) -> Column:
    """A ring as {lat, lon} points."""
    return F.transform(ring, lambda p: F.struct(p["y"].alias("lat"), p["x"].alias("lon")))


def parts(df: DataFrame, geometry: str) -> DataFrame:
    """A row for each part of a shape of many, numbered from 0."""
    return df.select("*", F.posexplode(geometry).alias("part", "ring")).drop(geometry)


def centroid_extent(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") for c in (x, y) for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])


def dissolved(df: DataFrame, by: str, keep: Sequence[str], ring: str, order: str) -> DataFrame:
    """One shape of many parts for each value, with the attributes of its first row in order."""
    firsts = [F.min_by(c, order).alias(c) for c in keep]
    return df.groupBy(by).agg(*firsts, F.collect_list(ring).alias("parts"))
