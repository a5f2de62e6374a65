"""Compositing, neighbourhoods, grids and shapes of pixel tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import scene_day


def composite(df: DataFrame, pixel: Sequence[str], rank: str, bands: Sequence[str], scene: str, stat: str = "max") -> DataFrame:
    """All bands of the scene whose index is largest (or smallest); the first scene wins ties.

    One aggregation combines before the shuffle, so a pixel of many scenes stays one row from each
    task; scenes without an index don't count.
    """
    key = F.struct((F.col(rank) if stat == "min" else -F.col(rank)).alias("k"), F.col(scene))
    best = F.min_by(F.struct(scene, rank, *bands), key)
    valid = df.filter(F.col(rank).isNotNull())
    return valid.groupBy(*pixel).agg(best.alias("_b"), F.count("*").alias("n_valid")).select(*pixel, "n_valid", "_b.*")


def percentile_composite(df: DataFrame, pixel: Sequence[str], rank: str, bands: Sequence[str], scene: str, p: float) -> DataFrame:
    """All bands of the scene whose index is nearest the p-th percentile; the first scene wins ties.

    One shuffle: a pixel's (index, scene) pairs come together once, a few bytes for each scene, and the chosen
    scene's bands are among them. A pixel has as many scenes as a season has overpasses.
    """
    valid = df.filter(F.col(rank).isNotNull())
    seen = valid.groupBy(*pixel).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("k"), F.col(scene).alias("s"), F.struct(*bands).alias("b")))).alias("_s"))
    at = F.lit(float(p)) * (F.size("_s") - 1)
    low, high = (F.get(F.col("_s.k"), f(at).cast("int")) for f in (F.floor, F.ceil))
    goal = low + (high - low) * (at - F.floor(at))
    best = F.array_min(F.transform("_s", lambda x: F.struct(F.abs(x["k"] - F.col("_goal")).alias("d"), x["s"].alias("s"), x["k"].alias("k"), x["b"].alias("b"))))
    out = seen.withColumn("_goal", goal).withColumn("_b", best)
    return out.select(*pixel, F.col("_b.s").alias(scene), F.col("_b.k").alias(rank), "_b.b.*")


def enough_scenes(composite_: DataFrame, least: int, bands: Sequence[str], n: str = "n_valid") -> DataFrame:
    """A composite whose pixels of too few valid scenes are emptied."""
    return composite_.withColumns({b: F.when(F.col(n) >= least, F.col(b)) for b in bands})


def scene_dates(df: DataFrame, scene: str, product: str) -> DataFrame:
    """year and doy columns from the scenes' file names, so that a composite carries them."""
    return df.withColumns(scene_day(F.col(scene), product))


def backfilled(first: DataFrame, fill: DataFrame, pixel: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """The first composite, with the other where it has no value."""
    other = fill.select(*pixel, *[F.col(b).alias(f"_{b}") for b in bands])
    return first.join(other, list(pixel), "full_outer").select(*pixel, *[F.coalesce(b, f"_{b}").alias(b) for b in bands])


def first_valid(df: DataFrame, pixel: Sequence[str], value: str, priority: str) -> DataFrame:
    """A mosaic: of overlapping layers the first with a value."""
    return df.filter(F.col(value).isNotNull()).groupBy(*pixel).agg(F.min_by(value, priority).alias(value))


def mosaic_max(df: DataFrame, pixel: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*pixel).agg(F.max(value).alias(value))


def around(df: DataFrame, value: str, half: int, centre: bool = True) -> DataFrame:
    """Each pixel's value sent to the pixels around it: rows (row, col, near), one shuffle on the pixel.

    The number of copies is the window's, whatever the data.
    """
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-half, half + 1) for j in range(-half, half + 1) if centre or i or j])
    return df.filter(F.col(value).isNotNull()).select("row", "col", F.col(value).alias("near"), F.explode(steps).alias("_s")).select((F.col("row") + F.col("_s.i")).alias("row"), (F.col("col") + F.col("_s.j")).alias("col"), "near")


def focal_mean(df: DataFrame, value: str, half: int = 5) -> DataFrame:
    means = around(df, value, half).groupBy("row", "col").agg(F.avg("near").alias("focal_mean"))
    return df.join(means, ["row", "col"], "left")


def focal_mode(df: DataFrame, value: str, half: int = 5) -> DataFrame:
    modes = around(df, value, half).groupBy("row", "col").agg(F.mode(F.col("near"), True).alias("focal_mode"))
    return df.join(modes, ["row", "col"], "left")


def position_index(df: DataFrame, elevation: str) -> DataFrame:
    """Height above the mean of the (up to eight) neighbours."""
    means = around(df, elevation, 1, centre=False).groupBy("row", "col").agg(F.avg("near").alias("_m"))
    return df.join(means, ["row", "col"], "left").withColumn("tpi", F.col(elevation) - F.col("_m")).drop("_m")


def terrain(df: DataFrame, elevation: str, size: float) -> DataFrame:
    """Slope (degrees) and aspect (degrees from north, clockwise) by Horn's weights; null at the edges.

    The eight neighbours come by one shuffle and a conditional aggregation; rows run south.
    """
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    at = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])
    sent = df.select("row", "col", F.col(elevation).alias("z"), F.explode(at).alias("s")).select((F.col("row") - F.col("s.i")).alias("row"), (F.col("col") - F.col("s.j")).alias("col"), "s", "z")
    cells = {(i, j): F.max(F.when((F.col("s.i") == i) & (F.col("s.j") == j), F.col("z"))) for i, j in steps}
    z = sent.groupBy("row", "col").agg(*[c.alias(f"z{i + 1}{j + 1}") for (i, j), c in cells.items()])
    c = F.col
    east = ((c("z02") + 2 * c("z12") + c("z22")) - (c("z00") + 2 * c("z10") + c("z20"))) / (8 * size)
    south = ((c("z20") + 2 * c("z21") + c("z22")) - (c("z00") + 2 * c("z01") + c("z02"))) / (8 * size)
    g = z.filter(c("z11").isNotNull()).select("row", "col", c("z11").alias(elevation), east.alias("dx"), south.alias("dy"))
    downhill = F.pmod(F.degrees(F.atan2(-c("dx"), c("dy"))), F.lit(360.0))
    return g.withColumns({"slope": F.degrees(F.atan(F.sqrt(c("dx") * c("dx") + c("dy") * c("dy")))), "aspect": F.when((c("dx") != 0) | (c("dy") != 0), downhill)})


def tsri(aspect: Column) -> Column:
    """The topographic solar radiation index."""
    return 0.5 - F.cos(F.lit(math.pi / 180) * (aspect - 30)) / 2


def hillshade(slope: Column, aspect: Column, azimuth: float = 315.0, altitude: float = 45.0) -> Column:
    """0 to 255 from slope and aspect in degrees."""
    up, s = math.radians(altitude), F.radians(slope)
    light = math.sin(up) * F.cos(s) + math.cos(up) * F.sin(s) * F.cos(F.radians(F.lit(azimuth) - aspect))
    return 255 * (light + 1) / 2


#: How a block of pixels becomes one.
RESAMPLING = {"average": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "median": F.median, "mode": lambda c: F.mode(c, True), "count": F.count}


def resampled(df: DataFrame, value: str, k: int, method: str = "average") -> DataFrame:
    """Blocks of k x k pixels as one; nearest takes the pixel at the block's middle."""
    block = {c: F.floor(F.col(c) / k).cast("int") for c in ("row", "col")}
    if method == "nearest":
        middle = (F.pmod(F.col("row"), F.lit(k)) == k // 2) & (F.pmod(F.col("col"), F.lit(k)) == k // 2)
        return df.filter(middle).select(*[c.alias(n) for n, c in block.items()], value)
    return df.groupBy(*[c.alias(n) for n, c in block.items()]).agg(RESAMPLING[method](F.col(value)).alias(value))


def refined(df: DataFrame, k: int) -> DataFrame:
    """Each pixel as k x k smaller ones with its values: a coarse layer on a fine grid."""
    step = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    out = df.withColumn("_i", step).withColumn("_j", step)
    return out.withColumns({"row": F.col("row") * k + F.col("_i"), "col": F.col("col") * k + F.col("_j")}).drop("_i", "_j")


def reduced(df: DataFrame, value: str, k: int) -> DataFrame:
    """Blocks of k x k pixels: mean, mode and count."""
    return df.groupBy(F.floor(F.col("row") / k).cast("int").alias("row"), F.floor(F.col("col") / k).cast("int").alias("col")).agg(F.avg(value).alias("mean"), F.mode(F.col(value), True).alias("mode"), F.count(value).alias("n"))


def pixel_centre(row: Column, col: Column, origin: tuple[float, float], size: float) -> dict[str, Column]:
    return {"x": origin[0] + (col + 0.5) * size, "y": origin[1] - (row + 0.5) * size}


def metres_a_degree(lat: Column) -> Column:
    """Of longitude, at a latitude."""
    return 111_320 * F.cos(F.radians(lat))


def steep(slope: Column) -> Column:
    """1 where there is a slope, else 0."""
    return F.coalesce((slope > 0).cast("int"), F.lit(0))


def zone_stride(area: Column, pixel_area: float, most: int = 1500) -> Column:
    """Every which row and column of a zone is read, so that its longer side counts at most so many pixels; 1 for small zones."""
    return F.greatest(F.lit(1), F.ceil(F.sqrt(area / pixel_area) / most)).cast("int")


def pieces(df: DataFrame, rows: int, cols: int, side: int) -> DataFrame:
    """The number of the piece of a raster cut into side x side."""
    h, w = math.ceil(rows / side), math.ceil(cols / side)
    return df.withColumn("piece", (F.floor(F.col("row") / h) * side + F.floor(F.col("col") / w)).cast("int"))


def fishnet(boxes: DataFrame, dx: float, dy: float) -> DataFrame:
    """Cells of boxes (id, xmin, ymin, xmax, ymax), the last ones cut at the edge."""
    nx = F.ceil((F.col("xmax") - F.col("xmin")) / dx).cast("int")
    ny = F.ceil((F.col("ymax") - F.col("ymin")) / dy).cast("int")
    cells = boxes.withColumn("i", F.explode(F.sequence(F.lit(0), nx - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), ny - 1)))
    x, y = F.col("xmin") + F.col("i") * dx, F.col("ymin") + F.col("j") * dy
    return cells.select("id", "i", "j", x.alias("x0"), y.alias("y0"), F.least(x + dx, F.col("xmax")).alias("x1"), F.least(y + dy, F.col("ymax")).alias("y1"))


def at_dateline(boxes: DataFrame) -> DataFrame:
    """Boxes that cross the antimeridian (xmin > xmax) as two, with ids 100 * id + part."""
    c = F.col
    crossing = c("xmin") > c("xmax")
    one = F.struct((c("id") * 100).alias("id"), c("xmin").alias("xmin"), F.lit(180.0).alias("xmax"))
    two = F.struct((c("id") * 100 + 1).alias("id"), F.lit(-180.0).alias("xmin"), c("xmax").alias("xmax"))
    whole = F.struct((c("id") * 100).alias("id"), c("xmin").alias("xmin"), c("xmax").alias("xmax"))
    return boxes.select(F.explode(F.when(crossing, F.array(one, two)).otherwise(F.array(whole))).alias("p"), "ymin", "ymax").select("p.id", "p.xmin", "p.xmax", "ymin", "ymax")


def _edges(ring: Column) -> Column:
    return F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct((a["x"] * b["y"] - b["x"] * a["y"]).alias("w"), (a["x"] + b["x"]).alias("x"), (a["y"] + b["y"]).alias("y")))


def ring_area(ring: Column) -> Column:
    """Of a closed ring, by the shoelace formula."""
    return F.abs(F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e["w"])) / 2


def ring_centroid(ring: Column) -> Column:
    e = _edges(ring)
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x["w"])
    weighted = lambda k: F.aggregate(e, F.lit(0.0), lambda s, x: s + x[k] * x["w"]) / (3 * total)
    return F.struct(weighted("x").alias("x"), weighted("y").alias("y"))


#: An equal-area conic projection of the boreal zone: standard parallels, origin, sphere's radius.
ALBERS = {"lat1": 50.0, "lat2": 70.0, "lat0": 40.0, "lon0": 180.0, "radius": 6371007.181}


def _albers() -> tuple[float, float, float, float, float]:
    p1, p2, p0 = (math.radians(ALBERS[k]) for k in ("lat1", "lat2", "lat0"))
    n = (math.sin(p1) + math.sin(p2)) / 2
    c = math.cos(p1) ** 2 + 2 * n * math.sin(p1)
    r = ALBERS["radius"]
    return n, c, r * math.sqrt(c - 2 * n * math.sin(p0)) / n, r, math.radians(ALBERS["lon0"])


def to_albers(lon: Column, lat: Column) -> dict[str, Column]:
    n, c, rho0, r, _ = _albers()
    west = ALBERS["lon0"] - 180.0
    turn = F.radians(lon - (ALBERS["lon0"] + 360.0 * F.floor((lon - west) / 360.0)))  # whole turns go in degrees, which keeps all digits
    rho = r * F.sqrt(c - 2 * n * F.sin(F.radians(lat))) / n
    return {"x": rho * F.sin(n * turn), "y": rho0 - rho * F.cos(n * turn)}


def from_albers(x: Column, y: Column, near: Column | None = None) -> dict[str, Column]:
    """Longitude and latitude; the longitude between -180 and 180, or less than half a turn from `near`."""
    n, c, rho0, r, lon0 = _albers()
    rho2 = x * x + (rho0 - y) * (rho0 - y)
    turn = F.atan2(x, rho0 - y) / n
    lon = F.degrees(F.pmod(turn + lon0 + math.pi, F.lit(2 * math.pi)) - math.pi)
    if near is not None:
        lon = lon + 360.0 * F.rint((near - lon) / 360.0)
    return {"lon": lon, "lat": F.degrees(F.asin((c - rho2 * n * n / (r * r)) / (2 * n)))}
