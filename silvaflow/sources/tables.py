"""Sources and sinks of tables, catalogues and file listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(paths, header=True, nullValue="", mode="PERMISSIVE")


def in_bounds(df: DataFrame, box: Sequence[float]) -> DataFrame:
    """Shapes whose bounds overlap a box; the predicate on the bounds reaches the Parquet scan."""
    x0, y0, x1, y1 = box
    return df.filter((F.col("xmin") <= x1) & (F.col("xmax") >= x0) & (F.col("ymin") <= y1) & (F.col("ymax") >= y0))


def list_files(spark: SparkSession, folder: str, pattern: str, recursive: bool = True) -> DataFrame:
    """path, name, size and time of files; contents aren't read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(folder).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    return files.withColumn("file", F.element_at(F.split("path", "/"), -1))


def dated_patterns(root: str, users: Sequence[str], algorithms: Sequence[str], years: Sequence[int], months: Sequence[int], days: Sequence[int] = ()) -> list[str]:
    """Folders of all combinations of user, algorithm, year, month and (if given) day."""
    out = []
    for u in users:
        for a in algorithms:
            for y in years:
                for m in months:
                    out += [f"{root}/{u}/{a}/{y}/{m:02d}/{d:02d}" for d in days] or [f"{root}/{u}/{a}/{y}/{m:02d}"]
    return out


#: Asset names of bands by product.
ASSETS = {
    "HLSL30": {"blue": "B02", "green": "B03", "red": "B04", "nir": "B05", "swir": "B06", "swir2": "B07", "qa": "Fmask"},
    "HLSS30": {"blue": "B02", "green": "B03", "red": "B04", "nir": "B8A", "swir": "B11", "swir2": "B12", "qa": "Fmask"},
    "LC2SR": {"blue": "SR_B2", "green": "SR_B3", "red": "SR_B4", "nir": "SR_B5", "swir": "SR_B6", "swir2": "SR_B7", "qa": "QA_PIXEL"},
}
CATALOGUE = "features array<struct<id:string, properties:map<string,string>, assets:map<string,struct<href:string>>>>"


def catalogue(spark: SparkSession, path: str, only: str = "s3", lines: bool = False) -> DataFrame:
    """scene, band, href of a scene catalogue (a document a file, or lines of them); only links of the given kind."""
    scenes = spark.read.schema(CATALOGUE).json(path, multiLine=not lines).select(F.explode("features").alias("f")).select(F.col("f.id").alias("scene"), F.col("f.assets").alias("assets"))
    names = spark.createDataFrame([(p, b, a) for p, bands in ASSETS.items() for b, a in bands.items()], "product string, band string, asset string")
    links = scenes.select("scene", F.explode("assets").alias("asset", "link")).select("scene", "asset", F.col("link.href").alias("href")).filter(F.col("href").startswith(only))
    product = F.when(F.col("scene").contains("L30"), "HLSL30").when(F.col("scene").contains("S30"), "HLSS30").otherwise("LC2SR")
    return links.withColumn("product", product).join(F.broadcast(names), ["product", "asset"]).select("scene", "product", "band", "href")


def parameters(spark: SparkSession, path: str, schema: str | None = None, lines: bool = False) -> DataFrame:
    """Rows of JSON parameter files with the file each came from."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=not lines).select("*", F.col("_metadata.file_path").alias("json_path"))


def relaxed(scenes: DataFrame, cloud: str, start: int, least: int, step: int = 5, limit: int = 90) -> DataFrame:
    """Scenes below the first cloud limit (start, start + step, ... limit) that gives enough of them.

    One aggregation counts all limits.
    """
    limits = list(range(start, limit + 1, step))
    counts = scenes.agg(*[F.count(F.when(F.col(cloud) <= x, 1)).alias(f"n{x}") for x in limits])
    chosen = F.lit(limits[-1])
    for x in reversed(limits):
        chosen = F.when(F.col(f"n{x}") >= least, x).otherwise(chosen)
    return scenes.crossJoin(F.broadcast(counts.select(chosen.alias("max_cloud")))).filter(F.col(cloud) <= F.col("max_cloud"))


def yearly(scenes: DataFrame, at: str, first: int, last: int, begin: str, end: str) -> DataFrame:
    """Scenes of a season (MM-DD to MM-DD) in each of the years."""
    day = F.date_format(at, "MM-dd")
    return scenes.filter(F.year(at).between(first, last) & day.between(begin, end))


def existing(links: DataFrame, listing: DataFrame, link: str = "href") -> DataFrame:
    return links.join(listing.select(F.col("path").alias(link)).distinct(), link, "left_semi")


def read_fixed_width(spark: SparkSession, path: str, columns: Sequence[tuple[str, str]], comment: str = "#") -> DataFrame:
    """White-space separated text with comment lines; a header line, whose first word is the first column's name, is skipped."""
    rows = spark.read.text(path).filter(~F.lower(F.ltrim("value")).startswith(columns[0][0].lower())).filter(~F.ltrim("value").startswith(comment) & (F.trim("value") != "")).select(F.split(F.trim("value"), r"\s+").alias("v"))
    return rows.select(*[F.get("v", F.lit(k)).try_cast(kind).alias(name) for k, (name, kind) in enumerate(columns)])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_tiles(df: DataFrame, path: str, tile: str = "tile_num") -> None:
    """Parquet by tile: rows of a tile are put together first, so a tile is few files."""
    df.repartition(tile).write.mode("overwrite").partitionBy(tile).parquet(path)


#: Pixels on a side of a raster's chunk.
CHUNK = 256


def write_raster(df: DataFrame, path: str, bands: Sequence[str], nodata: float | None = None, scale: tuple[float, float] = (1.0, 0.0)) -> None:
    """Pixels (tile_num, row, col, bands) by tile and sorted by chunk, so that a window reads few row groups; nodata becomes null."""
    clean = {b: (F.when(F.col(b) != nodata, F.col(b)) if nodata is not None else F.col(b)) * scale[0] + scale[1] for b in bands}
    out = df.withColumns({**clean, "chunk_row": F.floor(F.col("row") / CHUNK).cast("int"), "chunk_col": F.floor(F.col("col") / CHUNK).cast("int")})
    out.repartition("tile_num").sortWithinPartitions("tile_num", "chunk_row", "chunk_col", "row", "col").write.mode("overwrite").partitionBy("tile_num").parquet(path)


def read_raster(spark: SparkSession, path: str, bands: Sequence[str], window: tuple[int, int, int, int] | None = None, scale: tuple[float, float] = (1.0, 0.0)) -> DataFrame:
    """Bands by name, scaled, perhaps of a window (first row, last row, first column, last column); both prune the scan."""
    df = spark.read.parquet(path)
    if window is not None:
        r0, r1, c0, c1 = window
        df = df.filter(F.col("chunk_row").between(r0 // CHUNK, r1 // CHUNK) & F.col("chunk_col").between(c0 // CHUNK, c1 // CHUNK) & F.col("row").between(r0, r1) & F.col("col").between(c0, c1))
    return df.select("tile_num", "row", "col", *[(F.col(b) * scale[0] + scale[1]).alias(b) for b in bands])


def write_shapes(df: DataFrame, path: str, ring: str = "ring") -> None:
    """Polygons with the bounds of their ring beside it, sorted by them: what in_bounds() prunes by."""
    out = df.withColumns({f"{k}{name}": f(F.col(f"{ring}.{k}")) for k in ("x", "y") for name, f in (("min", F.array_min), ("max", F.array_max))})
    out.sortWithinPartitions("xmin", "ymin").write.mode("overwrite").parquet(path)


def read_shapes(spark: SparkSession, path: str, box: Sequence[float] | None = None) -> DataFrame:
    """Polygons, perhaps only those whose bounds meet a box."""
    df = spark.read.parquet(path)
    return df if box is None else in_bounds(df, box)


def sliced(df: DataFrame, at: str, time: int, lon: tuple[float, float], lat: tuple[float, float]) -> DataFrame:
    """One time of an ensemble, within ranges of longitude and latitude."""
    return df.filter((F.col(at) == time) & F.col("lon").between(*lon) & F.col("lat").between(*lat))


def mosaic_json(tiles: DataFrame, path: Column, footprint: Column) -> DataFrame:
    """One JSON text a tile group: its files and footprints, in order. A group is a map sheet, so its list is short."""
    return tiles.groupBy("tile_group").agg(F.to_json(F.sort_array(F.collect_list(F.struct(path.alias("path"), footprint.alias("footprint"))))).alias("mosaic"))


def mosaic_updated(mosaics: DataFrame, tiles: DataFrame, path: Column, footprint: Column) -> DataFrame:
    """Mosaics with further files: those of a path that is listed already replace it."""
    listed = mosaics.select("tile_group", F.explode(F.from_json("mosaic", "array<struct<path:string,footprint:string>>")).alias("f")).select("tile_group", "f.*")
    new = tiles.select("tile_group", path.alias("path"), footprint.cast("string").alias("footprint"))
    kept = listed.join(new.select("tile_group", "path").distinct(), ["tile_group", "path"], "left_anti")
    return mosaic_json(kept.unionByName(new), F.col("path"), F.col("footprint"))


def expanded(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """Entries of a map or structure as columns of their own, the column itself dropped."""
    return df.withColumns({n: F.col(column)[n] for n in names}).drop(column)


def remaining(work: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Work whose key has no result yet."""
    return work.join(done.select(*key).distinct(), list(key), "left_anti")
