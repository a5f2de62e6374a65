"""The driver's tables in the roles of the engine's, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import HEIGHT_CEILING

CODES = list(HEIGHT_CEILING)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as lidar segments."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("granule"), c("l_suppkey").alias("tile_num"), c("l_partkey").alias("part"), c("l_linenumber").alias("line"),
        c("l_quantity").alias("h_can"), (c("l_tax") * 100).alias("h_dif"), (c("l_discount") * 300).alias("slope"), (c("l_extendedprice") / 1000).alias("agb"),
        ((c("l_extendedprice") / 1000) * (0.05 + c("l_discount"))).alias("agb_sd"), F.get(F.array(*[F.lit(x) for x in CODES]), (c("l_partkey") % len(CODES)).cast("int")).alias("land_cover"),
        (c("l_orderkey") % 3).cast("int").alias("orient"), F.concat(F.lit("gt"), (c("l_linenumber") % 3 + 1).cast("string"), F.when(c("l_returnflag") == "R", "r").otherwise("l")).alias("gt"),
        (c("l_linenumber") % 2).cast("int").alias("msw"), (c("l_suppkey") % 3).cast("int").alias("snow"), (c("l_partkey") % 170).cast("int").alias("age"),
        (c("l_orderkey") % 11).cast("int").alias("kendall"), c("l_shipdate").alias("seen_at"), F.month("l_shipdate").alias("month"), F.dayofyear("l_shipdate").alias("doy"), F.year("l_shipdate").alias("year"),
    )


SEG = f"""seg AS (
  SELECT l_orderkey AS granule, l_suppkey AS tile_num, l_partkey AS part, l_linenumber AS line, l_quantity AS h_can, l_tax * 100 AS h_dif,
    l_discount * 300 AS slope, l_extendedprice / 1000 AS agb, (l_extendedprice / 1000) * (CAST(0.05 AS DOUBLE) + l_discount) AS agb_sd,
    CAST(([{", ".join(map(str, CODES))}])[CAST(l_partkey % {len(CODES)} AS INTEGER) + 1] AS INTEGER) AS land_cover,
    CAST(l_orderkey % 3 AS INTEGER) AS orient, 'gt' || CAST(l_linenumber % 3 + 1 AS VARCHAR) || CASE WHEN l_returnflag = 'R' THEN 'r' ELSE 'l' END AS gt,
    CAST(l_linenumber % 2 AS INTEGER) AS msw, CAST(l_suppkey % 3 AS INTEGER) AS snow, CAST(l_partkey % 170 AS INTEGER) AS age,
    CAST(l_orderkey % 11 AS INTEGER) AS kendall, l_shipdate AS seen_at, CAST(month(l_shipdate) AS INTEGER) AS month,
    CAST(dayofyear(l_shipdate) AS INTEGER) AS doy, CAST(year(l_shipdate) AS INTEGER) AS year
  FROM lineitem)"""
CEILING = "ceil_ AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {float(v)})" for k, v in HEIGHT_CEILING.items()) + ") AS t(land_cover, ceiling))"
BEAM = "CASE WHEN (orient = 1 AND gt LIKE '%r') OR (orient = 0 AND gt LIKE '%l') THEN 'Strong' WHEN (orient = 1 AND gt LIKE '%l') OR (orient = 0 AND gt LIKE '%r') THEN 'Weak' END"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as points: x and y are the first two components."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.get(e, F.lit(0)).cast("double").alias("x"), F.get(e, F.lit(1)).cast("double").alias("y"), F.get(e, F.lit(2)).cast("double").alias("z"), "label")


PTS = "pts AS (SELECT vec_id AS point_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, label FROM embeddings)"


def reflectance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as reflectances between 0.01 and 1."""
    from ..functions.spectral import BANDS

    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", *[(0.01 + 0.99 * (F.abs(F.get(e, F.lit(k)).cast("double")) % 1.0)).alias(b) for k, b in enumerate(BANDS)])


REFL = "refl AS (SELECT vec_id, " + ", ".join(f"CAST(0.01 AS DOUBLE) + CAST(0.99 AS DOUBLE) * (abs(CAST(embedding[{k + 1}] AS DOUBLE)) % CAST(1.0 AS DOUBLE)) AS {b}" for k, b in enumerate(("blue", "green", "red", "nir", "swir", "swir2"))) + " FROM embeddings)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points gathered on a grid of quarter units: row, col, value."""
    p = points(spark, sf_dir)
    return p.groupBy(F.floor(F.col("y") * 4).cast("int").alias("row"), F.floor(F.col("x") * 4).cast("int").alias("col")).agg(F.avg(F.col("label").cast("double")).alias("value"), F.max("label").cast("int").alias("top"))


CELLS = PTS + ", cells AS (SELECT CAST(floor(y * 4) AS INTEGER) AS row, CAST(floor(x * 4) AS INTEGER) AS col, avg(CAST(label AS DOUBLE)) AS value, CAST(max(label) AS INTEGER) AS top FROM pts GROUP BY 1, 2)"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a value over days by pixel (user)."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("pixel"), "event_id", (F.dayofyear("ts") + F.hour("ts") / 24).alias("t"), F.col("value").alias("v"), "event_type", "ts")


SER = "ser AS (SELECT user_id AS pixel, event_id, dayofyear(ts) + hour(ts) / 24 AS t, value AS v, event_type, ts FROM events)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, for comparing engines that add in different orders."""
    return df.select(*[F.round(c, digits).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])


def rounding(columns: str, digits: int = 6) -> str:
    """SQL of the same for names separated by white space."""
    return ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) AS {c}" for c in columns.split())


def chance(key: str, seed: int = 0) -> str:
    """SQL of the text by which operators.windows.hash_order() orders rows; key: SQL of its parts, separated by commas."""
    return f"md5(concat_ws(':', '{seed}', {', '.join(f'CAST({k} AS VARCHAR)' for k in key.split(', '))}))"


def number_of(text: str, digits: int = 13) -> str:
    """SQL of the number that the first hexadecimal digits of a text write."""
    return f"CAST(('0x' || substr({text}, 1, {digits})) AS BIGINT)"


def normal_steps(source: str, keys: str, stream: int = 0, name: str = "z") -> str:
    """SQL steps (named <name>0 to <name>4) that add a column <name> to the rows of `source`, which have a column sim: operators.uncertainty.hashed_normal()."""
    from ..operators.uncertainty import BY_DRAW, BY_KEY, BY_STREAM, PRIME

    seed = "CAST(0 AS BIGINT)"
    for k in keys.split(", "):
        seed = f"({seed} * 31 + CAST({k} AS BIGINT) % {PRIME}) % {PRIME}"
    a, b = 2 * stream + 1, 2 * stream + 2
    one = lambda s: f"({name}_s * {BY_KEY} + CAST(sim AS BIGINT) * {BY_DRAW} + {s * BY_STREAM} + 1) % {PRIME}"
    steps = [
        f"{name}0 AS (SELECT *, {seed} AS {name}_s FROM {source})",
        f"{name}1 AS (SELECT *, {one(a)} AS {name}_a, {one(b)} AS {name}_b FROM {name}0)",
        f"{name}2 AS (SELECT * REPLACE (({name}_a * {name}_a + {name}_s) % {PRIME} AS {name}_a, ({name}_b * {name}_b + {name}_s) % {PRIME} AS {name}_b) FROM {name}1)",
        f"{name}3 AS (SELECT * REPLACE (({name}_a * {BY_KEY} + CAST(sim AS BIGINT)) % {PRIME} AS {name}_a, ({name}_b * {BY_KEY} + CAST(sim AS BIGINT)) % {PRIME} AS {name}_b) FROM {name}2)",
        f"{name}4 AS (SELECT * EXCLUDE ({name}_a, {name}_b, {name}_s), sqrt(-2 * ln((({name}_a * {name}_a + {a}) % {PRIME} + 0.5) / CAST({PRIME} AS DOUBLE))) * cos(2 * pi() * (({name}_b * {name}_b + {b}) % {PRIME} + 0.5) / CAST({PRIME} AS DOUBLE)) AS {name} FROM {name}3)",
    ]
    return ", ".join(steps)
