"""Helpers that the text operators share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own_dir: dict[str, str] = {}
#: Spark's setting of the bytes of an Arrow batch, its default and what whole texts are sent in.
BATCH_SETTING, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608b"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only a local-mode session without the setting gets a folder of its own; on a cluster the
    setting is required, because a machine-local folder would not reach the other executors.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="silvaflow-")
    return _own_dir[app]


def written(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder (in folders by some columns) and read it back.

    Spark's commit protocol makes the files whole even if executors are lost. The files live as
    long as the cluster keeps its checkpoint folder, as those of checkpoint() do.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def removed(*tables: DataFrame) -> None:
    """Remove the files of tables from written() that nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose session from now on sends Arrow batches of 8 MB to Python, unless the setting was given another value.

    A batch and its copies are held by Spark and by Python at once, for each task.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, BATCH_DEFAULT) == BATCH_DEFAULT:
        conf.set(BATCH_SETTING, BATCH_BYTES)
    return df


def tidied(run):
    """run, which at its end gives what it has freed back to the system: a Python worker lives on for other tasks."""

    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return wrapped


def over_rows(docs: DataFrame, run) -> DataFrame:
    """Batches of whole rows through run, which keeps their columns; these go by place, so that any name will do."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    plain = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema)])
    return small_batches(docs).toDF(*names).mapInArrow(tidied(run), plain).toDF(*docs.columns)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id (long) and text (null becomes empty); other columns go."""
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null stays null."""
    return F.crc32(doc_id.cast("string")) % parts


def bounded_rows(sample: DataFrame, parts: int = 8):
    """Yields the rows of a sample of bounded size with a doc_id, in an order of its own.

    One parallel job finds them and puts them into a few partitions, which come one by one.
    """
    return sample.repartition(parts, "doc_id").sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").toLocalIterator()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """A tokenizer file's place; the folder can be set by SILVAFLOW_TOKENIZERS."""
    if folder := os.environ.get("SILVAFLOW_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def join_skewed(left: DataFrame, right: DataFrame, keys: list[str], size: str, rows: int, parts: int = 1000) -> DataFrame:
    """left inner-joined to right, which has one row for each key and in `size` the number of left's rows.

    Keys with 1/parts of all rows or more are at most `parts`, so these join by broadcast and their
    rows stay where they are; the others are shuffled, none of them large.
    """
    heavy = F.col(size) * parts >= rows
    marked = left.join(F.broadcast(right.filter(heavy)), keys, "left")
    new = [c for c in right.columns if c not in keys]
    few = marked.filter(F.col(size).isNull()).drop(*new).join(right.filter(~heavy), keys)
    return few.unionByName(marked.filter(F.col(size).isNotNull()).select(*few.columns))
