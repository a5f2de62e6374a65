"""Exact deduplication of whole texts with two passes over Bloom filters.

The first pass folds 64-bit hashes of the texts' SHA-256 into two filters, `once` and `again`. A
task puts a hash into `once`, and into `again` if it meets it twice; two tasks' filters merge as
once = a.once | b.once, again = a.again | b.again | (a.once & b.once), so every hash that occurs
twice anywhere has all its bits in `again`. The second pass probes `again`: rows that miss it are
alone and pass straight through; the rest, repeated ones and a few false alarms, are shuffled by
digest and settled exactly.

Sizes: a filter has BITS_PER_ROW bits a row up to 2**MOST_LOG2_BITS (32 MB), so what is broadcast is
bounded. Beyond some 17 million rows the hashes are cut by their first bits into parts that each fill one
such filter, and the two passes run for one part after another, over that part's hashes alone: the share of
lone rows that a filter lets through stays the same at any size. Filters travel in slices and tasks merge
slices one row at a time. A digest with a thousandth of all rows or more
joins by broadcast, as there are a thousand such digests at most; partial aggregation comes before every
shuffle, so a group of any size is spread over the cluster.

Texts are equal when identical; null counts as empty. Of equal texts the row with the largest
doc_id stays, a null doc_id being the smallest; rows with the same doc_id too are told apart by
where they stand, and exactly one stays. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, texts, tidied, written

BITS_PER_ROW, PROBES, LEAST_LOG2_BITS, MOST_LOG2_BITS = 16, 6, 16, 28
#: Of the filter of repeated hashes alone, for more rows than one filter takes (128 MB).
LARGE_LOG2_BITS = 30
SLICE_BYTES = 1 << 13


def places(hashes: np.ndarray, log2_bits: int) -> np.ndarray:
    """PROBES bit places of each hash, by double hashing."""
    h = hashes.view(np.uint64)
    first, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((first[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64((1 << log2_bits) - 1)).astype(np.int64)


def with_bits(hashes: np.ndarray, log2_bits: int) -> np.ndarray:
    bits = np.zeros((1 << log2_bits) // 8, np.uint8)
    for a in range(0, len(hashes), 1 << 18):
        at = places(hashes[a : a + (1 << 18)], log2_bits).reshape(-1)
        np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    return bits


def probe(bits: np.ndarray, hashes: np.ndarray, log2_bits: int) -> np.ndarray:
    at = places(hashes, log2_bits)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def log2_size(rows: int, most: int) -> int:
    return int(np.clip(np.ceil(np.log2(max(1, rows) * BITS_PER_ROW)), min(LEAST_LOG2_BITS, most), most))


def sliced(once: np.ndarray, again: np.ndarray):
    """A filter's slices with any bit, as rows (slice, once, again)."""
    a, b = once.reshape(-1, SLICE_BYTES), again.reshape(-1, SLICE_BYTES)
    some = np.flatnonzero(a.any(axis=1))
    for part in np.array_split(some, max(1, len(some) // 512)):
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([x.tobytes() for x in a[part]], pa.binary()), pa.array([x.tobytes() for x in b[part]], pa.binary())], names=["slice", "once", "again"])


def merged(hashes: DataFrame, rows: int, which: str, most: int | None = None) -> tuple[np.ndarray, int]:
    """The `once` or `again` filter of a column of 64-bit hashes, and the logarithm of its bits.

    Tasks merge slices of tasks; what reaches the driver is one filter, 32 MB at most.
    """
    log2_bits = log2_size(rows, most or MOST_LOG2_BITS)

    def collect(batches):
        once = again = None
        for batch in batches:
            kinds, counts = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_counts=True)
            own, twice = with_bits(kinds, log2_bits), with_bits(kinds[counts > 1], log2_bits)
            once, again = (own, twice) if once is None else (once | own, again | twice | (once & own))
        if once is not None:
            yield from sliced(once, again)

    def merge(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k, once, again in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                a, b = (np.frombuffer(x.as_py(), np.uint8) for x in (once, again))
                if k in held:
                    held[k][1] = held[k][1] | b | (held[k][0] & a)
                    held[k][0] = held[k][0] | a
                else:
                    held[k] = [a, b]
        for k, (a, b) in held.items():
            bits = a if which == "once" else b
            if bits.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([bits.tobytes()], pa.binary())], names=["slice", "bits"])

    slices = hashes.mapInArrow(tidied(collect), "slice long, once binary, again binary").repartition("slice").mapInArrow(tidied(merge), "slice long, bits binary")
    out = np.zeros((1 << log2_bits) // 8, np.uint8)
    for r in slices.collect():
        out[r["slice"] * SLICE_BYTES : (r["slice"] + 1) * SLICE_BYTES] = np.frombuffer(r["bits"], np.uint8)
    return out, log2_bits


def asked(filter_: tuple[np.ndarray, int], spark):
    """A function of a column of hashes: may the filter hold them?"""
    shared = spark.sparkContext.broadcast(filter_)

    @F.pandas_udf("boolean")
    def maybe(h):
        import pandas as pd

        return pd.Series(probe(shared.value[0], h.to_numpy(), shared.value[1]))

    return maybe


def prefix_bits(rows: int) -> int:
    """Of hashes, so that a part's rows fill a filter of the largest size no more than a small one."""
    return max(0, (-(-rows * BITS_PER_ROW // (1 << MOST_LOG2_BITS)) - 1).bit_length())


def _part(h: str, bits: int):
    return F.shiftrightunsigned(h, 64 - bits).cast("int") if bits else F.lit(0)


def _digests(docs: DataFrame) -> DataFrame:
    rows = texts(docs).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
    return rows.withColumns({"h": F.xxhash64("digest"), "row": F.monotonically_increasing_id()})


def flagged(rows: DataFrame, n: int, bits: int) -> DataFrame:
    """Rows (with h and, if there are several, part) with whether their hash may occur twice: a filter for each part of the hashes.

    Parts are folders, so each is read alone; its flags are written before the next part's filter is made, so one
    filter is broadcast at a time.
    """
    out = None
    for k in range(1 << bits):
        own = rows.filter(F.col("part") == k).drop("part") if bits else rows
        size = own.count() if bits else n
        maybe = asked(merged(own.select("h"), size, "again"), rows.sparkSession)
        found = written(own.withColumn("maybe", maybe(F.col("h"))), "flagged")
        out = found if out is None else out.unionByName(found)
    return out


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of docs."""
    bits = prefix_bits(docs.count())
    rows = written(_digests(docs).withColumn("part", _part("h", bits)), "digests", ["part"]) if bits else written(_digests(docs), "digests")
    n = rows.count()
    marked = flagged(rows, n, bits)
    alone = marked.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    rest = marked.filter("maybe").select("doc_id", "digest", "row")
    each = written(rest.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size")), "groups")
    joined = join_skewed(rest, each, ["digest"], "group_size", n)
    settled = joined.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "digest")
    return alone.unionByName(settled).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, all columns; only possibly repeated rows are shuffled.

    Equal texts are put together by a partial maximum before and a maximum after the shuffle. Of rows with the same
    text and doc_id the one whose other columns hash highest stays.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    row = docs.select(F.struct(*columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("digest"))
    row = row.withColumn("h", F.xxhash64("digest"))
    hashes = written(_digests(docs).select("h"), "hashes")
    n = hashes.count()
    bits = prefix_bits(n)
    if bits:  # too many for one filter: those that do repeat are found part by part, and a filter holds them alone
        parts = written(hashes.withColumn("part", _part("h", bits)), "hashes", ["part"])
        again = flagged(parts, n, bits).filter("maybe").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
        again = written(again, "repeated")
        found = merged(again, again.count(), "once", LARGE_LOG2_BITS)
    else:
        found = merged(hashes, n, "again")
    known = row.withColumn("maybe", asked(found, docs.sparkSession)(F.col("h")))
    alone = known.filter(~F.col("maybe")).select("row.*")
    best = known.withColumn("tie", F.xxhash64(F.to_json("row"))).filter("maybe").groupBy("digest").agg(F.max_by("row", F.struct("id", "tie")).alias("row"))
    return alone.unionByName(best.select("row.*"))


#: The same rows by SQL.
ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
