"""Token-id files of patched frame-of-reference blocks.

A file is a Parquet table, so that any store Spark knows can hold it and its commit protocol
guards it; each row is one segment: some neighbouring documents in ascending doc_id order with, in
`payload`, their ids. `range` and `segment` order the segments, `before` is the number of ids of its range before it. A payload is, little-endian:

    magic b"PFR1", then unsigned 32-bit: block size, documents, blocks, packed bytes, exceptions;
    signed 64-bit number of ids; documents' doc_id (signed 64-bit), null marks (a byte each), and
    ids (unsigned 32-bit); for each block its minimum (unsigned 32-bit), width (a byte), number of
    exceptions (unsigned 16-bit) and start among the packed bytes (unsigned 32-bit); the packed
    bytes; the exceptions' places in their blocks (unsigned 16-bit) and their high bits (unsigned
    32-bit).

In a block the minimum is subtracted; the width is the bits that hold a given percentile of the
differences; the higher bits of larger ones are exceptions. The last block is filled up with its
minimum. The index of block starts lets a reader unpack some blocks alone.

Nulls: a null text is empty and has the end id alone; a null doc_id sorts first and stays null.
Rows that repeat a doc_id are written one after another, each as a document. An empty table gives
an empty file. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import texts, tidied, written
from .token_ids import encoder

MAGIC = b"PFR1"
BLOCK = 128
HEAD = struct.Struct("<4s5Iq")
FILE_SCHEMA = "range int, segment int, before long, first_doc long, n_docs int, n_tokens long, payload binary"
#: Ids that a segment holds at least, but for a partition's last.
SEGMENT_TOKENS = 2_000_000
#: Blocks whose bits are moved at a time, so that they stay in a core's cache.
PART_BLOCKS = 1024


def _overlaps(width: int):
    """(i, j, shift): of every eight values, width bytes when packed, value i shares bits with byte j if shifted left by shift (right, if negative)."""
    for i in range(8):
        for j in range(i * width // 8, -(-(i + 1) * width // 8)):
            yield i, j, 8 * (j + 1) - (i + 1) * width


def _shifted(values: np.ndarray, by: int) -> np.ndarray:
    return values << np.uint32(by) if by >= 0 else values >> np.uint32(-by)


def _parts(rows: np.ndarray):
    return np.array_split(rows, -(-len(rows) // PART_BLOCKS))


def pack_blocks(ids: np.ndarray, block: int = BLOCK, percentile: float = 0.9):
    """(minima, widths, exception counts, block starts, packed bytes, exception places, high bits)."""
    n = -(-len(ids) // block)
    full = np.empty(n * block, np.uint32)
    full[: len(ids)] = ids
    if n * block > len(ids):
        full[len(ids) :] = ids[(n - 1) * block :].min()
    full = full.reshape(n, block)
    minima = full.min(axis=1) if n else np.empty(0, np.uint32)
    rest = full - minima[:, None]
    need, widths = int(np.ceil(percentile * block)), np.full(n, 32, np.uint8)
    for w in range(min(31, int(rest.max(initial=0)).bit_length()), -1, -1):  # the smallest width that holds enough of the block
        fits = (rest < np.uint32(1 << w)).sum(axis=1) >= need
        if not fits.any():
            break
        widths[fits] = w
    sizes = widths.astype(np.int64) * block // 8
    starts = np.cumsum(sizes) - sizes
    packed = np.zeros(int(sizes.sum()), np.uint8)
    high = rest >> widths[:, None].astype(np.uint32)
    at, place = np.nonzero(high)
    for w in map(int, np.unique(widths)):
        if not w:
            continue
        into = np.lib.stride_tricks.sliding_window_view(packed, w * block // 8, writeable=True)
        for part in _parts(np.flatnonzero(widths == w)):
            low = (rest[part] & np.uint32((1 << w) - 1)).reshape(-1, 8)
            bits = np.zeros((len(low), w), np.uint8)
            for i, j, shift in _overlaps(w):
                bits[:, j] |= _shifted(low[:, i], shift).astype(np.uint8)
            into[starts[part]] = bits.reshape(len(part), -1)
    return minima, widths, np.bincount(at, minlength=n).astype(np.uint16), starts.astype(np.uint32), packed, place.astype(np.uint16), high[at, place]


def unpack_blocks(minima, widths, counts, starts, packed, places, high, block: int = BLOCK) -> np.ndarray:
    out = np.zeros((len(minima), block), np.uint32)
    for w in map(int, np.unique(widths)):
        if not w:
            continue
        held = np.lib.stride_tricks.sliding_window_view(packed, w * block // 8)
        for part in _parts(np.flatnonzero(widths == w)):
            bits = held[starts[part]].reshape(-1, w).astype(np.uint32)
            low = np.zeros((len(bits), 8), np.uint32)
            for i, j, shift in _overlaps(w):
                low[:, i] |= _shifted(bits[:, j], -shift)
            out[part] = (low & np.uint32((1 << w) - 1)).reshape(len(part), block)
    at = np.repeat(np.arange(len(minima)), counts)
    out[at, places] |= high << widths[at].astype(np.uint32)
    return (out + minima[:, None]).reshape(-1)


def encode_segment(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    minima, widths, counts, starts, packed, places, high = pack_blocks(ids)
    return b"".join(
        [
            HEAD.pack(MAGIC, BLOCK, len(doc_ids), len(minima), len(packed), len(places), len(ids)),
            np.asarray([d or 0 for d in doc_ids], "<i8").tobytes(),
            bytes(d is None for d in doc_ids),
            np.asarray(lengths, "<u4").tobytes(),
            *(np.ascontiguousarray(x, t).tobytes() for x, t in ((minima, "<u4"), (widths, "u1"), (counts, "<u2"), (starts, "<u4"), (packed, "u1"), (places, "<u2"), (high, "<u4"))),
        ]
    )


class Segment:
    """Reads a payload: doc_ids, lengths, ids() and block-wise read(first, last)."""

    def __init__(self, payload: bytes):
        magic, self.block, docs, blocks, packed, exceptions, self.n_tokens = HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a token-id segment")
        at = HEAD.size
        got = []
        for n, t in ((docs, "<i8"), (docs, "u1"), (docs, "<u4"), (blocks, "<u4"), (blocks, "u1"), (blocks, "<u2"), (blocks, "<u4"), (packed, "u1"), (exceptions, "<u2"), (exceptions, "<u4")):
            got.append(np.frombuffer(payload, t, n, at))
            at += got[-1].nbytes
        self.doc_ids = [None if null else int(d) for d, null in zip(got[0], got[1])]
        self.lengths, self.parts = got[2], got[3:]

    def ids(self) -> np.ndarray:
        return unpack_blocks(*self.parts, block=self.block)[: self.n_tokens]

    def read(self, first: int, last: int) -> np.ndarray:
        """Ids first to last - 1 of the segment, from the blocks that hold them."""
        if first >= last:
            return np.empty(0, np.uint32)
        a, b = first // self.block, -(-last // self.block)
        minima, widths, counts, starts, packed, places, high = self.parts
        e = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        return unpack_blocks(minima[a:b], widths[a:b], counts[a:b], starts[a:b], packed, places[e[a] : e[b]], high[e[a] : e[b]], self.block)[first - a * self.block : last - a * self.block]


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 1, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Write the segments of docs to the shared folder; the table of them, as read back.

    Documents are dealt out by ranges of doc_id and sorted within them, so a segment's number
    (range, then place in it) rises with doc_id. The task that writes a range counts what lies before each segment.
    """

    def encode(batches):
        part, k, before, coder = TaskContext.get().partitionId(), 0, 0, encoder(tokenizer)
        end = np.asarray([end_id], np.uint32)
        doc_ids, lengths, parts, total = [], [], [], 0

        def segment():
            return pa.RecordBatch.from_pylist(
                [{"range": part, "segment": k, "before": before, "first_doc": doc_ids[0], "n_docs": len(doc_ids), "n_tokens": total, "payload": encode_segment(doc_ids, lengths, np.concatenate(parts))}],
                pa.schema([("range", pa.int32()), ("segment", pa.int32()), ("before", pa.int64()), ("first_doc", pa.int64()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("payload", pa.binary())]),
            )

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1).to_pylist())):
                doc_ids.append(doc_id)
                lengths.append(len(ids) + 1)
                parts += ids.copy(), end
                total += len(ids) + 1
                if total >= segment_tokens:
                    yield segment()
                    k, before = k + 1, before + total
                    doc_ids, lengths, parts, total = [], [], [], 0
        if doc_ids:
            yield segment()

    ordered = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(tidied(encode), FILE_SCHEMA), "token-files")


def read_token_files(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of the segments.

    Payloads stay where they are read: one number for each range, a range being a task that wrote, is added
    up in one task and broadcast.
    """
    sizes = segments.groupBy("range").agg(F.sum("n_tokens").alias("n"))
    begins = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("begin"))

    def decode(batches):
        for batch in batches:
            for payload, base in zip(batch.column(0), batch.column(1).to_pylist()):
                segment = Segment(payload.as_py())
                ids = segment.ids().astype("<u4")
                ends = np.cumsum(segment.lengths, dtype=np.int64)
                starts = ends - segment.lengths
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(segment.doc_ids, pa.int64()),
                        pa.array(starts + base, pa.int64()),
                        pa.array(segment.lengths.astype(np.int64)),
                        pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)], pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    placed = segments.select("range", "before", "payload").join(F.broadcast(begins), "range")
    return placed.select("payload", (F.col("begin") + F.col("before")).alias("base")).mapInArrow(tidied(decode), "doc_id long, start long, n_tokens long, ids_crc32 long")
