"""Hierarchical packing of tokenised documents into training sequences of several lengths.

Each document's ids (end id included) are cut into full windows of the longest tier; the remainder
is routed to the shortest tier that holds it. Tiers are packed from the longest down: a window
opens with the longest piece of its tier, its gap takes the longest pieces that fit from shorter
tiers, and the last gap is filled by cutting a piece. Tier lengths are powers of two, and what is
left when no piece can fill a window is cut at powers of two, so no sequence needs padding.
Sequences are then dealt in turn, longest first and back again, to step groups of equal work.

Packing works in blocks of BLOCK_TOKENS within a partition, so nothing shuffles and memory is
bounded; a sequence never spans two blocks. Sequence ids are the partition's number and a count in
it: a lost task's rerun gives the same ones.

Nulls: a null text is empty and has the end id alone; a null doc_id stays null. Rows that repeat a
doc_id are packed each. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import texts, tidied
from .token_ids import encoder

TIERS = (128, 256, 512, 1024)
BLOCK_TOKENS = 2_000_000
STEP_TOKENS = 65_536
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, tier long, step_group long"


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document's place, start, length); tiers: rising powers of two.

    Every id lies in exactly one piece, and every sequence's length is a power of two up to the
    longest tier.
    """
    longest = tiers[-1]
    sequences: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []  # (length, document, start), rising
    for doc, n in enumerate(lengths):
        for start in range(0, n - longest + 1, longest):
            sequences.append([(doc, start, longest)])
        if n % longest:
            rest.append((n % longest, doc, n - n % longest))
    rest.sort()
    left = sum(p[0] for p in rest)

    def fill(window: list[tuple[int, int, int]], gap: int) -> None:
        """Shorter pieces that fit, longest first; then a cut one."""
        while gap:
            k = bisect.bisect_right(rest, (gap, float("inf"), 0)) - 1
            if k >= 0:
                n, doc, start = rest.pop(k)
                window.append((doc, start, n))
                gap -= n
            else:  # all that are left are longer
                n, doc, start = rest.pop(0)
                window.append((doc, start, gap))
                bisect.insort(rest, (n - gap, doc, start + gap))
                gap = 0

    for tier, below in zip(reversed(tiers), [*reversed(tiers[:-1]), 0]):
        while rest and below < rest[-1][0] <= tier <= left:
            n, doc, start = rest.pop()
            window = [(doc, start, n)]
            fill(window, tier - n)
            sequences.append(window)
            left -= tier
    while left:  # less than a window of the tier that its longest piece needs
        size = min(longest, 1 << (left.bit_length() - 1))
        window = []
        fill(window, size)
        sequences.append(window)
        left -= size
    return sequences


def step_groups(lengths: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """The step group of each sequence: dealt longest first, to and fro, so groups weigh the same."""
    n = max(1, -(-sum(lengths) // step_tokens))
    out = [0] * len(lengths)
    for k, i in enumerate(sorted(range(len(lengths)), key=lambda i: -lengths[i])):
        lap, at = divmod(k, n)
        out[i] = n - 1 - at if lap % 2 else at
    return out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, tiers: tuple[int, ...] = TIERS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece of a document (SCHEMA)."""

    def run(batches):
        part, coder = TaskContext.get().partitionId(), encoder(tokenizer)
        end = np.asarray([end_id], "<u4")
        doc_ids, ids, total, made, steps = [], [], 0, 0, 0

        def block():
            nonlocal made, steps
            columns: list[list[int]] = [[] for _ in range(10)]
            sequences = pack([len(x) for x in ids], tiers)
            sizes = [sum(p[2] for p in s) for s in sequences]
            group = step_groups(sizes)
            for k, (pieces, size) in enumerate(zip(sequences, sizes)):
                offset = 0
                for doc, start, n in pieces:
                    row = (doc_ids[doc], start, n, zlib.crc32(ids[doc][start : start + n].tobytes()), len(ids[doc]), (part << 36) + made + k, offset, size, next(t for t in tiers if t >= size), (part << 36) + steps + group[k])
                    for column, value in zip(columns, row):
                        column.append(value)
                    offset += n
            made += len(sequences)
            steps += max(group, default=-1) + 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, got in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1).to_pylist())):
                doc_ids.append(doc_id)
                ids.append(np.concatenate([got, end]))
                total += len(got) + 1
                if total >= block_tokens:
                    yield block()
                    doc_ids, ids, total = [], [], 0
        if ids:
            yield block()

    return texts(docs).mapInArrow(tidied(run), SCHEMA)
