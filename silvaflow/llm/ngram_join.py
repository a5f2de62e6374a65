"""Near-duplicate documents: an exact Jaccard self-join on word shingles by signature trees.

Words are runs of anything but ASCII white space, with A-Z lower-cased; a document's set holds its
distinct shingles of five words (64-bit hashes), or its whole sequence if it is shorter. Documents
link when 100 * intersection >= 80 * union.

1. Documents with equal sets form a class; only classes are compared.
2. Dealing out. Two linked sets of sizes a <= b differ in at most (a + b) / 9 shingles. Shingles are
   dealt by hash to more cells than that, so some cell holds the same shingles in both (pigeonhole).
   Cells depend on the size band of the larger set; a set enters its own band and, if a partner of
   at most 1.25 times its size can lie there, the next. Cells that are empty in a set are left out
   unless so many are that every other cell might differ. Of the cells of which t at least are the same in
   any partner's set, t - 1 needn't be dealt: in an order of all cells, the first shared one of two linked
   sets comes before either's last t - 1 (prefix filter). Cells met by many tasks come last in that order,
   so common passages don't chain unlike sets together. Sets that share a cell may be linked; the
   connected components of that relation are the groups to compare. A task first folds equal cells
   of its own rows into one row and a few links, so a very frequent cell is one row from each task.
3. Signature trees. Each group's sets are the leaves of a tree, ordered by their smallest hashes; a
   node holds the OR of its leaves' bitmaps, their range of sizes and how far sizes exceed bitmaps.
   The dual traversal descends into all pairs of nodes whose sizes and largest possible overlap may
   still reach 0.8; pairs of leaves that pass are compared exactly. Small groups share tasks. A group
   too large for one is cut into chunks, and each chunk meets itself and every other one in a task
   of its own, so each pair of sets is looked at once.
4. The links' connected components give component_id. A class's links are counted with the members
   of the classes that it links with; n_links adds the other members of its own class.

No link is missed, capped or left uncounted. Sets and links stay distributed; of a task's links, their
numbers for each class and a star for each component go out.

Nulls: a null or blank text has an empty set and links with nothing; rows with a null doc_id are
returned, link with nothing and have a null component_id. Rows that repeat a doc_id count as one
document with each of these sets; n_links counts rows: all others with a doc_id whose set links. An empty table gives an empty result. Other columns are ignored by
near_duplicates(), kept by one_of_each().
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, texts, tidied, written
from .components import connected, forest
from .exact_dedup import asked, merged, probe

SHINGLE = 5
BITS = 2048
LEAVES, FANOUT = 32, 8
#: What one task compares at a time, or twice that: sets, and shingles in them.
CHUNK_SETS, CHUNK_SHINGLES = 4096, 3_000_000
#: Rows of cells that a task folds at a time; shingles of all documents whose cells make a part; bytes of a cell's key there.
FOLD_ROWS, PART_SHINGLES, KEY_BYTES = 1_000_000, 1_000_000, 7
#: Pairs of a block from which on it is compared by a matrix product, and the most shared shingles for that.
MANY, WIDE = 16, 65_536
LOW_BITS, MARK = np.uint64(127), np.uint64(64)
#: Rows of a cell, one from each fold of a task, from which on it counts as frequent.
FREQUENT = 4


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of a text."""
    from xxhash import xxh3_64_intdigest

    words = text.encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    w = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    if not len(w):
        return w
    n = min(SHINGLE, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k]
    return np.unique(mix(h))


def digest(found: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed 64-bit integers."""
    from xxhash import xxh3_128_digest

    hi, lo = np.frombuffer(xxh3_128_digest(found.tobytes()), ">i8")
    return int(hi), int(lo)


def bands() -> tuple[list[int], list[int], list[int]]:
    """Of size bands: the least size, the most differences of a pair whose larger set lies there, cells."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(max(low[-1] + 1, low[-1] * 8 // 5))
    most = [2 * (b - 1) // 9 for b in low[1:]]
    return low, most, [d + 1 + (-(-d // 10) + 1 if d else 0) for d in most]


LOW, MOST, CELLS = bands()
LOWS = np.array(LOW)


def cells(found: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(band, how many of its cells must be shared, keys of its cells) of each band that a set enters.

    A key's lowest six bits are the band; bit 6 is left for a mark.
    """
    n = len(found)
    own = int(np.searchsorted(LOWS, n, side="right")) - 1
    out = []
    spread = mix(found + np.uint64(0x632BE59BD9B4E019))
    for band in (own, own + 1) if n * 5 // 4 >= LOW[own + 1] else (own,):
        if not MOST[band]:
            continue  # linked sets of this band are equal
        # the largest partner of this band that may be linked bounds the differences
        differ = (n + min(n * 5 // 4, LOW[band + 1] - 1)) // 9
        k = CELLS[band]
        cell = (found % np.uint64(k)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        name = np.uint64(band << 48) + cell[starts].astype(np.uint64)
        keys = mix(np.add.reduceat(spread[order], starts) + mix(name))
        if len(starts) <= differ:  # all cells with shingles may differ from a partner's: the empty ones count too
            empty = np.setdiff1d(np.arange(k), cell[starts])
            keys = np.concatenate([keys, mix(np.uint64(band << 48) + empty.astype(np.uint64))])
        out.append((band, len(starts) - differ, (keys & ~LOW_BITS) | np.uint64(band)))
    return out


def fold_equal(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one row for each key: keys, ids) and links (n x 2) that tie the ids of a key together."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    first = np.repeat(ids[starts], np.diff(np.concatenate([starts, [len(keys)]])))
    other = first != ids
    return keys[starts], ids[starts], forest(ids[other], first[other])


def pack_rows(keys: np.ndarray, ids: np.ndarray) -> bytes:
    """Rows (56 bits of a key, id): ids by their distance from the least one, in as few bytes as that takes."""
    base = int(ids.min())
    away = (ids - base).astype("<u8")
    width = max(1, (int(away.max()).bit_length() + 7) // 8)
    return struct.pack("<qBI", base, width, len(ids)) + keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes() + away.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_rows(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    base, width, n = struct.unpack_from("<qBI", blob)
    at = struct.calcsize("<qBI")
    out = []
    for size in (KEY_BYTES, width):
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :size] = np.frombuffer(blob, np.uint8, n * size, at).reshape(n, size)
        out.append(wide.view("<u8").reshape(-1))
        at += n * size
    return out[0], out[1].astype(np.int64) + base


def cell_hashes(keys: np.ndarray) -> np.ndarray:
    """64-bit hashes of cells by what pack_rows() keeps of their keys, the mark aside."""
    return mix(keys & np.uint64((1 << 8 * KEY_BYTES) - 1) & ~MARK).view(np.int64)


def firsts(keys: np.ndarray, sums: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Which cells of dealt() are to go out: of each set and band all but the last of those that must be shared less one, frequent ones last."""
    sizes, owner = sums[:, 3], np.repeat(np.arange(len(sums)), sums[:, 3])
    order = np.lexsort((keys, frequent, owner))
    place = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.empty(len(keys), bool)
    out[order] = place <= (sizes - np.maximum(sums[:, 2], 1))[owner]
    return out


def enough(common, a, b):
    return 100 * common >= 80 * (a + b - common)


class Tree:
    """A signature tree over distinct sets, for joining them with one another, or only those of unlike sides."""

    def __init__(self, sets: list[np.ndarray], members: list[int], sides: list[int], across: bool):
        order = sorted(range(len(sets)), key=lambda i: (sides[i], int(sets[i][0]), int(sets[i][1 % len(sets[i])]), len(sets[i]), i))
        self.order, self.sets, self.across = order, [sets[i] for i in order], across
        self.sizes = np.array([len(s) for s in self.sets])
        self.members = np.array([members[i] for i in order], np.int64)
        self.sides = np.array([sides[i] for i in order], np.int64)
        self.bits = np.zeros((len(sets), BITS // 64), np.uint64)
        for k, s in enumerate(self.sets):
            b = (s % np.uint64(BITS)).astype(np.int64)
            np.bitwise_or.at(self.bits[k], b >> 6, np.uint64(1) << (b & 63).astype(np.uint64))
        self.excess = self.sizes - np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        self.parent = list(range(len(sets)))
        self.counts = np.zeros(len(sets), np.int64)
        self.nodes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        #: levels from the leaves' nodes up: (bitmaps, least size, most size, most excess, least side, most side), and leaves a node
        self.levels, self.widths = [], []
        values, width = (self.bits, self.sizes, self.sizes, self.excess, self.sides, self.sides), 1
        for fan in (LEAVES, *[FANOUT] * 20):
            starts = np.arange(0, len(values[0]), fan)
            by = (np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum)
            values = tuple(f.reduceat(v, starts) for f, v in zip(by, values))
            width *= fan
            self.levels.append(values)
            self.widths.append(width)
            if len(starts) == 1:
                break

    def root(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = k = self.parent[self.parent[k]]
        return k

    def span(self, level: int, k: int) -> range:
        return range(k * self.widths[level], min(len(self.sets), (k + 1) * self.widths[level]))

    def possible(self, level: int, i: int, j: int) -> bool:
        bits, least, most, excess, first, last = self.levels[level]
        if self.across and first[i] == last[i] == first[j] == last[j]:
            return False
        if 5 * most[i] < 4 * least[j] or 5 * most[j] < 4 * least[i]:
            return False
        overlap = int(np.bitwise_count(bits[i] & bits[j]).sum()) + int(min(excess[i], excess[j]))
        return 9 * min(overlap, most[i], most[j]) >= 4 * (least[i] + least[j])

    def node(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct shingles of a leaves' node, and (leaf, place among them) of all its shingles."""
        if i not in self.nodes:
            span = self.span(0, i)
            names, at = np.unique(np.concatenate([self.sets[k] for k in span]), return_inverse=True)
            self.nodes[i] = names, np.repeat(np.arange(len(span)), self.sizes[span.start : span.stop]), at.reshape(-1)
        return self.nodes[i]

    def common(self, i: int, j: int, near: np.ndarray) -> np.ndarray:
        """Exact sizes of the intersections of the leaves of two nodes, at least where near."""
        rows, columns = self.span(0, i), self.span(0, j)
        if np.count_nonzero(near) >= MANY:
            (a, *left), (b, *right) = self.node(i), self.node(j)
            _, x, y = np.intersect1d(a, b, assume_unique=True, return_indices=True)
            if len(x) <= WIDE:
                sides = []
                for names, (leaf, at), shared, n in ((a, left, x, len(rows)), (b, right, y, len(columns))):
                    column = np.full(len(names), -1, np.int64)
                    column[shared] = np.arange(len(shared))
                    column = column[at]
                    sides.append(np.zeros((n, len(shared)), np.float32))
                    sides[-1][leaf[column >= 0], column[column >= 0]] = 1
                return np.rint(sides[0] @ sides[1].T).astype(np.int64)
        out = np.zeros(near.shape, np.int64)
        for x, y in zip(*np.nonzero(near)):
            out[x, y] = len(np.intersect1d(self.sets[rows[x]], self.sets[columns[y]], assume_unique=True))
        return out

    def leaves(self, i: int, j: int) -> None:
        rows, columns = self.span(0, i), self.span(0, j)
        a, b = slice(rows.start, rows.stop), slice(columns.start, columns.stop)
        both = np.bitwise_count(self.bits[a, None, :] & self.bits[None, b, :]).sum(axis=2, dtype=np.int64)
        m, n = self.sizes[a, None], self.sizes[None, b]
        overlap = both + np.minimum(self.excess[a, None], self.excess[None, b])
        near = 9 * np.minimum(overlap, np.minimum(m, n)) >= 4 * (m + n)
        if i == j:
            near = np.triu(near, 1)
        if self.across:
            near &= self.sides[a, None] != self.sides[None, b]
        if not near.any():
            return
        common = self.common(i, j, near)
        linked = near & enough(common, m, n)
        self.counts[a] += linked @ self.members[b]
        self.counts[b] += self.members[a] @ linked
        x, y = np.nonzero(linked)
        labels = np.array([self.root(k) for k in rows]), np.array([self.root(k) for k in columns])
        for p, q in np.unique(np.stack([labels[0][x], labels[1][y]], axis=1), axis=0).tolist():
            self.parent[self.root(q)] = self.root(p)

    def join(self) -> tuple[np.ndarray, np.ndarray]:
        """For each set, in the given order: how many members of others it links with, and a set of its component."""
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, i, j = stack.pop()
            if not self.possible(level, i, j):
                continue
            if not level:
                self.leaves(i, j)
                continue
            below, n = self.widths[level] // self.widths[level - 1], len(self.levels[level - 1][0])
            for x in range(i * below, min(n, (i + 1) * below)):
                for y in range(max(j * below, x if i == j else 0), min(n, (j + 1) * below)):
                    stack.append((level - 1, x, y))
        counts, first = np.empty(len(self.sets), np.int64), np.empty(len(self.sets), np.int64)
        counts[self.order] = self.counts
        first[self.order] = [self.order[self.root(k)] for k in range(len(self.sets))]
        return counts, first


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, hi, lo) of documents; classes (hi, lo, n, id: smallest doc_id, members)."""

    def run(batches):
        for batch in batches:
            rows = [(len(s), *(digest(s) if len(s) else (0, 0))) for s in map(shingles, batch.column(1).to_pylist())]
            n, hi, lo = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, hi, lo))], names=["doc_id", "n", "hi", "lo"])

    rows = written(texts(docs).mapInArrow(tidied(run), "doc_id long, n long, hi long, lo long"), "sets")
    linked = rows.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    return rows, written(linked.groupBy("hi", "lo").agg(F.max("n").alias("n"), F.min("doc_id").alias("id"), F.count("*").alias("members")), "classes")


def grouped_rows(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of key (the mark aside) and id, and whether another row has the same key."""
    order = np.lexsort((ids, keys & ~MARK))
    keys, ids = keys[order], ids[order]
    same = (keys[1:] & ~MARK) == (keys[:-1] & ~MARK)
    return keys, ids, np.concatenate([same, [False]]) | np.concatenate([[False], same])


def tallied(ids: np.ndarray, bands: np.ndarray, counts: np.ndarray | int) -> pa.RecordBatch:
    """Rows (id, band, delta), one for each id and band."""
    names, at = np.unique(np.stack([ids, bands.astype(np.int64)], axis=1), axis=0, return_inverse=True)
    delta = np.bincount(at.reshape(-1), np.broadcast_to(counts, len(ids)), len(names)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(delta)], names=["id", "band", "delta"])


def _sharing(docs: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Ids of documents of which enough cells occur elsewhere: the others have no link. And hashes h of frequent cells.

    A sum for each document and band starts at minus the number of cells that must be shared and
    rises by one for each that is. A task folds equal cells of its rows into one marked row.
    """

    def deal(batches):
        for _, keys, ids, sums in dealt(batches):
            keys, ids, many = grouped_rows(keys, ids)
            first = np.concatenate([[True], keys[1:] != keys[:-1]])
            forward = keys[first] | np.where(many[first], MARK, np.uint64(0))
            local = tallied(np.concatenate([ids[many], sums[:, 0]]), np.concatenate([(keys[many] & np.uint64(63)).astype(np.int64), sums[:, 1]]), np.concatenate([np.ones(many.sum(), np.int64), -sums[:, 2]]))
            yield from packed(forward, ids[first], bits, np.stack([c.to_numpy() for c in local.columns], axis=1))

    def meet(batches):
        for keys, ids, passed in unpacked(batches):
            if len(passed):
                yield tallied(passed[:, 0], passed[:, 1], passed[:, 2])
            if len(keys):
                keys, ids, many = grouped_rows(keys, ids)
                new = many & ((keys & MARK) == 0)
                if new.any():
                    yield tallied(ids[new], keys[new] & np.uint64(63), 1)
                own, counts = np.unique(keys[many] & ~MARK, return_counts=True)
                often = cell_hashes(own[counts >= FREQUENT])
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (often, np.full(len(often), -1), np.zeros(len(often), np.int64))], names=["id", "band", "delta"])

    rows = texts(docs.filter(F.col("doc_id").isNotNull())).mapInArrow(tidied(deal), "part int, rows binary, passed binary").repartition("part").mapInArrow(tidied(meet), "id long, band long, delta long")
    rows = written(rows, "shared-counts")
    sums = rows.filter("band >= 0").groupBy("id", "band").agg(F.sum("delta").alias("delta"))
    return sums.filter("delta >= 0").select("id").distinct(), rows.filter("band < 0").select(F.col("id").alias("h"))


def dealt(batches):
    """(number, keys, ids, sums) of about FOLD_ROWS cells at a time; sums: rows (id, band, cells that must be shared, cells) in the cells' order."""
    keys, ids, sums, total, k = [], [], [], 0, 0
    for batch in batches:
        for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = shingles(text)
            for band, need, own in cells(found) if len(found) else ():
                keys.append(own)
                ids.append(np.full(len(own), ident, np.int64))
                sums.append((ident, band, need, len(own)))
                total += len(own)
            if total >= FOLD_ROWS:
                yield k, np.concatenate(keys), np.concatenate(ids), np.array(sums, np.int64)
                keys, ids, sums, total, k = [], [], [], 0, k + 1
    if keys:
        yield k, np.concatenate(keys), np.concatenate(ids), np.array(sums, np.int64)


def packed(keys: np.ndarray, ids: np.ndarray, bits: int, passed: np.ndarray):
    """Rows in order of key as one packed row for each part (the keys' first bits); `passed` goes along with the first."""
    part = (keys >> np.uint64(64 - bits)).astype(np.int32)
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    ends = [*starts[1:], len(keys)]
    along = [passed.astype("<i8").tobytes()] + [b""] * (len(starts) - 1)
    yield pa.RecordBatch.from_arrays([pa.array(part[starts]), pa.array([pack_rows(keys[x:y], ids[x:y]) for x, y in zip(starts, ends)], pa.binary()), pa.array(along, pa.binary())], names=["part", "rows", "passed"])


def unpacked(batches):
    """(keys, ids, passed) of each part of a partition."""
    by_part: dict[int, list[tuple[bytes, bytes]]] = {}
    for batch in batches:
        for part, rows, passed in zip(*(c.to_pylist() for c in batch.columns)):
            by_part.setdefault(part, []).append((rows, passed))
    while by_part:
        blobs = by_part.popitem()[1]
        keys, ids = map(np.concatenate, zip(*(unpack_rows(rows) for rows, _ in blobs)))
        yield keys, ids, np.frombuffer(b"".join(p for _, p in blobs), "<i8").reshape(-1, 3)


def _groups(docs: DataFrame, shingles_in_all: int) -> DataFrame:
    """id, component: groups of documents that share cells.

    Rows of a task go out in parts by the cells' first bits, each part as one packed row; the parts'
    number grows with the data, so a part keeps its size.
    """
    bits = min(24, max(3, (shingles_in_all // PART_SHINGLES).bit_length()))
    sharing, often = _sharing(docs, bits)
    sharing = written(sharing, "sharing")
    send = docs.sparkSession.sparkContext.broadcast
    shared = send(merged(sharing.select(F.xxhash64("id").alias("h")), sharing.count(), "once"))
    frequent = send(merged(often, often.count(), "once"))

    def wanted(batches):
        for batch in batches:
            yield batch.filter(pa.array(probe(shared.value[0], batch.column(2).to_numpy(), shared.value[1])))

    def deal(batches):
        for _, keys, ids, sums in dealt(wanted(batches)):
            # any one order of cells will do, so a false alarm of the filter is harmless
            out = firsts(keys, sums, probe(frequent.value[0], cell_hashes(keys), frequent.value[1]))
            keys, ids, links = fold_equal(keys[out], ids[out])
            yield from packed(keys, ids, bits, np.concatenate([links, np.zeros((len(links), 1), np.int64)], axis=1))

    def meet(batches):
        links = [np.empty((0, 2), np.int64)]
        for keys, ids, passed in unpacked(batches):
            links += fold_equal(keys, ids)[2], passed[:, :2]
        tied = forest(*np.concatenate(links).T)
        yield pa.RecordBatch.from_arrays([pa.array(tied[:, 0]), pa.array(tied[:, 1])], names=["a", "b"])

    near = texts(docs).filter(F.col("doc_id").isNotNull()).withColumn("h", F.xxhash64("doc_id"))
    rows = near.mapInArrow(tidied(deal), "part int, rows binary, passed binary").repartition("part")
    return connected(written(rows.mapInArrow(tidied(meet), "a long, b long"), "shared-cells"))


def _trees(rows: DataFrame) -> DataFrame:
    """Of rows (task, part, across, side, id, hi, lo, members, text), those of one task and part joined (across: of unlike
    sides only): links (a, b) that tie components together, and rows (hi, lo, n) of how many members each class links with."""

    def run(key, found):
        names = ("id", "part", "across", "side", "hi", "lo", "members", "text")
        ids, parts, across, sides, his, los, members, contents = (found.column(c).to_pylist() for c in names)
        by_part: dict = {}
        for k, part in enumerate(parts):
            by_part.setdefault(part, []).append(k)
        tied, counted = [np.empty((0, 2), np.int64)], []
        for places in by_part.values():
            sets, own = [], {}
            for k in places:
                # an id that comes with several texts: each class goes with its own text, once
                if (his[k], los[k]) not in own and digest(content := shingles(contents[k])) == (his[k], los[k]):
                    own[his[k], los[k]] = k
                    sets.append(content)
            at = list(own.values())
            if len(at) > 1:
                counts, first = Tree(sets, [members[k] for k in at], [sides[k] for k in at], across[at[0]]).join()
                named = np.array([ids[k] for k in at], np.int64)
                tied.append(np.stack([named, named[first]], axis=1)[named != named[first]])
                counted += [(his[k], los[k], n) for k, n in zip(at, counts.tolist()) if n]
        # as stars, which components are soon found of
        stars = forest(*np.concatenate(tied).T)
        hi, lo, n = zip(*counted) if counted else ((), (), ())
        none = lambda k: [None] * k
        columns = [*(stars[:, k].tolist() + none(len(n)) for k in (0, 1)), *(none(len(stars)) + list(x) for x in (hi, lo, n))]
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("a", "b", "hi", "lo", "n"), columns)})

    return rows.groupBy("task").applyInArrow(run, "a long, b long, hi long, lo long, n long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), n_links of each document."""
    rows, classes = _classes(docs)
    # members of groups with two sets or more: id, n, hi, lo, members, component
    grouped = written(classes.join(_groups(docs, rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]), "id"), "grouped")
    tallies = grouped.groupBy("component").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    tallies = written(tallies.filter("sets > 1").withColumn("chunks", F.greatest(F.ceil(F.col("sets") / CHUNK_SETS), F.ceil(F.col("shingles") / CHUNK_SHINGLES))), "tallies")
    total = tallies.agg(F.coalesce(F.sum("sets"), F.lit(0)).alias("sets"), F.coalesce(F.sum("shingles"), F.lit(0)).alias("shingles"), F.coalesce(F.max("chunks"), F.lit(0)).alias("chunks")).first()
    placed = join_skewed(grouped, tallies, ["component"], "sets", max(1, total.sets))
    # one text for each class; a doc_id that comes with several texts is compared with each
    text = texts(docs).withColumnRenamed("doc_id", "id").filter(F.col("id").isNotNull())
    members = placed.join(text.filter(_wanted(placed, total.sets)(F.col("id"))), "id")
    bins = max(1, -(-int(total.shingles) // (CHUNK_SHINGLES // 2)))
    columns = ["id", "hi", "lo", "members", "text"]
    small = members.filter("chunks <= 1").select(F.pmod(F.xxhash64("component"), F.lit(bins)).alias("task"), F.col("component").alias("part"), F.lit(False).alias("across"), F.lit(0).alias("side"), *columns)
    joined = written(_trees(small), "links")
    if total.chunks > 1:
        joined = joined.union(written(_trees(_large(members.filter("chunks > 1"), columns)), "links"))
    found = connected(joined.filter("a is not null").select("a", "b"))
    counts = joined.filter("n is not null").groupBy("hi", "lo").agg(F.sum("n").alias("near"))
    named = classes.join(found.select("id", "component"), "id", "left").join(counts, ["hi", "lo"], "left")
    named = named.select("hi", "lo", "members", F.coalesce("component", "id").alias("component_id"), (F.col("members") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    own = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    tied = join_skewed(rows.filter(own), named, ["hi", "lo"], "members", rows.count())
    alone = rows.filter(~F.coalesce(own, F.lit(False))).withColumn("component_id", F.col("doc_id")).withColumn("n_links", F.lit(0).cast("long"))
    return tied.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links").union(alone.select("doc_id", "n", "component_id", "n_links"))


def _wanted(ids: DataFrame, n: int):
    """A function of the id column: may it be among these? A Bloom filter of bounded size keeps other texts from being shuffled."""
    maybe = asked(merged(ids.select(F.xxhash64("id").alias("h")), n, "once"), ids.sparkSession)
    return lambda ident: maybe(F.xxhash64(ident))


def _large(members: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of the groups that don't fit one task, for _trees: a chunk meets itself and each other one in a task of their own."""
    chunk = F.pmod(F.xxhash64("hi", "lo"), F.col("chunks")).cast("long")
    every = F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)
    met = members.withColumn("chunk", chunk).withColumn("other", F.explode(every))
    x, y = F.least("chunk", "other"), F.greatest("chunk", "other")
    return met.select(F.xxhash64("component", x, y).alias("task"), F.col("component").alias("part"), (x != y).alias("across"), (F.col("chunk") > F.col("other")).cast("int").alias("side"), *columns)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that are the smallest doc_id of their component, all columns; rows with a null doc_id stay."""
    found = near_duplicates(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
