"""Connected components of a table of links, by alternating stars.

A link is kept as (a, b) with a > b. Each round every vertex learns its least neighbour: first the
larger end of a link is tied to the least neighbour of the smaller one, then all smaller neighbours
of a vertex are tied to the least of them. Paths halve in each round and links never become more;
what is left at the end is a star around the least id of each component.

Labels and links stay distributed. Before the rounds a task puts together what its own links tie, so
that links which say the same go once. The end of a link that very many others share is joined by
broadcast (join_skewed), so that no task gets all of its links; least neighbours are combined before the
shuffle. Each half of a round is written, so lineage stays short, and what it was made from is removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, removed, tidied, written

#: Rows that a task writes at least, so that small tables are few files; links that a task ties together at a time.
ROWS, TIED = 500_000, 2_000_000


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Links (id, smallest id of its component) that tie together what the links a-b do."""
    if not len(a):
        return np.empty((0, 2), np.int64)
    names, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(names))
    return np.stack([names[other], names[label[other]]], axis=1)


def tied(edges: DataFrame) -> DataFrame:
    """The same components from fewer links: all of a vertex meet in a task, which keeps a star of each component it sees."""

    def run(batches):
        held, n = [np.empty((0, 2), np.int64)], 0
        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns], axis=1))
            n += batch.num_rows
            if n >= TIED:
                held = [forest(*np.concatenate(held).T)]
                n = len(held[0])
                if n >= TIED // 2:  # nothing more to gain
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][:, k]) for k in (0, 1)], names=["a", "b"])
                    held, n = [np.empty((0, 2), np.int64)], 0
        stars = forest(*np.concatenate(held).T)
        yield pa.RecordBatch.from_arrays([pa.array(stars[:, k]) for k in (0, 1)], names=["a", "b"])

    return edges.select("a", "b").filter("a <> b").repartition("a").mapInArrow(tidied(run), "a long, b long")


def _links(a: str, b: str) -> list:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def connected(edges: DataFrame) -> DataFrame:
    """id, component (its smallest id) for each id in the columns a and b of edges."""
    links = written(tied(edges).select(*_links("a", "b")).distinct(), "links")
    n, moved = links.count(), True
    while n and moved:
        few = max(4, -(-n // ROWS))
        low = links.groupBy("a").agg(F.min("b").alias("low"))
        ends = links.groupBy("b").agg(F.count("*").alias("degree")).join(low.withColumnRenamed("a", "b"), "b", "left")
        ends = written(ends.coalesce(few), "ends")
        large = join_skewed(links.select("a", "b"), ends, ["b"], "degree", n)
        larger = written(large.select("a", F.coalesce("low", "b").alias("b"), F.col("low").isNotNull().alias("moved")).groupBy("a", "b").agg(F.max("moved").alias("moved")).coalesce(few), "links")
        removed(links, ends)
        # a vertex has one smaller neighbour from each task that met it, so these groups are small
        low = larger.groupBy("a").agg(F.min("b").alias("low"))
        small = larger.join(low, "a").select("a", "b", "low", (F.col("moved") | (F.col("b") > F.col("low"))).alias("moved"))
        # of a vertex's links, those to others than the least become links of these others; the one to the least stays
        kept = small.select(F.when(F.col("b") > F.col("low"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("low").alias("b"), "moved")
        links = written(kept.groupBy("a", "b").agg(F.max("moved").alias("moved")).coalesce(few), "links")
        removed(larger)
        n, moved = links.count(), bool(links.filter("moved").limit(1).count())
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).union(links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
