"""Language identification by prediction by partial matching.

For each language a context tree over bytes holds how often each byte followed each context of up
to ORDER bytes. The cost of a byte is that of its longest context that was seen: its share there
if the byte followed it, otherwise an escape (distinct followers / (all + distinct followers)) and
the cost in the next shorter context, at last 1 / alphabet. All 256 byte values are symbols of their
own. Statistics are frozen after training, so a byte's cost depends on it and the ORDER bytes before
it alone: a language's tree is kept as the sorted keys of all contexts and followers that its sample
holds, and the costs of a slice of texts are worked out once for each distinct place in it. A text's
language is the one with the least code length; the score is the probability that the code lengths
give it among the learned languages.

Learned from a bounded sample: of rows with text and lang in the training fold, the
`per_language` rows of each language with the smallest hashes of doc_id (found among those below a bound that
lets about SPARE times as many pass), down to `sample_chars` characters in all (but a text of each language). The sample is the only bound: every lang value is
learned, and every whole text is scored.

Results: null texts and texts without a letter get `und` and score 0, and so does every text if
nothing could be learned. Repeated rows are scored each; ties go to the language first in order; a
null doc_id is in the held-out fold's complement but never learned from. Other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_rows, fold, over_rows, small_batches, tidied
from .token_ids import groups

ORDER = 3
#: Symbols: all bytes, and 0 for what stands before a text.
SYMBOLS = 257
#: Characters (and costs of a text in a language) that are taken at a time.
SLICE = 500_000
#: Sampled ids that may be broadcast.
FEW_IDS = 100_000
#: How many times the wanted rows of a language may pass the first thinning.
SPARE = 4
#: Rows of a batch that are taken at a time.
ROWS = 1000
FOLDS, HELD_OUT = 4, 2
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
ASCII_LETTER = re.compile("[A-Za-z]")


def at_keys(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key stands among the sorted keys, and whether it does."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of each one's counts."""
    names, at = np.unique(keys, return_inverse=True)
    return names, np.bincount(at, counts, len(names)).astype(np.int64)


class Model:
    """symbols: byte -> symbol; trees: for each language and order 0 to ORDER the sorted keys of (context, follower),
    their bits, the sorted contexts and the bits of an escape from each."""

    def __init__(self, languages: list[str], samples: dict[str, list[str]]):
        self.languages = languages
        self.n = SYMBOLS
        self.symbols = np.arange(1, SYMBOLS, dtype=np.int32)
        self.trees = [self._tree(*self._counted(samples[k])) for k in languages]

    def _counted(self, sample: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct places of a sample, and how often each occurs."""
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for a, b in groups([len(t) for t in sample], SLICE):
            new, times = np.unique(self.contexts([t.encode().lower() for t in sample[a:b]])[0], return_counts=True)
            keys, counts = summed(np.concatenate([keys, new]), np.concatenate([counts, times]))
        return keys, counts

    def _tree(self, places: np.ndarray, times: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        out = []
        for order in range(ORDER + 1):
            keys, counts = summed(places % self.n ** (order + 1), times)
            contexts, own, kinds = np.unique(keys // self.n, return_inverse=True, return_counts=True)
            weight = np.bincount(own, counts, len(contexts)) + kinds
            out.append((keys, np.log2(weight[own] / counts).astype(np.float32), contexts, np.log2(weight / kinds).astype(np.float32)))
        return out

    def _costs(self, tree: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], places: np.ndarray) -> np.ndarray:
        """Bits of distinct places in one language: by the longest seen context, escapes on the way to it."""
        out, left = np.zeros(len(places), np.float32), np.arange(len(places))
        for order in range(ORDER, -1, -1):
            keys, bits, contexts, escapes = tree[order]
            wanted = places[left] % self.n ** (order + 1)
            at, seen = at_keys(keys, wanted)
            out[left[seen]] += bits[at[seen]]
            left, wanted = left[~seen], wanted[~seen]
            at, seen = at_keys(contexts, wanted // self.n)
            out[left[seen]] += escapes[at[seen]]
        out[left] += np.float32(np.log2(self.n))
        return out

    def contexts(self, coded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The place in the table of each byte of the texts, and where the texts begin in it (and end)."""
        sizes = np.array([len(t) for t in coded], np.int64)
        joined = self.symbols[np.frombuffer(b"".join(b"\0" * ORDER + t for t in coded), np.uint8)]
        ends = np.cumsum(sizes + ORDER)
        pad = (ends - sizes - ORDER)[:, None] + np.arange(ORDER)
        joined[pad.reshape(-1)] = 0
        place = np.zeros(max(0, len(joined) - ORDER), np.int64)
        for k in range(ORDER + 1):
            place = place * self.n + joined[k : len(joined) - ORDER + k]
        own = np.ones(len(joined), bool)
        own[pad.reshape(-1)] = False
        return place[own[ORDER:]], np.concatenate([[0], np.cumsum(sizes)])

    def bits(self, texts: list[str]) -> np.ndarray:
        """Code length of each text in each language."""
        place, bounds = self.contexts([t.encode().lower() for t in texts])
        distinct, at = np.unique(place, return_inverse=True)
        out = np.zeros((len(texts), len(self.languages)))
        some = bounds[1:] > bounds[:-1]
        if some.any():
            for k, tree in enumerate(self.trees):
                out[some, k] = np.add.reduceat(self._costs(tree, distinct)[at], bounds[:-1][some], dtype=np.float64)
        return out


def has_letter(text: str | None) -> bool:
    return bool(text) and (ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def train(docs: DataFrame, per_language: int = 400, sample_chars: int = 16_000_000) -> Model:
    spark = docs.sparkSession
    docs = docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    taught = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    sizes = {r.lang: r["count"] for r in taught.groupBy("lang").count().collect()}  # one row a language
    values = sorted(sizes)
    if not values:
        return Model([], {})
    # a language's rows are first thinned by their hashes to a few times those wanted, so that none is a large group
    share = spark.createDataFrame([(k, int(min(1.0, SPARE * per_language / n) * 2**32)) for k, n in sizes.items()], "lang string, below long")
    thinned = taught.select("doc_id", "lang").join(F.broadcast(share) if len(values) <= FEW_IDS else share, "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(2**32)) < F.col("below"))
    first = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(2**32)), "doc_id")
    ids = thinned.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= per_language)
    ids = ids.select("doc_id", "lang").distinct()
    chosen = taught.join(F.broadcast(ids) if len(values) * per_language <= FEW_IDS else ids, ["doc_id", "lang"]).select("doc_id", "lang", "text")
    samples: dict[str, list[str]] = {k: [] for k in values}
    share, used = max(1, sample_chars // len(values)), dict.fromkeys(values, 0)
    for r in bounded_rows(chosen):
        if used[r.lang] < share:
            samples[r.lang].append(r.text)
            used[r.lang] += len(r.text)
    return Model(values, samples)


def predicted(model: Model, found: list[str | None]) -> list[tuple[str, float]]:
    """(language, score) of each text."""
    out: list[tuple[str, float]] = []
    for a, b in groups([len(t or "") + len(model.languages) for t in found], SLICE):
        part = found[a:b]
        bits = model.bits([t or "" for t in part]) if model.languages else np.zeros((len(part), 1))
        best = bits.argmin(axis=1)
        odds = np.exp2(np.clip(bits.min(axis=1, keepdims=True) - bits, -1000, 0)).sum(axis=1)
        known = [bool(model.languages) and has_letter(t) for t in part]
        out += [(model.languages[k], float(1 / s)) if ok else ("und", 0.0) for k, s, ok in zip(best, odds, known)]
    return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = F.coalesce(fold(F.col("doc_id").cast("long"), FOLDS) == HELD_OUT, F.lit(False))

    def run(batches):
        model = shared.value
        for batch in batches:
            names, scores = zip(*predicted(model, batch.column(2).to_pylist())) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(tidied(run), SCHEMA)


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language could be told (not `und`), whole rows; a null lang becomes the prediction.

    If nothing could be learned, as from a table without lang values or without that column, those with a letter.
    """
    model = train(docs)
    shared, at, lang = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text"), docs.columns.index("lang") if "lang" in docs.columns else None

    def run(batches):
        model = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                found = part.column(at).to_pylist()
                names = [name for name, _ in predicted(model, found)]
                kept = [name != "und" for name in names] if model.languages else list(map(has_letter, found))
                if lang is not None:
                    given = [g if g is not None or name == "und" else name for g, name in zip(part.column(lang).to_pylist(), names)]
                    part = part.set_column(lang, part.schema.field(lang), pa.array(given, part.schema.field(lang).type))
                yield part.filter(pa.array(kept, pa.bool_()))

    return over_rows(docs, run)
