"""Byte-pair encoding and decoding of whole texts by a prefix-sharing trie traversal.

The distinct words of a group of texts are put in order, which is the preorder of their trie; the
traversal keeps, for each letter on the path from the root, the last token of the encoding of the
letters so far. That token determines the encoding: what comes before it is the encoding of the
shorter prefix at which it begins. So a prefix that many words share is worked out once, and a word
costs its own last letters. The last letter of a word carries the end-of-word mark and is a step
of its own.

A token may follow another if merging the letters of both gives just the two back; these answers
are remembered too.

Nulls: a null text is empty; an empty text has no ids and decodes to "". Rows that repeat a doc_id
are encoded each; a null doc_id stays null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts, tidied
from .token_ids import Recent, byte_letters, groups, plain

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class TrieEncoder:
    """For byte-level vocabularies with an end-of-word suffix whose words don't hold white space.

    cap: words, chunks and pairs of tokens remembered (at most twice that); it bounds memory only.
    """

    def __init__(self, path: str, cap: int = 200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        cut = spec["pre_tokenizer"]["pretokenizers"][0]
        if not model.get("end_of_word_suffix") or cut["behavior"] != "Removed" or not cut["invert"] or spec["decoder"]:
            raise ValueError("the tokenizer file is of another kind")
        self.suffix, self.vocabulary = model["end_of_word_suffix"], model["vocab"]
        self.names = {i: t for t, i in self.vocabulary.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): r for r, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.word_pattern, self.letters = regex.compile(cut["pattern"]["Regex"]), byte_letters()
        # tokens that encode to themselves; others never stand in an encoding
        self.inner = {t: i for t, i in self.vocabulary.items() if not t.endswith(self.suffix) and self.merge(list(t)) == [t]}
        self.final = {t[: -len(self.suffix)]: i for t, i in self.vocabulary.items() if t.endswith(self.suffix) and self.merge(self.symbols(t)) == [t]}
        #: length of the longest token with such an end (its last two letters, or its only one)
        self.spans: dict[int, dict[str, int]] = {}
        for tokens in (self.inner, self.final):
            spans = self.spans[id(tokens)] = {}
            for t in tokens:
                spans[t[-2:]] = max(len(t), spans.get(t[-2:], 0))
        self.pairs = Recent(lambda p: self.merge(self.symbols(self.names[p[0]]) + self.symbols(self.names[p[1]])) == [self.names[p[0]], self.names[p[1]]], 4 * cap)
        self.words: dict[str, tuple[int, ...]] = Recent(lambda w: self.traverse([w])[0], cap)
        self.chunks = Recent(self._chunk, cap)

    def symbols(self, token: str) -> list[str]:
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def merge(self, symbols: list[str]) -> list[str]:
        """Merges by rank, leftmost first: the definition, used on tokens and pairs of them."""
        while len(symbols) > 1:
            best = min(zip(symbols, symbols[1:]), key=lambda p: self.ranks.get(p, len(self.ranks)))
            if best not in self.ranks:
                break
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == best:
                    out.append(symbols[i] + symbols[i + 1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def _last(self, word: str, end: int, tokens: dict[str, int], path: list[tuple[int, int]]) -> tuple[int, int]:
        """(token, where it begins) that ends the encoding of word[:end]."""
        get, pairs = tokens.get, self.pairs
        for start in range(max(0, end - self.spans[id(tokens)].get(word[max(0, end - 2) : end], 1)), end):
            token = get(word[start:end])
            if token is not None and (start == 0 or pairs[path[start - 1][0], token]):
                return token, start
        raise ValueError(f"no token ends at {end} of {word!r}")

    def traverse(self, words: list[str]) -> list[tuple[int, ...]]:
        """Encodings of words (in byte letters) in rising order, depth first over their trie."""
        out, path, before = [], [], ""
        for word in words:
            shared, most = 0, min(len(path), len(word) - 1)
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del path[shared:]
            while len(path) < len(word) - 1:
                path.append(self._last(word, len(path) + 1, self.inner, path))
            token, start = self._last(word, len(word), self.final, path)
            ids = [token]
            while start:
                token, start = path[start - 1]
                ids.append(token)
            out.append(tuple(reversed(ids)))
            before = word
        return out

    def _pieces(self, chunk: bytes) -> list[str]:
        """The words of a chunk without ASCII white space, in byte letters."""
        text = chunk.decode()
        if plain(text):
            low = text.lower()
            words = [low] if low.isalpha() else [low[:-1], low[-1]] if low[:-1].isalpha() and low[-1] in ",." else self.word_pattern.findall(low)
            return words if low.isascii() else [w.encode().decode("latin-1").translate(self.letters) for w in words]  # ASCII stands for itself
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def _chunk(self, chunk: bytes, pieces: list[str] | None = None) -> tuple[int, str, str]:
        ids = [i for p in pieces or self._pieces(chunk) for i in self.words[p]]
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        """The file has no decoder: tokens are joined by one space."""
        return " ".join(map(self.names.__getitem__, ids))

    def group(self, batch: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, ids as text, decoded text) of each text."""
        cut = [[(s, s in self.special) for s in self.cut_special.split(t) if s] for t in batch]
        cut = [[([s] if special else s.encode().split(), special) for s, special in parts] for parts in cut]  # bytes: ASCII white space only
        for cache in (self.words, self.chunks, self.pairs):
            cache.trim()
        new = {c for parts in cut for chunks, special in parts if not special for c in chunks} - self.chunks.keys() - self.chunks.old.keys()
        cut_new = {c: self._pieces(c) for c in new}
        words = sorted({p for pieces in cut_new.values() for p in pieces} - self.words.keys() - self.words.old.keys())
        self.words.update(zip(words, self.traverse(words)))
        self.chunks.update((c, self._chunk(c, pieces)) for c, pieces in cut_new.items())
        out = []
        for parts in cut:
            got = []
            for chunks, special in parts:
                got += [(1, str(self.special[chunks[0]]), chunks[0])] if special else [self.chunks[c] for c in chunks]
            got = [g for g in got if g[0]]
            out.append((sum([g[0] for g in got]), " ".join([g[1] for g in got]), " ".join([g[2] for g in got])))
        return out


_encoders: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    if path not in _encoders:
        _encoders[path] = TrieEncoder(path)
    return _encoders[path]


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256 of each document."""

    def run(batches):
        coder = encoder(tokenizer)
        for batch in batches:
            ids, contents = batch.column(0), batch.column(1).to_pylist()
            rows = []
            for a, b in groups([len(t) for t in contents], 2_000_000):
                rows += [(n, hashlib.sha256(i.encode()).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for n, i, d in coder.group(contents[a:b])]
            n, i, d = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(tidied(run), SCHEMA)
