"""Token ids of whole texts through the tokenizers library, with each distinct chunk encoded once.

Text is cut only where the tokenizer itself always cuts, so the ids equal those of one call on the
whole text; texts in which such cuts aren't certain go to the library whole. A chunk of printable ASCII or a word
of Latin letters is split here; any other goes through the library's own normalizer and pre-tokenizer, whose tables of
letters, digits, white space and lower case are the ones that count.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode white space and separators besides the space and the line feed.
OTHER_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))
#: Characters of text worked on at a time.
GROUP_CHARS = 4_000_000


class Recent(dict):
    """A mapping that computes what it lacks and remembers the latest cap to 2 * cap entries."""

    def __init__(self, compute, cap: int):
        super().__init__()
        self.compute, self.cap, self.old = compute, cap, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.cap:
            self.old = dict(self)
            self.clear()


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a printable character: itself, or the next one free from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in kept else chr(next(spare)) for b in range(256)}


def plain(chunk: str) -> bool:
    """Printable ASCII, or a word of Latin letters, perhaps with a comma or full stop behind it: every table agrees on these."""
    if chunk.isascii():
        return chunk.isprintable()
    word = chunk[:-1] if chunk[-1] in ",." else chunk
    return word.isalpha() and max(word) < "\u0250" and "\u0130" not in word


def latin(text: str) -> bool:
    """Characters below U+0100 alone, in which lower case never depends on a table's age or the context."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def even_space(text: str) -> bool:
    """Only single spaces and line feeds, each between two other characters."""
    return not (text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or any(c in text for c in OTHER_SPACE))


def groups(lengths: list[int], most: int = GROUP_CHARS):
    """Ranges of neighbours whose lengths add up to about most."""
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


class Encoder:
    """Ids of texts; cap is the number of distinct chunks remembered: it bounds memory, never results."""

    def __init__(self, path: str, cap: int = 250_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.letters = byte_letters()
        cut = spec.get("pre_tokenizer") or {}
        self.kind = "whole"
        if spec.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space"):
            from public_tokenizers import PATTERN

            self.kind, self.pieces = "spaced", regex.compile(PATTERN)
        elif cut.get("type") == "Sequence" and [p.get("behavior") for p in cut["pretokenizers"]] == ["Removed", None] and cut["pretokenizers"][0].get("invert"):
            self.kind, self.pieces = "words", regex.compile(cut["pretokenizers"][0]["pattern"]["Regex"])
        self.tokenize = self.library.model.tokenize  # the model comes as a new object each time it is asked for
        self.marks = {mark: self._ids([mark]) for mark in ",."}
        self.chunks = Recent(self._words if self.kind == "words" else self._spaced, cap)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _ids(self, pieces: list[str], lettered: bool = False) -> bytes:
        """lettered: the pieces are written in byte letters already."""
        ids = array("I")
        for piece in pieces:
            if not lettered and not (piece.isascii() and piece.isalpha()):
                piece = piece.encode().decode("latin-1").translate(self.letters)
            ids.extend([t.id for t in self.tokenize(piece)])
        return ids.tobytes()

    def _own(self, chunk: str) -> bytes:
        """Ids of a chunk as the library normalises and splits it."""
        chunk = self.library.normalizer.normalize_str(chunk) if self.library.normalizer else chunk
        return self._ids([p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(chunk)], True)

    def _split(self, chunk: str, before: str = "") -> list[str]:
        """The pattern's pieces; a word, alone or with a comma or full stop after it, needs no search."""
        if chunk.isalpha():
            return [before + chunk]
        if chunk[-1] in ",." and chunk[:-1].isalpha():
            return [before + chunk[:-1], chunk[-1]]
        return self.pieces.findall(before + chunk)

    def _words(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        # as _split and _ids do, in one step
        word, mark = (chunk[:-1], chunk[-1]) if chunk[-1] in ",." else (chunk, "")
        if word.isascii() and word.isalpha():
            return self.chunks[word] + self.marks[mark] if mark else array("I", [t.id for t in self.tokenize(word.lower())]).tobytes()
        return self._ids(self._split(chunk.lower())) if plain(chunk) else self._own(chunk)

    def _spaced(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if not plain(chunk.lstrip("\0\n") or " "):
            return self._own(chunk if chunk[0] == "\n" else chunk[1:] if chunk[0] == "\0" else " " + chunk)
        if chunk[0] == "\n":
            return self._ids(self.pieces.findall(chunk))
        # U+0000 marks a text's first chunk, which has no space before it
        return self._ids(self.pieces.findall(chunk[1:]) if chunk[0] == "\0" else self._split(chunk, " "))

    def _cut(self, texts: list[str]) -> pa.ListArray:
        if self.kind == "words":
            return pc.ascii_split_whitespace(pa.array([t.lower() if t.isascii() or latin(t) else t for t in texts], pa.large_string()))
        return pc.split_pattern(pa.array(["\0" + t.replace("\n", " \n") for t in texts], pa.large_string()), " ")

    def _certain(self, text: str) -> bool:
        if not text or any(s in text for s in self.special):
            return False
        return self.kind == "words" or self.kind == "spaced" and "\0" not in text and even_space(text)

    def group(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's ids begin (one more than texts)."""
        certain = [self._certain(t) for t in texts]
        lists = self._cut([t for t, ok in zip(texts, certain) if ok])
        coded = lists.flatten().dictionary_encode()
        self.chunks.trim()
        found = [self.chunks[c] for c in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]  # to_pylist() makes a scalar of each
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool, starts = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        which = coded.indices.to_numpy(zero_copy_only=False)
        per = sizes[which]
        ends = np.concatenate([[0], np.cumsum(per)])
        ids = pool[np.repeat(starts[which] - ends[:-1], per) + np.arange(ends[-1])]
        bounds = ends[np.asarray(lists.offsets) - lists.offsets[0].as_py()] if len(lists) else np.zeros(1, np.int64)
        if all(certain):
            return ids, bounds
        parts, k = [], 0
        for t, ok in zip(texts, certain):
            parts.append(ids[bounds[k] : bounds[k + 1]] if ok else np.frombuffer(self.whole(t), "<u4"))
            k += ok
        return np.concatenate(parts).astype("<u4"), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def encode(self, texts: list[str]):
        """Yields (ids as an array of unsigned 32-bit integers) for each text."""
        for a, b in groups([len(t) for t in texts]):
            ids, bounds = self.group(texts[a:b])
            for i in range(b - a):
                yield ids[bounds[i] : bounds[i + 1]]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
