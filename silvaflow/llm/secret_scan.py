"""Secret scans: fixed patterns, and password guess costs for values in a credential's context.

Base spans, leftmost non-overlapping for each kind, in code points with the end exclusive:
    assign  a credential name, a sign and a value; kept if the value has 6 or more characters
    access  AKIA and capitals or digits; kept from 20 characters on
    hex     lower-case hexadecimal digits; kept from 24 on

Method: a value of 8 or more characters that stands after a wider set of credential names, which may
end a longer name, is cut into words, dates, repeats, keyboard walks and brute-force characters so
that the guesses cost least (dynamic programming over its places). From GUESS_LOG10 on, whatever its
characters, the value becomes a span of kind `guess`, unless base spans cover all of it; it may reach
past one. The cost of every base `assign` value is reported too.

Nulls: a null text is empty and has no spans. Repeated rows are scanned each; a null doc_id stays
null. Other columns are ignored by scan(), kept by redact().
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_rows, texts, tidied

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Each match of ASSIGN holds one of these.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
CONTEXT = re.compile(r"""(passphrase|password|passwd|pass|pwd|secret|token|api[_-]?key|access[_-]?key|credentials?|auth)["']?\s{0,4}(?:[:=]|=>|\bis\b)\s{0,4}["']?([^\s"'<>,;]{8,})""", re.I | re.A)
CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth")
GUESS_LOG10 = 8.0
#: Rows of a batch that are taken at a time.
ROWS = 1000
#: Frequent words of passwords, most frequent first.
WORDS = "password qwerty letmein dragon monkey football baseball welcome master login admin princess sunshine shadow superman iloveyou trustno hello freedom whatever secret summer winter spring autumn soccer hockey killer pepper jordan michael daniel charlie computer internet service access batman starwars flower cheese cookie banana orange purple silver golden money love test user root guest default changeme example sample token key pass word".split()
#: Rows of a keyboard.
KEYS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(r"(?:19|20)\d\d|(?:0?[1-9]|[12]\d|3[01])[-/.]?(?:0?[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])")
LONGEST_DATE = 10
RANK = {w: k + 1 for k, w in enumerate(WORDS)}
LONGEST_WORD, ENDINGS = max(map(len, WORDS)), {w[-3:] for w in WORDS}
#: Lengths of a repeat's unit; log10 of the digits, letters and other characters, and of a walk's turn.
UNITS, BRUTE, TURN = (1, 2, 3, 4), tuple(map(math.log10, (10, 26, 33))), math.log10(6)
#: What common substitutions stand for.
PLAIN = str.maketrans("@4301!5$7", "aaeoiisst")
SPANS_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, assign_log10 array<double>"


#: Where a key lies; each row stands half a key to the right of the one above.
PLACES = {c: (x + y / 2, y) for y, row in enumerate(KEYS) for x, c in enumerate(row)}


def stride(a: str, b: str):
    """The step from a key to one beside it, or to the next or previous character; None if b is neither."""
    if abs(ord(b) - ord(a)) == 1:
        return ord(b) - ord(a)
    if a in PLACES and b in PLACES and a != b:
        (x, y), (u, v) = PLACES[a], PLACES[b]
        if abs(u - x) <= 1 and abs(v - y) <= 1:
            return u - x, v - y
    return None


def brute(c: str) -> float:
    return BRUTE[0] if c.isdigit() else BRUTE[1] if c.isalpha() else BRUTE[2]


class Starts:
    """The cheapest start of a piece whose cost at its end j is w + log10(j - i), for ends that come in order.

    A later start is dearer or drops out at once, and what it gains by being nearer shrinks with every end, so
    each start is the best one for one stretch of ends at most: the top is the best now, those below come
    later. Each start goes in and out once, so all ends together take linear time.
    """

    def __init__(self):
        self.held: list[tuple[int, float]] = []

    def add(self, i: int, w: float, end: int) -> None:
        """From `end` on, i is a start."""
        held = self.held
        while held and held[-1][1] >= w:
            held.pop()
        if held and w + math.log10(end - i) >= self.best(end):
            return  # nor will it be the best of a later end
        while len(held) > 1 and self.until(held[-2], held[-1]) <= self.until(held[-1], (i, w)):
            held.pop()
        held.append((i, w))

    @staticmethod
    def until(far: tuple[int, float], near: tuple[int, float]) -> float:
        """The end from which on the far start is the cheaper one."""
        r = 10 ** (far[1] - near[1])
        return (near[0] - r * far[0]) / (1 - r) if r < 1 else math.inf

    def best(self, end: int) -> float:
        held = self.held
        while len(held) > 1 and held[-2][1] + math.log10(end - held[-2][0]) <= held[-1][1] + math.log10(end - held[-1][0]):
            held.pop()
        return held[-1][1] + math.log10(end - held[-1][0]) if held else math.inf


def guess_log10(value: str) -> float:
    """log10 of the guesses that the cheapest segmentation of value costs, in time linear in its length.

    A piece costs: a character its alphabet (10, 26 or 33); a word twice its rank, four times that if written
    with substitutions, and one more than its capitals; a year 200, a date 200 * 365; a repeat its unit of one
    to four characters and the number of times; a walk over neighbouring keys or characters 47 times its
    length, and 6 for each turn.
    """
    n = len(value)
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(PLAIN)
    single = [brute(c) for c in low]
    cost = [0.0] + [math.inf] * n
    century = {m.start() for m in re.finditer("(?=19|20)", value)}
    repeats = {u: [Starts() for _ in range(u)] for u in UNITS}
    same = dict.fromkeys(UNITS, 0)  # how many characters up to here equal those a unit before
    walk, length, turned, before = Starts(), 1, [0] * (n + 1), None  # turned: turns up to each character
    for j in range(1, n + 1):
        best = cost[j - 1] + single[j - 1]
        for i in range(max(0, j - LONGEST_WORD), j - 2) if low[j - 3 : j] in ENDINGS or plain[j - 3 : j] in ENDINGS else ():
            if low[i:j] in RANK or plain[i:j] in RANK:
                rank = RANK.get(low[i:j]) or 4 * RANK[plain[i:j]]
                capitals = sum(c.isupper() for c in value[i:j])
                best = min(best, cost[i] + math.log10(2 * rank * (1 + capitals)))
        if century and value[j - 1].isdigit():
            for i in range(max(0, j - LONGEST_DATE), j - 3):
                if value[i].isdigit() and not century.isdisjoint(range(i, j - 3)) and DATE.fullmatch(value, i, j):
                    best = min(best, cost[i] + math.log10(200 if j - i == 4 else 200 * 365))
        for u in UNITS:
            same[u] = same[u] + 1 if j > u and low[j - 1] == low[j - 1 - u] else 0
            starts = repeats[u][j % u]
            if same[u] >= u:
                i = j - 2 * u
                starts.add(i, cost[i] + sum(single[i : i + u]) - math.log10(u), j)
                best = min(best, starts.best(j))
            elif not same[u]:
                for other in repeats[u]:
                    other.held.clear()
        step = stride(low[j - 2], low[j - 1]) if j > 1 else None
        length = length + 1 if step is not None else 1
        turned[j] = turned[j - 1] + (step is not None and before is not None and step != before)
        before = step
        if length >= 3:  # the first two characters of a piece make no turn
            i = j - 3
            walk.add(i, cost[i] + math.log10(47) - TURN * turned[i + 2], j)
            best = min(best, walk.best(j) + TURN * turned[j])
        elif length == 1:
            walk.held.clear()
        cost[j] = best
    return cost[n]


def find(text: str) -> tuple[list[tuple[str, int, int]], list[float]]:
    """All spans in order, and the guess costs of the base `assign` values."""
    spans, costs = [], []
    low = text.lower()
    if any(x in low for x in NAMES):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                spans.append(("assign", m.start(), m.end()))
                costs.append(guess_log10(m[2]))
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if any(x in low for x in CONTEXT_HINTS):
        covered, at = {k for _, s, e in spans for k in range(s, e)}, 0
        while m := CONTEXT.search(text, at):
            a, at = m.start(2), m.end(1)  # a value that isn't taken may hold the next name
            value = m[2].rstrip(".:)]}")
            b = a + len(value)
            if len(value) >= 8 and guess_log10(value) >= GUESS_LOG10:
                at = b
                if not covered.issuperset(range(a, b)):
                    spans.append(("guess", a, b))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))), costs


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document (SPANS_SCHEMA)."""

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                spans, costs = find(text)
                base = [s for s in spans if s[0] != "guess"]
                n = {k: sum(s[0] == k for s in spans) for k in KINDS}
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), n["guess"], costs))
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[c.split()[0] for c in SPANS_SCHEMA.split(", ")])

    return texts(docs).mapInArrow(tidied(run), SPANS_SCHEMA)


def redacted(text: str | None, mark: str) -> str | None:
    if not text:
        return text
    out, at = [], 0
    for _, a, b in find(text)[0]:
        if b > at:
            out += ([text[at:a], mark] if a >= at else [])
            at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns; in `text` each span, or run of overlapping ones, becomes the mark. n_chars, if there, follows."""

    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                yield part.set_column(at, part.schema.field(at), pa.array([redacted(t, mark) for t in part.column(at).to_pylist()], part.schema.field(at).type))

    out = over_rows(docs, run)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
