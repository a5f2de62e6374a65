"""Format-preserving pseudonyms for personal data, by Feistel networks in SQL functions alone.

Found and validated: e-mail addresses, IBANs (remainder 97), dates (of the calendar, 1900 to 2099),
IPv4 addresses (parts to 255), social security numbers (no zero part, no 000, 666 or 9xx area),
North American telephone numbers, and payment cards (13 to 19 digits, Luhn). What fails its
validation stays as it is. In a run of groups of digits a card may begin and end at any group: the
first valid ones are taken, the longest from each group, and marked before the other kinds are sought.

A value is cut into halves; in each round one half is shifted by what a keyed SHA-256 of the other
gives. A shift keeps a letter a letter of its case and a digit a digit, or stays within the half's
range, so the network is a permutation of the values of a format: equal values get equal pseudonyms
in every document and, cards and telephone numbers, in every notation, different ones different ones, and
whoever has the key can go back. The key comes as a table of one row, so that it stands in no plan or log. Check digits
are worked out anew; a card keeps its first digit, a telephone number its country code and the
first digits of area and exchange, an address its domain, a social security number its area, an IBAN
its country. Dates map to dates in the same notation.

Nulls: a null text stays null and counts nothing; an empty one stays empty. Repeated rows give the
same text each; a null doc_id stays. An empty table gives an empty one. Other columns are ignored by
pseudonyms(), kept by pseudonymise().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,}"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![0-9A-Za-z])"
DATE = r"(?<![0-9A-Za-z.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})(?![0-9A-Za-z])"
IPV4 = r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
PHONE = r"(?<![0-9A-Za-z+(])(?:\+?1[ .-]?)?(?:\([1-9][0-9]{2}\)[ .-]?|[1-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9A-Za-z])"
#: Digits, spaces and hyphens that may hold a card; a card found there, between two noncharacters.
RUN = r"(?<![0-9A-Za-z])[0-9][0-9 -]{11,}[0-9](?![0-9A-Za-z])"
OPEN, CLOSE = "\ufdd0", "\ufdd1"
CARD = OPEN + r"[0-9](?:[ -]?[0-9]){12,18}" + CLOSE
OTHERS = (EMAIL, IBAN, DATE, IPV4, SSN, PHONE)
ANY, RUNS = "|".join((*OTHERS, CARD)), "|".join((*OTHERS, RUN))
KINDS = ("email", "iban", "date", "ip", "ssn", "phone", "card")
#: Days from 1900-01-01 to 2099-12-31: 73049 = 17 * 4297.
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def whole(x: Column) -> Column:
    return x.cast("long")


def keyed(key: Column, kind: str, step: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", key, F.lit(kind), step.cast("string"), other.cast("string")), 256)


def number(digest: Column, at: Column | int, n: int) -> Column:
    return whole(F.conv(F.substring(digest, at, n) if isinstance(at, int) else digest.substr(at, F.lit(n)), 16, 10))


def shifted(half: Column, digest: Column) -> Column:
    """Each letter or digit of half moved on within its kind."""

    def one(c, i):
        by = number(digest, (i % 30) * 2 + 1, 4)
        code = F.ascii(c)
        turn = lambda base, n: F.char(base + (code - base + by) % n)
        return F.when(code.between(48, 57), turn(48, 10)).when(code.between(65, 90), turn(65, 26)).when(code.between(97, 122), turn(97, 26)).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(half, ""), lambda c: c != ""), one), "")


def feistel_text(value: Column, key: Column, kind: str) -> Column:
    """A permutation of the strings with the same pattern of letters, digits and marks."""
    n = F.length(value)
    left, right = value.substr(F.lit(1), (n / 2).cast("int")), value.substr((n / 2).cast("int") + 1, n)
    start = F.struct(left.alias("l"), right.alias("r"))
    step = lambda s, k: F.struct(s["r"].alias("l"), shifted(s["l"], keyed(key, kind, k, s["r"])).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, k: let(s, lambda t: step(t, k)), lambda s: F.concat(s["l"], s["r"]))


def feistel_pair(x: Column, y: Column, a: int, b: int, key: Column, kind: str) -> Column:
    """A permutation of the pairs below a and b: a structure of x and y."""
    start = F.struct(whole(x).alias("x"), whole(y).alias("y"))

    def step(s, k):
        odd = k % 2 == 1
        by = number(keyed(key, kind, k, F.when(odd, s["y"]).otherwise(s["x"])), 1, 12)
        return F.struct(F.when(odd, (s["x"] + by) % a).otherwise(s["x"]).alias("x"), F.when(odd, s["y"]).otherwise((s["y"] + by) % b).alias("y"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, k: let(s, lambda t: step(t, k)))


def luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10; the last one counts once."""
    each = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + (c.cast("int") * 2 / 10).cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10


def remainder97(iban: Column) -> Column:
    moved = F.concat(iban.substr(F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    each = F.transform(F.filter(F.split(moved, ""), lambda c: c != ""), lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48))
    return F.aggregate(each, F.lit(0), lambda s, x: (s * F.when(x > 9, 100).otherwise(10) + x) % 97)


def email(m: Column, key: Column) -> Column:
    return F.concat(feistel_text(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), F.substring_index(m, "@", -1))


def iban(m: Column, key: Column) -> Column:
    def rebuilt(account):
        zero = F.concat(F.substring(m, 1, 2), F.lit("00"), account)
        return let(zero, lambda z: F.concat(F.substring(m, 1, 2), F.lpad((98 - remainder97(z)).cast("string"), 2, "0"), account))

    return F.when(remainder97(m) == 1, let(feistel_text(m.substr(F.lit(5), F.length(m)), key, "iban"), rebuilt))


def date(m: Column, key: Column) -> Column:
    def of(day: Column, pattern: str) -> Column:
        n = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
        permuted = feistel_pair(n / DAYS[1], n % DAYS[1], *DAYS, key, "date")
        moved = let(permuted, lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p["x"] * DAYS[1] + p["y"]).cast("int")))
        return F.when(day.between(F.lit(FIRST_DAY).cast("date"), F.lit("2099-12-31").cast("date")), F.date_format(moved, pattern))

    def parsed(pattern: str) -> Column:
        return F.try_to_timestamp(m, F.lit(pattern)).cast("date")

    found = F.when(F.substring(m, 5, 1) == "-", of(parsed("yyyy-MM-dd"), "yyyy-MM-dd"))
    for mark in "/.":
        dm, md = f"dd{mark}MM{mark}yyyy", f"MM{mark}dd{mark}yyyy"
        both = m.rlike(rf"^[0-9]{{2}}[{mark}][0-9]{{2}}[{mark}][0-9]{{4}}$")
        found = found.when(both & parsed(dm).isNotNull(), of(parsed(dm), dm)).when(both & parsed(md).isNotNull(), of(parsed(md), md))
    return found


def ip(m: Column, key: Column) -> Column:
    parts = F.transform(F.split(m, r"\."), whole)

    def rebuilt(p):
        moved = feistel_pair(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, key, "ip")
        return let(moved, lambda q: F.concat_ws(".", (q["x"] / 256).cast("int"), q["x"] % 256, (q["y"] / 256).cast("int"), q["y"] % 256))

    return F.when(F.forall(parts, lambda x: x < 256), let(parts, rebuilt))


def ssn(m: Column, key: Column) -> Column:
    area, group, serial = F.substring(m, 1, 3), whole(F.substring(m, 5, 2)), whole(F.substring(m, 8, 4))
    moved = let(feistel_pair(group - 1, serial - 1, 99, 9999, key, "ssn"), lambda q: F.concat(area, F.lit("-"), F.lpad((q["x"] + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((q["y"] + 1).cast("string"), 4, "0")))
    return F.when(~area.isin("000", "666") & ~area.startswith("9") & (group > 0) & (serial > 0), moved)


def phone(m: Column, key: Column) -> Column:
    parts = r"^(.*?)([1-9])([0-9]{2})([^0-9]{0,2})([2-9])([0-9]{2})([^0-9]?)([0-9]{4})$"
    g = lambda k: F.regexp_extract(m, parts, k)
    moved = feistel_text(F.concat(g(3), g(6), g(8)), key, "phone")
    return let(moved, lambda d: F.concat(g(1), g(2), F.substring(d, 1, 2), g(4), g(5), F.substring(d, 3, 2), g(7), F.substring(d, 5, 4)))


def card(marked: Column, key: Column) -> Column:
    m = F.regexp_replace(marked, f"[{OPEN}{CLOSE}]", "")
    digits = F.regexp_replace(m, "[^0-9]", "")
    body = F.concat(F.substring(digits, 1, 1), feistel_text(digits.substr(F.lit(2), F.length(digits) - 2), key, "card"))
    check = lambda b: F.pmod(10 - luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")
    return F.when(luhn(digits) == 0, let(let(body, lambda b: F.concat(b, check(b))), lambda d: noted(d, m)))


def noted(digits: Column, like: Column) -> Column:
    """Digits with the marks that stand between those of `like`: a card has one pseudonym in every notation."""

    def step(s, i):
        c = like.substr(i, F.lit(1))
        digit = c.between("0", "9")
        return F.struct(F.concat(s["out"], F.when(digit, digits.substr(s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + digit.cast("int")).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(F.sequence(F.lit(1), F.length(like)), start, lambda s, i: let(s, lambda t: step(t, i)), lambda s: s["out"])


def marked_run(run: Column) -> Column:
    """A run with OPEN and CLOSE around each card: from the first group on, the longest valid one that begins there."""

    def valid(groups, k, n):
        parts = F.slice(groups, k, n)
        digits = F.array_join(parts, "")
        return F.when(F.length(digits).between(13, 19) & F.forall(parts, lambda p: p != ""), luhn(digits) == 0).otherwise(F.lit(False))

    def longest(groups, k):
        return F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), F.least(F.lit(19), F.size(groups) - k + 1)), lambda n: valid(groups, k, n))), F.lit(0))

    def step(s, x):
        left = F.when(s["left"] > 0, s["left"]).otherwise(x["n"])  # groups of a card from here on
        piece = F.concat(F.when((s["left"] == 0) & (left > 0), OPEN).otherwise(""), x["group"], F.when(left == 1, CLOSE).otherwise(""))
        return F.struct(F.greatest(left - 1, F.lit(0)).alias("left"), F.concat(s["out"], F.array(piece)).alias("out"))

    def rebuilt(groups):
        each = F.transform(groups, lambda g, i: F.struct(g.alias("group"), longest(groups, i + 1).alias("n")))
        start = F.struct(F.lit(0).alias("left"), F.array().cast("array<string>").alias("out"))
        pieces = F.aggregate(each, start, step, lambda s: s["out"])
        return F.array_join(F.zip_with(pieces, F.regexp_extract_all(run, F.lit("[ -]"), F.lit(0)), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return let(F.split(run, "[ -]", -1), rebuilt)


def with_cards_marked(text: Column) -> Column:
    """The text with its cards marked, outside what is matched by another kind first."""
    found = F.transform(F.regexp_extract_all(text, F.lit(RUNS), F.lit(0)), lambda m: F.when(m.rlike("^[0-9][0-9 -]{11,}[0-9]$"), marked_run(m)).otherwise(m))
    pieces = F.zip_with(F.split(text, RUNS, -1), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(text.rlike(RUN), F.array_join(pieces, "")).otherwise(text)


def kind_of(m: Column) -> Column:
    """The kind whose pattern a match has."""
    return (
        F.when(F.instr(m, "@") > 0, "email")
        .when(m.rlike("^[A-Z]"), "iban")
        .when(m.rlike("^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})$"), "date")
        .when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "ip")
        .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(m.rlike("^" + PHONE.replace(r"(?<![0-9A-Za-z+(])", "") + "$"), "phone")
        .otherwise("card")
    )


def _found(marked: Column, key: Column) -> Column:
    """For each match of the marked text: its kind, the match and its pseudonym (null if it is no valid value)."""

    def one(m):
        kind, made = kind_of(m), F.when(F.lit(False), F.lit(None).cast("string"))
        for name, f in (("email", email), ("iban", iban), ("date", date), ("ip", ip), ("ssn", ssn), ("phone", phone), ("card", card)):
            made = made.when(kind == name, f(m, key))
        return F.struct(kind.alias("kind"), m.alias("was"), made.alias("now"))

    return F.transform(F.regexp_extract_all(marked, F.lit(ANY), F.lit(0)), one)


def _text(marked: Column, found: Column, text: Column) -> Column:
    now = F.transform(found, lambda x: F.coalesce(x["now"], x["was"]))
    return F.when(F.size(found) > 0, F.array_join(F.zip_with(F.split(marked, ANY, -1), now, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")).otherwise(text)


def with_key(docs: DataFrame, key: DataFrame, name: str) -> DataFrame:
    """docs with the key in a column: the key's table has one row, so it is broadcast, and no plan or log shows it."""
    one = key.agg(F.max(F.col(f"`{key.columns[0]}`").cast("string")).alias(name))
    given = one.select(F.when(F.length(name) > 0, F.col(name)).otherwise(F.raise_error(F.lit("pseudonyms need a key"))).alias(name))
    return docs.crossJoin(F.broadcast(given))


def pseudonyms(docs: DataFrame, key: DataFrame) -> DataFrame:
    """doc_id, a count for each kind, n_found, and the pseudonymised text; key: a table of one row and column."""
    marked = with_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", with_cards_marked(F.col("text")).alias("marked")), key, "key")
    found = marked.withColumn("found", _found(F.col("marked"), F.col("key")))
    count = lambda kind: F.coalesce(F.size(F.filter("found", lambda x: (x["kind"] == kind) & x["now"].isNotNull())), F.lit(0)).cast("long")
    counted = found.select("doc_id", *(F.when(F.col("text").isNull(), F.lit(0)).otherwise(count(k)).cast("long").alias(f"n_{k}") for k in KINDS), _text(F.col("marked"), F.col("found"), F.col("text")).alias("text"))
    return counted.withColumn("n_found", sum((F.col(f"n_{k}") for k in KINDS), F.lit(0)))


def pseudonymise(docs: DataFrame, key: DataFrame) -> DataFrame:
    """All rows and columns of docs, with the pseudonymised text."""
    taken, names = {c.lower() for c in docs.columns}, []
    for name in ("marked", "found", "key"):
        while name in taken:
            name += "_"
        names.append(name)
        taken.add(name)
    marked, found, own = names
    out = with_key(docs.withColumn(marked, with_cards_marked(F.col("text"))), key, own)
    out = out.withColumn(found, _found(F.col(marked), F.col(own)))
    return out.withColumn("text", _text(F.col(marked), F.col(found), F.col("text"))).select(*[F.col(f"`{c}`") for c in docs.columns])
