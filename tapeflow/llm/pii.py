"""Personal data in texts, with SQL functions only.

Regular expressions propose spans, validators confirm them (Luhn for cards, modulus 97 for bank account numbers, part
and digit ranges for addresses and phones), and context words just before a span move its score. Spans of the four base kinds are
kept whenever their validator passes; account numbers, which the method adds, need a score of `KEEP`.

Positions come from the gaps between matches: splitting at a pattern and extracting it visit the same matches. Running sums of their lengths are taken in blocks of about the
square root of their number, and the context of a span comes from the pieces just before it, so a text of many matches takes little more than linear time. The
patterns are possessive and start only at the head of a run, which finds the same leftmost matches as the plain forms in
linear time and without recursion on long runs. Everything is a projection of the scan: no shuffle, no Python.

Defined results: NULL text has no spans; each input row gives one output row. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone", "iban"]

# Patterns. The base forms are those of the contract; heads and possessive quantifiers only save work.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9])"

#: Context words that speak for a kind when they stand within `REACH` code points before the span.
CONTEXT = {
    "email": "mail|contact|kontakt|correo|courriel",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|credit|karte|carte|tarjeta",
    "phone": "phone|call|tel|fax|mobile",
    "iban": "iban|account|bank|konto|compte|cuenta",
}
AGAINST = "example|sample|test|order|serial|version|isbn"
REACH = 40
PRIOR = {"email": 0.7, "ip": 0.5, "card": 0.4, "phone": 0.6, "iban": 0.4}
CHECKED = {"card", "iban"}  #: a checksum has confirmed the span
KEEP = 0.5


def _with(value: Column, use) -> Column:
    """`use(value)` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(sizes: Column) -> Column:
    """Running sums of an array of whole numbers. A block's sums are appended one by one, so blocks are short."""
    def sums(x: Column, before: Column) -> Column:
        return F.aggregate(x, F.struct(before.alias("at"), F.array().cast("array<int>").alias("all")),
                           lambda a, v: F.struct((a.at + v).alias("at"), F.concat(a.all, F.array(a.at + v)).alias("all")), lambda a: a.all)

    def cut(x: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(x))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / width).cast("int")), lambda b: F.slice(x, b * width + 1, width))

    def joined_up(blocks: Column) -> Column:
        ends = sums(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, v: a + v)), F.lit(0))
        return F.flatten(F.zip_with(blocks, F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1)), sums))

    return _with(sizes, lambda x: F.when(F.size(x) == 0, F.array().cast("array<int>")).otherwise(_with(cut(x), joined_up)))


def _matches(text: Column, pattern: str, valid, shortest: int) -> Column:
    """array<struct<start, end, found, before>> of those of the leftmost, non-overlapping matches that are valid; ``before`` are the `REACH` code points
    before a match. No match is shorter than ``shortest``, so that few pieces hold them."""
    pieces = -(-REACH // shortest)
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gap"))

    def place(p):
        # A gap and the match behind it make a piece.
        piece = F.zip_with(F.slice(p.gap, 1, F.size(p.found)), p.found, lambda g, f: F.struct((F.length(g) + F.length(f)).alias("size"), F.right(g, F.lit(REACH)).alias("gap"), f.alias("found"),
                                                                                           F.right(F.concat(g, f), F.lit(REACH)).alias("tail")))
        return _with(piece, lambda x: _with(F.struct(x.alias("piece"), _running(F.transform(x, lambda y: y.size)).alias("ends")), located))

    def located(p):
        every = F.zip_with(p.piece, p.ends, lambda x, e: F.struct((e - F.length(x.found)).alias("start"), e.alias("end"), x.found.alias("found"), x.gap.alias("gap")))
        numbered = F.transform(every, lambda m, i: F.struct(m.start.alias("start"), m.end.alias("end"), m.found.alias("found"), m.gap.alias("gap"), i.alias("i")))
        return F.transform(F.filter(numbered, lambda m: valid(m.found)), lambda m: F.struct(m.start.alias("start"), m.end.alias("end"), F.right(F.concat(
            F.array_join(F.array(*[F.get(p.piece, m.i - k).getField("tail") for k in range(pieces, 0, -1)]), ""), m.gap), F.lit(REACH)).alias("before")))

    return _with(parts, place)


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    d = F.transform(F.sequence(F.lit(1), n), lambda i: F.when((n - i) % 2 == 1, F.substr(digits, i, F.lit(1)).cast("int") * 2).otherwise(F.substr(digits, i, F.lit(1)).cast("int")))
    return F.aggregate(d, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def mod97(found: Column) -> Column:
    """Letters count 10 to 35; the first four characters move to the end; the remainder modulo 97 must be 1."""
    plain = F.replace(found, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    value = F.transform(F.filter(F.split(moved, ""), lambda c: c != ""), lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(value, F.lit(0), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97) == 1


def _ip_ok(found: Column) -> Column:
    part = F.transform(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(part, lambda p: (F.length(p) <= 3) & (F.when(F.length(p) <= 3, F.concat(F.lit("0"), p).cast("int")).otherwise(999) <= 255))


def _card_ok(found: Column) -> Column:
    d = _digits(found)
    return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)


#: kind: (pattern, cheap necessary condition on the text, validator of a match, least length of a match)
RULES = {
    "email": (EMAIL, lambda t: F.contains(t, F.lit("@")), lambda f: F.lit(True), 5),
    "ip": (IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), _ip_ok, 7),
    "card": (CARD, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), _card_ok, 2),
    "phone": (PHONE, lambda t: F.contains(t, F.lit("+")), lambda f: F.length(_digits(f)).between(10, 15), 4),
    "iban": (IBAN, lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]"), mod97, 15),
}


def _score(before: Column, kind: str) -> Column:
    before = F.lower(before)
    s = F.lit(PRIOR[kind] + (0.3 if kind in CHECKED else 0.0)) + F.when(before.rlike(CONTEXT[kind]), 0.2).otherwise(0.0) - F.when(before.rlike(AGAINST), 0.3).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


_SPAN = "array<struct<start:int,rank:int,kind:string,end:int,score:double>>"


def _of_kind(text: Column, kind: str) -> Column:
    pattern, may, valid, shortest = RULES[kind]
    found = F.transform(_matches(text, pattern, valid, shortest), lambda m: F.struct(
        m.start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), m.end.alias("end"), _score(m.before, kind).alias("score")))
    if kind == "iban":
        found = F.filter(found, lambda s: s.score >= KEEP)
    return F.when(may(text), found).otherwise(F.array().cast(_SPAN))


def spans(text: Column) -> Column:
    """array<struct<start, rank, kind, end, score>> in order of start, then kind."""
    return F.array_sort(F.concat(*[_of_kind(text, kind) for kind in KINDS]))


def detected(docs: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """`docs` with the column `name`: the spans of each row."""
    return docs.withColumn(name, spans(F.coalesce(F.col(text), F.lit(""))))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
