"""Personal data and secrets in texts, by DataFrame expressions only.

Per kind a regular expression proposes spans (leftmost, not overlapping), a validator confirms
them: value ranges for IP addresses, Luhn for card numbers, mod-97 for IBANs, digit counts for
phone numbers, letters and digits in a secret's value.  Every confirmed span has a score: the kind's
base value, raised when a context word of the kind stands within ``CONTEXT`` characters in front.
Kinds with a certain form (``BASE``) are reported whatever their score; the others only from
``MIN_SCORE`` on, which social security numbers and secret values reach by a context word only.

The patterns use possessive runs and look-behind, so that the matcher walks over long runs once;
they propose the same spans as the plain forms given beside them.  Before the card pattern, a
single separator between two digits is turned into U+0001, so that a proposal is one character
class run.  Proposals are placed in groups of about the square root of their number (``_running``),
context and redacted text are taken from pieces of the text: no step's work grows with the square of
a text's length.

Null texts count as empty: no spans.  Very long texts are searched whole.  Repeated rows get
equal results.  Only the columns asked for are read; names of other columns do not matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT = 40
MIN_SCORE = 0.5
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "key", "secret")
PIECE = 1000  # code points of a piece of text

_LOCAL = r"A-Za-z0-9._%+\-"
# Fixed forms of the base kinds: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ | [0-9]+(\.[0-9]+){3}
# | [0-9]([\x20-]?[0-9])+ | \+[0-9][\x20().0-9-]+[0-9]
PATTERN = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": "[0-9][0-9\u0001]++",
    "phone": r"\+[0-9][\x20().0-9\-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    # fixed forms of published credential prefixes
    "key": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9\-]{10,72}|sk_(?:live|test)_[A-Za-z0-9]{16,64})(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_/+])[A-Za-z0-9_/+]{12,128}+={0,2}",
}
# What a text must hold to be searched for the kind.
ROUGH = {
    "email": r"@[A-Za-z0-9-]+\.", "ip": r"[0-9]\.[0-9]+\.", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]{8}", "ssn": "[0-9]-[0-9]{2}-[0-9]", "key": "AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk_(?:live|test)_",
    "secret": r"(?i)(?:passw|pwd|secret|token|credential|api[_\x20-]?key|access[_\x20-]?key)",
}
START_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.6, "ssn": 0.3, "key": 0.8, "secret": 0.2}
CONTEXT_WORDS = {
    "email": "mail|contact|write", "ip": "address|host|server", "card": "card|visa|credit|payment",
    "phone": "phone|tel|call|mobile", "iban": "iban|account|bank", "ssn": "ssn|social|security",
    "key": "key|aws|token|secret", "secret": r"(?:passw(?:or)?d|pwd|secret|token|credential|api[_\x20-]?key|access[_\x20-]?key)[a-z_]*[\"']?\x20?(?:=|:|is)\x20?[\"']?$",
}


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Sum of the digits, every second from the right doubled, is divisible by 10."""
    value = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def _mod97(s: Column) -> Column:
    """The country and check characters moved to the end, letters as 10 to 35: the number is 1 modulo 97."""
    plain = F.regexp_replace(s, "\\x20", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(a: Column, c: Column) -> Column:
        v = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return F.when(v < 10, a * 10 + v).otherwise(a * 100 + v) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        # the value of a part: leading zeros aside, three digits at most
        return F.forall(F.split(m, "\\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & _luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(m, "\\x20", "")).between(15, 34) & _mod97(m)
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return ~m.rlike("^(?:000|666|9[0-9]{2})-|-00-|-0000$") if kind == "ssn" else F.lit(True)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _groups(items: Column) -> Column:
    """The array as an array of slices of about the square root of its length."""

    def cut(x: Column) -> Column:
        step = F.greatest(F.ceil(F.sqrt(F.size(x))).cast("int"), F.lit(1))
        return F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.size(x) - 1, step), lambda i: F.slice(x, i + 1, step))).otherwise(F.slice(F.array(x), 2, 1))

    return _let(items, cut)


def _running(lengths: Column) -> Column:
    """Sum of the lengths before each item: within each group, then the groups' sums before it."""
    none = F.expr("named_struct('at', 0L, 'out', cast(array() as array<bigint>))")
    step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    own = F.transform(_groups(lengths), lambda g: F.aggregate(g, none, step))
    return _let(own, lambda parts: F.flatten(F.zip_with(
        parts, F.aggregate(F.transform(parts, lambda p: p["at"]), none, step, lambda acc: acc["out"]),
        lambda p, before: F.transform(p["out"], lambda x: x + before))))


def _in_front(pairs: Column, i: Column) -> Column:
    """The last ``CONTEXT`` characters before match i (from 0): of its gap, or else of the matches and gaps before it too."""
    gap = F.element_at(pairs, i + 1)["gap"]
    first = F.greatest(i - CONTEXT + 1, F.lit(1))  # a match has a character at least
    earlier = F.array_join(F.transform(F.slice(pairs, first, i - first + 1), lambda p: F.concat(p["gap"], p["match"])), "")
    return F.right(F.when(F.length(gap) >= CONTEXT, gap).otherwise(F.concat(earlier, gap)), F.lit(CONTEXT))


def _spans(text: Column, kind: str) -> Column:
    """Array of struct(kind, start, end, score) of the confirmed spans, in text order."""
    seen = text
    if kind == "card":
        seen = F.regexp_replace(F.translate(text, "\u0001", "\u0002"), r"(?<=[0-9])[\x20\-](?=[0-9])", "\u0001")
    found, gaps = F.regexp_extract_all(seen, F.lit(PATTERN[kind]), F.lit(0)), F.split(seen, PATTERN[kind], -1)
    pairs = _let(found, lambda f: F.zip_with(F.slice(gaps, 1, F.size(f)), f, lambda g, m: F.struct(g.alias("gap"), m.alias("match"))))

    def confirmed(p: Column) -> Column:
        starts = _running(F.transform(p, lambda x: (F.length(x["gap"]) + F.length(x["match"])).cast("long")))
        # a start is the sum before the pair and the pair's own gap
        numbered = F.zip_with(F.transform(p, lambda x, i: F.struct(x["gap"].alias("gap"), x["match"].alias("match"), i.alias("i"))), starts, lambda x, s: F.struct(x["i"].alias("i"), x["match"].alias("match"), (s + F.length(x["gap"])).alias("start")))
        long = F.filter(numbered, lambda x: F.length(x["match"]) >= 13) if kind == "card" else numbered
        scored = F.transform(F.filter(long, lambda x: _valid(kind, x["match"])), lambda x: F.struct(
            F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["match"])).alias("end"),
            (F.lit(START_SCORE[kind]) + F.when(F.lower(_in_front(p, x["i"])).rlike(CONTEXT_WORDS[kind]), F.lit(0.4)).otherwise(F.lit(0.0))).alias("score")))
        return scored if kind in BASE else F.filter(scored, lambda x: x["score"] >= MIN_SCORE)

    none = F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint,score:double>>)")
    return F.when(text.rlike(ROUGH[kind]), _let(pairs, confirmed)).otherwise(none)


def find(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """The input with a column of spans: kind, start, end (code points, end exclusive) and score, by kind, then start."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(out, F.concat(*[_spans(t, k) for k in KINDS]))


def joined(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    return F.array_join(F.transform(F.filter(spans, lambda x: x["kind"].isin(*kinds)), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _between(pieces: Column, lo: Column, hi: Column) -> Column:
    """Characters lo to hi of a text that is given in pieces of ``PIECE`` characters."""
    a, b = F.floor(lo / PIECE).cast("int"), F.floor(hi / PIECE).cast("int")
    at = lambda k: F.coalesce(F.get(pieces, k), F.lit(""))
    head, tail = (lo % PIECE).cast("int"), (hi % PIECE).cast("int")
    return F.when(a == b, F.substring(at(a), head + 1, tail - head)).otherwise(
        F.concat(F.substring(at(a), head + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, a + 2, b - a - 1), ""), F.substring(at(b), F.lit(1), tail)))


def _cleaned(text: Column, spans: Column) -> Column:
    """The text with its spans (by start) replaced; a span that begins before the end of an earlier one joins it."""

    def placed(groups: Column) -> Column:
        """Each span with the end of all spans before it: within its group from the end of the groups before."""
        ends = F.transform(groups, lambda g: F.array_max(F.transform(g, lambda x: x["end"])))
        before = _let(ends, lambda e: F.transform(e, lambda _, k: F.coalesce(F.array_max(F.slice(e, 1, k)), F.lit(0).cast("long"))))
        step = lambda acc, x: F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], F.array(F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), acc["at"].alias("before")))).alias("out"))
        out = F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint,before:bigint>>)")
        return F.flatten(F.zip_with(groups, before, lambda g, b: F.aggregate(g, F.struct(b.alias("at"), out.alias("out")), step, lambda acc: acc["out"])))

    def joined_up(pieces: Column, all_: Column) -> Column:
        parts = F.transform(F.filter(all_, lambda x: x["start"] >= x["before"]), lambda x: F.concat(_between(pieces, x["before"], x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))
        last = F.array_max(F.transform(all_, lambda x: x["end"]))
        return F.concat(F.array_join(parts, ""), _between(pieces, last, F.length(text).cast("long")))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return _let(pieces, lambda p: _let(_let(_groups(spans), placed), lambda all_: joined_up(p, all_)))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input with every found span replaced by its kind in brackets; overlapping spans become one, named after
    the first.  Texts without spans, nulls included, stay as they are."""
    spans = f"spans_{uuid.uuid4().hex}"  # no column of the input has this name
    got = find(docs, text, spans)
    first = F.expr(f"array_sort({spans}, (a, b) -> case when a.start <> b.start then case when a.start < b.start then -1 else 1 end when a.end <> b.end then case when a.end > b.end then -1 else 1 end else 0 end)")
    clean = _let(first, lambda s: _cleaned(F.col(text), s))
    return got.withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(F.col(text))).drop(spans)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, all spans, their number (n_spans) and scores, of every document."""
    got = find(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return got.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(F.col("spans"), BASE), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
                      F.size("spans").cast("long").alias("n_spans"), F.transform("spans", lambda x: F.round(x["score"], 2)).alias("scores"))
