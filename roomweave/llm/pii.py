"""Personal data and secrets in texts, with DataFrame functions only.

Regular expressions propose spans.  Checks confirm them: octets at most 255, Luhn for cards, mod 97 for account
numbers, digit counts for phones, number ranges for social security numbers.  Words nearby raise the score or lower
it.  Confirmed spans of the four base kinds stay whatever their score; spans of the added kinds stay from
``min_score`` on: at 0.6, a confirmed account number or key goes where words nearby call it a placeholder, and a social
security number only stays where words nearby call it one.

Spark has no function for the places of matches.  split() gives what lies between the matches of a pattern and
regexp_extract_all() the matches; running sums of their lengths are the places.  Texts in which a pattern cannot match
(no "@", no digit) skip it.  The patterns are written so that Java's matcher neither backtracks over long runs nor
recurses: a run that failed from its first character is not tried from its second.

Null and empty texts have no spans.  Places count code points, from 0, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind -> (pattern, sign that it may occur). \\G is where the match before ended.
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(text, '@')"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "rlike(text, '[0-9][.][0-9]')"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "rlike(text, '[0-9][ -]?[0-9]')"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "contains(text, '+')"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", "rlike(text, '[A-Z]{2}[0-9]{2}')"),
    "secret": (r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:password|passwd|secret|token|api_key)\x20?[=:]\x20?\"?[A-Za-z0-9]{16,64}+", "rlike(text, 'AKIA|[=:]')"),
    "ssn": (r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])", "rlike(text, '[0-9]-[0-9][0-9]-[0-9]')"),
}
BASE = ("email", "ip", "card", "phone")
#: Score of a proposed span, what its check adds, and what words nearby add or take away.
PROPOSED, CONFIRMED, NEARBY = 0.4, 0.3, 0.15
WEAK = {"ssn": (0.3, 0.2)}  # kinds whose form and check say less
AROUND = 40
WORDS_NEARBY = {
    "email": "mail|contact|correo|kontakt|courriel",
    "ip": "address|server|host|ip",
    "card": "card|visa|credit|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|konto|compte|cuenta|bank",
    "secret": "key|password|secret|token|api",
    "ssn": "ssn|social security|security number",
}
WORDS_AGAINST = "placeholder|dummy|fictitious|not a real"
BLOCK = 128
CHUNK = 1024  # code points; a place in a long text is found from the start of its chunk, not of the text


def _chunks(needed: Column) -> Column:
    return F.when(needed, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))


def _cut(start: Column, size: Column) -> Column:
    """Code points of the text from start on, by the column chunks."""
    first = F.floor(start / CHUNK).cast("int")
    held = F.array_join(F.slice("chunks", first + 1, F.floor((start + size) / CHUNK).cast("int") - first + 1), "")
    return F.substring(held, (start - first * CHUNK + 1).cast("int"), size.cast("int"))


def running(values: Column, start: Column, total) -> Column:
    """For an array: total() of start and what stands before each element. By blocks, so time is not quadratic."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, BLOCK))
    up_to = lambda xs, i, first: total(F.concat(F.array(first), F.slice(xs, 1, i)))
    before = F.aggregate(F.transform(blocks, total), F.array(start), lambda a, x: F.concat(a, F.array(total(F.array(F.element_at(a, -1), x)))))
    within = lambda xs, first: F.transform(xs, lambda _, i: up_to(xs, i, first))
    return F.flatten(F.zip_with(blocks, F.slice(before, 1, F.size(blocks)), within))


def running_sums(lengths: Column) -> Column:
    """For an array of int: the sum of what stands before each element."""
    return running(lengths, F.lit(0), lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _mod97(x: Column) -> Column:
    turned = F.concat(F.substring(x, 5, 64), F.substring(x, 1, 4))
    values = F.transform(F.split(turned, ""), lambda c: F.when(c.between("A", "Z"), F.ascii(c) - 55).otherwise(F.ascii(c) - 48))
    return F.aggregate(values, F.lit(0), lambda a, v: (F.when(v > 9, a * 100).otherwise(a * 10) + v) % 97)


def confirmed(kind: str, x: Column) -> Column:
    """Do the checks of a kind hold for the matched string?"""
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return x.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.char_length(_digits(x)).between(16, 19) & F.call_function("luhn_check", _digits(x))
    if kind == "phone":
        return F.char_length(_digits(x)).between(8, 15)
    if kind == "iban":
        return _mod97(F.translate(x, " ", "")) == 1
    if kind == "ssn":
        return x.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    return F.lit(True)


def find_spans(docs: DataFrame, min_score: float = 0.6, text: str = "text") -> DataFrame:
    """All columns of docs in a struct ``row``, its text (null: empty), and spans: array of (kind, start, end, score).

    Matches, their ends and spans are made one after the other, so that no function of array elements computes them again.
    """
    df = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    found = df.select("row", "text", *(F.when(F.expr(sign), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none).alias(kind) for kind, (pattern, sign) in PATTERNS.items()))
    found = found.withColumns({f"{kind}_sizes": _sizes(kind, pattern) for kind, (pattern, _) in PATTERNS.items()})
    found = found.withColumns({f"{kind}_before": F.when(F.size(kind) > 0, running_sums(F.col(f"{kind}_sizes"))) for kind in PATTERNS})
    found = found.withColumn("chunks", _chunks(sum((F.size(kind) for kind in PATTERNS), F.lit(0)) > 0))
    return found.select("row", "text", F.concat(*(_spans_of(kind, min_score) for kind in PATTERNS)).alias("spans"))


def _sizes(kind: str, pattern: str) -> Column:
    """For each match: its code points and those between it and the match before."""
    gaps = F.transform(F.split("text", pattern, -1), lambda x: F.char_length(x))
    lengths = F.transform(F.col(kind), lambda x: F.char_length(x))
    return F.when(F.size(kind) > 0, F.zip_with(F.slice(gaps, 1, F.size(kind)), lengths, lambda g, m: g + m)).otherwise(F.array().cast("array<int>"))


def _spans_of(kind: str, min_score: float) -> Column:
    """The confirmed spans of a kind, from the columns text, its matches, their sizes and the sums before them."""
    proposed, checked = WEAK.get(kind, (PROPOSED, CONFIRMED))
    ends = F.zip_with(F.col(f"{kind}_before"), F.col(f"{kind}_sizes"), lambda a, b: a + b)

    def span(x: Column, end: Column) -> Column:
        start = end - F.char_length(x)
        near = F.lower(F.concat(_cut(F.greatest(F.lit(0), start - AROUND), F.least(F.lit(AROUND), start)), F.lit(" "), _cut(end, F.lit(AROUND))))
        says = lambda words: F.when(F.regexp_like(near, F.lit(words)), NEARBY).otherwise(0.0)
        score = F.lit(proposed) + F.when(confirmed(kind, x), checked).otherwise(0.0) + says(WORDS_NEARBY[kind]) - says(WORDS_AGAINST)
        stays = confirmed(kind, x) if kind in BASE else F.round(score, 2) >= min_score
        return F.when(stays, F.struct(F.lit(kind).alias("kind"), start.cast("long").alias("start"), end.cast("long").alias("end"), F.round(score, 2).alias("score")))

    kept = F.array_compact(F.zip_with(F.col(kind), ends, span))
    return F.when(F.size(kind) == 0, F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")).otherwise(kept)


def with_masked(found: DataFrame) -> DataFrame:
    """found (text, spans) with masked: the text with each span replaced by its kind in brackets; spans that overlap are
    replaced together, once, by the kind of the first."""
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))))
    found = found.withColumn("_spans", ordered).withColumn("chunks", _chunks(F.size("_spans") > 0)).withColumn("_ends", F.transform("_spans", lambda s: s.end))
    found = found.withColumn("_reached", F.when(F.size("_ends") > 0, running(F.col("_ends"), F.lit(0).cast("long"), F.array_max)))  # before each span
    apart = F.filter(F.zip_with("_spans", "_reached", lambda s, reached: F.struct(s.start.alias("start"), s.kind.alias("kind"), reached.alias("before"))), lambda s: s.start >= s.before)
    piece = lambda s: F.concat(_cut(s.before, s.start - s.before), F.lit("["), F.upper(s.kind), F.lit("]"))
    rest = _cut(F.array_max("_ends"), F.char_length("text") - F.array_max("_ends"))
    return found.withColumn("masked", F.when(F.size("_ends") == 0, F.col("text")).otherwise(F.concat(F.array_join(F.transform(apart, piece), ""), rest))).drop("_spans", "_ends", "_reached", "chunks")
