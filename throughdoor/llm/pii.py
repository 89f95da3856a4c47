"""Personal data: patterns propose spans, checksums confirm, context scores.

Everything is a column expression. Spark's ``regexp_extract_all`` returns the
matches and ``split`` with the same pattern the stretches between them, so the
position of a match is the running length of what stands before it; both count
code points.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: the kinds, in the order that breaks ties of equal starts
BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = BASE_KINDS + ["iban"]

# Patterns. A local part, an octet or a digit run is only tried from where it
# begins (or where the last match ended, \G), and runs are possessive, so a run
# of a million digits or letters is read once and not once for each of its ends.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    # a run of under twelve digits can never pass; where it matches, it takes the whole run
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
}

# What a text must hold for a pattern to be tried at all; never excludes a match.
NEEDS = {"email": r"@[A-Za-z0-9-]+\.", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]",
         "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}"}

# Words that, shortly before a span, make it likelier to be what it looks like.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reply|kontakt|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|login|client|adresse|servidor|serveur)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|pay|karte|tarjeta|carte)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|tel[eé]fono|t[eé]l[eé]phone)\b",
    "iban": r"(?i)\b(?:iban|bank|account|transfer|konto|cuenta|compte)\b",
}
# A checksum says more than a shape does.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
CONTEXT_GAIN = 0.3
CONTEXT_CHARS = 40


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """True if the digits of ``match`` pass the mod-10 check from the right."""
    figures = F.transform(F.split(F.reverse(digits(match)), ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))

    def weigh(d: Column, at: Column) -> Column:
        twice = d * 2
        return F.when(at % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.transform(figures, weigh), F.lit(0), lambda s, x: s + x)
    return total % 10 == 0


def mod97(match: Column) -> Column:
    """True if an account number (country, check digits, rest) leaves 1 modulo 97."""
    plain = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    values = F.transform(F.split(turned, ""), lambda c: F.when(
        c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(F.coalesce(c.try_cast("int"), F.lit(0))))
    # letters stand for two digits
    rest = F.aggregate(values, F.lit(0), lambda s, v: (F.when(v > 9, s * 100).otherwise(s * 10) + v) % 97)
    return rest == 1


def octets(match: Column) -> Column:
    """True if all four parts are at most 255, leading zeros aside."""
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255))


def confirmed(kind: str, match: Column) -> Column:
    n = F.length(digits(match))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return octets(match)
    if kind == "card":
        return n.between(12, 19) & luhn(match)
    if kind == "phone":
        return n.between(9, 15)
    plain = F.length(F.regexp_replace(match, " ", ""))
    return plain.between(15, 34) & mod97(match)


SPANS = "array<struct<start:int,rank:int,end:int,match:string,score:double>>"


def proposals(text: Column, kind: str) -> Column:
    """What the pattern finds: array<struct<match, before>>, in order.

    ``before`` is the stretch since the previous match.
    """
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    between = F.split(text, PATTERNS[kind], -1)
    pairs = F.arrays_zip(found.alias("match"), between.alias("before"))
    none = F.array().cast("array<struct<match:string,before:string>>")
    # the stretch after the last match has no partner
    return F.when(text.rlike(NEEDS[kind]), F.filter(pairs, lambda p: p["match"].isNotNull())).otherwise(none)


def located(pairs: Column, kind: str) -> Column:
    """Confirmed spans of one kind with positions and scores, in order."""

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["before"])
        end = start + F.length(pair["match"])
        near = F.substring(pair["before"], -CONTEXT_CHARS, CONTEXT_CHARS).rlike(CONTEXT[kind])
        score = F.least(F.lit(1.0), F.lit(BASE_SCORE[kind]) + F.when(near, CONTEXT_GAIN).otherwise(0.0))
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"),
                        pair["match"].alias("match"), score.alias("score"))
        kept = F.when(confirmed(kind, pair["match"]), F.concat(state["spans"], F.array(span)))
        return F.struct(end.alias("at"), kept.otherwise(state["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))
    return F.aggregate(pairs, start, step, lambda state: state["spans"])


def find(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``df`` with ``out``: every confirmed span, by start and then kind.

    Elements are (start, rank, end, match, score): code points with the end
    exclusive, ``KINDS[rank]``, the matched text, and a score that rises where a
    context word stands within ``CONTEXT_CHARS`` before the span (or since the
    previous span of the kind). Null and empty texts have no spans. Columns of
    ``df`` are kept; ``out`` replaces a column of that name.
    """
    columns = [c for c in df.columns if c.lower() != out.lower()]
    whole = F.coalesce(df[text].cast("string"), F.lit(""))
    raw = df.select(*[df[c] for c in columns], F.struct(
        *[proposals(whole, kind).alias(kind) for kind in KINDS]).alias("_pii_raw"))
    spans = F.array_sort(F.concat(*[located(F.col(f"_pii_raw.{kind}"), kind) for kind in KINDS]))
    return raw.withColumn(out, spans).drop("_pii_raw")


def named(span: Column) -> Column:
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), span["rank"] + 1)
    return F.concat_ws(":", kind, span["start"], span["end"])


def count_of(spans: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")


def mask(df: DataFrame, text: str = "text", out: str = "masked", least: float = 0.0) -> DataFrame:
    """``df`` with the spans scoring ``least`` or more replaced by ``[KIND]``.

    Where spans overlap, the one that starts first is replaced, up to its end.
    """
    found = find(df, text, "_pii")
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(whole, state["at"] + 1, s["start"] - state["at"])
        longer = F.concat(state["text"], gap, F.element_at(tags, s["rank"] + 1))
        use = (s["score"] >= least) & (s["start"] >= state["at"])
        return F.struct(F.when(use, s["end"]).otherwise(state["at"]).alias("at"),
                        F.when(use, longer).otherwise(state["text"]).alias("text"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    masked = F.aggregate(F.col("_pii"), start, step, lambda state: F.concat(
        state["text"], F.substring(whole, state["at"] + 1, F.length(whole))))
    return found.withColumn(out, masked).drop("_pii")


def digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts, the digest of the base spans, all spans.

    ``scores`` follows ``spans``, element by element.
    """
    found = find(df.select(key, text), text, "_pii")
    spans = F.col("_pii")
    base = F.filter(spans, lambda s: s["rank"] < len(BASE_KINDS))
    return found.select(
        key, *[count_of(spans, k).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.transform(base, named), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(spans, named), ",").alias("spans"),
        F.transform(spans, lambda s: F.round(s["score"], 3)).alias("scores"))
