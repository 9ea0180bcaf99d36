"""Personal data by patterns, checksums and context (operator 2, DataFrame functions only).

Regular expressions propose spans; Luhn and mod-97 checks, octet ranges and digit counts confirm them; words
near a span raise its score.  The four base kinds are kept whatever their score; the added kinds need
``threshold``.

The patterns for e-mail and IP addresses match what their plain forms match.  A match can only begin where
a run of its first class begins or where the match before it ended (``\\G``), and runs are taken possessively, so
that very long runs cost linear time.

Defined cases: null text is empty and has no spans; very long texts are scanned whole; spans that begin together come in the
order of ``KINDS``; null and repeated doc_ids do no harm, repeated rows give repeated rows; an empty table gives an empty
result; ``find`` keeps all columns, whatever their names, and adds ``out``, which replaces a column of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .spans import matches, mentions, none, of_kind, render

LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
DIGITS = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
LOCAL_PHONE = r"(?<![+0-9().-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"

CONTEXT = {
    "email": ["mail", "contact", "write to"],
    "ip": ["host", "server", "address", r"\bip\b"],
    "card": ["card", "visa", "master", "amex", "payment", "credit"],
    "phone": ["phone", "tel", "call", "mobile", "fax"],
    "iban": ["iban", "bank", "account", "konto", "compte", "cuenta"],
}
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.7, "card_short": 0.4, "phone_local": 0.4}
BOOST = 0.2
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "card_short", "phone_local")


def _score(kind: str, before: Column, after: Column) -> Column:
    near = mentions(F.concat(before, F.lit(" "), after), CONTEXT[kind.split("_")[0]])
    return F.lit(PRIOR[kind]) + F.when(near, F.lit(BOOST)).otherwise(F.lit(0.0))


def _only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _octets(m: Column) -> Column:
    """All parts at most 255, however many zeros they begin with."""
    return ~m.rlike(r"(?:^|\.)0*+(?:[1-9][0-9]{3,}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])(?:\.|$)")


def _mod97(m: Column) -> Column:
    """ISO 7064 mod 97-10: the first four characters moved to the end, letters as two digits, rest 1."""
    s = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))
    rest = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda acc, c: F.when(c == "", acc).when(c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97),
    )
    return rest == 1


def _said(keep: Column, kind: str | Column, score: Column) -> Column:
    return F.struct(keep.alias("keep"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), score.alias("score"))


def _judges(threshold: float) -> dict[str, tuple[str, str | None, object]]:
    """By pass: pattern, a string without which nothing can match, and the judge."""

    def email(m, before, after):
        return _said(F.lit(True), "email", _score("email", before, after))

    def ip(m, before, after):
        return _said(_octets(m), "ip", _score("ip", before, after))

    def card(m, before, after):
        digits = _only_digits(m)
        n = F.length(digits)
        short = n < 16
        score = F.when(short, _score("card_short", before, after)).otherwise(_score("card", before, after))
        fits = n.between(13, 19) & (~short | (score >= threshold))
        return _said(F.when(fits, F.call_function("luhn_check", digits)).otherwise(F.lit(False)), F.when(short, F.lit("card_short")).otherwise(F.lit("card")), score)

    def phone(m, before, after):
        return _said(F.length(_only_digits(m)).between(8, 15), "phone", _score("phone", before, after))

    def iban(m, before, after):
        score = _score("iban", before, after)
        return _said((score >= threshold) & _mod97(m), "iban", score)

    def local(m, before, after):
        score = _score("phone_local", before, after)
        return _said(score >= threshold, "phone_local", score)

    return {"email": (EMAIL, "@", email), "ip": (IP, ".", ip), "card": (DIGITS, None, card), "phone": (PHONE, "+", phone), "iban": (IBAN, None, iban), "phone_local": (LOCAL_PHONE, None, local)}


def find(docs: DataFrame, text: str = "text", out: str = "spans", threshold: float = 0.6) -> DataFrame:
    """``docs`` with ``out``: array of (kind, start, end, score), by kind as in ``KINDS``, then start; offsets are
    code points, the end exclusive."""
    body = F.coalesce(F.col(text), F.lit(""))
    has_digit = body.rlike("[0-9]")
    passes = []
    for pattern, needs, judge in _judges(threshold).values():
        may = (F.contains(body, F.lit(needs)) if needs else F.lit(True)) & (F.lit(True) if needs == "@" else has_digit)
        passes.append(F.when(may, matches(body, pattern, judge)).otherwise(none()))
    found = docs.withColumn(out, F.concat(*passes))
    kinds = [of_kind(F.col(out), kind) for kind in KINDS]
    return found.withColumn(out, F.concat(*kinds))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts and a hash of the base spans, and all spans."""
    found = find(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "spans")
    counts = [F.size(of_kind(F.col("spans"), kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    base = of_kind(F.col("spans"), *BASE)
    return found.select("doc_id", *counts, F.sha2(render(base), 256).alias("base_sha256"), render(F.col("spans")).alias("spans"))
