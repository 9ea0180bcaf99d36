"""Secret scans through a trigram inverted index (operator 4, DataFrame functions only).

Each rule's regular expression gives a Boolean trigram query.  Postings (trigram, text key) of the trigrams
that any query names are made from all texts and intersected by key; only the candidates of a rule are
verified with its regular expression.  Rules without a mandatory trigram scan every text.  The key is a
64-bit hash of the text: equal texts share postings, and a collision can only add a candidate, which
verification then refuses.  Keys need no doc_id, so null and repeated ids do no harm.  The candidates' keys go back to the
rows by broadcast if they are few; else the rows of equal texts are dealt to several tasks.

Defined cases: null text is empty and has no spans; very long texts are scanned whole; spans that begin together come in the
order of the rules; repeated rows give repeated rows; an empty table gives an empty result; other columns are kept, whatever
their names, but for one named like the result (``out``), which is replaced; columns of one name are refused.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.sized import spread
from ..plans.store import settle
from .spans import matches, none, of_kind, render
from .trigrams import Query, grams_of, query_of

#: Fixed patterns of the base rules, then of the added ones; a rule's match must also pass its check.
RULES = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key)["']? *[:=] *["']?)([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
    "github": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "google": r"AIza[0-9A-Za-z_-]{35}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+",
    "pem": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----",
}
BASE = ("assign", "access", "hex")
#: Candidate keys (16 bytes each) that may be broadcast; beyond, rows of one key are dealt to so many tasks.
BROADCAST_KEYS = 1_000_000
SALTS = 16


def _checks(kind: str, m: Column) -> Column:
    if kind == "assign":
        return F.length(F.regexp_extract(m, RULES["assign"], 2)) >= 6
    if kind == "access":
        return F.length(m) >= 20
    return F.lit(True)


def _judge(kind: str):
    return lambda m, before, after: F.struct(_checks(kind, m).alias("keep"), F.lit(kind).alias("kind"), F.lit(1.0).alias("score"))


def _sortable(spans: Column, order: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s.start.alias("start"), F.lit(order).alias("o"), s.end.alias("end"), s.kind.alias("kind"), s.score.alias("score")))


def key_of(text: Column) -> Column:
    return F.xxhash64(text)


def postings(docs: DataFrame, grams: list[str], text: str = "text") -> DataFrame:
    """The inverted index over ``grams``: one row (gram number, key) for each text that has the gram, letters in
    either case."""
    body = F.coalesce(F.col(text), F.lit(""))
    numbers = F.array(*[F.struct(F.lit(k).alias("n"), F.lit(g).alias("g")) for k, g in enumerate(grams)])
    there = F.transform(F.array(F.lower(body)), lambda low: F.filter(numbers, lambda x: F.contains(low, x.g)))[0]
    return docs.select(key_of(body).alias("key"), F.explode(there.n).alias("gram"))


def _evaluate(query: Query, grams: list[str], words: list[Column]) -> Column:
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        k = grams.index(query)
        return words[k // 62].bitwiseAND(F.lit(1 << (k % 62))) != 0
    parts = [_evaluate(p, grams, words) for p in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query[0] == "and" else out | p
    return out


def candidates(index: DataFrame, queries: dict[str, Query], grams: list[str]) -> DataFrame:
    """Intersect the postings: ``key`` and ``rules``, a bit for each rule (in the order of ``queries``) whose query
    holds; keys without any are left out."""
    n = (len(grams) + 61) // 62
    words = [F.bit_or(F.when(F.col("gram").between(62 * k, 62 * k + 61), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("gram") - 62 * k)).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(n)]
    masks = index.groupBy("key").agg(*words)
    rules = F.lit(0).cast("long")
    for k, q in enumerate(queries.values()):
        rules = rules.bitwiseOR(F.when(_evaluate(q, grams, [F.col(f"w{i}") for i in range(n)]), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return masks.select("key", rules.alias("rules")).filter("rules <> 0")


def find(docs: DataFrame, rules: dict[str, str] | None = None, text: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with ``out``: array of (kind, start, end, score), by start, then rule; offsets are code points."""
    rules = rules or RULES
    queries = {k: query_of(p) for k, p in rules.items()}
    indexed = {k: q for k, q in queries.items() if q is not True}
    grams = sorted({g for q in indexed.values() for g in grams_of(q)})
    names = docs.columns
    if len(names) != len(set(names)):
        raise ValueError("columns must have different names")
    docs = spread(docs)
    mark = uuid.uuid4().hex[:8]
    key, bits, salt = f"key_{mark}", f"rules_{mark}", f"salt_{mark}"
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.withColumn(key, key_of(body))
    if grams:
        some = settle(candidates(postings(docs, grams, text), indexed, grams).select(F.col("key").alias(key), F.col("rules").alias(bits)))
        if some.count() <= BROADCAST_KEYS:
            keyed = keyed.join(F.broadcast(some), key, "left")
        else:
            plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name != text and f.dataType.typeName() not in ("map", "variant")]
            keyed = keyed.withColumn(salt, F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("int") if plain else F.lit(0))
            keyed = keyed.join(some.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, salt], "left")
    else:
        keyed = keyed.withColumn(bits, F.lit(None).cast("long"))
    passes = []
    for order, (kind, pattern) in enumerate(rules.items()):
        spans = matches(body, pattern, _judge(kind))
        if kind in indexed:
            spans = F.when(F.col(bits).bitwiseAND(F.lit(1 << list(indexed).index(kind))) != 0, spans).otherwise(none())
        passes.append(_sortable(spans, order))
    found = F.transform(F.array_sort(F.concat(*passes)), lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"), s.score.alias("score")))
    return keyed.withColumn(out, found).select(*[F.col(f"`{n}`") for n in names if n != out], out)


def redact(docs: DataFrame, mark: str = "[secret]", text: str = "text") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mark``; overlapping spans become one mark."""
    spans = f"spans_{uuid.uuid4().hex[:8]}"
    found = find(docs, text=text, out=spans)
    body = F.col(text)

    def step(acc: Column, s: Column) -> Column:
        fresh = s.start >= acc.at
        gap = F.substring(body, acc.at + 1, s.start - acc.at)
        return F.struct(F.greatest(acc.at, s.end).alias("at"), F.when(fresh, F.concat(acc.out, gap, F.lit(mark))).otherwise(acc.out).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(spans, start, step, lambda acc: F.concat(acc.out, F.substring(body, acc.at + 1, F.length(body))))
    return found.withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(body)).drop(spans)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts and a hash of the base spans, and all spans."""
    found = find(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "spans")
    counts = [F.size(of_kind(F.col("spans"), kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    base = of_kind(F.col("spans"), *BASE)
    return found.select("doc_id", *counts, F.sha2(render(base), 256).alias("base_sha256"), render(F.col("spans")).alias("spans"))
