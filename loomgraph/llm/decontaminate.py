"""Benchmark decontamination by spaced-seed hashing (operator 9, DataFrame functions only).

A text is its sequence of lower-cased words (split at ASCII white space), each as a 64-bit hash.  A seed is the
hash of the words at the positions that a mask keeps; the others may differ.  Test and training seeds
are joined, and around each hit the two texts are laid on one another: a document holds a passage of an item
if ``WINDOW`` consecutive words of the item meet at least ``NEED`` equal words of the document.  The two masks leave
no gap: any two substitutions in ``WINDOW`` words spare a whole seed, so no such passage is missed.  Items of
8 to 12 words must occur exactly; shorter ones, which have no seed, are looked up by the hash of all their words
and must occur exactly too.

Training seeds are made, looked up and dropped row by row; only hits leave the scan.  The item side is
broadcast, with the items' words, when that takes at most ``BROADCAST_BYTES``.  Beyond, seeds alone are shuffled, those that
many items share by a salt too, and the words of both texts are brought to the distinct hits.
A hit is verified only where a run of hits on its diagonal begins.

Defined cases: null or empty texts are clean; texts of fewer than 8 words can hold only shorter items; items with null or
empty text are never met; equal items are all reported; of equally good overlaps the first is reported; repeated doc_ids
share their rows; null doc_ids are reported as null; very long texts are compared whole; other columns are kept and take
no part, whatever their names; an empty table on either side gives an empty result (``clean`` keeps all rows if the
item table is empty).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.sized import spread
from ..plans.store import settle

SPAN = 8
MASKS = ((0, 1, 2, 3, 6, 7), (0, 1, 3, 5, 6, 7))
WINDOW, NEED = 13, 11
#: Bytes of the item side (seed rows with the item's words) that may be broadcast, and the most rows.
BROADCAST_BYTES = 64 << 20
#: Tasks that the rows of one seed, or of one text, are dealt to.
SALTS = 16


def word_hashes(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t\\n\\x0B\\f\\r]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def seeds(words: Column) -> Column:
    """All seeds of a text, those of the first mask first; each mask has size - SPAN + 1."""

    def under(mask: tuple[int, ...], number: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(words) - SPAN), lambda i: F.xxhash64(F.lit(number), *[F.get(words, i + k) for k in mask]))

    return F.when(F.size(words) >= SPAN, F.concat(*[under(m, k) for k, m in enumerate(MASKS)]))


def _hashed(text: Column) -> Column:
    """Struct of a text's words and seeds.

    A lambda binds the words: an array that is named inside another lambda would be made anew at each of its
    elements once Catalyst has merged the projections."""
    return F.transform(F.array(word_hashes(text)), lambda w: F.struct(w.alias("words"), seeds(w).alias("seeds")))[0]


def _exploded(rows: DataFrame) -> DataFrame:
    """A row for each seed; the outer form, since the inner one would evaluate the seeds a second time as a filter
    on their number.  Texts without seeds give a null seed, which meets nothing."""
    return rows.select("*", F.posexplode_outer("h.seeds").alias("n", "seed"))


def _item_seeds(items: DataFrame, with_words: bool) -> DataFrame:
    """``items``: item_id, h."""
    some = _exploded(items).filter("seed is not null")
    per = F.size("h.words") - SPAN + 1
    kept = [F.col("h.words").alias("item_words")] if with_words else []
    return some.select("item_id", *kept, "seed", (F.col("n") % per).alias("j"), F.when(F.col("n") % per > 0, F.get("h.seeds", F.col("n") - 1)).alias("seed_before"))


def _laid(words: Column, item: Column, first: Column) -> Column:
    """Struct of how many words meet an equal one when the item begins at ``first``, in all and in the best window."""
    low = F.greatest(F.lit(0), -first)
    both = F.least(F.size(item) - low, F.size(words) - first - low)
    equal = F.zip_with(F.slice(words, first + low + 1, both), F.slice(item, low + 1, both), lambda a, b: (a == b).cast("int"))
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, e: a + e)
    best = lambda x: F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(x) - WINDOW + 1)), lambda t: total(F.slice(x, t, F.lit(WINDOW)))))
    return F.transform(F.array(equal), lambda x: F.struct(total(x).alias("matched"), best(x).alias("window")))[0]


def _hits_by_broadcast(docs: DataFrame, items: DataFrame, names: list[str]) -> DataFrame:
    """``names``, item_id, item_words, first, words: every beginning of a run of hits; seeds are looked up in the scan."""
    i = F.col("n") % (F.size("h.words") - SPAN + 1)
    starts = (i == 0) | F.col("seed_before").isNull() | (F.get("h.seeds", F.col("n") - 1) != F.col("seed_before"))
    met = _exploded(docs).join(F.broadcast(_item_seeds(items, True)), "seed").filter(starts)
    return met.select(*names, "item_id", "item_words", (i - F.col("j")).alias("first"), F.col("h.words").alias("words"))


def _hits_by_shuffle(docs: DataFrame, items: DataFrame, names: list[str]) -> DataFrame:
    """The same, without a broadcast: only numbers are shuffled by seed, and the words join the distinct hits."""
    mark = [F.xxhash64("h.words").alias("text_a"), F.xxhash64("h.words", F.lit(1)).alias("text_b")]
    marked = docs.select(*names, "h", *mark)
    i = F.col("n") % (F.size("h.words") - SPAN + 1)
    salt = F.pmod(F.xxhash64("text_a", "n"), F.lit(SALTS)).cast("int").alias("salt")
    train = _exploded(marked.select("text_a", "text_b", "h")).filter("seed is not null")
    train = train.select("text_a", "text_b", "seed", salt, i.alias("i"), F.when(i > 0, F.get("h.seeds", F.col("n") - 1)).alias("own_before"))
    test = _item_seeds(items, False).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = train.join(test, ["seed", "salt"]).filter((F.col("i") == 0) | F.col("seed_before").isNull() | (F.col("own_before") != F.col("seed_before")))
    found = met.select("text_a", "text_b", "item_id", (F.col("i") - F.col("j")).alias("first")).distinct()
    # equal texts are dealt to several tasks, and so are the hits of one item
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    owned = marked.select(*names, "text_a", "text_b", F.col("h.words").alias("words"), F.pmod(F.xxhash64(*names), F.lit(SALTS)).cast("int").alias("salt"))
    words = items.select("item_id", F.col("h.words").alias("item_words"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return found.join(words, ["item_id", "salt"]).join(owned, ["text_a", "text_b", "salt"]).select(*names, "item_id", "item_words", "first", "words")


def _short(docs: DataFrame, items: DataFrame, names: list[str]) -> DataFrame | None:
    """Items too short for a seed, wherever all their words occur; None if there are none."""
    size = F.size("h.words")
    few = items.filter((size > 0) & (size < SPAN))
    lengths = sorted(r[0] for r in few.select(size).distinct().collect())
    if not lengths:
        return None
    wanted = settle(few.select("item_id", size.alias("item_tokens"), F.xxhash64("h.words").alias("seed")))
    small = wanted.count() <= BROADCAST_BYTES // 64

    def runs(words: Column, n: int) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.struct(F.xxhash64(F.slice(words, i + 1, F.lit(n))).alias("seed"), i.alias("first"), F.lit(n).alias("item_tokens")))
        return F.when(F.size(words) >= n, made).otherwise(F.array().cast("array<struct<seed:bigint,first:int,item_tokens:int>>"))

    spans = lambda w: F.concat(*[runs(w, n) for n in lengths])
    rows = docs.select(*names, F.explode(F.transform(F.array("h.words"), spans)[0]).alias("s")).select(*names, "s.*")
    # the first place of each, before rows of one seed meet
    rows = rows if small else rows.groupBy(*names, "seed", "item_tokens").agg(F.min("first").alias("first"))
    met = rows.join(F.broadcast(wanted) if small else wanted, ["seed", "item_tokens"])
    n = F.col("item_tokens")
    return met.groupBy(*names, "item_id", "item_tokens").agg(F.min("first").alias("first_token")).select(*names, "item_id", n, n.alias("matched_tokens"), n.alias("window_matches"), "first_token")


def hits(docs: DataFrame, items: DataFrame, keys: dict[str, Column], text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Verified overlaps, the best one for each value of the columns ``keys`` and item: these columns, item_id,
    item_tokens, matched_tokens (of the laid out item), window_matches (in the best window) and first_token
    (where the item would begin).

    The threshold applies after the grouping.  As a filter on single hits it would move into the join, and with
    it the array functions, for which Spark has no generated code: seeds would no longer be looked up where
    they are made, but leave as rows that each hold the whole document."""
    names = list(keys)
    train = spread(docs.select(*[c.alias(k) for k, c in keys.items()], F.col(text).alias("body"))).select(*names, _hashed(F.col("body")).alias("h"))
    test = items.select(F.col(item_id).alias("item_id"), _hashed(F.col(item_text)).alias("h"))
    n = F.size("h.words").cast("long")
    size = test.agg(F.sum(F.when(n >= SPAN, len(MASKS) * (n - SPAN + 1) * (8 * n + 64)))).first()[0] or 0
    met = (_hits_by_broadcast if size <= BROADCAST_BYTES else _hits_by_shuffle)(train, test, names)
    laid = met.select(*names, "item_id", F.size("item_words").alias("item_tokens"), F.col("first").alias("first_token"), _laid(F.col("words"), F.col("item_words"), F.col("first")).alias("laid"))
    best = F.max(F.struct("laid.window", "laid.matched", (-F.col("first_token")).alias("at"))).alias("best")
    rows = laid.groupBy(*names, "item_id", "item_tokens").agg(best)
    enough = F.col("best.window") >= F.when(F.col("item_tokens") >= WINDOW, F.lit(NEED)).otherwise(F.col("item_tokens"))
    found = rows.filter(enough).select(*names, "item_id", "item_tokens", F.col("best.matched").alias("matched_tokens"), F.col("best.window").alias("window_matches"), (-F.col("best.at")).alias("first_token"))
    short = _short(train, test, names)
    return found if short is None else found.unionByName(short)


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document and item that share a passage, with the best of their overlaps."""
    found = hits(docs, items, {"doc_id": F.col("doc_id").cast("long")})
    return found.select("doc_id", "item_id", *[F.col(c).cast("long").alias(c) for c in ("item_tokens", "matched_tokens", "window_matches", "first_token")])


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no passage of an item.

    Contaminated texts are named by two 64-bit hashes, so null and repeated doc_ids need no care.  Their list is broadcast if
    it is short; else rows of one text are dealt to several tasks."""
    body = F.coalesce(F.col(text), F.lit(""))
    mark = uuid.uuid4().hex[:8]
    names = {f"leak_{mark}_a": F.xxhash64(body), f"leak_{mark}_b": F.xxhash64(body, F.lit(1))}
    bad = settle(hits(docs, items, names, text).select(*names).distinct())
    if bad.count() <= BROADCAST_BYTES // 64:
        kept = docs.withColumns(names).join(F.broadcast(bad), list(names), "left_anti")
    else:
        salt = f"leak_{mark}_salt"
        plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name != text and f.dataType.typeName() not in ("map", "variant")]
        salted = docs.withColumns(names | {salt: F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("int") if plain else F.lit(0)})
        kept = salted.join(bad.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*names, salt], "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


#: Lays every document on every item wherever they share a word: no seeds.
ORACLE = f"""
with d as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\v\\f\\r]+'), lambda w: w <> '') as w from documents),
b as (select item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\v\\f\\r]+'), lambda w: w <> '') as w from benchmark),
dt as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) - 1 as i from d),
bt as (select item_id, len(w) as l, unnest(w) as word, generate_subscripts(w, 1) - 1 as j from b),
m as (select doc_id, item_id, l, i - j as diag, j from dt join bt using (word)),
c as (select *, count(*) over (partition by doc_id, item_id, diag order by j range between current row and {WINDOW - 1} following) as n from m),
g as (select doc_id, item_id, l, diag, count(*) as matched, max(n) as best from c group by all),
k as (select * from g where best >= case when l >= {WINDOW} then {NEED} else l end),
r as (select *, row_number() over (partition by doc_id, item_id order by best desc, matched desc, diag) as rank from k)
select doc_id, item_id, l::bigint as item_tokens, matched::bigint as matched_tokens, best::bigint as window_matches, diag::bigint as first_token from r where rank = 1
"""
