"""Language identification by interpolated Kneser-Ney character models (operator 1).

For each language a character n-gram model (orders 1 to ``ORDER``) is estimated over the words of a training
sample: maximal runs of letters, lower-cased, with a border before and after.  The highest order uses counts,
lower orders the number of distinct left neighbours; each order has its own discount n1 / (n1 + 2 n2) and is
interpolated with the next lower one.  The n-grams of all languages are stored as one sorted array of hashes per
order, beside it a matrix with a column per language.

A text's cross-entropy under a model is its negative log probability divided by its characters (borders
included).  The language of the lowest one is predicted.  The rejection is calibrated on sample texts that the
counts did not see: a text is rejected if its cross-entropy is above the mean of its predicted language by more
than ``STRICT`` times the spread that texts of its number of words have.  ``score`` is the share of the chosen
language when 2 ** (-cross-entropy * min(characters, EVIDENCE)) is shared out over the languages.

The fit is the only step that sees a sample: at most ``per_language`` labelled documents of each language, chosen
by a hash of doc_id and text; the documents are whole, and repeated ones are one.  Prediction reads nothing but the text, all of it, and scores each
distinct word once per worker.

Defined cases: null text or text without letters gives ``und``, score 0, rejected; a text in which only
unseen characters occur is scored by the uniform part of the models; ties go to the first language by name; without
any labelled document everything is ``und``; null doc_ids are not trained on and not held out; repeated rows
give repeated rows; a very long text is scored whole; an empty table gives an empty result.
"""

from __future__ import annotations

import dataclasses
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import words as W

ORDER = 5
PER_LANGUAGE = 400
STRICT = 8.0
EVIDENCE = 40
UND = "und"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each between two borders (a blank), and each character's place in its word."""
    flat = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.array([len(w) + 2 for w in words], np.int64)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    return flat, place


def _grams(codes: np.ndarray) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each position, n = 1 .. ORDER; to be used where the place allows them."""
    out = [W.mix(codes + np.uint64(1))]
    for n in range(2, ORDER + 1):
        h = np.zeros(len(codes), np.uint64)
        h[n - 1 :] = W.mix(out[-1][n - 1 :] * _STEP + codes[: max(len(codes) - n + 1, 0)] + np.uint64(n))
        out.append(h)
    return out


@dataclasses.dataclass
class Model:
    """``keys[n]``: sorted hashes of (n + 1)-grams; ``own[n]``: their discounted share of their context, per language;
    ``back[n]``: the weight of the lower order after such an n-gram as context (1 if unseen)."""

    languages: list[str]
    keys: list[np.ndarray]
    own: list[np.ndarray]
    back: list[np.ndarray]
    floor: float
    mean: np.ndarray
    base: np.ndarray
    spread: np.ndarray

    def word_bits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Negative base-2 log probability of each word in each language, and its characters."""
        codes, place = _codes(words)
        grams = _grams(codes)
        p = np.full((len(codes), len(self.languages)), self.floor)
        for n in range(ORDER):
            fits = np.flatnonzero(place >= n)
            if n:
                at, known = W.find(self.keys[n - 1], grams[n - 1][fits - 1])
                p[fits] *= np.where(known[:, None], self.back[n - 1][at], 1.0) if len(self.keys[n - 1]) else 1.0
            else:
                p[fits] *= self.back0
            at, known = W.find(self.keys[n], grams[n][fits])
            if len(self.keys[n]):
                p[fits] += np.where(known[:, None], self.own[n][at], 0.0)
        bits = -np.log2(p)
        bits[place == 0] = 0  # the border in front is given
        border = np.concatenate([np.flatnonzero(place == 0), [len(place)]])
        return W.per_doc(bits, border), np.diff(border) - 1

    back0: np.ndarray | float = 1.0


def fit(sample: list[tuple[str, str]], held: list[tuple[str, str]]) -> Model:
    """Model of (language, text) pairs; ``held`` calibrates the rejection (the sample itself if it is empty)."""
    languages = sorted({lang for lang, _ in sample})
    counts = {lang: Counter() for lang in languages}
    for lang, text in sample:
        counts[lang].update(words_of(text))
    seen: list[dict[str, tuple]] = [{} for _ in range(ORDER)]
    alphabet: set[int] = set()
    for lang in languages:
        words = list(counts[lang])
        codes, place = _codes(words)
        alphabet.update(np.unique(codes).tolist())
        weight = np.repeat(np.array([counts[lang][w] for w in words], np.float64), [len(w) + 2 for w in words])
        grams = _grams(codes)
        # distinct (n+1)-grams give the continuation counts of order n
        for n in reversed(range(ORDER)):
            fits = np.flatnonzero(place >= max(n, 1))
            if n == ORDER - 1:
                key, first, inverse = np.unique(grams[n][fits], return_index=True, return_inverse=True)
                c = np.bincount(inverse, weight[fits])
            else:
                wide = np.flatnonzero(place >= n + 1)
                _, one = np.unique(grams[n + 1][wide], return_index=True)
                # n-grams at a word's beginning have no left neighbour; their own count stands for it
                short = np.flatnonzero(place == n) if n else np.zeros(0, np.int64)
                all_at = np.concatenate([wide[one], short])
                unit = np.concatenate([np.ones(len(one)), weight[short]])
                key, first, inverse = np.unique(grams[n][all_at], return_index=True, return_inverse=True)
                c, fits = np.bincount(inverse, unit), all_at
            context = grams[n - 1][fits[first] - 1] if n else np.zeros(len(key), np.uint64)
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 else 0.5
            d = min(max(d, 0.1), 0.95)
            who, inverse = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(inverse, c), np.bincount(inverse)
            seen[n][lang] = (key, np.maximum(c - d, 0) / total[inverse], who, d * kinds / total)
    keys, own, back = [], [], []
    for n in range(ORDER):
        key = np.unique(np.concatenate([x for k in (seen[n], seen[n + 1] if n + 1 < ORDER else {}) for lang, v in k.items() for x in ([v[0]] if k is seen[n] else [v[2]])]))
        o, b = np.zeros((len(key), len(languages))), np.ones((len(key), len(languages)))
        for k, lang in enumerate(languages):
            o[np.searchsorted(key, seen[n][lang][0]), k] = seen[n][lang][1]
            if n + 1 < ORDER:
                b[np.searchsorted(key, seen[n + 1][lang][2]), k] = seen[n + 1][lang][3]
        keys.append(key), own.append(o), back.append(b)
    zero = np.zeros(len(languages))
    model = Model(languages, keys, own, back, 1 / (len(alphabet) + 1000), zero, zero, zero)
    model.back0 = np.array([seen[0][lang][3][0] for lang in languages])
    # calibration: mean, and the two parts of the spread (of whole texts, of single words)
    by: dict[int, list[tuple[float, float, int]]] = defaultdict(list)
    for lang, text in held or sample:
        words = words_of(text)
        if lang in languages and words:
            bits, chars = model.word_bits(words)
            k = languages.index(lang)
            h = bits[:, k].sum() / chars.sum()
            by[k].append((h, ((bits[:, k] / chars - h) ** 2 * (chars / chars.mean()) ** 2).mean(), len(words)))
    mean, base, spread = (np.zeros(len(languages)) for _ in range(3))
    for k in range(len(languages)):
        h = np.array([x[0] for x in by[k]] or [8.0])
        mean[k] = np.median(h)
        base[k] = max(1.4826 * np.median(np.abs(h - mean[k])), 0.02)
        spread[k] = np.sqrt(np.median([x[1] for x in by[k]])) if by[k] else 2.0
    model.mean, model.base, model.spread = mean, base, spread
    return model


def words_of(text: str) -> list[str]:
    """Maximal runs of letters, lower-cased; every non-ASCII character counts as a letter."""
    table = pa.array([text])
    out = []
    for chunk in W.chunks(table):
        starts, ends, _ = W.runs(chunk, W.IS_LETTER)
        raw = chunk.data.tobytes()
        out += [raw[a:b].decode("utf-8", "replace").lower() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return out


class _Scorer:
    def __init__(self, model: Model):
        self.model, self.memo = model, W.Memo(1_000_000)
        self.bits, self.chars = [np.zeros((0, len(model.languages)), np.float32)], [np.zeros(0, np.int32)]

    def _learn(self, words: list[bytes]) -> None:
        for k in range(0, len(words), 20_000):
            bits, chars = self.model.word_bits([w.decode("utf-8", "replace").lower() for w in words[k : k + 20_000]])
            self.bits.append(bits.astype(np.float32))
            self.chars.append(chars.astype(np.int32))

    def documents(self, chunk: W.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits in each language, characters and words of each document."""
        if self.memo.count > self.memo.limit:
            self.__init__(self.model)
        starts, ends, first = W.runs(chunk, W.IS_LETTER)
        raw = chunk.data.tobytes()
        slots = self.memo.slots_of(W.hash_spans(chunk.data, starts, ends), lambda i: self._learn([raw[a:b] for a, b in zip(starts[i], ends[i], strict=True)]))
        if len(self.bits) > 1:
            self.bits, self.chars = [np.concatenate(self.bits)], [np.concatenate(self.chars)]
        return W.per_doc(self.bits[0][slots].astype(np.float64), first), W.per_doc(self.chars[0][slots].astype(np.int64), first), np.diff(first)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit on labelled documents with crc32(doc_id as text) mod 5 unequal 0, at most ``per_language`` of each language.

    One document in five of the sample is kept from the counts for the calibration."""
    rows = docs.filter("lang is not null and text is not null and doc_id is not null").filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    rows = rows.select("lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("o"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("place"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct("o").alias("n")).collect()}
    if not sizes:
        return None
    # twice the wanted share by hash, then cut to the bound in the order of the doc_id's hash; equal rows are one, so
    # what is collected is bounded
    share = F.lit(None).cast("long")
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1 << 30, (1 << 31) * per_language // n))).otherwise(share)
    some = rows.filter(F.col("o") < share).dropDuplicates(["lang", "o"]).collect()
    by: dict[str, list] = defaultdict(list)
    for r in sorted(some, key=lambda r: (r.place, r.text)):
        if len(by[r.lang]) < per_language:
            by[r.lang].append((r.lang, r.text))
    sample = [x for lang in sorted(by) for k, x in enumerate(by[lang]) if k % 5]
    held = [x for lang in sorted(by) for k, x in enumerate(by[lang]) if k % 5 == 0]
    return fit(sample or held, held)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with lang_pred, score, cross_entropy (bits a character) and rejected.

    Columns of these names are replaced; all others are kept and never reach the models, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    token = uuid.uuid4().hex
    fields = ["lang_pred", "score", "cross_entropy", "rejected"]

    @F.arrow_udf(T.StructType([T.StructField(n, t) for n, t in zip(fields, (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType()), strict=True)]))
    def said(texts: pa.Array, has_letter: pa.Array) -> pa.Array:
        model = shared.value
        languages = np.array([*(model.languages if model else []), UND], object)
        if model and ("lang", token) not in W.KEPT:
            W.forget()
            W.KEPT["lang", token] = _Scorer(model)
        letters = has_letter.to_numpy(zero_copy_only=False).astype(bool)
        out = [pa.StructArray.from_arrays([pa.array([], t) for t in (pa.string(), pa.float64(), pa.float64(), pa.bool_())], fields)]
        for chunk in W.chunks(texts):
            n = chunk.n
            known = letters[chunk.first : chunk.first + n]
            pick, score, entropy, rejected = np.full(n, len(languages) - 1), np.zeros(n), np.full(n, np.nan), np.ones(n, bool)
            if model:
                bits, chars, words = W.KEPT["lang", token].documents(chunk)
                known = known & (words > 0)
                h = bits / np.maximum(chars, 1)[:, None]
                best = h.argmin(axis=1)
                low = h[np.arange(n), best]
                weight = np.exp2(-(h - low[:, None]) * np.minimum(chars, EVIDENCE)[:, None])
                limit = model.mean[best] + STRICT * np.sqrt(model.base[best] ** 2 + model.spread[best] ** 2 / np.maximum(words, 1))
                pick, score = np.where(known, best, pick), np.where(known, 1 / weight.sum(axis=1), 0.0)
                entropy, rejected = np.where(known, low, np.nan), ~known | (low > limit)
            out.append(pa.StructArray.from_arrays([pa.array(languages[pick], pa.string()), pa.array(score), pa.array(entropy, mask=np.isnan(entropy)), pa.array(rejected)], fields))
        return pa.concat_arrays(out)

    held = f"said_{token[:8]}"
    kept = docs.drop(*fields)
    names = [F.col(f"`{n}`") for n in kept.columns]
    given = kept.select(*names, said(F.col("text"), F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))).alias(held))
    return given.select(*names, *[F.col(f"{held}.{n}").alias(n) for n in fields])


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected of every document."""
    model = train(docs)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text"), model).drop("text")
