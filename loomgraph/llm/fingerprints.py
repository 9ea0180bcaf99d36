"""Document fingerprints from prefix polynomial hashes (operator 7).

For a text c[0..n) of code points the prefix array H[i] = sum of c[j] * B^j for j < i, taken modulo each of two primes
near 2^31, answers every span: two spans are equal when their differences of H, each times the inverse of B to the
power of its begin, are.
Longest common extensions come from it by binary search.

A fingerprint is made from span hashes alone: the hash of the whole text and the ``KEEP`` smallest hashes of its
windows of ``WINDOW`` code points (all windows if there are fewer; a shorter text is one window), as fixed-width
hexadecimal text.  The smallest hashes are a uniform sample of the set of windows, so the share of common
ones among the smallest of both estimates the Jaccard likeness of the two sets.

That likeness is 0 for most long texts that share a small part.  :func:`extensions` is exact instead: common prefixes
by longest common extension, and the share of all windows.

The text of a row's successor is needed beside it.  Rows are dealt by ranges of doc_id and sorted there; the
first rows of a range are also sent to the range before it.  The driver sees range borders only.

Defined cases: null text is empty; an empty text has the fingerprint of length 0, like 1 to another empty text
and 0 to any other; null doc_ids follow all others; repeated doc_ids are ordered by text; the successor of the
last row is the first; an empty table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .token_output import doc_ranges

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_000_003_691, 1_234_567_891)
WINDOW, KEEP = 24, 64

_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base^0 .. base^n modulo the prime, kept and doubled as needed."""
    have = _POWERS.get((base, prime), np.ones(1, np.uint64))
    while len(have) <= n:
        step = have[-1] * np.uint64(base) % np.uint64(prime)
        have = np.concatenate([have, have * step % np.uint64(prime)])
    _POWERS[base, prime] = have
    return have


class Prefixes:
    """Prefix arrays of one text, given as code points."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        c = codes.astype(np.uint64) + np.uint64(1)
        self.h = []
        for b, p in zip(BASES, PRIMES, strict=True):
            terms = c * _powers(b, p, self.n)[: self.n] % np.uint64(p)
            self.h.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)]) % np.uint64(p))

    @staticmethod
    def of(text: str) -> Prefixes:
        return Prefixes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))

    def spans(self, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """62-bit hashes of spans, which depend on nothing but their text."""
        out = np.zeros(len(begin), np.uint64)
        for h, b, p in zip(self.h, BASES, PRIMES, strict=True):
            d = (h[begin + length] + np.uint64(p) - h[begin]) % np.uint64(p)
            out = (out << np.uint64(31)) | (d * _powers(pow(b, -1, p), p, self.n)[begin] % np.uint64(p))
        return out

    def equal(self, i: int, other: Prefixes, j: int, length: int) -> bool:
        """Whether the spans of ``length`` at i here and at j in ``other`` are equal."""
        if i + length > self.n or j + length > other.n:
            return False
        return self.spans(np.array([i]), np.array([length]))[0] == other.spans(np.array([j]), np.array([length]))[0]

    def extension(self, i: int, other: Prefixes, j: int) -> int:
        """Length of the longest common extension of position i here and j in ``other``."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            # lengths are equal up to one of them: many at a time, as a call costs more than its spans
            at = np.unique(np.linspace(low + 1, high, 64).astype(np.int64))
            same = self.spans(np.full(len(at), i), at) == other.spans(np.full(len(at), j), at)
            good = len(at) if same.all() else int(np.argmin(same))
            low, high = int(at[good - 1]) if good else low, int(at[good]) - 1 if good < len(at) else high
        return low

    def windows(self) -> np.ndarray:
        """Hashes of the different windows, ascending; a shorter text is one window, an empty one has none."""
        size = min(WINDOW, self.n)
        begin = np.arange(self.n - size + 1 if self.n else 0)
        return np.unique(self.spans(begin, np.full(len(begin), size)))

    def sketch(self) -> np.ndarray:
        """The whole text's hash with its length, then the smallest window hashes, ascending."""
        if not self.n:
            return np.zeros(1, np.uint64)
        size = min(WINDOW, self.n)
        begin = np.arange(self.n - size + 1)
        h = W.mix(self.spans(begin, np.full(len(begin), size)))
        whole = W.mix(self.spans(np.array([0]), np.array([self.n])) + np.uint64(self.n))
        k = 4 * KEEP
        while len(h) > k:
            small = np.unique(np.partition(h, k)[:k])
            if len(small) >= KEEP:
                return np.concatenate([whole, small[:KEEP]])
            k *= 4  # many equal windows
        return np.concatenate([whole, np.unique(h)[:KEEP]])


def fingerprint(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: 1 for equal texts, else the share of common windows among the smallest of both."""
    if a[0] == b[0]:
        return 1.0
    a, b = a[1:], b[1:]
    if not len(a) or not len(b):
        return 0.0
    union = np.union1d(a, b)[: max(min(len(a), len(b)), KEEP)]
    return float(np.isin(union, np.intersect1d(a, b)).sum()) / len(union)


def share(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sets of windows, all of them; 1 if both are empty."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    both = len(a) + len(b) - common
    return common / both if both else 1.0


_ROWS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


_EXACT = "doc_id long, n_chars long, prefix_edited long, prefix_next long, share_edited double, share_next double"
_KINDS = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def _edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _compared(me: tuple, mine: np.ndarray, after: str, theirs: np.ndarray) -> tuple:
    edited = _edited(me[2], after)
    changed = Prefixes.of(edited).sketch()
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return me[1], len(me[2]), sha, fingerprint(mine), fingerprint(changed), likeness(mine, changed), likeness(mine, theirs)


def _extended(me: tuple, mine: tuple[Prefixes, np.ndarray], after: str, theirs: tuple[Prefixes, np.ndarray]) -> tuple:
    changed = Prefixes.of(_edited(me[2], after))
    return me[1], len(me[2]), mine[0].extension(0, changed, 0), mine[0].extension(0, theirs[0], 0), share(mine[1], changed.windows()), share(mine[1], theirs[1])


def _walk(schema: str, prepare: Callable, result: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``range, doc_id, text, guest`` in order; a guest only serves as the successor of the last own row."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = None
        for row in (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            if held is not None and row[0] != held[0][0]:
                held = None
            mine = prepare(Prefixes.of(row[2]))
            if held is not None:
                out.append(result(*held, row[2], mine))
            held = (row, mine) if not row[3] else None
            if len(out) >= 2000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    return run


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text: the last half of the text replaced by as much of the
    beginning of the successor's."""
    return _dealt(docs, _ROWS, lambda p: p.sketch(), _compared)


def extensions(docs: DataFrame) -> DataFrame:
    """The same texts compared exactly: length of the common prefix and share of common windows of each text with its
    edited text and with the successor."""
    return _dealt(docs, _EXACT, lambda p: (p, p.windows()), _extended)


def _dealt(docs: DataFrame, schema: str, prepare: Callable, result: Callable) -> DataFrame:
    """Rows made of each text and its successor's."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    number, _ = doc_ranges(own, parts)
    own = own.withColumn("range", number)
    # the smallest doc_id of each range, whose rows are sent to the range before as well
    lows = sorted((r.range, r.low) for r in own.groupBy("range").agg(F.min("doc_id").alias("low")).collect())
    if not lows:
        return spark.createDataFrame([], schema)
    # looked up by range number
    low_of, before = [None] * (lows[-1][0] + 1), [None] * (lows[-1][0] + 1)
    for (a, _), (b, low) in zip([lows[-1], *lows[:-1]], lows, strict=True):
        low_of[b], before[b] = low, a
    at = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("range"))
    is_low, to = F.col("doc_id").eqNullSafe(at(low_of, "long")), at(before, "int")
    both = own.select("doc_id", "text", F.explode(F.when(is_low, F.array(F.struct("range", F.lit(False).alias("guest")), F.struct(to.alias("range"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct("range", F.lit(False).alias("guest"))))).alias("r"))
    dealt = both.select("r.range", "doc_id", "text", "r.guest").repartitionById(lows[-1][0] + 1, F.col("range"))
    return dealt.sortWithinPartitions("range", "guest", F.col("doc_id").asc_nulls_last(), "text").mapInArrow(_walk(schema, prepare, result), schema)
