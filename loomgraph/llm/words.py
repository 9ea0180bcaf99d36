"""Vectorised splitting and hashing of whole texts, shared by the operators that run numpy.

Texts reach Python as Arrow batches.  A batch is cut into chunks of some megabytes at document borders;
inside a chunk all work is on flat arrays (bytes, word starts, word ends), never on Python strings.  Words
are named by a 64-bit hash; what a word costs to compute (its token ids, its character-model score) is
computed for distinct words only and kept in a :class:`Memo`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: ASCII letters and every byte of a non-ASCII character count as letters.
IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class Chunk:
    """Some consecutive documents: ``data`` (bytes, 8 spare zero bytes at the end) and ``offs`` (n + 1)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, first: int):
        self.data, self.offs, self.first, self.n = data, offs, first, len(offs) - 1
        self.size = int(offs[-1])


def chunks(texts: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES, lower: bool = False) -> Iterator[Chunk]:
    """Chunks of an Arrow string array (null counts as empty); a document is never cut."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, off_buf, data_buf = texts.buffers()
    offs = np.frombuffer(off_buf, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data_buf, np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        part = raw[offs[at] : offs[end]]
        data = np.zeros(len(part) + 8, np.uint8)
        data[: len(part)] = LOWER[part] if lower else part
        yield Chunk(data, offs[at : end + 1] - offs[at], at)
        at = end


def runs(chunk: Chunk, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes whose class is set in the table ``inside``, not across documents.

    Returns starts, ends and, for each document, the index of its first run (n + 1 values)."""
    n, offs = chunk.size, chunk.offs
    keep = inside[chunk.data[:n]]
    opens, closes = keep.copy(), keep.copy()
    opens[1:] &= ~keep[:-1]
    closes[:-1] &= ~keep[1:]
    heads = offs[:-1][offs[:-1] < n]
    opens[heads] = keep[heads]
    tails = offs[1:][offs[1:] > 0] - 1
    closes[tails] = keep[tails]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offs)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; ``data`` has 8 spare bytes at its end."""
    blocks = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    left = ends - starts
    h = mix(left.astype(np.uint64) * _M1 + _M3)
    todo, pos = None, starts
    while len(pos):
        v = blocks[pos] & _MASK[np.minimum(left, 8)]
        if todo is None:
            h = mix(h ^ v)
        else:
            h[todo] = mix((h[todo] * _M1) ^ v)
        more = np.flatnonzero(left > 8)
        todo = more if todo is None else todo[more]
        pos, left = pos[more] + 8, left[more] - 8
    return h


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` for each document; ``first``: borders (n + 1)."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[first[1:]] - total[first[:-1]]


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted array ``keys``, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def gather(flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The concatenation of ``flat[begin : begin + length]`` and the borders in it."""
    border = np.concatenate([[0], np.cumsum(length)])
    at = np.repeat(begin - border[:-1], length) + np.arange(border[-1])
    return flat[at], border


class Memo:
    """Sorted hash array of words already seen by this worker, with one slot number for each.

    It is only a cache: past ``limit`` words it starts anew, or with those that were met again (:meth:`shrink`)."""

    def __init__(self, limit: int = 3_000_000):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        #: By slot: whether a later call met the word again.
        self.again = np.zeros(0, bool)

    def shrink(self) -> np.ndarray:
        """Forget the words that no later call met; of the others the slots that they had, now numbered in this order.

        All are forgotten if the others are more than half of the limit."""
        kept = np.flatnonzero(self.again)
        if len(kept) > self.limit // 2:
            kept = kept[:0]
        stay = np.zeros(self.count, bool)
        stay[kept] = True
        mine = stay[self.slots]
        self.keys, self.slots, self.count = self.keys[mine], (np.cumsum(stay) - 1)[self.slots[mine]], len(kept)
        self.again = np.zeros(len(kept), bool)
        return kept

    def slots_of(self, hashes: np.ndarray, learn: Callable[[np.ndarray], None]) -> np.ndarray:
        """A slot for each hash. ``learn(i)`` gets indices into ``hashes``, one for each unseen word, and
        appends their values in that order; new slots continue the old ones."""
        order = np.argsort(hashes)
        s = hashes[order]
        head = np.ones(len(s), bool)
        head[1:] = s[1:] != s[:-1]
        unique, example = s[head], order[head]
        at, known = find(self.keys, unique)
        if known.any():
            self.again[self.slots[at[known]]] = True
        if not known.all():
            learn(example[~known])
            new = unique[~known]
            keys = np.concatenate([self.keys, new])
            slots = np.concatenate([self.slots, np.arange(self.count, self.count + len(new))])
            by = np.argsort(keys, kind="stable")
            self.keys, self.slots, self.count = keys[by], slots[by], self.count + len(new)
            self.again = np.concatenate([self.again, np.zeros(len(new), bool)])
            at, _ = find(self.keys, unique)
        out = np.empty(len(hashes), np.int64)
        out[order] = self.slots[at][np.cumsum(head) - 1]
        return out


class Ragged:
    """Growing list of integer sequences as one flat array."""

    def __init__(self, dtype):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0
        self.begin, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def extend(self, flat: np.ndarray, length: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        begin = self.used + np.concatenate([[0], np.cumsum(length)[:-1]]) if len(length) else np.zeros(0)
        self.begin = np.concatenate([self.begin, begin.astype(np.int64)])
        self.length = np.concatenate([self.length, length.astype(np.int64)])
        self.used += len(flat)

    def keep(self, places: np.ndarray) -> None:
        """Only the sequences at these places, in their order."""
        flat, border = gather(self.flat, self.begin[places], self.length[places])
        self.clear()
        self.extend(flat, np.diff(border))


#: What a worker keeps between tasks, by operator and parameters.
KEPT: dict = {}


def release() -> None:
    """Give free memory back to the system."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its memory
        pass


def forget() -> None:
    """Drop what operators before this one kept in the worker, and give free memory back to the system."""
    KEPT.clear()
    release()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, which gives its free memory back when a task ends: an executor has more workers than cores,
    and those that wait hold what their last task left."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole
