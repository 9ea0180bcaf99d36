"""N-gram Jaccard join with adaptive multi-match prefixes (operator 5).

A document's set is its distinct shingles of five words (lower-cased A-Z, split at ASCII white space), as
64-bit hashes; with fewer words it is the whole sequence, without words it is empty and linked with nothing.
Two documents link when 100 * intersection >= 75 * union.

1. One pass over the texts names each distinct set by a 64-bit class id (equal sets are one class from here
   on).  Each batch of some megabytes asks how frequent its distinct shingles are: a request lists them for a part of
   the hash space, sorted and packed, with their documents in the batch.  A shingle of very many documents of a
   batch is asked for once.
2. A part adds up its requests and answers for shared shingles only.  Shingles of frequency one need no
   answer: a class knows how many it has, and if more than a quarter of its set is such, it links with nothing and is
   done.  So the frequencies are those of the whole input at every size of it.
3. Rare shingles first, two sets of n shingles and more that link share at least l of the first
   n - ceil(0.75 n) + l.  Each class picks its own l from 1 to ``MOST_MATCHES``: the frequencies give the postings its
   prefix meets, a candidate must be met l times, and the cheapest sum of both wins.  A pair must share min(l, l')
   prefix shingles.  A shingle is posted only if the rest of the set from its place on still allows a partner; the
   largest such partner goes with the posting.
4. Shingles posted by ``HOT`` classes and more first go through star rounds: each class is compared with the one in
   which the shingle comes earliest.  Links found there make components, and from then on no pair inside
   one is made.  Groups of near copies collapse here in a linear number of comparisons; postings of a
   shingle that would fill a task are dealt by a salt, and later rounds join the salts' components.
5. Of all other pairs that share a posting, are in different components and fit in size, those that may have as many
   matches as they must (counted, or bounded by signatures of the prefixes) are verified on whole sets.  Shingles with very many postings are cut into blocks, and pairs of
   blocks are dealt out.

Nothing is dropped: steps 2 to 5 only skip pairs that can't link or are linked already, so components are exact
(class ids are 64-bit hashes: among d distinct texts about d * d / 2^65 unlike pairs would share one).
Requests name a shingle by 32 bits within its part; shingles that share a name only look more frequent.
Only bit filters (sized to what they hold, at most 32 MB) and a checked list of mixed shingles are broadcast.  The number of
parts follows the text's size (``PART_BYTES`` each), which bounds a task's memory up to ``PARTS`` of them, 1 TB of text; from
there on a part grows with the input (about ten bytes of worker memory for a byte of its text).

Defined cases: null text is empty; null doc_ids take part, but components are named by the smallest non-null
doc_id (null if there is none); repeated rows are equal sets; a very long text is one set like any other and is held
whole by one task; an empty table gives an empty result; other columns take no part, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.components import min_labels
from ..plans.store import settle, stored
from . import words as W

N = 5
#: Text whose shingles one batch of requests asks for.
GATHER = 8 << 20
#: Text for each part of the hash space, and the most parts.
PART_BYTES = 16 << 20
PARTS = 1 << 16
#: A shingle of more documents of a batch than this is asked for without naming them.
WIDE = 8
#: From this many classes on a posted shingle goes through the star rounds.
HOT = 8
#: More postings of one shingle than this are dealt to several tasks.
GROUP = 4096
MOST_MATCHES = 8
#: Prefixes of more shared shingles than this have signatures too full to say much.
LONG = 128
#: Cost of verifying a candidate, in postings: this and an eighth of its shingles.
VERIFY = 8
#: Longest broadcast list of mixed shingles (8 bytes each).
MIXED = 2_000_000
#: Copies of a component's name that rows of a large component are dealt to.
SALTS = 16

_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class Sets:
    """The shingle sets of a chunk's documents: ``flat``, ascending in each document, and ``border`` (n + 1)."""

    def __init__(self, chunk: W.Chunk):
        starts, ends, first = W.runs(chunk, ~W.IS_SPACE)
        h = W.hash_spans(chunk.data, starts, ends)
        count = np.diff(first)
        doc = np.repeat(np.arange(chunk.n), count)
        s = np.zeros(len(h), np.uint64)
        for k in range(N):
            s[: len(h) - k] += h[k:] * _K[k]
        whole = np.arange(len(h)) + N <= first[1:][doc]
        # shorter texts: one shingle of all their words, which their number tells from others
        short = np.flatnonzero((count > 0) & (count < N))
        for d in short:
            a, b = first[d], first[d + 1]
            s[a] = (h[a:b] * _K[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            whole[a] = True
        s, doc = W.mix(s[whole]), doc[whole]
        order = np.argsort(s)
        order = order[np.argsort(doc[order].astype(np.uint32 if chunk.n > 65_535 else np.uint16), kind="stable")]
        s, doc = s[order], doc[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
        self.flat, self.doc = s[new], doc[new]
        self.border = np.searchsorted(self.doc, np.arange(chunk.n + 1))
        self.size = np.diff(self.border)
        sums = W.per_doc(W.mix(self.flat ^ _K[1]), self.border)
        self.key = W.mix(sums + self.size.astype(np.uint64) * _K[3]).view(np.int64)


def _fresh(sets: Sets, seen: set) -> np.ndarray:
    """Documents with a non-empty set whose class this task has not met before."""
    out = []
    for d in np.flatnonzero(sets.size > 0).tolist():
        k = int(sets.key[d])
        if k not in seen:
            seen.add(k)
            out.append(d)
    return np.array(out, np.int64)


def _text_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _parts(docs: DataFrame) -> int:
    """Parts of the hash space: as many as shuffle partitions, and more where the text is large."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(PARTS, -(-size // PART_BYTES)))


def _pack(values: np.ndarray) -> bytes:
    """Compressed byte planes of an array."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T) if len(values) else b""
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(raw: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).reshape(-1).view(dtype)


class _Requests:
    """Collects the sets of a batch of documents and asks for the frequency of their shingles."""

    NAMES = ("part", "chunk", "t", "c", "d", "ids", "keys", "sizes", "fresh", "wide")
    SCHEMA = "part int, chunk long, t binary, c binary, d binary, ids binary, keys binary, sizes binary, fresh binary, wide binary"

    def __init__(self, parts: int, task: int):
        self.parts, self.task, self.count = parts, task, 0
        self.clear()

    def clear(self) -> None:
        self.flat, self.doc, self.ids, self.none, self.keys, self.sizes, self.fresh = [], [], [], [], [], [], []
        self.n, self.bytes = 0, 0

    def add(self, ids: pa.Array, sets: Sets, fresh: np.ndarray, size: int) -> None:
        flat, border = W.gather(sets.flat, sets.border[fresh], sets.size[fresh])
        self.flat.append(flat)
        self.doc.append(np.repeat(fresh + self.n, np.diff(border)).astype(np.uint32))
        self.none.append(ids.is_null().to_numpy(zero_copy_only=False))
        self.ids.append(ids.fill_null(0).to_numpy())
        self.keys.append(sets.key), self.sizes.append(sets.size.astype(np.int64))
        self.fresh.append((fresh + self.n).astype(np.uint32))
        self.n += len(ids)
        self.bytes += size

    def flush(self) -> Iterator[pa.RecordBatch]:
        """One row for each part asked, and one with the documents themselves."""
        if not self.n:
            return
        flat, doc, fresh, keys = (np.concatenate(x) for x in (self.flat, self.doc, self.fresh, self.keys))
        ids, none, sizes = np.concatenate(self.ids), np.concatenate(self.none), np.concatenate(self.sizes)
        self.clear()
        self.count += 1
        # named by task and content: a task that is run again on other rows can't pass for this one
        mark = W.mix(W.mix(keys.view(np.uint64) + np.arange(len(keys), dtype=np.uint64)).sum(dtype=np.uint64) + W.mix(np.array([self.task << 32 | self.count], np.uint64)))
        chunk = int(mark.view(np.int64)[0])
        t = (flat >> np.uint64(32)) % np.uint64(self.parts) << np.uint64(32) | flat & np.uint64(0xFFFFFFFF)
        del flat
        order = np.argsort(t, kind="stable")
        t, doc = t[order], doc[order]
        del order
        at = np.flatnonzero(np.diff(t, prepend=~t[:1])) if len(t) else np.zeros(0, np.int64)
        t, c = t[at], np.diff(at, append=len(t)).astype(np.uint32)
        wide = c > WIDE
        far = _pack(t[wide]), _pack(c[wide]), _pack(doc[np.repeat(wide, c)])
        doc = doc[np.repeat(~wide, c)]
        upto = np.concatenate([[0], np.cumsum(np.where(wide, 0, c), dtype=np.int64)])
        border = np.searchsorted(t, np.arange(self.parts + 1).astype(np.uint64) << np.uint64(32))
        there = np.flatnonzero(np.diff(border))
        rows = [(int(p), chunk, _pack(np.diff(t[a:b].astype(np.uint32), prepend=np.uint32(0))), _pack(c[a:b]), _pack(doc[upto[a] : upto[b]]), *[None] * 5) for p, a, b in zip(there, border[there], border[there + 1], strict=True)]
        apart = len(far[0]).to_bytes(8, "little") + len(far[1]).to_bytes(8, "little") + b"".join(far)
        rows.append((chunk % self.parts, chunk, None, None, None, _pack(ids) + none.tobytes(), _pack(keys), _pack(sizes), _pack(fresh), apart))
        columns = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, [pa.int32(), pa.int64(), *[pa.binary()] * 8], strict=True)], list(self.NAMES))


def _answers(docs: DataFrame, parts: int) -> DataFrame:
    """Stored rows of each batch of documents (``chunk``): one with the documents (ids, keys, sizes, fresh, wide), and for each
    part that shares any of its shingles the shared ones ``t``, their frequency ``f`` and documents ``c, d``."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.forget()
        seen: set = set()
        held = _Requests(parts, TaskContext.get().partitionId())
        for batch in batches:
            for chunk in W.chunks(batch.column(1), lower=True):
                sets = Sets(chunk)
                held.add(batch.column(0).slice(chunk.first, chunk.n), sets, _fresh(sets, seen), chunk.size)
                if held.bytes >= GATHER:
                    yield from held.flush()
        yield from held.flush()

    names = ["chunk", "t", "f", "c", "d", *_Requests.NAMES[5:]]

    def told(rows: list[tuple]) -> pa.RecordBatch:
        chunk, *packed = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), *(pa.array(x, pa.binary()) for x in packed), *[pa.nulls(len(rows), pa.binary())] * 5], names)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.forget()
        part, chunk, t, c, d = [], [], [], [], []
        for batch in batches:
            asked = np.flatnonzero(batch.column(2).is_valid().to_numpy(zero_copy_only=False))
            own = batch.filter(batch.column(2).is_null())
            if own.num_rows:
                none = pa.nulls(own.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([own.column(1), none, none, none, none, *own.columns[5:]], names)
            for k in asked.tolist():
                part.append(batch.column(0)[k].as_py()), chunk.append(batch.column(1)[k].as_py())
                t.append(np.cumsum(_unpack(batch.column(2)[k].as_py(), np.uint32), dtype=np.uint32))
                c.append(_unpack(batch.column(3)[k].as_py(), np.uint32))
                d.append(batch.column(4)[k].as_py())
        if not t:
            return
        border = np.concatenate([[0], np.cumsum([len(x) for x in t])])
        t, c = np.concatenate(t), np.concatenate(c)
        # several parts can meet in a task only if they were dealt again; they never share a shingle
        at = t if len(set(part)) == 1 else np.repeat(np.array(part, np.uint64) << np.uint64(32), np.diff(border)) | t
        order = np.argsort(at, kind="stable")
        at = at[order]
        head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        del at
        total = np.add.reduceat(c[order].astype(np.int64), head)
        f = np.empty(len(t), np.int64)
        f[order] = np.repeat(total, np.diff(head, append=len(t)))
        del order
        shared = f >= 2
        rows = []
        for k in range(len(part)):
            a, b = border[k], border[k + 1]
            keep = shared[a:b]
            if keep.any():
                n = c[a:b]
                doc = _unpack(d[k], np.uint32)[np.repeat(keep, np.where(n > WIDE, 0, n).astype(np.int64))]
                name = t[a:b][keep].astype(np.uint64) | np.uint64(part[k] << 32)
                rows.append((chunk[k], _pack(name), _pack(f[a:b][keep]), _pack(n[keep]), _pack(doc)))
            if len(rows) == 500:
                yield told(rows)
                rows = []
        if rows:
            yield told(rows)

    asked = _text_of(docs).mapInArrow(W.lean(ask), _Requests.SCHEMA).repartitionById(parts, F.col("part"))
    return stored(asked.mapInArrow(W.lean(answer), "chunk long, t binary, f binary, c binary, d binary, ids binary, keys binary, sizes binary, fresh binary, wide binary"), "shared")


def _survey(answers: DataFrame) -> DataFrame:
    """``doc_id, key, n`` of every document; key is null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, keys, sizes in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                size = _unpack(sizes, np.int64)
                none = np.frombuffer(ids, np.uint8)[len(ids) - len(size) :].astype(bool)
                doc_id = _unpack(ids[: len(ids) - len(size)], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(doc_id, mask=none), pa.array(_unpack(keys, np.int64), mask=size == 0), pa.array(size)], ["doc_id", "key", "n"])

    return answers.filter("ids is not null").select("ids", "keys", "sizes").mapInArrow(W.lean(run), "doc_id long, key long, n long")


def _whole_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one chunk after the other; they must come sorted by chunk."""
    rows, at = [], None
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(j)[k].as_py() for j, name in enumerate(batch.schema.names)}
            if row["chunk"] != at and rows:
                yield rows
                rows = []
            at = row["chunk"]
            rows.append(row)
    if rows:
        yield rows


def _spread(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices ``begin .. begin + length`` of all runs, one after the other."""
    border = np.cumsum(length) - length
    return np.repeat(begin - border, length) + np.arange(int(length.sum()))


def _shared_of(rows: list[dict]) -> tuple[np.ndarray, ...]:
    """Keys and sizes of a chunk's fresh documents, and (document, frequency, shingle) of all that they share."""
    own = [r for r in rows if r["ids"] is not None]
    if len(own) != 1:
        raise RuntimeError("the documents changed between two attempts of a task: read them from a table")
    own = own[0]
    fresh = _unpack(own["fresh"], np.uint32).astype(np.int64)
    keys, sizes = _unpack(own["keys"], np.int64)[fresh], _unpack(own["sizes"], np.int64)[fresh]
    a, b = (int.from_bytes(own["wide"][k : k + 8], "little") for k in (0, 8))
    wide = own["wide"][16:]
    far_t, far_c, far_d = _unpack(wide[:a], np.uint64), _unpack(wide[a : a + b], np.uint32).astype(np.int64), _unpack(wide[a + b :], np.uint32)
    far_at = np.cumsum(far_c) - far_c
    doc, freq, name = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for r in rows:
        if r["ids"] is not None:
            continue
        t, f, c = _unpack(r["t"], np.uint64), _unpack(r["f"], np.int64), _unpack(r["c"], np.uint32).astype(np.int64)
        far = c > WIDE
        doc.append(_unpack(r["d"], np.uint32).astype(np.int64))
        name.append(np.repeat(t[~far], c[~far])), freq.append(np.repeat(f[~far], c[~far]))
        if far.any():
            at = np.searchsorted(far_t, t[far])
            doc.append(far_d[_spread(far_at[at], far_c[at])].astype(np.int64))
            name.append(np.repeat(t[far], c[far])), freq.append(np.repeat(f[far], c[far]))
    doc, freq, name = np.concatenate(doc), np.concatenate(freq), np.concatenate(name)
    return keys, sizes, np.searchsorted(fresh, doc), freq, name


def _prefixes(answers: DataFrame, parts: int) -> DataFrame:
    """A row per class that may link, and chunk that met it: key, n, l, spare, before (shingles ahead of the prefix), prefix
    (shingles, in order), frequency.  Copies that different tasks met are merged where their postings meet.

    ``spare``: shingles of the set whose name another of the set has too; the prefix is longer by as many, and one match
    is enough, since linked sets may share both."""
    schema = "key long, n int, l int, spare int, before int, prefix array<long>, frequency array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.forget()
        for rows in _whole_chunks(batches):
            key, n, doc, freq, name = _shared_of(rows)
            order = np.lexsort((name, freq, doc))
            doc, freq, name = doc[order], freq[order], name[order]
            again = np.zeros(len(doc), bool)
            again[1:] = (doc[1:] == doc[:-1]) & (name[1:] == name[:-1])
            spare = np.bincount(doc[again], minlength=len(n))
            doc, freq, name = doc[~again], freq[~again], name[~again]
            border = np.searchsorted(doc, np.arange(len(n) + 1))
            shared = np.diff(border)
            need = (3 * n + 3) // 4
            may = np.flatnonzero((shared >= need - spare) & (shared > 0))
            if not len(may):
                continue
            key, n, spare, shared, need, begin = key[may], n[may], spare[may], shared[may], need[may], border[may]
            before = n - spare - shared
            upto = np.concatenate([[0], np.cumsum(freq - 1)])
            best, cost = np.ones(len(n), np.int64), None
            for matches in range(1, MOST_MATCHES + 1):
                met = upto[begin + np.clip(n - need + matches + spare - before, 0, shared)] - upto[begin]
                c = np.where((matches <= need) & ((matches == 1) | (spare == 0)), met * (1 + (VERIFY + n / 8) / matches), np.inf)
                best = best if cost is None else np.where(c < cost, matches, best)
                cost = c if cost is None else np.minimum(c, cost)
            length = np.clip(n - need + best + spare - before, 0, shared)
            tokens, edge = W.gather(name, begin, length)
            often, _ = W.gather(freq, begin, length)
            edge = pa.array(edge.astype(np.int32))
            small = [pa.array(x.astype(np.int32)) for x in (n, best, spare, before)]
            yield pa.RecordBatch.from_arrays([pa.array(key), *small, pa.ListArray.from_arrays(edge, pa.array(tokens.view(np.int64))), pa.ListArray.from_arrays(edge, pa.array(often))], ["key", "n", "l", "spare", "before", "prefix", "frequency"])

    rows = answers.repartitionById(parts, F.pmod("chunk", F.lit(parts)).cast("int")).sortWithinPartitions("chunk")
    return stored(rows.mapInArrow(W.lean(run), schema), "prefixes")


_POSTING = np.dtype([("t", "<u8"), ("key", "<i8"), ("root", "<i8"), ("n", "<i4"), ("most", "<i4"), ("l", "<i2"), ("g", "<i4"), ("x", "<i4"), ("y", "<i4"), *((f"s{k}", "<u8") for k in range(4)), ("e", "<i4"), ("place", "<i4"), ("spare", "<i2"), ("long", "<i2")])


def _slices(batches: Iterator[pa.RecordBatch], lists: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a part has at most ``limit`` list elements (or one row)."""
    for batch in batches:
        border = batch.column(lists).offsets.to_numpy()
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(border, border[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def _packed(p: np.ndarray) -> bytes:
    """Postings column by column, which the shuffle's compression likes; a root that is the class itself becomes 0."""
    return b"".join((p[f] ^ p["key"] if f == "root" else p[f]).tobytes() for f in _POSTING.names)


def _unpacked(raw: list[bytes]) -> np.ndarray:
    out = np.empty(sum(map(len, raw)) // _POSTING.itemsize, _POSTING)
    at = 0
    for b in raw:
        n, start = len(b) // _POSTING.itemsize, 0
        part = out[at : at + n]
        for f in _POSTING.names:
            size = n * _POSTING[f].itemsize
            part[f] = np.frombuffer(b, _POSTING[f], n, start)
            start += size
        part["root"] ^= part["key"]
        at += n
    return out


def _signatures(tokens: np.ndarray, begin: np.ndarray, row: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each shingle of the lists the bits (four words) of those before it in its list, and how many of them have no bit
    of their own.  Two lists have at most as many shingles in common as bits, and the smaller of these numbers more."""
    h = W.mix(tokens + _K[3])
    bit, word = np.uint64(1) << (h & np.uint64(63)), (h >> np.uint64(6)) & np.uint64(3)
    ahead = np.arange(len(tokens)) - begin[row]
    signs = []
    for k in range(4):
        one = np.where(word == k, bit, np.uint64(0))
        sign = np.concatenate([np.zeros(1, np.uint64), one[:-1]])
        sign[ahead == 0] = 0
        step = 1
        while step < ahead.max(initial=0) + 1:
            far = np.flatnonzero(ahead > step)
            sign[far] |= sign[far - step]
            step *= 2
        signs.append(sign)
    return signs, ahead - sum(np.bitwise_count(x).astype(np.int64) for x in signs)


def _groups(often: np.ndarray, star: int | None) -> np.ndarray:
    """Into how many blocks the postings of a shingle are dealt."""
    return 1 + often // GROUP ** (1 + (star or 0))


def _postings(prefixes: DataFrame, parts: int, star: int | None, mixed=None) -> DataFrame:
    """Postings of the rows of :func:`_prefixes` with their ``root``, packed by the partition of their shingle.

    ``star``: round number of the star rounds, or None for the pairs.  ``x, y``: the blocks of a shingle with very
    many postings that meet here; this posting's own block is ``g``.  ``mixed``: those of such shingles (broadcast, ascending)
    that several components post; the others have no pairs left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.forget()
        for batch in _slices(batches, 5, 400_000):
            key, n, matches, spare, before = (batch.column(k).to_numpy() for k in range(5))
            root = batch.column(7).to_numpy()
            lists, often = batch.column(5), batch.column(6)
            border = lists.offsets.to_numpy().astype(np.int64)
            tokens = lists.values.to_numpy()[border[0] : border[-1]].view(np.uint64)
            often = often.values.to_numpy()[often.offsets[0].as_py() : often.offsets[len(key)].as_py()]
            length = np.diff(border)
            row = np.repeat(np.arange(len(key)), length)
            place = before[row] + np.arange(len(tokens)) - np.repeat(border[:-1] - border[0], length)
            rest = n[row] - place + matches[row] - 1 + spare[row]
            most = np.minimum(7 * rest // 3 - n[row], 4 * n[row] // 3)
            keep = 4 * most >= 3 * n[row]
            if star is not None:
                keep &= often >= HOT
                if star:
                    keep &= (key == root)[row]
            elif mixed is not None:
                _, both = W.find(mixed.value, tokens)
                keep &= both | (often < GROUP)
            if not keep.any():
                continue
            if star is None:
                signs, extra = _signatures(tokens, border[:-1] - border[0], row)
            p = np.zeros(int(keep.sum()), _POSTING)
            if star is None:
                for k, sign in enumerate(signs):
                    p[f"s{k}"] = sign[keep]
                p["e"], p["place"], p["spare"], p["long"] = extra[keep], place[keep], np.minimum(spare, 32_767)[row[keep]], (length > LONG)[row[keep]]
            row, groups = row[keep], _groups(often[keep], star)
            p["t"], p["key"], p["root"], p["n"], p["most"], p["l"] = tokens[keep], key[row], root[row], n[row], most[keep], matches[row]
            p["g"] = (W.mix(p["key"].view(np.uint64)) % groups.astype(np.uint64)).astype(np.int32)
            p["x"] = p["y"] = p["g"]
            # a posting meets every block of its shingle once; so many are made at a time
            copies = groups if star is None else np.ones_like(groups)
            upto = np.cumsum(copies)
            at = 0
            while at < len(p):
                end = max(at + 1, int(np.searchsorted(upto, upto[at] - copies[at] + 400_000, "right")))
                q, many = p[at:end], copies[at:end]
                if (many > 1).any():
                    other = _spread(np.zeros(len(q), np.int64), many).astype(np.int32)
                    q, alone = np.repeat(q, many), np.repeat(many == 1, many)
                    q["x"], q["y"] = np.where(alone, q["g"], np.minimum(q["g"], other)), np.where(alone, q["g"], np.maximum(q["g"], other))
                yield dealt(q)
                at = end

    def dealt(p: np.ndarray) -> pa.RecordBatch:
        to = (W.mix(p["t"] + p["x"].astype(np.uint64) * _K[0] + p["y"].astype(np.uint64) * _K[2]) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        p, to = p[order], to[order]
        cut = np.flatnonzero(np.diff(to, prepend=-1))
        ends = np.append(cut[1:], len(p))
        return pa.RecordBatch.from_arrays([pa.array(to[cut].astype(np.int32)), pa.array([_packed(p[a:b]) for a, b in zip(cut, ends, strict=True)], pa.binary())], ["part", "postings"])

    rows = prefixes.select("key", "n", "l", "spare", "before", "prefix", "frequency", "root")
    return rows.mapInArrow(W.lean(run), "part int, postings binary").repartitionById(parts, F.col("part"))


def _mixed(prefixes: DataFrame):
    """The shingles of at least ``GROUP`` postings that several components post (ascending, broadcast); None if they are too
    many to broadcast, when all are posted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, tuple[int, int]] = {}
        for batch in batches:
            root, lists = batch.column(0).to_numpy(), batch.column(1)
            border = lists.offsets.to_numpy()
            many = batch.column(2).values.to_numpy()[batch.column(2).offsets[0].as_py() :][: border[-1] - border[0]] >= GROUP
            tokens = lists.values.to_numpy()[border[0] : border[-1]][many]
            for t, r in zip(tokens.tolist(), np.repeat(root, np.diff(border))[many].tolist(), strict=True):
                a, b = low.get(t, (r, r))
                low[t] = min(a, r), max(b, r)
        yield pa.RecordBatch.from_arrays([pa.array(list(low), pa.int64()), pa.array([x[0] for x in low.values()], pa.int64()), pa.array([x[1] for x in low.values()], pa.int64())], ["t", "a", "b"])

    ends = prefixes.select("root", "prefix", "frequency").mapInArrow(W.lean(run), "t long, a long, b long")
    found = settle(ends.groupBy("t").agg(F.min("a").alias("a"), F.max("b").alias("b")).filter("a < b").select("t"))
    if found.count() > MIXED:
        return None
    return prefixes.sparkSession.sparkContext.broadcast(np.sort(found.toArrow().column(0).to_numpy().view(np.uint64)))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Postings that share a shingle (and blocks), at least two of them."""
    W.forget()
    raw = [b for batch in batches for b in batch.column(1).to_pylist()]
    if not raw:
        return
    p = _unpacked(raw)
    del raw
    p = p[np.lexsort((p["key"], p["y"], p["x"], p["t"]))]
    same = (p["t"][1:] == p["t"][:-1]) & (p["x"][1:] == p["x"][:-1]) & (p["y"][1:] == p["y"][:-1])
    once = np.concatenate([[True], ~(same & (p["key"][1:] == p["key"][:-1]))])
    p = p[once]
    same = (p["t"][1:] == p["t"][:-1]) & (p["x"][1:] == p["x"][:-1]) & (p["y"][1:] == p["y"][:-1])
    cut = np.flatnonzero(np.concatenate([[True], ~same]))
    ends = np.append(cut[1:], len(p))
    for a, b in zip(cut[ends - cut > 1], ends[ends - cut > 1], strict=True):
        yield p[a:b]


_PAIRS = "a long, b long, c long, least int"


def _emit(pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Distinct pairs, how often they were met, and how often they must be."""
    a, b, least = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64) for _ in range(3))
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high, least = low[order], high[order], least[order]
    head = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])[: len(low)])
    return pa.RecordBatch.from_arrays([pa.array(low[head]), pa.array(high[head]), pa.array(np.diff(head, append=len(low))), pa.array(least[head].astype(np.int32))], ["a", "b", "c", "least"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs = []
    for p in _buckets(batches):
        hub = p[np.lexsort((p["key"], -(p["most"] / p["n"])))[0]]
        fits = (p["n"] <= hub["most"]) & (hub["n"] <= p["most"]) & (p["root"] != hub["root"])
        if fits.any():
            pairs.append((np.full(int(fits.sum()), hub["key"]), p["key"][fits], np.ones(int(fits.sum()), np.int64)))
    yield _emit(pairs)


def _all_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs in different components that may have matches enough; never two of one component.

    The signatures bound the common shingles ahead of the one at hand: a pair is met from its last match that it
    must have on, and only while the rest of both sets can make up the overlap.  Of two long prefixes, whose
    signatures say little, every match is told, and counted later."""
    pairs, held = [], 0
    for p in _buckets(batches):
        if (p["root"] == p["root"][0]).all():
            continue
        p = p[np.argsort(p["n"], kind="stable")]
        last = np.searchsorted(p["n"], p["most"], "right")
        for k in range(0, len(p), 64):
            x, end = p[k : k + 64], int(last[k : k + 64].max())
            y = p[k + 1 : end]
            if not len(y):
                continue
            fits = (y["n"][None] <= x["most"][:, None]) & (x["n"][:, None] <= y["most"][None]) & (x["root"][:, None] != y["root"][None])
            fits &= np.arange(len(y))[None] >= np.arange(len(x))[:, None]
            if p["x"][0] != p["y"][0]:
                fits &= x["g"][:, None] != y["g"][None]
            i, j = np.nonzero(fits)
            if len(i):
                ahead = sum(np.bitwise_count(x[w][i] & y[w][j]).astype(np.int64) for w in ("s0", "s1", "s2", "s3")) + np.minimum(x["e"][i], y["e"][j])
                rest = np.minimum((x["n"] - x["place"] + x["spare"])[i], (y["n"] - y["place"] + y["spare"])[j])
                least = np.minimum(x["l"][i], y["l"][j]).astype(np.int64)
                both = (x["long"][i] > 0) & (y["long"][j] > 0)
                may = (7 * (ahead + rest) >= 3 * (x["n"].astype(np.int64)[i] + y["n"][j])) & (both | (ahead >= least - 1))
                i, j, least, both = i[may], j[may], least[may], both[may]
                if len(i):
                    pairs.append((x["key"][i], y["key"][j], np.where(both, least, 1)))
                    held += len(i)
                if held > 500_000:
                    yield _emit(pairs)
                    pairs, held = [], 0
    yield _emit(pairs)


def _filter_of(ends: DataFrame) -> np.ndarray:
    """A bit filter over the classes ``key``, by the first bits of their ids; it may let others pass.  It has some 16 bits for
    each, from 2^16 up to 2^28."""
    ends = settle(ends.distinct())
    bits = min(max(16, (16 * ends.count()).bit_length()), 28)
    bit = F.shiftrightunsigned("key", 64 - bits)
    words = ends.select((bit / 32).cast("int").alias("w"), (bit % 32).cast("int").alias("k")).groupBy("w").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("k"))).alias("bits"))
    out = np.zeros(1 << (bits - 5), np.uint32)
    got = words.toArrow()
    out[got.column("w").to_numpy()] = got.column("bits").to_numpy().astype(np.uint32)
    return out


def _may_hold(filter_words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys.view(np.uint64) >> np.uint64(64 - (len(filter_words).bit_length() + 4))).astype(np.int64)
    return (filter_words[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) == 1


def _rooted(prefixes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``prefixes`` with the component ``root`` of each class.  Only rows that the filter of linked classes lets pass are
    joined; all others are their own root and stay where they are."""
    if roots is None:
        return prefixes.withColumn("root", F.col("key"))
    known = prefixes.sparkSession.sparkContext.broadcast(_filter_of(roots.select("key")))

    def sift(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(_may_hold(known.value, batch.column(0).to_numpy()) == wanted))

        return prefixes.mapInArrow(W.lean(run), prefixes.schema)

    joined = sift(True).join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    return sift(False).withColumn("root", F.col("key")).unionByName(joined)


def _linked(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of classes that link, by their whole sets."""
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(_filter_of(pairs.select(F.explode(F.array("a", "b")).alias("key"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = wanted.value, set()
        for batch in batches:
            for chunk in W.chunks(batch.column(1), lower=True):
                sets = Sets(chunk)
                fresh = _fresh(sets, seen)
                fresh = fresh[_may_hold(bits, sets.key[fresh])]
                if len(fresh):
                    flat, border = W.gather(sets.flat, sets.border[fresh], sets.size[fresh])
                    lists = pa.ListArray.from_arrays(pa.array(border.astype(np.int32)), pa.array(flat.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(sets.key[fresh]), lists], ["key", "shingles"])

    rows = _text_of(docs).mapInArrow(W.lean(run), "key long, shingles array<long>")
    sets = rows.groupBy("key").agg(F.first("shingles").alias("shingles"))
    one = pairs.select("a", "b").join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), "a")
    two = one.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    return two.select("a", "b", common.alias("c"), (F.size("sa") + F.size("sb")).alias("s")).filter("100 * c >= 75 * (s - c)").select("a", "b")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc_id, key, n`` of all rows, and ``key, root`` of the classes that link with another."""
    parts = _parts(docs)
    answers = _answers(docs, parts)
    prefixes = _prefixes(answers, parts)
    edges, roots, star = None, None, 0
    hottest = prefixes.agg(F.max(F.array_max("frequency"))).first()[0] or 0
    while hottest >= HOT:
        with_root = _rooted(prefixes, roots)
        pairs = settle(_postings(with_root, parts, star).mapInArrow(W.lean(_stars), _PAIRS).select("a", "b").distinct())
        found = settle(_linked(docs, pairs))
        edges = found if edges is None else edges.union(found)
        roots = min_labels(edges, "a", "b").select(F.col("id").alias("key"), F.col("label").alias("root"))
        star += 1
        if hottest < GROUP**star:
            break
    with_root = _rooted(prefixes, roots)
    mixed = _mixed(with_root) if hottest >= GROUP else None
    pairs = _postings(with_root, parts, None, mixed).mapInArrow(W.lean(_all_pairs), _PAIRS).groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("least").alias("least"))
    found = settle(_linked(docs, settle(pairs.filter("c >= least").select("a", "b"))))
    edges = found if edges is None else edges.union(found)
    return _survey(answers), min_labels(edges, "a", "b").select(F.col("id").alias("key"), F.col("label").alias("root"))


def _dealt_join(rows: DataFrame, named: DataFrame, on: str, by: str) -> DataFrame:
    """``rows`` left join ``named`` (unique in ``on``); rows of one value are dealt to ``SALTS`` tasks by a hash of ``by``."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return salted.join(named.withColumn("salt", salts), [on, "salt"], "left").drop("salt")


def groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_id (equal sets share it; null if empty)."""
    survey, roots = classes(docs)
    first = survey.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("low"), F.count("*").alias("c"))
    # all other classes are one document that is linked with nothing
    several = settle(first.join(roots, "key", "left").filter("c > 1 or root is not null").select("key", "low", F.coalesce("root", "key").alias("root")))
    lowest = several.groupBy("root").agg(F.min("low").alias("component_id"))
    named = settle(_dealt_join(several, lowest, "root", "key").select("key", "component_id", F.lit(True).alias("named")))
    out = _dealt_join(survey, named, "key", "doc_id")
    component = F.when(F.col("named"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("key").alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group: that of the smallest doc_id (rows without one come last), whose equal repetitions go too.

    Rows without words form no group and stay.  All columns are kept, whatever their names."""
    survey, roots = classes(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    same = survey.filter("key is not null").groupBy("key", "doc_id").agg(F.count("*").alias("c"))
    first = same.groupBy("key").agg(F.min(order).alias("low"), F.sum("c").alias("c"), F.max("c").alias("again"))
    rooted = settle(first.join(roots, "key", "left").filter("c > 1 or root is not null"))
    win = rooted.groupBy(F.coalesce("root", "key").alias("root")).agg(F.min(F.struct("low", "key")).alias("w"), F.max("again").alias("again"))
    known = [n.lower() for n in docs.columns]
    key, doc = (f"{n}_{uuid.uuid4().hex[:8]}" for n in ("class", "first"))
    win = settle(win.select(F.col("w.key").alias(key), F.col("w.low.doc_id").alias(doc), "again"))
    assert key not in known and doc not in known
    # only rows whose class may have copies or links are moved; all others stay where they are.  A class that passes the
    # filter by chance wins for itself
    bits = docs.sparkSession.sparkContext.broadcast(_filter_of(rooted.select("key")))
    chance = first.join(rooted.select("key"), "key", "left_anti").select(F.col("key").alias(key), F.col("low.doc_id").alias(doc), "again")
    all_wins = win.unionByName(chance.filter(_passes(bits)(F.col(key))))
    names = [F.col(f"`{n}`") for n in docs.columns]
    keyed = docs.select(*names, _class_of(bits)(F.col("text")).alias(key))
    stay = keyed.filter(F.col(key).isNull())
    # by class and document, so that the copies of one text are not one task's
    ours = keyed.filter(F.col(key).isNotNull()).withColumn(doc, F.col("doc_id").cast("long"))
    kept = ours.join(all_wins.drop("again").withColumnRenamed(doc, f"{doc}_w").withColumnRenamed(key, f"{key}_w"), (F.col(key) == F.col(f"{key}_w")) & F.col(doc).eqNullSafe(F.col(f"{doc}_w")), "left_semi")
    if (win.agg(F.max("again")).first()[0] or 0) > 1:
        kept = kept.dropDuplicates([key])
    return stay.select(*names).unionByName(kept.select(*names))


def _passes(bits):
    @F.arrow_udf("boolean")
    def passes(keys: pa.Array) -> pa.Array:
        return pa.array(_may_hold(bits.value, keys.to_numpy()))

    return passes


def _class_of(bits):
    """The class id of a text, null if the broadcast filter rules it out or the text has no words."""

    @F.arrow_udf(T.LongType())
    def class_of(texts: pa.Array) -> pa.Array:
        keys, none = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for chunk in W.chunks(texts, lower=True):
            sets = Sets(chunk)
            keys.append(sets.key)
            none.append(~_may_hold(bits.value, sets.key) | (sets.size == 0))
        return pa.array(np.concatenate(keys), mask=np.concatenate(none))

    return class_of
