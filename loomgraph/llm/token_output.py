"""Token ids as flat binary files (operator 8).

Format, one pair of files per shard:

* ``shard-NNNNN.bin``: the ids of all documents one after another, little-endian unsigned integers of 2
  bytes if the vocabulary has at most 65,536 ids, else 4;
* ``shard-NNNNN.idx``: little-endian 64-bit integers: magic, bytes per id, documents n, then n doc_ids
  (the smallest 64-bit value stands for null) and n + 1 offsets into the shard's ids.

Shards hold consecutive ranges of ascending doc_id.  Each task writes under a name of its own attempt and
renames, so a repeated task replaces its file by an equal one.  A shard's base, the number of ids before
it, is the prefix sum of the shards' sizes: the driver sees one row per shard, never a document.

With a vocabulary whose pre-tokenizer is known to part ASCII white space, and an ASCII letter from an ASCII
non-letter (``PARTING``), the tokenizer sees each distinct word piece once per worker: texts are cut there, which leaves the
ids of the whole text unchanged.  They are lower-cased first only if the vocabulary's normaliser does so.  Texts that
hold a special token's string, and all texts under any other vocabulary, are encoded whole.

Defined cases: null text is empty; an empty text has only the end id; null doc_ids come last; repeated
doc_ids keep all their rows, in the order of their ids' bytes; a very long text is encoded whole by one task; an empty table gives an empty result; only ``doc_id`` and ``text``
are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..plans.store import scratch
from . import words as W

MAGIC = 0x4C474944
NULL_ID = -(1 << 63)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_OTHER = ~_LETTER
_OTHER[128:] = False
_SEPARATOR = "\x01"

#: Split patterns (what they don't match is dropped) and normalisers that leave such cuts where they are.
PARTING = ("'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",)
LEAVING = ("NFC", "Lowercase", "Replace")


def _steps(part: dict | None, inner: str) -> list[dict]:
    """A normaliser or pre-tokenizer as the list of its steps."""
    if part is None:
        return []
    return [x for p in part[inner] for x in _steps(p, inner)] if part["type"] == "Sequence" else [part]


def cuts_of(path: str) -> tuple[bool, bool]:
    """Whether texts may be cut into pieces under this vocabulary, and whether it lower-cases them."""
    import json

    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    norms = _steps(config["normalizer"], "normalizers")
    first = (_steps(config["pre_tokenizer"], "pretokenizers") or [{"type": None}])[0]
    parts = first["type"] == "Split" and first["pattern"].get("Regex") in PARTING and first["behavior"] == "Removed" and first["invert"]
    leaves = all(x["type"] in LEAVING and (x["type"] != "Replace" or (x["pattern"].get("Regex"), x["content"]) == (r"\s+", " ")) for x in norms)
    return bool(parts and leaves), any(x["type"] == "Lowercase" for x in norms)


class Encoder:
    """Ids of whole texts by way of their distinct pieces; one per worker and vocabulary."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.cuts, self.lower = cuts_of(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        mark = self._ids(_SEPARATOR)
        self.mark = mark[0] if len(mark) == 1 else None
        self.memo, self.ids = W.Memo(), W.Ragged(np.uint32)

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _many(self, pieces: list[bytes]) -> None:
        """Encode pieces, a thousand at a time, parted by a mark that is one id and never joins its neighbours."""
        flat, length = [], []
        for k in range(0, len(pieces), 1000):
            part = [p.decode("utf-8", "replace") for p in pieces[k : k + 1000]]
            if self.mark is not None and not any(_SEPARATOR in p for p in part):
                ids = np.array(self._ids(f" {_SEPARATOR} ".join(part)), np.uint32)
                cut = np.flatnonzero(ids == self.mark)
                if len(cut) == len(part) - 1:
                    length.append(np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1)
                    flat.append(np.delete(ids, cut))
                    continue
            each = [self._ids(p) for p in part]
            length.append(np.array([len(x) for x in each], np.int64))
            flat.append(np.array([i for x in each for i in x], np.uint32))
        self.ids.extend(np.concatenate(flat), np.concatenate(length))

    def encode(self, chunk: W.Chunk, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunk's documents, each ended by ``end_id``, and the borders between documents."""
        raw = chunk.data[: chunk.size].tobytes()
        if not self.cuts or any(s.encode() in raw for s in self.special):
            each = [np.array([*self._ids(raw[a:b].decode("utf-8", "replace")), end_id], np.uint32) for a, b in zip(chunk.offs[:-1], chunk.offs[1:], strict=True)]
            return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        low = W.Chunk(W.LOWER[chunk.data], chunk.offs, chunk.first) if self.lower else chunk
        starts, ends, _ = W.runs(low, ~W.IS_SPACE)
        cut = np.zeros(chunk.size + 1, bool)
        cut[1:-1] = _LETTER[low.data[: chunk.size - 1]] & _OTHER[low.data[1 : chunk.size]] & ~W.IS_SPACE[low.data[1 : chunk.size]]
        cut[starts] = True
        starts = np.flatnonzero(cut)
        stop = np.zeros(chunk.size + 1, bool)
        stop[ends] = True
        stop[starts] = True
        stop = np.flatnonzero(stop)
        ends = stop[np.searchsorted(stop, starts, "right")] if len(starts) else starts
        first = np.searchsorted(starts, chunk.offs)
        hashes = W.hash_spans(low.data, starts, ends)
        if self.memo.count > self.memo.limit:
            self.memo.clear()
            self.ids.clear()
        text = low.data.tobytes()
        slots = self.memo.slots_of(hashes, lambda i: self._many([text[a:b] for a, b in zip(starts[i], ends[i], strict=True)]))
        begin, length = self.ids.begin[slots], self.ids.length[slots]
        flat, border = W.gather(self.ids.flat, begin, length)
        at = border[first]
        out = np.insert(flat, at[1:], np.uint32(end_id))
        return out, at + np.arange(len(at))


def _encoder(path: str) -> Encoder:
    key = ("tokens", path)
    if key not in W.KEPT:
        W.KEPT[key] = Encoder(path)
    return W.KEPT[key]


def encode(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """``doc_id``, ``ids``: little-endian unsigned integers as bytes (2 or 4 each, by the vocabulary's size)."""
    width = id_width(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            for chunk in W.chunks(batch.column(1)):
                ids, border = encoder.encode(chunk, end_id)
                data = ids.astype(f"<u{width}").tobytes()
                offs = pa.py_buffer((border * width).astype(np.int32).tobytes())
                col = pa.Array.from_buffers(pa.binary(), chunk.n, [None, offs, pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.n), col], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def id_width(vocabulary: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(vocabulary).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def _files(path: str):
    """A file system and a path in it; a bare path is local."""
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def doc_ranges(docs: DataFrame, parts: int):
    """Column with the number of the range of ascending doc_id that a row is in; nulls are in the last.

    Borders are quantiles of all doc_ids, at most ``parts`` of them."""
    cuts = docs.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", [k / parts for k in range(1, parts)], 0.2 / parts) if parts > 1 else []
    cuts = sorted({int(c) for c in cuts})
    ids = F.col("doc_id").cast("long")
    number = F.lit(0)
    if cuts:
        # the number of borders at or below the id
        number = F.size(F.filter(F.lit(cuts), lambda c: c <= ids))
    return F.when(ids.isNull(), F.lit(len(cuts) + 1)).otherwise(number).cast("int"), len(cuts) + 2


def write(encoded: DataFrame, bucket, shards: int, folder: str, width: int) -> list[tuple[int, int, int]]:
    """Write ``doc_id, ids`` rows as shards; returns (shard, documents, ids) of each, in order."""
    fs, root = _files(folder)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        mine = f".{ctx.stageId()}-{ctx.partitionId()}-{ctx.attemptNumber()}-{ctx.taskAttemptId()}"
        fs, root = _files(folder)
        open_shard, out, docs, sizes, done = None, None, [], [], []

        def close() -> None:
            if open_shard is None:
                return
            out.close()
            head = np.array([MAGIC, width, sum(map(len, docs))], "<i8").tobytes()
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype("<i8")
            with fs.open_output_stream(f"{root}/shard-{open_shard:05d}.idx{mine}") as f:
                f.write(head + np.concatenate(docs).astype("<i8").tobytes() + offsets.tobytes())
            for kind in ("bin", "idx"):
                fs.move(f"{root}/shard-{open_shard:05d}.{kind}{mine}", f"{root}/shard-{open_shard:05d}.{kind}")
            done.append((open_shard, sum(map(len, docs)), int(offsets[-1])))

        for batch in batches:
            number = batch.column(0).to_numpy()
            ids = batch.column(1).cast(pa.large_binary())
            ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
            data = ids.buffers()[2]
            who = batch.column(2).fill_null(NULL_ID).to_numpy()
            edge = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if a == b:
                    continue
                if open_shard != int(number[a]):
                    close()
                    open_shard, docs, sizes = int(number[a]), [], []
                    out = fs.open_output_stream(f"{root}/shard-{open_shard:05d}.bin{mine}")
                out.write(data[int(ends[a]) : int(ends[b])])
                docs.append(who[a:b])
                sizes.append(np.diff(ends[a : b + 1]) // width)
        close()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([d[0] for d in done], pa.int32()), "docs": pa.array([d[1] for d in done], pa.int64()), "ids": pa.array([d[2] for d in done], pa.int64())})

    dealt = encoded.select(bucket.alias("shard"), "ids", "doc_id").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_last(), "ids")
    return sorted((r.shard, r.docs, r.ids) for r in dealt.mapInArrow(run, "shard int, docs long, ids long").collect())


def read(spark, folder: str, shards: list[tuple[int, int, int]]) -> DataFrame:
    """Documents of the shards, from the files: doc_id, start, n_tokens, ids_crc32, in any order."""
    rows, base = [], 0
    for shard, _, ids in shards:
        rows.append((shard, base))
        base += ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        fs, root = _files(folder)
        for batch in batches:
            for shard, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = f"{root}/shard-{shard:05d}"
                if isinstance(fs, pafs.LocalFileSystem):
                    index, ids = (np.memmap(f"{name}.{k}", np.uint8, "r") if fs.get_file_info(f"{name}.{k}").size else np.zeros(0, np.uint8) for k in ("idx", "bin"))
                else:
                    index, ids = (np.frombuffer(fs.open_input_stream(f"{name}.{k}").read(), np.uint8) for k in ("idx", "bin"))
                magic, width, n = index[:24].view("<i8")
                if magic != MAGIC:
                    raise ValueError(f"{name}.idx is no token index")
                who, offs = index[24 : 24 + 8 * n].view("<i8"), index[24 + 8 * n :].view("<i8")
                ids = ids.view(f"<u{width}")
                for a in range(0, n, 20_000):
                    b = min(n, a + 20_000)
                    crc = [zlib.crc32(np.ascontiguousarray(ids[offs[k] : offs[k + 1]], "<u4")) for k in range(a, b)]
                    ids_of = pa.array(np.array(who[a:b]), pa.int64(), mask=np.array(who[a:b]) == NULL_ID)
                    yield pa.RecordBatch.from_arrays([ids_of, pa.array(base + np.array(offs[a:b])), pa.array(np.diff(offs[a : b + 1])), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    given = spark.createDataFrame(rows, "shard int, base long")
    return given.repartition(max(1, min(len(rows), 4096))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 2, shards: int | None = None, folder: str | None = None) -> tuple[str, list[tuple[int, int, int]]]:
    """Encode ``docs`` and write them in ascending doc_id order; the folder and its shards."""
    spark = docs.sparkSession
    parts = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = folder or scratch(spark, "tokens")
    bucket, n = doc_ranges(docs, parts)
    return folder, write(encode(docs, vocabulary, end_id), bucket, n, folder, id_width(vocabulary))
