"""SentencePiece encoding and decoding by a shared-prefix Viterbi (operator 6).

A text is normalised as the library does for these models (blank to the marker, one marker in front) and
cut into marked words: a run of markers and what follows it.  No piece of the vocabulary has a marker after
another character, so no merge crosses such a border and words can be encoded one by one.  The same holds
for any two ASCII characters that no piece holds side by side; words are cut there too.

Distinct marked words are sorted and walked as the depth-first traversal of their trie: a stack holds the
forward state of each prefix, and a word reuses the states of the prefix it shares with the one before.
Each step looks at the pieces that end at the position.

For a model of the unigram kind the state is the Viterbi forward score: the best sum of piece scores up to there, and
the piece that ends it.  For one of the BPE kind the best sum of scores is *not* the library's segmentation.  Its
forward state is therefore the last piece of the prefix's own segmentation, and a piece may follow a state only if
the two, merged by the model's rules as one string, stay those two pieces.  Exactly one piece can end each prefix, so
the state needs no back-tracking over alternatives, and the result equals the library's.  The kind and the
normaliser are read from the model; one that does more than the above (other normalisations, unused pieces that
compete, pieces across words) is refused.

Defined cases: null text is empty; an empty text has no ids and decodes to the empty text; characters
outside the vocabulary become byte pieces; null or repeated doc_ids pass through row by row; an empty
table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W

MARK = "▁"


#: Field numbers and values of the model file's format that are read here.
TRAINER, NORMALIZER = 2, 3
MODEL_TYPE, UNIGRAM, BPE = 3, 1, 2
RULES_NAME, CHARSMAP, DUMMY_PREFIX, EXTRA_BLANKS, ESCAPE_BLANKS = 1, 2, 3, 4, 5
#: Fixed value: how far the score of a character without a piece lies below the lowest one.
UNKNOWN_PENALTY = 10.0
#: Bounds of what a worker remembers: pairs of pieces (some 100 bytes each) and words (some 60).  They only save time.
PAIRS, WORDS = 500_000, 500_000


def _fields(raw: bytes) -> dict[int, int | bytes]:
    """The last value of each field of a protocol buffer message."""
    out, at = {}, 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        field, kind = divmod(number(), 8)
        if kind == 0:
            out[field] = number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            out[field] = raw[at : at + size]
            at += size
    return out


class Unigram:
    """Viterbi over pieces with scores (natural logarithms of their probabilities)."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores))
        self.unknown = min(scores.values()) - UNKNOWN_PENALTY

    def walk(self, words: list[str]) -> Iterator[list[str]]:
        """Best segmentations of sorted words; of equally good ones that with the longest last piece, and so on."""
        # forward state of prefix k: its best score, and where the last piece of the best segmentation begins
        state: list[tuple[float, int]] = [(0.0, 0)]
        before = ""
        for word in words:
            k = 0
            while k < min(len(before), len(word)) and before[k] == word[k]:
                k += 1
            del state[k + 1 :]
            for end in range(k + 1, len(word) + 1):
                best = None
                for begin in range(max(0, end - self.longest), end):
                    score = self.scores.get(word[begin:end])
                    if score is None and end - begin == 1:
                        score = self.unknown
                    if score is not None and (best is None or state[begin][0] + score > best[0]):
                        best = (state[begin][0] + score, begin)
                state.append(best)
            before = word
            at, parts = len(word), []
            while at:
                begin = state[at][1]
                parts.append(word[begin:at])
                at = begin
            yield parts[::-1]


class Model:
    """Pieces and merge rules of one vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = _fields(sp.serialized_model_proto())
        self.kind = _fields(proto.get(TRAINER, b"")).get(MODEL_TYPE, UNIGRAM)
        normalizer = _fields(proto.get(NORMALIZER, b""))
        if self.kind not in (UNIGRAM, BPE) or normalizer.get(CHARSMAP) or normalizer.get(EXTRA_BLANKS, 1) or not normalizer.get(DUMMY_PREFIX, 1) or not normalizer.get(ESCAPE_BLANKS, 1):
            raise ValueError("this model's kind or normalisation is not supported")
        n = sp.get_piece_size()
        self.byte = {}
        self.piece: dict[str, int] = {}
        self.score = [sp.get_score(i) for i in range(n)]
        self.bytes_of: list[bytes] = []
        for i in range(n):
            s = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(s[1:-1], 16)] = i
                self.bytes_of.append(bytes([int(s[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.piece[s] = i
                self.bytes_of.append(s.replace(MARK, " ").encode())
        if len(self.byte) != 256:
            raise ValueError("a model without byte pieces can't give every text back")
        self.unigram = Unigram({s: self.score[i] for s, i in self.piece.items()}) if self.kind == UNIGRAM else None
        if any(MARK in s.lstrip(MARK) for s in self.piece):
            raise ValueError("a piece has a marker after another character; words can't be encoded one by one")
        self.longest = max(map(len, self.piece))
        #: ASCII pairs that some piece holds side by side; nothing merges across any other pair.
        self.joined = np.zeros((128, 128), bool)
        for s in self.piece:
            codes = [32 if c == MARK else ord(c) for c in s]
            for a, b in zip(codes[:-1], codes[1:], strict=True):
                if a < 128 and b < 128:
                    self.joined[a, b] = True
        #: Whether a piece may follow another, by the numbers of both: a piece's id, beyond them a character that is none,
        #: last the beginning of a word.
        self.follows: dict[int, bool] = {}
        self.head = n + 0x110000

    def merged(self, text: str) -> list[str]:
        """The segmentation of a string by merging, best score first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.piece.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, key: int, a: str, b: str) -> bool:
        if len(self.follows) >= PAIRS:
            self.follows.clear()
        known = self.follows[key] = self.merged(a + b) == [p for p in (a, b) if p]
        return known

    def ids(self, piece: str) -> list[int]:
        if (i := self.piece.get(piece)) is not None:
            return [i]
        return [self.byte[b] for b in piece.encode("utf-8", "surrogatepass")]

    def walk(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of sorted distinct words."""
        if self.unigram:
            for parts in self.unigram.walk(words):
                yield [i for s in parts for i in self.ids(s)]
            return
        # forward state of prefix k: where its last piece begins, and that piece's number
        state: list[tuple[int, int]] = [(0, self.head)]
        before = ""
        piece, longest, follows, n = self.piece, self.longest, self.follows, len(self.score)
        for word in words:
            k = 0
            most = min(len(before), len(word))
            while k < most and before[k] == word[k]:
                k += 1
            del state[k + 1 :]
            for end in range(k + 1, len(word) + 1):
                for begin in range(max(0, end - longest), end):
                    s = word[begin:end]
                    if (number := piece.get(s)) is None:
                        if end - begin > 1:
                            continue
                        number = n + ord(s)
                    at, last = state[begin]
                    key = last * (self.head + 1) + number
                    if (known := follows.get(key)) is None:
                        known = self.may_follow(key, word[at:begin], s)
                    if known:
                        state.append((begin, number))
                        break
                else:
                    raise AssertionError(f"no segmentation of {word[:end]!r}")
            before = word
            end, parts = len(word), []
            while end:
                begin, number = state[end]
                parts.append([number] if number < n else self.ids(word[begin:end]))
                end = begin
            yield [i for ids in reversed(parts) for i in ids]


class Codec:
    def __init__(self, path: str):
        self.model = Model(path)
        self.memo, self.ids = W.Memo(WORDS), W.Ragged(np.int32)
        length = np.array([len(b) for b in self.model.bytes_of], np.int64)
        self.text_flat = np.frombuffer(b"".join(self.model.bytes_of), np.uint8)
        self.text_length, self.text_begin = length, np.cumsum(length) - length

    def _learn(self, found: list[bytes]) -> None:
        words = [w.decode("utf-8", "replace").replace(" ", MARK) for w in found]
        order = sorted(range(len(words)), key=words.__getitem__)
        got: list[list[int]] = [[]] * len(words)
        for k, ids in zip(order, self.model.walk([words[k] for k in order]), strict=True):
            got[k] = ids
        self.ids.extend(np.array([i for x in got for i in x], np.int32), np.array([len(x) for x in got], np.int64))

    def encode(self, chunk: W.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of documents that begin with a blank (or are empty), and the borders between documents."""
        d, n = chunk.data, chunk.size
        cut = np.zeros(n + 1, bool)
        a, b = d[: n - 1], d[1:n]
        cut[1:-1] = (a < 128) & (b < 128) & ~self.model.joined[a & 127, b & 127]
        cut[chunk.offs] = True
        cut[n] = False
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n) if len(starts) else starts
        first = np.searchsorted(starts, chunk.offs)
        hashes = W.hash_spans(d, starts, ends)
        if self.memo.count > self.memo.limit:
            self.ids.keep(self.memo.shrink())
        raw = d.tobytes()
        slots = self.memo.slots_of(hashes, lambda i: self._learn([raw[a:b] for a, b in zip(starts[i], ends[i], strict=True)]))
        flat, border = W.gather(self.ids.flat, self.ids.begin[slots], self.ids.length[slots])
        return flat, border[first]

    def decode(self, ids: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of id sequences, without the blank put in front, and the borders between documents."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.text_length)):
            raise ValueError("id outside the vocabulary")
        flat, at = W.gather(self.text_flat, self.text_begin[ids], self.text_length[ids])
        edge = at[border]
        heads = edge[:-1][edge[1:] > edge[:-1]]
        heads = heads[flat[heads] == 0x20]
        drop = np.zeros(len(flat) + 1, np.int64)
        drop[heads + 1] = 1
        return np.delete(flat, heads), edge - np.cumsum(drop)[edge]


def _codec(path: str) -> Codec:
    key = ("spm", path)
    if key not in W.KEPT:
        W.forget()
        W.KEPT[key] = Codec(path)
    return W.KEPT[key]


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(text == "", text).otherwise(F.concat(F.lit(" "), F.replace(text, F.lit(MARK), F.lit(" ")))).alias("text"))


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id``, ``ids`` (array of int) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary)
        for batch in batches:
            for chunk in W.chunks(batch.column(1)):
                ids, border = codec.encode(chunk)
                col = pa.ListArray.from_arrays(pa.array(border.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.n), col], ["doc_id", "ids"])

    return _texts(docs).mapInArrow(W.lean(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id``, ``ids``, ``text`` for rows of ``doc_id, ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary)
        for batch in batches:
            col = batch.column(1)
            border = col.offsets.to_numpy().astype(np.int64)
            ids = col.values.to_numpy(zero_copy_only=False)[border[0] : border[-1]]
            flat, edge = codec.decode(ids, border - border[0])
            raw = flat.tobytes()
            text = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), col, text], ["doc_id", "ids", "text"])

    whole = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return whole.mapInArrow(W.lean(run), "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encode and decode each row in one pass: doc_id, n_pieces, ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers), decoded_sha256, round_trip (the decoded text is the text, with the marker
    character, which the model can't tell from a blank, read as one)."""
    import hashlib
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary)
        for batch in batches:
            for chunk in W.chunks(batch.column(1)):
                ids, border = codec.encode(chunk)
                flat, edge = codec.decode(ids, border)
                raw, mine, u4 = flat.tobytes(), chunk.data.tobytes(), ids.astype("<u4")
                crc = [zlib.crc32(u4[a:b]) for a, b in zip(border[:-1], border[1:], strict=True)]
                back = [raw[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
                same = [x == mine[a + 1 : b] for x, a, b in zip(back, chunk.offs[:-1], chunk.offs[1:], strict=True)]
                sha = [hashlib.sha256(x).hexdigest() for x in back]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.n), pa.array(np.diff(border)), pa.array(crc, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "round_trip"])

    return _texts(docs).mapInArrow(W.lean(run), "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
