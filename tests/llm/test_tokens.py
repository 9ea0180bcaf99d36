"""Operators 6 and 8 against the libraries, one whole text at a time."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from loomgraph.llm import spm, token_output, words as W

TEXTS = ["", None, "  a  b\n\nc ", "é!'s don't I'LL café, x»,y 123abc", "ﬁ ſt ŉ İstanbul ΣΑΣ", "▁a▁ b", "a" * 300, "日本語 テスト 😀😀", "tab\tx\r\ny", "x́ ́y ,̸z", "see <|endoftext|> here", "word " * 30_000, "\x01 x \x01"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k if k != 3 else None, t, "x") for k, t in enumerate(TEXTS)] + [(4, TEXTS[4], "again")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)


@pytest.mark.parametrize("vocabulary", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_tokenizers_library(spark, docs, vocabulary):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(vocabulary)
    tok = Tokenizer.from_file(path)
    folder, shards = token_output.token_files(docs, path, shards=4)
    got = sorted(token_output.read(spark, folder, shards).collect(), key=lambda r: r.start)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    start = 0
    for g, r in zip(got, rows, strict=True):
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), r.text
        start += len(ids)


def test_pieces_equal_the_sentencepiece_library(docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in spm.decode(spm.encode(docs, path), path).collect():
        assert r.ids == sp.encode(text[r.doc_id])
        assert r.text == text[r.doc_id].replace("▁", " ")
    for r in spm.round_trip(docs, path).collect():
        ids = sp.encode(text[r.doc_id])
        assert (r.n_pieces, r.ids_crc32, r.round_trip) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)


def test_what_a_worker_remembers_is_bounded(monkeypatch):
    """Many more words and pairs of pieces than the bounds: ids equal the library's, words met again are kept."""
    import random

    import sentencepiece

    monkeypatch.setattr(spm, "WORDS", 300)
    monkeypatch.setattr(spm, "PAIRS", 200)
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, codec, draw, shrunk = sentencepiece.SentencePieceProcessor(model_file=path), spm.Codec(path), random.Random(5), []
    shrink = codec.memo.shrink
    monkeypatch.setattr(codec.memo, "shrink", lambda: shrunk.append(shrink()) or shrunk[-1])
    for _ in range(30):
        texts = [" ".join(["the", "common", *("".join(draw.choices("abeéort日", k=draw.randint(1, 9))) for _ in range(40))]) for _ in range(3)]
        (chunk,) = W.chunks(pa.array([f" {t}" for t in texts]))
        ids, border = codec.encode(chunk)
        assert [ids[a:b].tolist() for a, b in zip(border[:-1], border[1:], strict=True)] == [sp.encode(t) for t in texts]
        assert codec.memo.count == len(codec.memo.again) == len(codec.ids.begin) <= 300 + 3 * 42 * 10
        assert codec.ids.used == codec.ids.length.sum() and len(codec.model.follows) <= 200
    assert len(shrunk) > 3 and all(0 < len(kept) <= 150 for kept in shrunk)


def test_workers_give_memory_back(monkeypatch):
    """Before a vocabulary is loaded, what other operators kept goes; after a task, ended or cut short, free memory goes."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    monkeypatch.setattr(W, "KEPT", {("lang", "x"): bytes(10)})
    codec = spm._codec(path)
    assert list(W.KEPT.values()) == [codec] and spm._codec(path) is codec
    calls = []
    monkeypatch.setattr(W, "release", lambda: calls.append(1))
    assert list(W.lean(lambda batches: iter(list(batches)))(iter([1, 2]))) == [1, 2] and calls == [1]
    cut = W.lean(lambda batches: batches)(iter([1, 2]))
    assert next(cut) == 1 and calls == [1]
    cut.close()
    assert calls == [1, 1]


def test_unigram_segmentations_have_the_best_sum():
    """Against all segmentations, on a small vocabulary made by hand."""
    scores = {"▁": -3.0, "▁a": -2.5, "▁ab": -4.0, "a": -2.0, "b": -2.25, "ab": -3.5, "ba": -3.0, "abc": -6.5, "c": -4.5, "bc": -5.0, "▁aba": -5.5}

    def every(word):
        if not word:
            yield []
        for k in range(1, len(word) + 1):
            if word[:k] in scores or k == 1:
                yield from ([word[:k], *rest] for rest in every(word[k:]))

    total = lambda parts: sum(scores.get(p, min(scores.values()) - spm.UNKNOWN_PENALTY) for p in parts)
    words = sorted("▁" * (k % 3) + "".join("abcx"[(k >> 2 * j) & 3] for j in range(k % 7)) for k in range(2000))
    for word, parts in zip(words, spm.Unigram(scores).walk(words), strict=True):
        assert "".join(parts) == word and total(parts) == pytest.approx(max(map(total, every(word)))), (word, parts)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    path = public_tokenizers.path("word_bpe_49k.json")
    folder, shards = token_output.token_files(none, path, shards=2)
    assert shards == [] and token_output.read(spark, folder, shards).collect() == []
    assert spm.round_trip(none, public_tokenizers.path("piece_bpe_32k.model")).collect() == []
