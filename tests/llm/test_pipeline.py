"""The pipeline's stages against plain versions, on the small tables and on odd rows."""

import re

import pytest
import sentencepiece
from test_jaccard import brute
from test_spans import base_secrets

import corpus_pipeline
from loomgraph.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage returned, by name."""
    odd = [(-1, None, "en", "s", None), (-2, "", None, None, 0), (None, "the and of thing is then", "en", "s", 24), (-3, "the and password=abcdef0123456789 of", "en", "s", 1)]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.union(spark.createDataFrame([*odd, odd[-1]], docs.schema))
    out = {"": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        found = stage(spark, docs, SF)
        if name != "sentencepiece":
            assert found.columns == docs.columns
        found.write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs.collect()
    return out


def test_languages(kept):
    gone = {r.doc_id for r in kept[""]} - {r.doc_id for r in kept["language_id"]}
    assert {-1, -2} <= gone and len(gone) <= 4


def test_one_of_each_group(kept):
    texts = {k: r.text for k, r in enumerate(sorted(kept["language_id"], key=lambda r: (r.doc_id is None, r.doc_id)))}
    ids = {k: r.doc_id for k, r in enumerate(sorted(kept["language_id"], key=lambda r: (r.doc_id is None, r.doc_id)))}
    want = sorted((ids[k] for k, (n, c) in brute(texts).items() if k == c), key=repr)
    assert sorted((r.doc_id for r in kept["ngram_jaccard_join"]), key=repr) == want


def test_leaks_go_and_clean_documents_stay(kept, spark):
    low = lambda t: " ".join(re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()))
    items = [low(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = ({r.doc_id: low(r.text) for r in kept[k]} for k in ("ngram_jaccard_join", "decontamination"))
    leaks = {i for i, t in before.items() if any(f" {x} " in f" {t} " for x in items)}
    assert leaks and set(before) - set(after) == leaks


def test_secrets_are_masked(kept):
    before, after = ({r.doc_id: r for r in kept[k]} for k in ("decontamination", "secret_scan"))
    assert set(before) == set(after)
    for i, r in after.items():
        spans = base_secrets(before[i].text or "")
        assert (r.text == before[i].text) == (not spans)
        assert not base_secrets(r.text or "") and all(before[i].text[a:b] not in r.text for _, a, b in spans)
    assert after[-3].text == "the and [secret] of" and after[-3].n_chars == len(after[-3].text)


def test_pieces(kept):
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    text = {r.doc_id: r.text for r in kept["secret_scan"]}
    assert {r.doc_id: r.ids for r in kept["sentencepiece"]} == {i: sp.encode(t or "") for i, t in text.items()}
