"""Operator 1: probabilities that sum to one, and accuracy on documents kept from training."""

import numpy as np

from loomgraph.llm import language_id as L

SF = "/root/testdata/sf0.01"


def test_next_characters_sum_to_one():
    """P(c | context) over all characters that the alphabet floor counts."""
    model = L.fit([("a", "banana bandana ananas nab"), ("b", "kiwi wiki kik wik")], [])
    alphabet = [ord(c) for c in "abdnskiw "]
    for context in (" ", " b", " ba", " ban", "anan", "ana", " k", "xyz"):
        total = np.zeros(2)
        for c in alphabet:
            codes = np.array([*map(ord, context), c], np.uint64)
            grams = L._grams(codes)
            p = np.full(2, model.floor)
            for n in range(min(L.ORDER, len(codes))):
                back = model.back0 if n == 0 else None
                if n:
                    at, known = L.W.find(model.keys[n - 1], grams[n - 1][-2:-1])
                    back = model.back[n - 1][at[0]] if known[0] else 1.0
                at, known = L.W.find(model.keys[n], grams[n][-1:])
                p = p * back + (model.own[n][at[0]] if known[0] else 0.0)
            total += p
        # what is left belongs to unseen characters, each with the floor times all back-off weights
        assert (total <= 1 + 1e-9).all() and (total > 0.5).all(), (context, total)


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = L.identify(docs).collect()
    held = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert len(rows) == 1000 and len(held) > 150
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held), [(r.doc_id, lang[r.doc_id], r) for r in held if r.lang_pred != lang[r.doc_id]]
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows), [r for r in rows if r.rejected]
    assert all(0 <= r.score <= 1 for r in rows)


def test_defined_cases(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.train(docs, per_language=50)
    odd = [(1, None), (2, ""), (3, "123 — !!"), (None, "the and of thing"), (5, "xq zj vvk qqx jzz kkq wxz zzq xqj jjq"), (6, "日本語"), (7, "THE AND OF THING " * 20_000)]
    rows = L.predict(spark.createDataFrame([(*x, 0.5, "own", "de") for x in odd], "doc_id long, text string, score double, __has_letter string, lang string"), model).collect()
    got = {r.doc_id: r for r in rows}
    assert {r["__has_letter"] for r in rows} == {"own"} and {r.lang for r in rows} == {"de"}
    same = spark.createDataFrame([(1, "abc def", "en")] * 300 + [(k, f"kiwi wik {k}", "xx") for k in range(2, 60)], "doc_id long, text string, lang string")
    assert L.train(same, per_language=5).languages in (["en", "xx"], ["xx"])
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and all(got[k].rejected and got[k].score == 0 for k in (1, 2, 3))
    assert got[None].lang_pred == got[7].lang_pred == "en" and not got[7].rejected
    assert got[5].rejected and got[6].rejected
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.identify(none).collect() == []
    assert L.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).first().lang_pred == "und"
