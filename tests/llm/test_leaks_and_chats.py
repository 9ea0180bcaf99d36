"""Operators 9 and 10 on hand-made rows."""

import itertools

from pyspark.sql import functions as F

from loomgraph.llm import chat, decontaminate as D


def test_masks_leave_no_gap():
    """Any two substitutions in a window spare the kept positions of some mask at some offset."""
    for bad in itertools.combinations(range(D.WINDOW), D.WINDOW - D.NEED):
        assert any(all(o + k not in bad for k in m) for m in D.MASKS for o in range(D.WINDOW - D.SPAN + 1))


def test_overlaps(spark, monkeypatch):
    w = [f"w{k}" for k in range(40)]
    swap = lambda words, *at: [("x" if k in at else x) for k, x in enumerate(words)]
    texts = {
        1: "pre " + " ".join(w[:20]) + " post", 2: " ".join(swap(w[:13], 3, 9)), 3: " ".join(swap(w[:13], 3, 6, 9)), 4: " ".join(w[7:20]), 5: " ".join(w[8:20]),
        6: None, 7: "", 8: " ".join(w[30:39]).upper(), 9: " ".join(swap(w[30:39], 4)), 10: " ".join(w[:20] * 3),
    }
    docs = spark.createDataFrame([*texts.items(), (None, texts[1]), (1, texts[1])], "doc_id long, text string").withColumn("words", F.lit("clash")).withColumn("item_id", F.lit(1))
    items = spark.createDataFrame([(100, " ".join(w[:20])), (101, None), (102, " ".join(w[30:39])), (103, "w1 w2"), (104, " ".join(w[:20])), (105, "X w10"), (106, ""), (107, " ".join(w[:20]))], "item_id long, text string")
    for most in (1 << 26, 0):  # broadcast, then shuffled
        monkeypatch.setattr(D, "BROADCAST_BYTES", most)
        got = {(r.doc_id, r.item_id): (r.item_tokens, r.matched_tokens, r.window_matches, r.first_token) for r in D.overlaps(docs, items).collect()}
        assert got[1, 100] == got[1, 104] == (20, 20, 13, 1)
        # two words: no seed, but reported wherever they occur
        short = {k: got.pop(k) for k in list(got) if k[1] in (103, 105)}
        assert short == {(d, 103): (2, 2, 2, at) for d, at in {1: 2, 2: 1, 3: 1, 10: 1, None: 2}.items()} | {(d, 105): (2, 2, 2, 9) for d in (2, 3)}
        assert got[2, 100][1:] == (11, 11, 0) and got[4, 100] == (20, 13, 13, -7)
        assert {d for d, _ in got} == {1, 2, 4, 5, 8, 10, None} and got[5, 100][2] == 12 and got[8, 102] == (9, 9, 9, 0)
        kept = D.clean(docs.withColumn("__leak_a", F.lit("own")), items.filter("item_id <> 103 and item_id <> 105"))
        assert sorted((r.doc_id, r["__leak_a"]) for r in kept.collect()) == [(k, "own") for k in (3, 6, 7, 9)] and kept.columns[:-1] == docs.columns
    assert D.overlaps(docs.limit(0), items).collect() == [] and D.overlaps(docs, items.limit(0)).collect() == []
    assert D.clean(docs, items.limit(0)).count() == docs.count()


def test_parts_and_attachments(spark):
    part = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    none = (None,) * 5
    rows = [
        (1, 1, "assistant", [("text", "a & <|end|> [x]", *none), ("image", None, "i.png", 56, 29, None, None)]),
        (1, 0, "user", [("audio", None, "a.wav", None, None, 2.0, None), ("text", "&amp; &lt;", *none), ("document", None, "d.pdf", None, None, None, 3), ("odd", None, "z", *none[:4])]),
        (None, None, None, None), (2, 0, "assistant", []), (2, 0, "assistant", []),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{part}>").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat.format_chats(df).withColumns({"back": chat.read_turns(F.col("formatted")), "loss": chat.read_loss(F.col("formatted"), F.col("loss_mask"))}).collect()}
    assert [(a.ordinal, a.turn, a.type, a.ref, a.tokens) for a in got[1].attachments] == [(1, 0, "audio", "a.wav", 50), (2, 0, "document", "d.pdf", 768), (3, 0, "odd", "z", 0), (4, 1, "image", "i.png", 4)]
    assert got[1].expanded_tokens == 822 and got[1].n_turns == 2
    assert got[1].formatted.count(chat.END) == 2 and "[" not in got[1].formatted
    assert [(t.role, t.text) for t in got[1].back] == [("user", "<|audio|>&amp; &lt;<|document|><|file|>"), ("assistant", "a & <|end|> [x]<|image|>")]
    assert got[1].loss == "a & <|end|> [x]<|image|>"
    assert got[None].n_turns == 1 and [(t.role, t.text) for t in got[None].back] == [("", "")]
    assert got[2].n_turns == 2 and got[2].loss == ""
    assert chat.format_chats(df.limit(0)).collect() == []


def test_texts_come_back(spark):
    said = ["</s>[INST] ok [/INST]", "", None, "&amp;lt; &#91; <|turn|>", "é😀\n\n", "<|end|>" * 3000]
    df = spark.createDataFrame([(7, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(said)], "conv_id long, turn long, role string, text string")
    r = chat.digest(df).first()
    import hashlib

    whole = "".join(f"{'assistant' if k % 2 else 'user'}\n{t or ''}\n" for k, t in enumerate(said))
    loss = "".join(t or "" for k, t in enumerate(said) if k % 2)
    assert r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest() and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and r.loss_chars == len(loss)
