"""Operator 5 against all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import jaccard_join as J


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingles(t):
    w = words(t)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocab) for _ in range(60)]
    out = ["", None, "a b", "A  b", "a b c", "one two three four five", "\n\t", "ONE two three four five six"]
    base = [rng.choice(vocab) for _ in range(80)]
    for _ in range(250):  # one group of many near copies, at all distances
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append(" ".join(w))
    for _ in range(150):  # a passage that takes more or less of the text
        own = [rng.choice(vocab) for _ in range(rng.randint(4, 60))]
        out.append(" ".join(passage + own))
    for _ in range(80):
        w = [rng.choice(vocab) for _ in range(rng.randint(1, 120))]
        out.append(" ".join(w))
        for _ in range(rng.randint(0, 3)):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            out.append(" ".join(v[: rng.randint(max(1, len(v) - 12), len(v))]))
    out += out[20:40]
    rng.shuffle(out)
    return {3 * k + 1: t for k, t in enumerate(out)}


@pytest.mark.parametrize("hot, group", [(64, 4096), (4, 40), (10**9, 30)])
def test_components_equal_brute_force(spark, texts, monkeypatch, hot, group):
    monkeypatch.setattr(J, "HOT", hot)
    monkeypatch.setattr(J, "GROUP", group)
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, key string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.groups(docs).collect()}
    assert got == brute(texts)


def test_one_of_each_group_stays(spark, texts):
    rows = [(i, t, "x") for i, t in texts.items()] + [(1, texts[1], "again")]
    docs = spark.createDataFrame([(*r, 4) for r in rows], "doc_id long, text string, key string, __class int").repartition(3)
    kept = [r.doc_id for r in J.keep_one(docs).collect()]
    want = {i for i, (n, c) in brute(texts).items() if i == c}
    assert set(kept) == want and J.keep_one(docs).columns == docs.columns
    odd = spark.createDataFrame([(None, "one two three four five six"), (None, "one two three four five six"), (None, None), (7, "w " * 300_000), (7, "w " * 300_000 + "v")], "doc_id long, text string")
    assert sorted(J.keep_one(odd).select("doc_id", F.length("text").alias("n")).collect(), key=repr) == [(7, 600_000), (7, 600_001), (None, 27), (None, None)]
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in J.groups(odd).collect()} == {(None, 2, None), (None, 0, None), (7, 1, 7), (7, 2, 7)}
    assert J.groups(docs.limit(0)).collect() == [] and J.keep_one(docs.limit(0)).collect() == []
