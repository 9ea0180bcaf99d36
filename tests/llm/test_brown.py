"""Operator 3: the base score exactly, the class model against its definition, sums that are one."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import brown_lm as B

SF = "/root/testdata/sf0.01"


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


@pytest.mark.parametrize("head, clustered", [(200_000, 1000), (300, 40), (0, 0)])
def test_against_plain_counts(spark, monkeypatch, head, clustered):
    monkeypatch.setattr(B, "HEAD", head)
    monkeypatch.setattr(B, "sizes", lambda kinds: (48, clustered))
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 150").select("doc_id", "text")
    extra = spark.createDataFrame([(None, None), (10**6, ""), (10**6 + 1, "never-seen-before zzz"), (5, "The the THE " * 9)], "doc_id long, text string")
    docs = docs.union(extra).repartition(4)
    rows = docs.collect()
    c = Counter(w for r in rows if not held(r.doc_id) for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    want = []
    for r in rows:
        t = tokens(r.text)
        want.append((r.doc_id, held(r.doc_id), len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)))
    got = B.score(docs).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(g)[:5] == w[:5]
        assert g.base_score == pytest.approx(w[5], rel=1e-9)
        assert math.isfinite(g.score) and g.score < 0
    if clustered:
        assert sum(g.score for g in got) > sum(g.base_score for g in got)


def test_model_sums_to_one(spark):
    docs = B._rows(spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 100"))
    _, m = B.fit(docs)
    assert np.allclose((10.0 ** m["step"]).sum(axis=1), 1)
    emit = 10.0 ** m["emission"]
    for k in range(m["other"]):
        assert np.isclose(emit[m["class"] == k].sum(), 1)
    rest = emit[m["class"] == m["other"]].sum() + 10.0 ** m["unseen"]
    assert np.isclose(rest, 1)


def test_exchange_finds_planted_classes():
    rng = np.random.default_rng(1)
    seq = []
    for _ in range(4000):
        seq += [rng.integers(0, 5), 5 + rng.integers(0, 5)]
    big = np.zeros((12, 12))
    np.add.at(big, (seq[:-1], seq[1:]), 1)
    of = B.exchange(big, 2, 10)[:10]
    assert len(set(of[:5])) == 1, of
    assert len(set(of[:5])) == 1 and len(set(of[5:])) == 1 and of[0] != of[5]


def test_no_single_move_raises_the_likelihood():
    rng = np.random.default_rng(2)
    big = rng.poisson(rng.gamma(0.3, 2, (14, 14))).astype(float)

    def likelihood(of):
        m = np.zeros((5, 5))
        np.add.at(m, (of[:, None].repeat(14, 1), of[None].repeat(14, 0)), big)
        f = lambda x: (x[x > 0] * np.log(x[x > 0])).sum()
        return f(m) - f(m.sum(0)) - f(m.sum(1))

    of = B.exchange(big, 3, 50)
    best = likelihood(of)
    for w in range(12):
        for k in range(3):
            other = of.copy()
            other[w] = k
            assert likelihood(other) <= best + 1e-6


def test_empty(spark):
    assert B.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_every_word_seen_twice_has_the_class_of_best_gain(spark, monkeypatch):
    monkeypatch.setattr(B, "sizes", lambda kinds: (4, 30))
    monkeypatch.setattr(B, "HEAD", 100)
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 40").select("doc_id", "text").repartition(3)
    texts = [tokens(r.text) for r in docs.collect() if not held(r.doc_id)]
    c = Counter(w for t in texts for w in t if w)
    rows = B._rows(docs)
    table, model = B.vocabulary(rows)
    found = {r.word: (r.c, r["class"]) for r in table.collect()}
    name = lambda w: int(B._tokens(next(B.W.chunks(pa.array([w]), lower=True)))[0][:1].view(np.int64)[0])
    names = {w: name(w) for w in c}
    core = {w: int(model["class"][np.flatnonzero(model["head"].view(np.int64) == names[w])[0]]) for w in c if names[w] not in found}
    assert len(core) == 30 and len(c) == len(core) + len(found) > 1000
    assert all(found[names[w]][0] == c[w] and (found[names[w]][1] < 4) == (c[w] >= 2) for w in c if w not in core)
    m, ctx = np.zeros((6, 6)), {}
    for t in texts:
        cls = [5 if w is None else core.get(w, 4) for w in t]
        for k, w in enumerate(t):
            m[cls[k - 1] if k else 5, cls[k]] += 1
            if w and w not in core:
                ctx.setdefault(w, []).append((cls[k - 1] if k else 5, cls[k + 1]))
    f = lambda x: (x[x > 0] * np.log(x[x > 0])).sum()
    for w in [w for w in ctx if c[w] >= 2][:300]:
        gain = []
        for k in range(4):
            x, row, col = m.copy(), m.sum(1), m.sum(0)
            for a, b in ctx[w]:
                x[a, k] += 1
                x[k, b] += 1
            row[k] += c[w]
            col[k] += c[w]
            gain.append(f(x) - f(row) - f(col))
        assert gain[found[names[w]][1]] >= max(gain) - 1e-6


@pytest.mark.parametrize("head", [200_000, 60])
def test_score_against_a_plain_class_model(spark, monkeypatch, head):
    """From the classes of the words alone: transitions, emissions and the product over each text, in plain Python."""
    monkeypatch.setattr(B, "HEAD", head)
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(7, None), (10**6, "unseen zzz-1 the"), (None, "x")], "doc_id long, text string")).repartition(3)
    rows = docs.collect()
    texts = [tokens(r.text) for r in rows if not held(r.doc_id)]
    c = Counter(w for t in texts for w in t)
    table, model = B.vocabulary(B._rows(docs))
    name = lambda w: int(B._tokens(next(B.W.chunks(pa.array([w]), lower=True)))[0][:1].view(np.int64)[0])
    found = {r.word: r["class"] for r in table.collect()} | dict(zip(model["head"].view(np.int64).tolist(), model["class"].tolist(), strict=True))
    other = model["other"]
    assert other == B.sizes(sum(c[w] >= 2 for w in c if w))[0]
    of = {w: found[name(w)] for w in c if w} | {None: other + 1}
    assert all((of[w] == other) == (c[w] < 2) for w in c if w)
    size, kinds = Counter(), sum(k == other for k in of.values())
    for w in c:
        size[of[w]] += c[w]
    step, out = Counter(), Counter()
    for t in texts:
        for a, b in zip([None, *t], t):
            step[of[a], of[b]] += 1
            out[of[a]] += 1
    total = sum(size.values()) + other + 2

    def bits(t):
        p, before = 0.0, other + 1
        for w in t:
            k = of.get(w, other)
            p += math.log10((step[before, k] + B.ALPHA * (size[k] + 1) / total) / (out[before] + B.ALPHA))
            if k < other:
                p += math.log10(c[w] / size[k])
            elif k == other:
                p += math.log10((c[w] + 1) / (size[k] + kinds + 1))
            before = k
        return p

    got = sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 6)) for r in B.score(docs).collect())
    want = sorted((r.doc_id is None, r.doc_id or 0, round(bits(tokens(r.text)), 6)) for r in rows)
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], rel=1e-7, abs=2e-6)


def test_sizes_grow_with_the_words():
    assert [B.sizes(n)[0] for n in (0, 1, 10**4, 10**6, 10**8)] == [1, 2, 24, 76, 240]
    assert B.sizes(10**6)[1] == 76 * B.PER_CLASS
