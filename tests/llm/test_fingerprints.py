"""Operator 7: spans and extensions against strings, and the query against a plain walk."""

import hashlib
import random

import pytest

from loomgraph.llm import fingerprints as P


def test_spans_and_extensions():
    rng = random.Random(1)
    a, b = ("".join(rng.choice("abé😀") for _ in range(300)) for _ in range(2))
    b = b[:100] + a[40:140] + b[100:]
    x, y = P.Prefixes.of(a), P.Prefixes.of(b)
    for _ in range(2000):
        i, j, n = rng.randrange(300), rng.randrange(400), rng.randrange(1, 30)
        assert x.equal(i, y, j, n) == (i + n <= len(a) and j + n <= len(b) and a[i : i + n] == b[j : j + n])
        k = 0
        while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
            k += 1
        assert x.extension(i, y, j) == k


@pytest.mark.parametrize("count", [0, 1, 2, 500])
def test_query(spark, count):
    rng = random.Random(count)
    texts = ["", None, "x", "a" * 100_000, "same text here", "same text here"] + ["".join(rng.choice("abcdefgh é😀") for _ in range(rng.randint(0, 900))) for _ in range(count)]
    rows = [(rng.randrange(10**6) if k != 3 else None, t, "y") for k, t in enumerate(texts[:count])] + ([(77, "twice", "z"), (77, "again", "z")] if count > 100 else [])
    df = spark.createDataFrame(rows, "doc_id long, text string, range string").repartition(4)
    got = sorted(map(tuple, P.compare(df).collect()), key=repr)
    order = sorted(((d is None, d or 0, t or "") for d, t, _ in rows))
    want = []
    for k, (none, d, t) in enumerate(order):
        after = order[(k + 1) % len(order)][2]
        h = len(t) // 2
        edited = t[: len(t) - h] + after[:h]
        s = [P.Prefixes.of(x).sketch() for x in (t, edited, after)]
        want.append((None if none else d, len(t), hashlib.sha256(edited.encode()).hexdigest(), P.fingerprint(s[0]), P.fingerprint(s[1]), P.likeness(s[0], s[1]), P.likeness(s[0], s[2])))
    assert got == sorted(want, key=repr)


def test_likeness_follows_the_share_of_windows():
    rng = random.Random(2)
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(4000)) for _ in range(2))
    s = lambda t: P.Prefixes.of(t).sketch()
    assert P.likeness(s(a), s(a)) == 1 and P.likeness(s(a), s(b)) == 0
    assert 0.15 < P.likeness(s(a), s(a[:2000] + b[:2000])) < 0.55
    assert P.likeness(s(a), s(a + "!")) > 0.9


def test_exact_comparison_sees_what_the_sketch_misses(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefgh é😀") for _ in range(n))
    long, short = word(60_000), word(3000)
    texts = [long, short + long[30_000:30_040], "", None, "x", "xy", short, short[:900] + word(40), short[:900] + word(50)] + [word(rng.randint(0, 90)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in P.extensions(df).collect()}

    def against(a, b):
        k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        x, y = ({t[i : i + 24] for i in range(max(len(t) - 23, 1))} - {""} for t in (a, b))
        return k, (len(x & y) / len(x | y) if x | y else 1.0)

    for k, t in enumerate(texts):
        t, after = t or "", texts[(k + 1) % len(texts)] or ""
        h = len(t) // 2
        (a, b), (c, d) = against(t, t[: len(t) - h] + after[:h]), against(t, after)
        assert got[k] == (len(t), a, c, pytest.approx(b), pytest.approx(d)), k
    assert got[0][4] > 0 == {r.doc_id: r.near_next for r in P.compare(df).collect()}[0]
