"""Positions of regular-expression matches as DataFrame expressions.

Spark gives the strings of all matches (``regexp_extract_all``) and the text between them (``split``), and both
walk the text in the same leftmost non-overlapping order.  Their lengths, added up, are the matches' offsets
in code points, found in one pass without leaving the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"
def none() -> Column:
    """No spans."""
    return F.array().cast(SPAN)


def matches(text: Column, pattern: str, judge: Callable[[Column, Column, Column], Column]) -> Column:
    """Spans of ``pattern`` in ``text``, in order.

    ``judge(match, before, after)`` gives a struct ``keep, kind, score``; ``before`` and ``after`` are the 40 code
    points next to the match, as far as no other match of the pattern cuts them off.  ``pattern`` must not
    match the empty string."""
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def walk(pieces: Column, hits: Column) -> Column:
        n = F.size(hits)
        pairs = F.zip_with(F.slice(pieces, 1, n), hits, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
        steps = F.zip_with(pairs, F.slice(pieces, 2, n), lambda x, q: F.struct(x.p.alias("p"), x.m.alias("m"), q.alias("q")))
        # what is kept is carried as text: a fold copies its state at each step, and bytes copy fastest
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            begin = acc.at + F.length(x.p)
            end = begin + F.length(x.m)
            said = judge(x.m, F.right(x.p, F.lit(40)), F.left(x.q, F.lit(40)))
            span = F.concat(F.lit(";"), F.concat_ws(":", said.kind, begin.cast("string"), end.cast("string"), said.score.cast("string")))
            return F.struct(end.alias("at"), F.when(said.keep, F.concat(acc.out, span)).otherwise(acc.out).alias("out"))

        return F.aggregate(steps, start, step, lambda acc: _parse(acc.out))

    # bound once by the outer lambda: an array expression named twice would be evaluated twice
    return F.transform(F.array(found), lambda m: F.when(F.size(m) == 0, none()).otherwise(F.transform(F.array(between), lambda p: walk(p, m))[0]))[0]


def _parse(kept: Column) -> Column:
    def one(x: Column) -> Column:
        part = F.split(x, ":")
        return F.struct(part[0].alias("kind"), part[1].cast("int").alias("start"), part[2].cast("int").alias("end"), part[3].cast("double").alias("score"))

    return F.transform(F.filter(F.split(kept, ";"), lambda x: x != ""), one)


def render(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def mentions(context: Column, words: list[str]) -> Column:
    """Whether any of the lower-case words is in the context."""
    return context.rlike("(?i)(?:" + "|".join(words) + ")")


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s.kind.isin(*kinds))
