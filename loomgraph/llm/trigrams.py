"""Boolean trigram queries derived from regular expressions.

A query is ``True`` (nothing is mandatory), a trigram, or ``("and" | "or", [queries])``.  It holds for every text in
which the expression can match, with text and literals folded to lower case.  Literals, alternatives,
optional parts and small classes are multiplied out to sets of exact strings while those stay small; the set
is turned into trigrams when something else interrupts it.
"""

from __future__ import annotations

import re._constants as K
import re._parser as parser

MOST_STRINGS = 64
MOST_OF_CLASS = 4

Query = bool | str | tuple


def both(a: Query, b: Query) -> Query:
    if a is True or a == b:
        return b
    return a if b is True else ("and", [a, b])


def either(parts: list[Query]) -> Query:
    if not parts or any(p is True for p in parts):
        return True
    found: list[Query] = []
    for p in parts:
        if p not in found:
            found.append(p)
    return found[0] if len(found) == 1 else ("or", found)


def of_strings(strings: set[str]) -> Query:
    """Any of the strings occurs."""
    parts: list[Query] = []
    for s in sorted(strings):
        q: Query = True
        for k in range(len(s) - 2):
            q = both(q, s[k : k + 3])
        parts.append(q)
    return either(parts)


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is K.LITERAL:
            out.add(chr(arg).lower())
        elif op is K.RANGE:
            if arg[1] - arg[0] >= MOST_OF_CLASS:
                return None
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_OF_CLASS else None


def _node(op, arg) -> tuple[set[str] | None, Query]:
    """Exact strings (or None) and the query of one node."""
    if op is K.LITERAL:
        return {chr(arg).lower()}, True
    if op is K.IN:
        return _class(arg), True
    if op is K.SUBPATTERN:
        return _sequence(arg[-1])
    if op is K.ATOMIC_GROUP:
        return _sequence(arg)
    if op is K.BRANCH:
        parts = [_sequence(p) for p in arg[1]]
        if all(e is not None for e, _ in parts):
            union = set().union(*(e for e, _ in parts))
            if len(union) <= MOST_STRINGS:
                return union, True
        return None, either([of_strings(e) if e is not None else q for e, q in parts])
    if op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
        least, most, inner = arg
        exact, query = _sequence(inner)
        if least == 0:
            return (exact | {""} if exact is not None and most == 1 else None), True
        if least == most and exact is not None and len(exact) == 1:
            return {next(iter(exact)) * least}, True
        return None, of_strings(exact) if exact is not None else query
    if op in (K.AT, K.ASSERT, K.ASSERT_NOT):
        return {""}, True
    return None, True


def _sequence(nodes) -> tuple[set[str] | None, Query]:
    exact, query, whole = {""}, True, True
    for op, arg in nodes:
        strings, q = _node(op, arg)
        if strings is not None and len(exact) * len(strings) <= MOST_STRINGS:
            exact = {a + b for a in exact for b in strings}
            continue
        query, whole = both(query, of_strings(exact)), False
        query = both(query, q)
        exact = strings if strings is not None else {""}
    if whole:
        return exact, True
    return None, both(query, of_strings(exact))


def query_of(pattern: str) -> Query:
    """The trigram query of a regular expression (in the syntax that Python and Java share)."""
    exact, query = _sequence(parser.parse(pattern))
    return of_strings(exact) if exact is not None else query


def grams_of(query: Query) -> list[str]:
    if query is True:
        return []
    if isinstance(query, str):
        return [query]
    return sorted({g for part in query[1] for g in grams_of(part)})


def holds(query: Query, text: str) -> bool:
    """Whether the query holds for one text; for tests and for reading."""
    if query is True:
        return True
    if isinstance(query, str):
        return query in text.lower()
    return (all if query[0] == "and" else any)(holds(p, text) for p in query[1])
