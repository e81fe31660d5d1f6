"""Boolean trigram queries that a regular expression's matches must satisfy.

A query is a list of clauses, all of which hold in a text with a match; a clause
is a set of alternatives, one of which holds; an alternative is a set of
trigrams that all occur. No clauses: nothing is known, and every text must be
scanned. Trigrams are of the text in lower case, which serves patterns with and
without regard to case.
"""

from __future__ import annotations

import re
from itertools import product

#: Beyond so many strings, what an expression can match isn't listed any more.
MOST = 256

Query = list[frozenset[frozenset[str]]]


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _clause(strings: set[str]) -> Query:
    """What holds where one of the strings occurs."""
    alternatives = {trigrams(s) for s in strings}
    if frozenset() in alternatives or not alternatives:
        return []
    return [frozenset(a for a in alternatives if not any(b < a for b in alternatives))]


def query(pattern: str) -> Query:
    """The trigram query of a pattern in the common part of Python's and Java's syntax."""
    strings, clauses = _sequence(list(re._parser.parse(pattern)))
    return clauses + (_clause(strings) if strings is not None else [])


def _sequence(nodes) -> tuple[set[str] | None, Query]:
    """All strings that the nodes can match, or None, and clauses that hold besides."""
    known: set[str] = {""}
    clauses: Query = []
    whole = True
    for node in nodes:
        strings, more = _node(node)
        clauses += more
        if strings is not None and len(known) * len(strings) <= MOST:
            known = {a + b for a, b in product(known, strings)}
            continue
        clauses += _clause(known)
        if strings is None:
            known = {""}
        else:
            known = strings
        whole = False
    return (known, clauses) if whole else (None, clauses + _clause(known))


def _node(node) -> tuple[set[str] | None, Query]:
    kind, value = str(node[0]), node[1]
    if kind == "LITERAL":
        return {chr(value).lower()}, []
    if kind == "IN" and all(str(k) in ("LITERAL", "RANGE") for k, _ in value):
        chars = set()
        for k, v in value:
            low, high = (v, v) if str(k) == "LITERAL" else v
            if high - low > MOST:
                return None, []
            chars |= {chr(c).lower() for c in range(low, high + 1)}
        return (chars, []) if len(chars) <= 8 else (None, [])
    if kind == "SUBPATTERN":
        return _sequence(list(value[-1]))
    if kind == "BRANCH":
        parts = [_sequence(list(b)) for b in value[1]]
        if all(s is not None and not c for s, c in parts):
            return set().union(*[s for s, _ in parts]), []
        return None, []
    if kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, inner = value
        strings, clauses = _sequence(list(inner))
        if strings is not None and int(high) <= 4 and sum(len(strings) ** n for n in range(int(low), int(high) + 1)) <= MOST:
            return {"".join(p) for n in range(int(low), int(high) + 1) for p in product(strings, repeat=n)}, []
        return None, (clauses + (_clause(strings) if strings is not None else [])) if low else []
    if kind in ("AT", "ASSERT", "ASSERT_NOT"):
        return {""}, []
    return None, []
