"""Boolean trigram queries of regular expressions (after Cox, "Regular Expression Matching with a Trigram Index", 2012).

A query is ``True`` (every text may match), a trigram, or ``("and" | "or", parts)``. Whatever text the expression matches, the lower-cased
text satisfies the query; the reverse need not hold.
"""

from __future__ import annotations

from itertools import product
from re import _constants as op, _parser

MOST = 64  # strings that one part of an expression may stand for, before they are given up for their trigrams

Query = bool | str | tuple


def both(kind: str, parts) -> Query:
    """``and`` or ``or`` of queries, flattened, without repeats."""
    flat: list[Query] = []
    for p in parts:
        flat.extend(p[1] if isinstance(p, tuple) and p[0] == kind else [p])
    flat = list(dict.fromkeys(flat))
    if kind == "or" and True in flat:
        return True
    flat = [p for p in flat if p is not True]
    if kind == "or":  # what asks for more than another alternative adds nothing
        asks = {p: {p} if isinstance(p, str) else set(p[1]) if p[0] == "and" else None for p in flat}
        flat = [p for p in flat if asks[p] is None or not any(o is not None and o < asks[p] for o in asks.values())]
    return True if not flat else flat[0] if len(flat) == 1 else (kind, tuple(flat))


def of_strings(strings: set[str]) -> Query:
    """One of the strings occurs."""
    return both("or", [both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def derive(pattern: str) -> Query:
    strings, query = _of(_parser.parse(pattern))
    return both("and", [query, of_strings(strings)]) if strings is not None else query


def _of(nodes) -> tuple[set[str] | None, Query]:
    """The strings a sequence can be, if few, and the query of what has been given up."""
    run: set[str] | None = {""}
    query: Query = True
    exact = True
    for kind, value in nodes:
        strings, more = _one(kind, value)
        query = both("and", [query, more])
        if strings is None or (run is not None and len(run) * len(strings) > MOST):
            query = both("and", [query, of_strings(run)])
            run, exact = ({""} if strings is None else strings), False
        else:
            run = {a + b for a, b in product(run, strings)}
    if exact:
        return run, query
    return None, both("and", [query, of_strings(run)])


def _one(kind, value) -> tuple[set[str] | None, Query]:
    if kind is op.LITERAL:
        return {chr(value).lower()}, True
    if kind is op.IN and len(value) <= MOST and all(k is op.LITERAL for k, _ in value):
        return {chr(v).lower() for _, v in value}, True
    if kind is op.SUBPATTERN:
        return _of(value[-1])
    if kind is op.BRANCH:
        each = [_of(branch) for branch in value[1]]
        if all(s is not None for s, _ in each) and sum(len(s) for s, _ in each) <= MOST:
            return set().union(*[s for s, _ in each]), both("or", [q for _, q in each])
        return None, both("or", [q if s is None else both("and", [q, of_strings(s)]) for s, q in each])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        low, high, inner = value
        strings, query = _of(inner)
        if (low, high) == (0, 1) and strings is not None and len(strings) < MOST and query is True:
            return strings | {""}, True
        if low == high and low <= 4 and strings is not None and len(strings) ** low <= MOST:
            return {"".join(p) for p in product(strings, repeat=low)}, query
        return None, True if low == 0 else query if strings is None else both("and", [query, of_strings(strings)])
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return {""}, True
    return None, True


def trigrams_of(query: Query) -> set[str]:
    if isinstance(query, str):
        return {query}
    return set().union(*[trigrams_of(p) for p in query[1]]) if isinstance(query, tuple) else set()
