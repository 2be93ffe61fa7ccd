"""Boolean trigram queries from regular expressions.

The parsed expression is walked from its leaves. Of each part it is known which strings it matches exactly, while they
are few; else which strings its matches begin and end with, and a query that every match satisfies. Literals and small
classes are exact, concatenation multiplies, alternation unites, repeats of at least one keep their beginning. Where a
part stops being exact its strings become a query, and what meets at a seam is asked for too. Letters are taken in
lower case, as the index holds lower-cased texts.

A query is a disjunction of conjunctions of trigrams. It may ask for less than a match needs, never for more.
"""

from __future__ import annotations

from functools import reduce
from itertools import product
from re import _constants as codes
from re import _parser
from typing import NamedTuple

#: Strings and characters of a class that are held exactly, alternatives of a query, and trigrams kept of each.
EXACT, CLASS, ALTERNATIVES, KEPT = 64, 8, 64, 3

Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])


class Part(NamedTuple):
    exact: frozenset[str] | None
    first: frozenset[str]
    last: frozenset[str]
    query: Query


def _least(alternatives: set[frozenset[str]]) -> Query:
    """Without alternatives that ask for more than another one; any document, if there are too many."""
    kept = frozenset(a for a in alternatives if not any(b < a for b in alternatives))
    return kept if len(kept) <= ALTERNATIVES else ANY


def _of_strings(strings: frozenset[str]) -> Query:
    return _least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _and(a: Query, b: Query) -> Query:
    return _least({x | y for x, y in product(a, b)})


def _open(strings: frozenset[str]) -> Part:
    """A part of exact strings, told by their ends and a query."""
    return Part(None, frozenset(s[:2] for s in strings), frozenset(s[-2:] for s in strings), _of_strings(strings))


NOTHING = Part(frozenset([""]), frozenset([""]), frozenset([""]), ANY)
UNKNOWN = Part(None, frozenset([""]), frozenset([""]), ANY)


def _exactly(strings: set[str]) -> Part:
    found = frozenset(s.lower() for s in strings)
    return Part(found, found, found, ANY) if len(found) <= EXACT else _open(found)


def _then(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= EXACT:
        return _exactly({x + y for x, y in product(a.exact, b.exact)})
    a, b = (_open(x.exact) if x.exact is not None else x for x in (a, b))
    # Ends of less than two characters may go on unknown, so only whole seams are asked for.
    seam = _of_strings(frozenset(x + y for x, y in product(a.last, b.first)))
    return Part(None, a.first, b.last, _and(_and(a.query, b.query), seam))


def _either(parts: list[Part]) -> Part:
    if all(p.exact is not None for p in parts):
        return _exactly({s for p in parts for s in p.exact})
    parts = [_open(p.exact) if p.exact is not None else p for p in parts]
    union = lambda field: frozenset().union(*(getattr(p, field) for p in parts))
    return Part(None, union("first"), union("last"), _least(set(union("query"))))


def _class(items: list) -> Part:
    found: set[str] = set()
    for op, value in items:
        if op is codes.LITERAL:
            found.add(chr(value))
        elif op is codes.RANGE and value[1] - value[0] < 2 * CLASS:
            found.update(map(chr, range(value[0], value[1] + 1)))
        else:
            return UNKNOWN
    return _exactly(found) if len({c.lower() for c in found}) <= CLASS else UNKNOWN


def _walk(tree) -> Part:
    parts = [NOTHING]
    for op, value in tree:
        if op is codes.LITERAL:
            part = _exactly({chr(value)})
        elif op is codes.IN:
            part = _class(value)
        elif op is codes.BRANCH:
            part = _either([_walk(t) for t in value[1]])
        elif op is codes.SUBPATTERN:
            part = _walk(value[3])
        elif op in (codes.MAX_REPEAT, codes.MIN_REPEAT, codes.POSSESSIVE_REPEAT):
            least, most, inner = value
            one = _walk(inner)
            part = NOTHING
            for _ in range(min(least, 3)):
                part = _then(part, one)
            if least == 0 and most == 1:
                part = _either([NOTHING, one])
            elif least > 3 or most != least:
                part = _then(part, UNKNOWN)
        elif op in (codes.AT, codes.ASSERT, codes.ASSERT_NOT):
            part = NOTHING
        else:
            part = UNKNOWN
        # Neighbours that are exact become one string first, so that no seam inside a literal is lost.
        whole = parts[-1].exact is not None and part.exact is not None and len(parts[-1].exact) * len(part.exact) <= EXACT
        parts[-1:] = [_then(parts[-1], part)] if whole else [parts[-1], part]
    return reduce(_then, parts)


def _spread(conjunction: frozenset[str]) -> list[str]:
    """Some trigrams of a conjunction; asking for fewer finds more."""
    every = sorted(conjunction)
    step = max(1, -(-len(every) // KEPT))
    return every[::step]


def query(pattern: str) -> list[list[str]]:
    """The trigram query of an expression: alternatives of trigrams that must all occur; empty if it needs none."""
    part = _walk(_parser.parse(pattern))
    found = _of_strings(part.exact) if part.exact is not None else part.query
    return [] if frozenset() in found else [list(a) for a in sorted({tuple(_spread(a)) for a in found})]
