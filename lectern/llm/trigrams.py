"""Boolean trigram queries that every text with a match of a regular expression satisfies.

A query is True (any text), a trigram (three bytes of UTF-8, A to Z in lower case, as one number), or ("and" | "or", frozenset of
queries). It is derived bottom up over the expression that Python's own parser gives: of each part either all strings it
matches are known (while they are few), or sets of possible beginnings and ends, and a query for what lies between. Strings
that meet when parts are joined give trigrams. What a part's case-blind letters may be outside ASCII isn't known, so such letters
count as any.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

#: More strings than these are forgotten but for their ends.
MOST_STRINGS = 32
#: Letters that a case-blind pattern also finds outside ASCII.
_FOLDED_OUTSIDE = frozenset("iks")
Query = bool | int | tuple


def _both(kind: str, queries) -> Query:
    """The conjunction or disjunction, without what it needn't say."""
    neutral = kind == "and"
    parts: set[Query] = set()
    for q in queries:
        if isinstance(q, bool):
            if q != neutral:
                return q
        elif isinstance(q, tuple) and q[0] == kind:
            parts |= q[1]
        else:
            parts.add(q)
    if not parts:
        return neutral
    return next(iter(parts)) if len(parts) == 1 else (kind, frozenset(parts))


def trigrams_of(data: bytes) -> set[int]:
    return {int.from_bytes(data[i : i + 3]) for i in range(len(data) - 2)}


def _of_strings(strings: frozenset[bytes]) -> Query:
    """One of the strings is in the text."""
    return _both("or", (_both("and", trigrams_of(s)) for s in strings))


@dataclass(frozen=True)
class _Part:
    """What is known of the strings that a part matches: `whole` is all of them, or None; then `first` and `last` are possible
    beginnings and ends, and `query` holds for each."""

    whole: frozenset[bytes] | None
    first: frozenset[bytes]
    last: frozenset[bytes]
    query: Query = True

    def opened(self) -> _Part:
        if self.whole is None:
            return self
        return _Part(None, _ends(self.whole, lambda s, n: s[:n]), _ends(self.whole, lambda s, n: s[-n:] if n else b""), _of_strings(self.whole))


def _ends(strings: frozenset[bytes], cut) -> frozenset[bytes]:
    """As long ends of the strings as are few enough."""
    for n in (8, 2, 1, 0):
        few = frozenset(cut(s, n) for s in strings)
        if len(few) <= MOST_STRINGS:
            return few
    raise AssertionError


def _exact(strings) -> _Part:
    whole = frozenset(strings)
    return _Part(whole, whole, whole)


_EMPTY, _ANY = _exact([b""]), _Part(None, frozenset([b""]), frozenset([b""]))


def _then(a: _Part, b: _Part) -> _Part:
    if a.whole is not None and b.whole is not None and len(a.whole) * len(b.whole) <= MOST_STRINGS:
        return _exact(x + y for x in a.whole for y in b.whole)
    x, y = a.opened(), b.opened()
    meet = frozenset(s + t for s in x.last for t in y.first)
    first = frozenset(s + t for s in a.whole for t in y.first) if a.whole is not None else x.first
    last = frozenset(s + t for s in x.last for t in b.whole) if b.whole is not None else y.last
    return _Part(None, _ends(first, lambda s, n: s[:n]), _ends(last, lambda s, n: s[-n:] if n else b""), _both("and", (x.query, y.query, _of_strings(meet))))


def _either(parts: list[_Part]) -> _Part:
    if all(p.whole is not None for p in parts):
        whole = frozenset().union(*(p.whole for p in parts))
        if len(whole) <= MOST_STRINGS:
            return _exact(whole)
    opened = [p.opened() for p in parts]
    first, last = (frozenset().union(*(getattr(p, side) for p in opened)) for side in ("first", "last"))
    return _Part(None, _ends(first, lambda s, n: s[:n]), _ends(last, lambda s, n: s[-n:] if n else b""), _both("or", (p.query for p in opened)))


def _letters(codes: set[int], flags: int) -> _Part:
    """One of the letters."""
    strings = set()
    for c in codes:
        letter = chr(c)
        if flags & re.IGNORECASE and (not letter.isascii() or (not flags & re.ASCII and letter.lower() in _FOLDED_OUTSIDE)):
            return _ANY
        strings.add((letter.lower() if letter.isascii() else letter).encode("utf-8", "surrogatepass"))
    return _exact(strings) if len(strings) <= MOST_STRINGS else _ANY


def _class(items, flags: int) -> _Part:
    codes: set[int] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            codes.add(value)
        elif kind is op.RANGE and value[1] - value[0] <= 2 * MOST_STRINGS:
            codes |= set(range(value[0], value[1] + 1))
        else:  # a negation, a category, a wide range
            return _ANY
    return _letters(codes, flags)


def _repeat(least: int, most: int, part: _Part) -> _Part:
    if least == 0:
        return _either([_EMPTY, part]) if most == 1 else _ANY
    some = functools.reduce(_then, [part] * min(least, 4))
    if least == most and least <= 4:
        return some
    some = some.opened()
    return _Part(None, some.first, some.last, some.query)


def _sequence(items, flags: int) -> _Part:
    out = _EMPTY
    for kind, value in items:
        if kind is op.LITERAL:
            part = _letters({value}, flags)
        elif kind is op.IN:
            part = _class(value, flags)
        elif kind is op.BRANCH:
            part = _either([_sequence(x, flags) for x in value[1]])
        elif kind is op.SUBPATTERN:
            _, add, remove, inner = value
            part = _sequence(inner, (flags | add) & ~remove)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            part = _repeat(int(value[0]), int(value[1]), _sequence(value[2], flags))
        elif kind is op.ATOMIC_GROUP:
            part = _sequence(value, flags)
        elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):  # no letters of the match
            part = _EMPTY
        else:
            part = _ANY
        out = _then(out, part)
    return out


def query_of(pattern: str) -> Query:
    """The query of a pattern; True where it has no mandatory trigram."""
    tree = parser.parse(pattern)
    return _sequence(tree, tree.state.flags).opened().query


def asked(query: Query) -> set[int]:
    """The trigrams in a query."""
    if isinstance(query, bool):
        return set()
    return {query} if isinstance(query, int) else set().union(*(asked(q) for q in query[1]))


def holds(query: Query, trigrams: set[int]) -> bool:
    if isinstance(query, bool):
        return query
    if isinstance(query, int):
        return query in trigrams
    return (all if query[0] == "and" else any)(holds(q, trigrams) for q in query[1])
