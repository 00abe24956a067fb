"""Which trigrams a text must hold if a regular expression matches in it, and an index that answers.

`trigram_query` reads a pattern's parse tree and gives a Boolean query over trigrams of lower-cased
UTF-8 bytes (A-Z only): ANY, a trigram, or ("and" | "or", parts). A text in which the pattern matches
satisfies the query; the reverse does not hold, so hits are candidates. `Segment` is an inverted index
of some texts: the sorted (trigram, text) pairs, in which a trigram's postings lie side by side.

The derivation keeps, for each part of the pattern, the set of strings it can match as long as that
set is small, else the sets of possible beginnings and ends and what is known of the middle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import product
from re import _constants as op
from re import _parser
from typing import NamedTuple

import numpy as np

ANY = "any"
Query = str | int | tuple
SET, CLASS = 40, 8  # strings kept exactly, characters of a class written out


class Part(NamedTuple):
    """Strings of a sub-pattern: `exact` ones or None; `first` and `last` bytes; the query of what else is known."""

    exact: frozenset[bytes] | None
    first: frozenset[bytes]
    last: frozenset[bytes]
    query: Query


NOTHING = frozenset([b""])
UNKNOWN = Part(None, NOTHING, NOTHING, ANY)


def joined(kind: str, parts: Iterable[Query]) -> Query:
    """The parts under `and` or `or`, without what says nothing."""
    flat: list[Query] = []
    for part in parts:
        flat += part[1] if isinstance(part, tuple) and part[0] == kind else [part]
    if ANY in flat and kind == "or":
        return ANY
    flat = sorted({p for p in flat if p != ANY}, key=repr)
    if kind == "or" and not any(isinstance(x, tuple) for p in flat if isinstance(p, tuple) for x in p[1]):
        # What asks for more than another alternative does adds nothing.
        asked = [{p} if isinstance(p, int) else set(p[1]) for p in flat]
        flat = [p for p, own in zip(flat, asked, strict=True) if not any(other < own for other in asked)]
    return ANY if not flat else flat[0] if len(flat) == 1 else (kind, tuple(flat))


def _of_string(text: bytes) -> Query:
    return joined("and", [int.from_bytes(text[k : k + 3], "big") for k in range(len(text) - 2)])


def _of_set(strings: frozenset[bytes]) -> Query:
    return joined("or", map(_of_string, strings))


def _cross(a: frozenset[bytes], b: frozenset[bytes]) -> frozenset[bytes]:
    return frozenset(x + y for x, y in product(a, b))


def _exact(strings: frozenset[bytes]) -> Part:
    part = Part(strings, strings, strings, ANY)
    return part if len(strings) <= SET else _loose(part)


def _loose(part: Part) -> Part:
    """Without exact strings: their trigrams go into the query, two bytes stay at either end."""
    query = joined("and", [part.query, _of_set(part.first), _of_set(part.last)])
    ends = [frozenset(x[:2] for x in part.first), frozenset(x[-2:] for x in part.last)]
    first, last = (e if len(e) <= SET else NOTHING for e in ends)
    return Part(None, first, last, query)


def _then(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= SET:
        return _exact(_cross(a.exact, b.exact))
    middle = _of_set(_cross(a.last, b.first)) if len(a.last) * len(b.first) <= SET * SET else ANY
    first = _cross(a.exact, b.first) if a.exact is not None and len(a.exact) * len(b.first) <= SET else a.first
    last = _cross(a.last, b.exact) if b.exact is not None and len(a.last) * len(b.exact) <= SET else b.last
    return _loose(Part(None, first, last, joined("and", [a.query, b.query, middle])))


def _either(parts: list[Part]) -> Part:
    if all(p.exact is not None for p in parts):
        return _exact(frozenset().union(*[p.exact for p in parts]))
    parts = [_loose(p) for p in parts]
    first, last = (frozenset().union(*[getattr(p, end) for p in parts]) for end in ("first", "last"))
    return _loose(Part(None, first, last, joined("or", [p.query for p in parts])))


def _repeated(part: Part, least: int, most: int) -> Part:
    if least == 0:
        return _either([_exact(NOTHING), part]) if most == 1 else UNKNOWN
    out = part
    for _ in range(min(least, 4) - 1):
        out = _then(out, part)
    return out if least == most <= 4 else _then(out, UNKNOWN)


def _part(tree) -> Part:
    out = _exact(NOTHING)
    for kind, value in tree:
        if kind is op.LITERAL:
            step = _exact(frozenset([chr(value).encode("utf-8", "surrogatepass").lower()]))
        elif kind is op.IN and all(k is op.LITERAL for k, _ in value) and len(value) <= CLASS:
            step = _exact(frozenset(chr(v).encode("utf-8", "surrogatepass").lower() for _, v in value))
        elif kind is op.BRANCH:
            step = _either([_part(branch) for branch in value[1]])
        elif kind is op.SUBPATTERN:
            step = _part(value[3])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            step = _repeated(_part(value[2]), value[0], value[1])
        elif kind is op.ATOMIC_GROUP:
            step = _part(value)
        elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            step = _exact(NOTHING)
        else:  # any character, classes with ranges, back references: some string
            step = UNKNOWN
        out = _then(out, step)
    return out


def trigram_query(pattern: str, flags: int = 0) -> Query:
    """The query of a pattern. Cases are ignored by ASCII rules only, so that bytes can be compared."""
    tree = _parser.parse(pattern, flags)
    if tree.state.flags & re.IGNORECASE and not tree.state.flags & re.ASCII:
        raise ValueError("a pattern that ignores case needs re.ASCII")
    return _loose(_part(tree)).query


class Segment:
    """Inverted index of at most 256 texts."""

    MOST = 256

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(texts).lower(), np.uint8).astype(np.uint32)
        self.texts = len(texts)
        if len(data) < 3:
            self.pairs = np.zeros(0, np.uint32)
            return
        owner = np.repeat(np.arange(len(texts), dtype=np.uint32), sizes)
        pairs = ((data[:-2] << 16 | data[1:-1] << 8 | data[2:]) << 8) | owner[:-2]
        pairs = pairs[owner[:-2] == owner[2:]]  # none across two texts
        pairs.sort()
        self.pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])[: len(pairs)]]

    def postings(self, trigram: int) -> np.ndarray:
        low, high = np.searchsorted(self.pairs, np.array([trigram << 8, (trigram << 8) + 255], np.uint32), "left")
        high += int(high < len(self.pairs) and self.pairs[high] == (trigram << 8) + 255)
        return (self.pairs[low:high] & np.uint32(255)).astype(np.int64)

    def matching(self, query: Query) -> np.ndarray:
        """Texts that satisfy the query, in order."""
        if query == ANY:
            return np.arange(self.texts)
        if isinstance(query, int):
            return self.postings(query)
        kind, parts = query
        found = self.matching(parts[0])
        for part in parts[1:]:
            if kind == "or":
                found = np.union1d(found, self.matching(part))
            elif len(found):
                found = np.intersect1d(found, self.matching(part), assume_unique=True)
        return found
