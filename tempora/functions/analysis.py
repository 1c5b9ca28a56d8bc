"""The analyzer for short statuses: entities stay whole, the rest is split, stopped and stemmed."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .porter import stem
from .text import MENTION, URL

# The default stop words, the delimiters that never belong to an entity, those that begin or join one.
ENGLISH = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
DELIMITERS = frozenset('[]!"$%()*+,/:;<=>?\\^`{|}~-…¬·“')
SIGNS = "@＠#＃_"
_ENTITY = re.compile(rf"(?P<url>{URL})|(?:{MENTION})|(?:[#＃]\w*[^\W\d_]\w*)")
_SCHEME = re.compile("https?://")
_MARKS = frozenset(c for c in DELIMITERS | {"."} if c.isascii())
_FIRST = frozenset("@＠#＃")
_MAY_DELIMIT, _SIGN = (re.compile("[" + re.escape("".join(sorted(x))) + "]") for x in (DELIMITERS | {".", "&"}, SIGNS))


def entity(term: str) -> str | None:
    if "/" not in term and term[:1] not in _FIRST:  # a link has a slash, others begin with their sign
        return None
    m = _ENTITY.fullmatch(term)
    return None if not m else "url" if m["url"] else "tag"


def _delimits(t: str, i: int) -> bool:
    c = t[i]
    if c == ".":  # not within abbreviations, where every second character is a full stop
        return (i > 1 and t[i - 2] != ".") or (i + 2 < len(t) and t[i + 2] != ".")
    if c == "&":  # not between capitals
        return not (0 < i < len(t) - 1) or t[i - 1].islower() or t[i + 1].islower()
    return c in DELIMITERS


def split(raw: str, preserve_caps: bool = False) -> tuple[tuple[str, bool], ...]:
    """The terms of a word between white space, each with whether it is an entity; a pure function of the word."""
    plain = raw[:-1] if raw[-1:] in _MARKS else raw
    if plain.isalpha() or (plain.isascii() and plain.isalnum()):  # most words: no entity, nothing to split but a last mark
        term = plain if preserve_caps else plain.lower()
        if term.isalpha() or term.isascii():
            return ((term, False),)
    out, rest = [], [raw]
    while rest:
        term = rest.pop()
        if len(term) > 1 and term.endswith("…"):
            term = term[:-1]
        if kind := entity(term):
            out.append((term if kind == "url" else term.lower(), True))
            continue
        link = _SCHEME.search(term, 1)
        if link:
            rest.append(term[link.start() :])
            term = term[: link.start()]
        at = next((m.start() for m in _MAY_DELIMIT.finditer(term) if _delimits(term, m.start())), None)
        if at is not None:
            rest.append(term[at + 1 :])
            term = term[:at]
            if kind := entity(term):
                out.append((term.lower(), True))
                continue
        if sign := _SIGN.search(term):
            at = sign.start()
            rest.append(term[at + 1 :])
            term = term[:at]
        term = "".join(c for c in (term if preserve_caps else term.lower()) if c.isalpha() or c.isdecimal())
        if term:
            out.append((term, False))
    return tuple(out)


class _Known(dict):
    """The terms of each word between white space under one set of options; emptied when it is full."""

    MOST, LONGEST = 1 << 18, 64

    def __init__(self, stop: frozenset[str], stemming: bool, preserve_caps: bool, keep: frozenset[str]) -> None:
        self.stop, self.stemming, self.preserve_caps, self.keep = stop, stemming, preserve_caps, keep

    def __missing__(self, word: str) -> tuple[str, ...]:
        raw = word
        for mark in ("'", "’", "＇") if word[-1:] in ("s", "S") else ():
            raw = raw[:-2] if raw[-2:].lower() == mark + "s" else raw
        out = tuple(term if whole or not self.stemming or term in self.keep else stem(term) for term, whole in split(raw, self.preserve_caps) if term not in self.stop)
        if len(word) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[word] = out
        return out


_known = lru_cache(8)(_Known)


def tokens(text: str | None, stop: frozenset[str] = ENGLISH, stemming: bool = True, preserve_caps: bool = False, keep: frozenset[str] = frozenset()) -> list[str]:
    """keep: terms that aren't stemmed."""
    return list(chain.from_iterable(map(_known(stop, stemming, preserve_caps, keep).__getitem__, (text or "").split())))


def analyzer(stop: frozenset[str] = ENGLISH, stemming: bool = True, preserve_caps: bool = False):
    """An analyzer for an index: a function from a text column to one of term arrays. Arrow batches; words are cached."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: tokens(t, stop, stemming, preserve_caps))

    def of(text: Column) -> Column:
        return run(text)

    return of
