"""Keyword queries with operators: + - AND OR NOT, groups, phrases, wildcards, fuzzy terms, ranges, fields, boosts."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .index import word_tokens

_TOKEN = re.compile(r'\s*(?:(?P<op>AND\b|OR\b|NOT\b|&&|\|\||[+\-!()])|(?:(?P<field>\w+):)?(?:"(?P<phrase>[^"]*)"|(?P<open>[\[{])(?P<lo>\S+)\s+TO\s+(?P<hi>[^\]}\s]+)[\]}]|(?P<group>\()|(?P<term>[^\s()"^~]+))(?:~(?P<fuzz>[0-9.]*))?(?:\^(?P<boost>[0-9.]+))?)')


@dataclass
class Parsed:
    """must, never: terms; terms: all that aren't excluded, with weights; condition: the whole query as a predicate."""

    must: list[str] = field(default_factory=list)
    never: list[str] = field(default_factory=list)
    terms: list[tuple[str, float]] = field(default_factory=list)
    clauses: list[tuple[str, Callable[[], Column] | Parsed, str]] = field(default_factory=list)

    def condition(self) -> Column:
        each = [(k, c.condition() if isinstance(c, Parsed) else c()) for k, c, _ in self.clauses]
        must, may, never = ([c for k, c in each if k == x] for x in ("must", "may", "never"))
        out = F.lit(True)
        for c in must:
            out = out & c
        if not must and may:
            any_ = F.lit(False)
            for c in may:
                any_ = any_ | c
            out = out & any_
        for c in never:
            out = out & ~c
        return out


def parse(query: str, text: str = "text") -> Parsed:
    """Raises ValueError for a query that can't be read. Terms are in lower case; the default operator is OR."""
    found, end = _clauses(query, 0, text)
    if query[end:].strip():
        raise ValueError(f"can't read the query from {query[end:]!r}")
    return found


def _clauses(query: str, at: int, text: str) -> tuple[Parsed, int]:
    out, sign, joined = Parsed(), "may", False
    while at < len(query) and query[at:].strip():
        m = _TOKEN.match(query, at)
        if not m:
            raise ValueError(f"can't read the query from {query[at:]!r}")
        op = m["op"]
        if op == ")":
            return out, at
        at = m.end()
        if op in ("+", "-", "!", "NOT"):
            sign = "must" if op == "+" else "never"
            continue
        if op in ("AND", "&&"):
            joined = True
            if out.clauses and out.clauses[-1][0] == "may":
                out.clauses[-1] = ("must", *out.clauses[-1][1:])
                out.must += [out.clauses[-1][2]] * bool(out.clauses[-1][2])
            continue
        if op in ("OR", "||"):
            joined = False
            continue
        kind = "must" if joined and sign == "may" else sign
        if op == "(" or m["group"]:
            inner, at = _clauses(query, at, text)
            if at >= len(query) or ")" not in query[at:]:
                raise ValueError("a group isn't closed")
            at = query.index(")", at) + 1
            out.clauses.append((kind, inner, ""))
            if kind != "never":
                out.terms += inner.terms
        else:
            term, condition = _leaf(m, text)
            out.clauses.append((kind, condition, term))
            if kind == "never":
                out.never += [term] * bool(term)
            elif term:
                out.terms.append((term, float(m["boost"] or 1)))
                out.must += [term] * (kind == "must")
        sign, joined = "may", False
    return out, at


def _leaf(m: re.Match, text: str) -> tuple[str, Callable[[], Column]]:
    """The term, if it is a plain one, and what makes the predicate: columns need a session, reading a query doesn't."""
    name, term = m["field"] or text, (m["term"] or "").lower()

    def predicate() -> Column:
        column, tokens = F.col(name), word_tokens(F.col(name))
        if m["phrase"] is not None:
            words = re.findall("[a-z0-9]+", m["phrase"].lower())
            return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).contains(f" {' '.join(words)} ")
        if m["lo"] is not None:
            closed = m["open"] == "["
            lo = F.lit(True) if m["lo"] == "*" else (column >= m["lo"] if closed else column > m["lo"])
            return lo & (F.lit(True) if m["hi"] == "*" else (column <= m["hi"] if closed else column < m["hi"]))
        if m["field"] and m["field"] != text:
            return F.lower(column.cast("string")) == term
        if "*" in term or "?" in term:
            pattern = "^" + re.escape(term).replace(r"\*", ".*").replace(r"\?", ".") + "$"
            return F.exists(tokens, lambda t: t.rlike(pattern))
        if m["fuzz"] is not None:
            most = int(float(m["fuzz"] or 2))
            return F.exists(tokens, lambda t: F.levenshtein(t, F.lit(term)) <= most)
        return F.array_contains(tokens, term)

    plain = m["term"] is not None and m["fuzz"] is None and not set("*?") & set(term) and m["field"] in (None, text)
    return term if plain else "", predicate
