"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, scheme marks, plus signs, digits and identifier cues. From
each anchor a local parser expands to the borders of a candidate and validates it. A text is never searched by a
general pattern; work beyond the pass grows with the number of anchors.

Kinds `email`, `ip`, `card` and `phone` are the base; the anchors at schemes and cues add `url` (an address that
carries credentials), `iban` (checked by its check digits), `ssn` and `secret` (a long token after a cue).
Cues count in any case. Null and empty texts have no spans; very long texts are searched whole, and no number, scheme or
name is too long for a parser. Spans of several kinds may overlap and are listed by start, then kind, then end. Repeated
rows give repeated rows, an empty table none; columns beyond the named ones are not looked at, whatever their names.
Spans are in code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("url", "iban", "ssn", "secret")
KINDS = BASE_KINDS + EXTRA_KINDS
_ORDER = {k: i for i, k in enumerate(KINDS)}
#: Cues, in lower case, and the kinds that a parser looks for after them.
CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn", "token": "secret", "secret": "secret", "password": "secret", "passwd": "secret", "api_key": "secret", "apikey": "secret", "api key": "secret"}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
# Local parsers: each is only ever matched at a given place.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AUTHORITY = re.compile(r"[^\s/@:?#\"'<>]+(?::[^\s/@?#\"'<>]*)?@[A-Za-z0-9.-]+(?::[0-9]+)?[^\s\"'<>]*")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_NO_LETTER = "0123456789+.-"
_IBAN = re.compile(r"[\s:=#]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})\b")
_SSN = re.compile(r"(?:\s*(?:number|no\.?|#))?[\s:=#]{0,4}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])", re.I)
_SECRET = re.compile(r"\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9_/+-]{16,}={0,2})")


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, "digit")
    found.add_word("@", "at")
    found.add_word("+", "plus")
    found.add_word("://", "scheme")
    for cue in CUES:
        found.add_word(cue, (CUES[cue], len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str, anchors: list[int]) -> Iterator[tuple[int, int]]:
    free = 0
    for at in anchors:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            free = m.end()
            yield start, free


def _runs(text: str, digits: list[int], parser: re.Pattern) -> Iterator[re.Match]:
    """Matches that begin a run of digits, from left to right, none within the one before."""
    free, last = 0, -2
    for i in digits:
        begins, last = i != last + 1, i
        if i >= free and begins and (m := parser.match(text, i)):
            free = m.end()
            yield m


def _iban(text: str) -> bool:
    flat = text.replace(" ", "")
    return 15 <= len(flat) <= 34 and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def _urls(text: str, anchors: list[int]) -> Iterator[tuple[int, int]]:
    free = 0
    for end in anchors:
        start = mark = end - 2
        while start > free and text[start - 1] in _SCHEME:
            start -= 1
        while start < mark and text[start] in _NO_LETTER:
            start += 1
        if start < mark and (m := _AUTHORITY.match(text, end + 1)):
            free = m.end()
            yield start, free


def _folded(text: str) -> str:
    """text in lower case, code point for code point; one capital alone has a longer lower case."""
    return text.replace("\u0130", "\u0131").lower()


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans by start, then kind."""
    if not text:
        return []
    digits, at, plus, schemes, cues = [], [], [], [], []
    for end, what in _automaton().iter(_folded(text)):
        if what == "digit":
            digits.append(end)
        elif what == "at":
            at.append(end)
        elif what == "plus":
            plus.append(end)
        elif what == "scheme":
            schemes.append(end)
        else:
            cues.append((end, what))
    if not (digits or at or plus or schemes or cues):
        return []
    out = [("email", a, b) for a, b in _emails(text, at)]
    for m in _runs(text, digits, _IP):
        if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _runs(text, digits, _CARD):
        only = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(only) <= 19 and luhn(only):
            out.append(("card", *m.span()))
    free = 0
    for i in plus:
        if i >= free and (m := _PHONE.match(text, i)):
            free = m.end()
            if 9 <= sum(c in _DIGITS for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    out += [("url", a, b) for a, b in _urls(text, schemes)]
    seen = set()
    for end, (kind, _) in cues:
        if (m := {"iban": _IBAN, "ssn": _SSN, "secret": _SECRET}[kind].match(text, end + 1)) and (kind, m.start(1)) not in seen:
            if kind != "iban" or _iban(m[1]):
                seen.add((kind, m.start(1)))
                out.append((kind, *m.span(1)))
    return sorted(out, key=lambda s: (s[1], _ORDER[s[0]], s[2]))


def redact(text: str | None, spans: list[tuple[str, int, int]] | None = None) -> str | None:
    """text with each span, or run of overlapping spans, replaced by the kind of its first in angle brackets."""
    spans = find(text) if spans is None else spans
    if not spans:
        return text
    out, free, cut = [], 0, []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if cut and a < cut[-1][2]:
            cut[-1][2] = max(cut[-1][2], b)
        else:
            cut.append([kind, a, b])
    for kind, a, b in cut:
        out += [text[free:a], f"<{kind.upper()}>"]
        free = b
    return "".join([*out, text[free:]])


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_spans(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), redacted: bool = False) -> DataFrame:
    """The columns ``keep``, ``spans`` (array of kind, start, end) and, if asked for, ``redacted`` of each row.

    One pass without a shuffle. Repeated rows give repeated rows; null texts have no spans and stay null.
    """
    chosen = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                texts = part.column(part.num_columns - 1).to_pylist()
                found = [find(t) for t in texts]
                arrays = [*part.columns[:-1], pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in found], _SPAN)]
                if redacted:
                    arrays.append(pa.array([redact(t, s) for t, s in zip(texts, found, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names)

    names = [*keep, "spans", *(["redacted"] if redacted else [])]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]) + ", spans array<struct<kind:string,start:bigint,end:bigint>>" + (", redacted string" if redacted else "")
    return chosen.mapInArrow(shared.tidy(run), schema)
