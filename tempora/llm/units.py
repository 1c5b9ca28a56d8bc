"""Substring dedup by hashing lines, paragraphs or runs of phrases.

A text is cut into units: lines, paragraphs (runs of lines between empty ones), or runs. For runs a text is cut into
phrases: at marks that end a word, at line breaks, and in stretches of over LONG words also after words of at most
SHORT code points. From each phrase on, as many whole phrases as have ``min_words`` words are a unit. Runs overlap and
cross lines, and their borders come from the words alone, so a passage is found wherever in a line it starts or ends,
but for the words up to the first border within it and after the last.

A unit of at least ``min_words`` words is normalised (lower case, white space collapsed) and digested to 96 bits. Of all
units of one digest the earliest by (doc_id, place) stays and the others go; code point offsets in the original text are
kept. Runs that overlap or touch are removed as one span. A removed word has an equal run before it, so a copy of it
stays, though not always all of one run in one place.

What stands earlier in the same text is known without the others; so a text sends each digest once, counts and least
doc_ids are added up before the shuffle, and hot digests are joined back over salted partitions. A document gathers the
digests of its own removed units, no more.

Null texts have no units and stay null. Very long texts are taken whole. An empty table gives no rows; columns
beyond the named ones are not looked at. Null doc_ids rank last. Rows that repeat a doc_id don't take units from each
other. Marks of wide scripts count as line breaks. Letters whose lower case is longer than themselves keep their case.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .textvec import BASE, UNBASE, Words, chunked, mix, powers
from .textvec import digests as digest_numbers

MIN_WORDS = 5
#: Words in a run, at least.
RUN_WORDS = 25
#: A stretch without marks of more words than LONG is cut after words of at most SHORT code points.
LONG, SHORT = 12, 3
#: Runs of more words than this are known by a digest of their words, not by a polynomial.
LONG_RUN = 64
_WHITE = re.compile(r"[\x20\x09-\x0D]+")
_MARKS = "、。！，：；？"
_WIDE = str.maketrans(dict.fromkeys(_MARKS, "\n"))
_GAP = re.compile(rf"[\x20\x09-\x0D{_MARKS}]*")
_ENDS, _POINT = np.zeros(256, bool), np.ones(256, np.int64)
_ENDS[list(b",;:.!?")] = True
_POINT[0x80:0xC0] = 0
_LAST = (1 << 63) - 1


def normalise(text: str) -> str:
    return _WHITE.sub(" ", text).strip(" ").lower()


def _spans(text: str, unit: str) -> list[tuple[int, int]]:
    """(start, end) of each line or paragraph, in code points."""
    out, start = [], 0
    for line in text.split("\n"):
        out.append((start, start + len(line)))
        start += len(line) + 1
    if unit == "line":
        return out
    paragraphs: list[tuple[int, int]] = []
    open_ = False
    for a, b in out:
        if not text[a:b].strip():
            open_ = False
        elif open_:
            paragraphs[-1] = (paragraphs[-1][0], b)
        else:
            paragraphs.append((a, b))
            open_ = True
    return paragraphs


def fold(text: str) -> str:
    """Lower case, code point for code point, with the marks of wide scripts as line breaks."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    return low.translate(_WIDE)


def _runs(data: np.ndarray, at: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """row, start, end (code points in the text), high and low digest of all runs in a chunk of folded texts, by place."""
    words = Words(data, at)
    if not len(words.starts):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    hashes = words.hashes(data)
    point = np.concatenate([[0], np.cumsum(_POINT[data])])
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    ends = _ENDS[data[words.ends - 1]] | (breaks[np.append(words.starts[1:], len(data))] > breaks[words.ends]) | np.append(words.doc[1:] != words.doc[:-1], True)
    last = np.flatnonzero(ends)
    length = np.diff(last, prepend=-1)
    ends |= np.repeat(length > LONG, length) & (point[words.ends] - point[words.starts] <= SHORT)
    last = np.flatnonzero(ends)
    first = np.concatenate([[0], last[:-1] + 1])
    k = np.searchsorted(last, first + min_words - 1)
    whole = k < len(last)
    first, stop = first[whole], last[k[whole]]
    one_text = words.doc[first] == words.doc[stop]
    first, stop = first[one_text], stop[one_text]
    digests = []
    for base in (hashes, mix(hashes + np.uint64(1))):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(base * powers(BASE, len(base)), dtype=np.uint64)])
        digests.append(mix((total[stop + 1] - total[first]) * powers(UNBASE, len(base))[first] + (stop - first).astype(np.uint64)))
    long = np.flatnonzero(stop - first >= LONG_RUN)
    if len(long):
        known = digest_numbers(hashes.tobytes(), 8 * first[long], 8 * stop[long] + 8, 16)
        digests[0][long], digests[1][long] = known[:, 0], known[:, 1]
    row = words.doc[first]
    begin = point[at[row]]
    return row, point[words.starts[first]] - begin, point[words.ends[stop]] - begin, digests[0].view(np.int64), (digests[1] >> np.uint64(32)).astype(np.uint32).view(np.int32).astype(np.int64)


def cut(texts: pa.Array, unit: str, min_words: int) -> Iterator[tuple[int, int, tuple[np.ndarray, ...]]]:
    """(first row, last row + 1, (row, start, end, high, low)) of the units that count, for parts of a column."""
    if unit == "run":
        folded = pa.array([fold(t or "") for t in texts.to_pylist()], pa.large_string())
        for i, j, data, at in chunked(folded):
            yield i, j, _runs(data, at, min_words)
        return
    out = []
    for k, text in enumerate(texts.to_pylist()):
        for a, b in _spans(text or "", unit):
            if (form := normalise((text or "")[a:b])) and form.count(" ") + 1 >= min_words:
                digest = hashlib.md5(form.encode(), usedforsecurity=False).digest()
                out.append((k, a, b, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:12], "little", signed=True)))
    yield 0, len(texts), tuple(np.array([r[c] for r in out], np.int64) for c in range(5))


def _again(row: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Which units stand earlier in their own text."""
    order = np.lexsort((np.arange(len(row)), low, high, row))
    same = np.zeros(len(row), bool)
    same[order[1:]] = (row[order[1:]] == row[order[:-1]]) & (high[order[1:]] == high[order[:-1]]) & (low[order[1:]] == low[order[:-1]])
    return same


def digests(docs: DataFrame, unit: str = "run", min_words: int = RUN_WORDS) -> DataFrame:
    """doc, high, low: each digest of a text once. docs: doc, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, (row, _, _, high, low) in cut(batch.column(1), unit, min_words):
                new = ~_again(row, high, low)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + row[new])), pa.array(high[new]), pa.array(low[new].astype(np.int32))], ["doc", "high", "low"])

    return docs.mapInArrow(shared.tidy(run), "doc bigint, high bigint, low int")


def repeated(docs: DataFrame, unit: str = "run", min_words: int = RUN_WORDS) -> DataFrame:
    """doc and ``gone``, the high digests of its units that a document of a lesser number has, where there are any."""
    found = shared.written(digests(docs, unit, min_words), "units")
    first = found.groupBy("high", "low").agg(F.count("*").alias("n"), F.min("doc").alias("first")).where("n > 1")
    met = shared.lookup(found, shared.written(first, "digests"), ["high", "low"], "n", found.count(), "inner", spread=("doc",))
    return met.where("doc > first").groupBy("doc").agg(F.collect_set("high").alias("gone"))


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", unit: str = "run", min_words: int | None = None) -> DataFrame:
    """doc_id, n_units, ``removed`` (array of start, end in the original text) and ``kept_text`` of each row. A line goes
    with its break."""
    least = min_words or (RUN_WORDS if unit == "run" else MIN_WORDS)
    named = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_LAST)).alias("doc"))
    removed = repeated(named.select("doc", "text"), unit, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = batch.column("text"), batch.column("gone")
            for i, j, (row, start, end, high, low) in cut(texts, unit, least):
                listed = gone.slice(i, j - i)
                holder = np.repeat(np.arange(j - i), pc.list_value_length(listed).fill_null(0).to_numpy())
                out = _again(row, high, low) | _among(row, high, holder, listed.flatten().to_numpy())
                edge, count = np.searchsorted(row, np.arange(j - i + 1)), []
                cuts, kept = [], []
                for k, t in enumerate(texts.slice(i, j - i).to_pylist()):
                    own = [(int(a), int(b)) for a, b, x in zip(start[edge[k] : edge[k + 1]], end[edge[k] : edge[k + 1]], out[edge[k] : edge[k + 1]], strict=True) if x]
                    if unit == "run":
                        own = merged(own, t or "")
                    count.append(edge[k + 1] - edge[k])
                    cuts.append([{"start": a, "end": b} for a, b in own])
                    kept.append(without(t, own, unit != "run") if own else t)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(count, pa.int64()), pa.array(cuts, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())], ["doc_id", "n_units", "removed", "kept_text"])

    joined = named.join(removed.withColumnRenamed("doc", "_doc"), F.col("doc") == F.col("_doc"), "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(shared.tidy(run), "doc_id bigint, n_units bigint, removed array<struct<start:bigint,end:bigint>>, kept_text string")


def _among(row: np.ndarray, high: np.ndarray, holder: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which (row, high) are among the pairs of holder and listed."""
    key = lambda r, h: mix(h.astype(np.int64).view(np.uint64) + r.astype(np.uint64) * np.uint64(BASE))
    return np.isin(key(row, high), key(holder, listed))


def merged(found: list[tuple[int, int]], text: str) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or have no word between them as one."""
    out: list[tuple[int, int]] = []
    for a, b in found:
        if out and (a <= out[-1][1] or _GAP.fullmatch(text, out[-1][1], a)):
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: str, gone: list[tuple[int, int]], with_break: bool) -> str:
    out, free = [], 0
    for a, b in gone:
        out.append(text[free:a])
        free = min(b + 1, len(text)) if with_break else b
    return "".join([*out, text[free:]])
