"""Document fingerprints as homomorphic multiset hashes.

A paragraph (a line of a text; line breaks end it) is hashed to a wide vector: LANES numbers modulo 2**32, which are the
BLAKE2b digest of the whole paragraph, and BINS signed counts modulo 2**32 that its word triples add to at hashed places. A document's
fingerprint is the sum of its paragraphs' vectors. So the order of paragraphs doesn't matter, paragraphs can be added
or taken away without the rest of the text, and equal multisets of paragraphs have equal fingerprints, while unequal
ones differ but with a probability of about 2**-256. The counts are a sketch of the triples: the cosine of two of them
estimates the likeness of two texts, with an error of about 1 / sqrt(BINS).

Null and empty texts have no paragraph and the sum 0; two of those are alike (1), one and a text are not (0). Very long texts are
taken whole. Columns beyond the named ones are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .textvec import BASE, Words, chunked, digests, mix

LANES, BINS = 8, 256


def sums(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sums of the paragraphs' vectors of each text: (n, LANES) and (n, BINS), both modulo 2**32."""
    lanes, bins = np.zeros((len(column), LANES), np.uint32), np.zeros((len(column), BINS), np.uint32)
    for i, j, data, at in chunked(column):
        if not len(data):
            continue
        breaks = np.flatnonzero(data == 10)
        full = np.flatnonzero(np.diff(at) > 0)
        starts = np.concatenate([at[full], breaks + 1])
        doc = np.concatenate([full, np.searchsorted(at, breaks, "right") - 1])
        stops = np.append(breaks, len(data))
        ends = np.minimum(stops[np.searchsorted(breaks, starts)], at[doc + 1])
        wide = digests(data, starts, ends, 4 * LANES).view("<u4").astype(np.uint64)
        order = np.argsort(doc, kind="stable")
        doc_sorted, wide = doc[order], wide[order]
        total = np.zeros((len(wide) + 1, LANES), np.uint64)
        np.cumsum(wide, axis=0, out=total[1:])
        edge = np.searchsorted(doc_sorted, np.arange(j - i + 1))
        lanes[i:j] = (total[edge[1:]] - total[edge[:-1]]).astype(np.uint32)

        words = Words(data, at)
        if len(words.starts):
            h = words.hashes(data)
            para = np.searchsorted(breaks, words.starts) + words.doc  # grows from paragraph to paragraph
            # The triples that end at each word, shorter at a paragraph's beginning.
            one, two = np.roll(h, 1), np.roll(h, 2)
            one[:1] = two[:2] = 0
            same1 = np.concatenate([[False], para[1:] == para[:-1]])
            same2 = np.concatenate([[False] * min(2, len(para)), para[2:] == para[:-2]])
            key = mix(h * np.uint64(BASE) + np.where(same1, one, np.uint64(7))) + np.where(same2, two, np.uint64(11)) * np.uint64(3)
            key = mix(key)
            place = (words.doc * BINS + (key & np.uint64(BINS - 1)).astype(np.int64))
            sign = np.where(key >> np.uint64(63), 1.0, -1.0)
            bins[i:j] = np.bincount(place, sign, (j - i) * BINS).astype(np.int64).reshape(j - i, BINS).astype(np.uint32)
    return lanes, bins


def to_text(lanes: np.ndarray, bins: np.ndarray) -> list[str]:
    raw = np.concatenate([np.ascontiguousarray(lanes, "<u4").view(np.uint8), np.ascontiguousarray(bins, "<u4").view(np.uint8)], axis=1)
    return [base64.b64encode(r).decode() for r in raw]


def from_text(prints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(base64.b64decode(p) for p in prints), np.uint8).reshape(len(prints), LANES * 4 + BINS * 4)
    return np.ascontiguousarray(raw[:, : LANES * 4]).view("<u4"), np.ascontiguousarray(raw[:, LANES * 4 :]).view("<u4")


def combine(prints: list[str], signs: list[int] | None = None) -> str:
    """The fingerprint of a text from those of its parts; sign -1 takes a part away."""
    lanes, bins = from_text(prints)
    s = np.array(signs or [1] * len(prints), np.int64)[:, None]
    return to_text((lanes * s).sum(0, keepdims=True).astype(np.uint32), (bins * s).sum(0, keepdims=True).astype(np.uint32))[0]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints: 1 for equal ones, else the cosine of the counts, at least 0."""
    x, y = a[1].view(np.int32).astype(np.float64), b[1].view(np.int32).astype(np.float64)
    norm = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    cosine = np.where(norm > 0, (x * y).sum(1) / np.maximum(norm, 1e-9), 0.0)
    return np.where((a[0] == b[0]).all(1) & (a[1] == b[1]).all(1), 1.0, np.clip(cosine, 0.0, 1.0))


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``fingerprint``; one pass without a shuffle."""
    chosen = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(to_text(*sums(batch.columns[-1])), pa.string())], [*keep, "fingerprint"])

    return chosen.mapInArrow(shared.tidy(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]) + ", fingerprint string")


def edited(own: str, following: str) -> str:
    """own with its last floor(n / 4) code points replaced by as many from the beginning of following, or all it has."""
    n = len(own) // 4
    return own[: len(own) - n] + following[:n]


_OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, doc_id, text, ahead) ordered by part and doc_id; a row with ahead only lends its text to the one before."""

    def out(rows: list[tuple[int | None, str]], following: str) -> pa.RecordBatch:
        texts = [t for _, t in rows]
        new = [edited(t, n) for t, n in zip(texts, [*texts[1:], following], strict=True)]
        a = sums(pa.array([*texts, following], pa.large_string()))
        b = sums(pa.array(new, pa.large_string()))
        own, ahead = (a[0][:-1], a[1][:-1]), (a[0][1:], a[1][1:])
        return pa.RecordBatch.from_arrays([
            pa.array([i for i, _ in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in new]),
            pa.array(to_text(*own), pa.string()), pa.array(to_text(*b), pa.string()), pa.array(likeness(own, b)), pa.array(likeness(own, ahead)),
        ], _NAMES)

    rows: list[tuple[int | None, str]] = []
    part, size = None, 0
    for batch in batches:
        for p, i, text, ahead in zip(*(batch.column(k).to_pylist() for k in ("part", "doc_id", "text", "ahead")), strict=True):
            text = text or ""
            if p != part:
                rows, part, size = [], p, 0  # what was left of a part has no follower here: it came with its lookahead
            if ahead:
                if rows:
                    yield out(rows, text)
                rows = []
                continue
            if size > 1 << 20:
                yield out(rows, text)
                rows, size = [], 0
            rows.append((i, text))
            size += len(text)


def edit_check(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document by ascending doc_id.

    Documents go to ranges of doc_id, a few for each partition; the first rows of a range are also sent, as lookahead,
    to the range before it (those of the first range to the last). One shuffle of the texts, no row count on a driver
    but the ranges' borders. Rows of one doc_id are taken in the order of their texts; null doc_ids come first.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.coalesce("doc_id", F.lit(-(1 << 63)))
    cut = named.select(place.alias("k")).agg(F.percentile_approx("k", [i / (4 * n) for i in range(4 * n)], 40 * n), F.min("k")).first()
    borders = sorted({cut[1], *(cut[0] or [])}) if cut[1] is not None else [0]
    parts = len(borders)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = np.array(borders, np.int64)
        for batch in batches:
            k = batch.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            part = np.searchsorted(edge, k, "right") - 1
            part = np.maximum(part, 0)
            first = np.flatnonzero(edge[part] == k)
            everything = batch.append_column("part", pa.array(part)).append_column("ahead", pa.array(np.zeros(len(k), bool)))
            yield everything
            if len(first):
                more = batch.take(pa.array(first))
                yield more.append_column("part", pa.array((part[first] - 1) % parts)).append_column("ahead", pa.array(np.ones(len(first), bool)))

    rows = named.mapInArrow(shared.tidy(dealt), "doc_id bigint, text string, part bigint, ahead boolean")
    spread = rows.repartitionById(n, F.pmod("part", F.lit(n)).cast("int")).sortWithinPartitions("part", "ahead", F.col("doc_id").asc_nulls_first(), "text")
    return spread.mapInArrow(shared.tidy(_compare), _OUT)
