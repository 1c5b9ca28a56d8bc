"""A quality classifier with naive Bayes support vectors.

A text's features are hashed indicators of n-grams: words, pairs of words, and one to four shapes of words in a row (a
shape says how a word is written: capitals, symbols, digits, its last mark, whether it repeats the word before). Word
pairs have half the bins, single words and shapes a quarter each, so that neither of a long text fills the others'.
The number of bins grows with the bytes of the training rows, from 2**LEAST_BITS up to 2**most_bits (a documented
bound: model, counts and what the driver gathers are of that size). The log-count ratio of each n-gram between the classes comes from counts over all training rows, added up by Spark. A
linear model over the indicators scaled by these ratios is fitted by dual coordinate descent for the hinge loss, on
at most ``fit_rows`` training rows taken by the hash of doc_id (the documented bound; a class gets half at most while
the other has more). A logistic curve over the margins of those rows gives scores from 0 to 1.

Labels are read for training alone. Null and empty texts have no n-gram; their score is that of the bias. Labels for
a doc_id that come more than once count as often as they come; unlabelled documents and null labels are not trained
on. With labels of one class only, or none, every score is that class's share (or 0.5).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .textvec import BASE, Words, chunked, mix

#: Bounds of the bits of a bin's number.
LEAST_BITS, MOST_BITS = 17, 20
FIT_ROWS = 6000
_CLASS = np.zeros(256, np.uint8)  # upper 1, lower 2, digit 4, symbol 8, loud mark 16, other mark 32
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 4
_CLASS[128:] = 2
for _c in b"#*$%&|<>=\\^~_@{}[]":
    _CLASS[_c] = 8
for _c in b"!?":
    _CLASS[_c] = 16
for _c in b".,;:'\"()-/+`":
    _CLASS[_c] = 32


def _shapes(data: np.ndarray, words: Words, hashes: np.ndarray) -> np.ndarray:
    kinds = _CLASS[data]
    padded = np.append(kinds, np.uint8(0))
    edges = np.empty(2 * len(words.starts), np.int64)
    edges[::2], edges[1::2] = words.starts, words.ends
    has = np.bitwise_or.reduceat(padded, edges)[::2].astype(np.uint64)
    repeat = np.zeros(len(hashes), np.uint64)
    repeat[1:] = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    size = np.minimum(words.ends - words.starts, 31).astype(np.uint64) // np.uint64(8)
    return has | repeat << np.uint64(6) | (kinds[words.starts].astype(np.uint64) == 1).astype(np.uint64) << np.uint64(7) | size << np.uint64(8)


def features(data: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, n-gram) of all n-grams of a chunk, each once a row, by row. An n-gram is the number of its bin, below 2**bits."""
    words = Words(data, at)
    if not len(words.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = words.hashes(data)
    shapes = mix(_shapes(data, words, hashes) + np.uint64(1 << 40))
    keys, docs = [], []
    for base, longest, kind in ((hashes, 2, 1), (shapes, 4, 2)):
        run = np.zeros(len(base), np.uint64)
        for n in range(1, longest + 1):
            if len(base) < n:
                break
            run = run[: len(base) - n + 1] * np.uint64(BASE) + base[n - 1 :]
            inside = words.doc[: len(run)] == words.doc[n - 1 :]
            # Bins of pairs are the odd numbers, those of words and shapes the even ones, by the next bit.
            space, step = (1, 1) if (kind, n) == (1, 2) else (2 * (kind - 1), 2)
            place = mix(run[inside] + np.uint64(kind * 16 + n)) & np.uint64((1 << bits - step) - 1)
            keys.append(place << np.uint64(step) | np.uint64(space))
            docs.append(words.doc[: len(run)][inside])
    both = np.unique(np.concatenate(docs).astype(np.int64) << bits | np.concatenate(keys).astype(np.int64))
    return both >> bits, both & ((1 << bits) - 1)


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << LEAST_BITS, np.float32))
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        row, gram = features(data, at, len(self.weights).bit_length() - 1)
        n = len(at) - 1
        norm = np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))
        return np.bincount(row, self.weights[gram], n) / norm + self.bias

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(data, at) + self.shift, -50, 50)))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of doc_id as text leaves 0; such rows, and null ids, are not trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def _count(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros((2, 1 << bits), np.int64), ([], []), 0

        def add() -> None:
            for k in (0, 1):
                if held[k]:
                    counts[k] += np.bincount(np.concatenate(held[k]), minlength=1 << bits)
                    held[k].clear()

        for batch in batches:
            label = batch.column("label").to_numpy()
            for i, j, data, at in chunked(batch.column("text")):
                row, gram = features(data, at, bits)
                for k in (0, 1):
                    held[k].append(gram[label[i:j][row] == k])
                size += len(gram)
                if size > 1 << 20:
                    add()
                    size = 0
        add()
        some = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[0, some]), pa.array(counts[1, some])], ["gram", "n0", "n1"])

    return run


def descend(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + the sum of costs times hinge losses, by dual coordinate descent.

    Rows are indicators scaled by ratio and divided by the root of their number; the bias is one more feature of 1. The
    two classes weigh alike in the sum.
    """
    w, bias = np.zeros(len(ratio)), 0.0
    y = np.where(labels == 1, 1.0, -1.0)
    share = np.where(labels == 1, len(y) / (2 * max(1, (labels == 1).sum())), len(y) / (2 * max(1, (labels == 0).sum())))
    limit = cost * share
    values = [(ratio[r] / np.sqrt(max(1, len(r)))).astype(np.float32) for r in rows]
    square = np.array([float(v @ v) + 1.0 for v in values])
    dual = np.zeros(len(y))
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in random.permutation(len(y)):
            r, v = rows[i], values[i]
            slope = y[i] * (w[r] @ v + bias) - 1
            new = min(max(dual[i] - slope / square[i], 0.0), limit[i])
            if step := new - dual[i]:
                dual[i] = new
                w[r] += step * y[i] * v
                bias += step * y[i]
                most = max(most, abs(step) * square[i] ** 0.5)
        if most < 1e-3:
            break
    return w, bias


def _logistic(margins: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    target = np.where(labels == 1, 1 - 1 / (labels.sum() + 2), 1 / ((1 - labels).sum() + 2))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -50, 50)))
        g, h = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-9)
        gradient = np.array([g @ margins + 1e-3 * a, g.sum()])
        hessian = np.array([[h @ margins**2 + 1e-3, h @ margins], [h @ margins, h.sum() + 1e-6]])
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 5 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def train(docs: DataFrame, labels: DataFrame, **options: object) -> Model:
    """``fit``, after which the driver gives back what it held of rows and counts."""
    model = fit(docs, labels, **options)
    shared.release()
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id", fit_rows: int = FIT_ROWS, cost: float = 1.0, smoothing: float = 1.0, most_bits: int = MOST_BITS) -> Model:
    """Fits on labelled rows outside the held-out fold. The driver gets 2 counts a bin and at most fit_rows rows' n-grams."""
    marks = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("_id")))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # Labels have no text: while they are few enough they go to the documents, and no text is shuffled.
    rows = texts.join(shared.small(marks, 1_000_000), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(size.bit_length(), LEAST_BITS), max(most_bits, LEAST_BITS))
    dim = 1 << bits
    counts = rows.select("text", "label").mapInArrow(shared.tidy(_count(bits)), "gram int, n0 bigint, n1 bigint").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    # The sample is chosen among the labels alone, which have no text.
    classes = dict(marks.groupBy("label").count().collect())
    if len(classes) < 2:
        share = 1.0 if 1 in classes else 0.0 if 0 in classes else 0.5
        return Model(slope=0.0, shift=float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    some = min(min(classes.values()), fit_rows // 2)
    of = {0: some, 1: some}
    of[max(classes, key=classes.get)] = fit_rows - some
    chosen = None
    for k, n in of.items():
        part = marks.where(F.col("label") == k).orderBy(F.xxhash64(F.lit(9), "_id"), "_id").limit(n)
        chosen = part if chosen is None else chosen.unionAll(part)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in chunked(batch.column("text")):
                row, gram = features(data, at, bits)
                edge = np.searchsorted(row, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("label").slice(i, j - i), pa.array([gram[edge[k] : edge[k + 1]].astype("<i4").tobytes() for k in range(j - i)], pa.binary())], ["doc_id", "label", "grams"])

    picked = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label")
    kind = picked.schema["doc_id"].dataType.simpleString()
    sample = picked.mapInArrow(shared.tidy(grams), f"doc_id {kind}, label int, grams binary").toArrow()
    n = counts.toArrow()
    total = np.full((2, dim), smoothing)
    at = n.column("gram").to_numpy()
    total[0, at] += n.column("n0").to_numpy()
    total[1, at] += n.column("n1").to_numpy()
    ratio = np.log(total[1] / total[1].sum()) - np.log(total[0] / total[0].sum())
    own = np.array(sample.column("label").to_pylist(), np.int64)
    key = sorted(range(len(own)), key=lambda i: (str(sample.column("doc_id")[i]), sample.column("grams")[i].as_py()))
    own = own[key]
    found = [np.frombuffer(sample.column("grams")[i].as_py(), "<i4") for i in key]
    w, bias = descend(found, own, ratio, cost)
    margins = np.array([w[r] @ ratio[r] / np.sqrt(max(1, len(r))) + bias for r in found])
    weight = np.where(own == 1, classes[1] / max(1, (own == 1).sum()), classes[0] / max(1, (own == 0).sum()))
    slope, shift = _logistic(margins, own, weight)
    return Model((w * ratio).astype(np.float32), float(bias), float(slope), float(shift))


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``score``; one pass without a shuffle. The model has a number a bin."""
    chosen = docs.select(*keep, F.col(text).alias("_text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in chunked(batch.columns[-1]):
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:-1]), pa.array(sent.value.scores(data, at))], [*keep, "score"])

    return chosen.mapInArrow(shared.tidy(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]) + ", score double")
