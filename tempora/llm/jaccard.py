"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of windows of five words (a text of fewer words is one window; without words, the empty set). Texts of
equal sets are one class, counted before anything else, so copies cost one row. Classes that agree in a band of their
MinHash values are candidates. Their values are compared 32 at a time; after each step a pair is dropped if the
posterior probability that its similarity reaches the threshold, under a uniform prior, is below ``tolerance``. The
rest are verified exactly on the sets. At a similarity of 0.8 a pair misses all bands with a probability of 5e-8.

Pairs are never rows. In a bucket of candidates, what survives the pruning is kept as a spanning forest, and its
connected groups are cut into blocks; each pair of blocks is compared in one task, which returns how many links each
class has there and a forest of them. Buckets over MAX_BUCKET keep a star of all their members instead, unpruned, so
nothing is lost. What a task holds is two blocks of bounded size.

A null or empty text is the empty set; such texts are one class. Null doc_ids are taken as the least number. Rows that
repeat a doc_id and its text are copies of each other. Very long texts are taken whole. Columns beyond the named ones
are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .components import components
from .textvec import BASE, Words, chunked, mix, windows

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-5
HASHES, BAND, STEP = 128, 4, 32
#: Classes in a block, and windows of their texts in a block, about.
BLOCK, BLOCK_WINDOWS = 512, 1_000_000
MAX_BUCKET = 4096
_rng = np.random.Generator(np.random.PCG64(97))
_A = _rng.integers(0, 1 << 64, HASHES, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 64, HASHES, dtype=np.uint64)


def window_sets(data: np.ndarray, at: np.ndarray, n: int = WORDS) -> list[np.ndarray]:
    """For each text of a chunk the sorted hashes of its n-word windows."""
    words = Words(data, at)
    if not len(words.starts):
        return [np.zeros(0, np.uint64)] * (len(at) - 1)
    hashes = words.hashes(data)
    here, keys = windows(hashes, words.doc, n)
    edge = np.searchsorted(words.doc[here], np.arange(len(at)))
    out = []
    for k in range(len(at) - 1):
        if words.counts[k] >= n:
            out.append(np.unique(keys[edge[k] : edge[k + 1]]))
        else:
            h = np.zeros(1, np.uint64)
            for x in hashes[words.first[k] : words.first[k + 1]]:
                h = mix(h * np.uint64(BASE) + x)
            out.append(h if words.counts[k] else np.zeros(0, np.uint64))
    return out


def signature(found: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of 32 bits; the largest values for the empty set."""
    least = np.full(HASHES, (1 << 64) - 1, np.uint64)
    for i in range(0, len(found), 1024):
        np.minimum(least, (found[i : i + 1024, None] * _A + _B).min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def least_matches(threshold: float, tolerance: float, steps: range) -> dict[int, int]:
    """After n values, how many must match for a posterior of at least tolerance of reaching the threshold.

    With a uniform prior, m matches of n give Beta(m + 1, n - m + 1), whose upper tail is a sum of binomial terms.
    """
    out = {}
    for n in steps:
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                out[n] = m
                break
    return out


def surviving(one: np.ndarray, many: np.ndarray, need: dict[int, int]) -> np.ndarray:
    """Rows of ``many`` that aren't dropped against ``one``."""
    left, same = np.arange(len(many)), np.zeros(len(many), np.int64)
    for n in need:
        same = same + (many[left, n - STEP : n] == one[n - STEP : n]).sum(1)
        good = same >= need[n]
        left, same = left[good], same[good]
        if not len(left):
            break
    return left


class _Forest:
    def __init__(self, n: int) -> None:
        self.up, self.edges = list(range(n)), []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((i, j))


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[dict[str, list]]:
    """The rows of each run of equal keys, as columns; one run is held at a time."""
    held: dict[str, list] | None = None
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        key = list(zip(*(columns[k] for k in keys), strict=True))
        start = 0
        for i in range(1, len(key) + 1):
            if i < len(key) and key[i] == key[start]:
                continue
            if key[start] != last:
                if held:
                    yield held
                held, last = {n: [] for n in columns}, key[start]
            for n, c in columns.items():
                held[n] += c[start:i]
            start = i
    if held:
        yield held


def _signed(docs: DataFrame, words: int, keep: tuple[str, ...]) -> DataFrame:
    """doc_id, the key (k1, k2) of its set, its size and signature, and the columns ``keep``."""
    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in chunked(batch.column(1)):
                found = window_sets(data, at, words)
                with np.errstate(over="ignore"):
                    key = [[int(mix(s + np.uint64(c)).sum(dtype=np.uint64).astype(np.int64)) for s in found] for c in (1, 2)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(k, pa.int64()) for k in key), pa.array([len(s) for s in found], pa.int64()), pa.array([signature(s).tobytes() for s in found], pa.binary()), *(batch.column(c).slice(i, j - i) for c in keep)], ["doc_id", "k1", "k2", "n", "sig", *keep])

    return docs.mapInArrow(shared.tidy(run), "doc_id bigint, k1 bigint, k2 bigint, n bigint, sig binary" + kept)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = HASHES // BAND
    for batch in batches:
        for i in range(0, batch.num_rows, 4000):
            part = batch.slice(i, 4000)
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint32).reshape(-1, count, BAND).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(BASE), sig.shape[:2])
            for k in range(BAND):
                key = mix(key * np.uint64(BASE) + sig[:, :, k])
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(part.column("class_id").to_numpy(), count))], ["bucket", "class_id"])


def _forest_of_buckets(need: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in _groups(batches, ("bucket",)):
            sig = np.frombuffer(b"".join(group["sig"]), np.uint32).reshape(-1, HASHES)
            forest = _Forest(len(sig))
            for i in range(len(sig) - 1):
                for j in surviving(sig[i], sig[i + 1 :], need):
                    forest.join(i, i + 1 + int(j))
            a += [group["class_id"][i] for i, _ in forest.edges]
            b += [group["class_id"][j] for _, j in forest.edges]
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def shared_windows(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """How many hashes the sets of each pair (rows of two places) have in common: one by one, or all by matrix products."""
    sizes = np.array([len(s) for s in sets])
    one_by_one = (2e-5 + 5e-8 * (sizes[pairs[:, 0]] + sizes[pairs[:, 1]])).sum() if len(pairs) else 0
    used = np.unique(pairs)
    if one_by_one > 0.05:
        every = np.concatenate([sets[i] for i in used])
        row = np.repeat(np.arange(len(used)), sizes[used])
        values, column, times = np.unique(every, return_inverse=True, return_counts=True)
        keep = times > 1
        place = np.cumsum(keep) - 1
        width = int(keep.sum())
        if 2e-10 * len(used) ** 2 * width < one_by_one:
            row, column = row[keep[column]], place[column[keep[column]]]
            order = np.argsort(column, kind="stable")
            row, column = row[order], column[order]
            total = np.zeros((len(used), len(used)), np.float32)
            for c in range(0, width, 4096):
                lo, hi = np.searchsorted(column, [c, c + 4096])
                part = np.zeros((len(used), min(4096, width - c)), np.float32)
                part[row[lo:hi], column[lo:hi] - c] = 1
                total += part @ part.T
            at = np.searchsorted(used, pairs)
            return total[at[:, 0], at[:, 1]].astype(np.int64)
    return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs], np.int64)


def links_of(sets: list[np.ndarray], sig: np.ndarray, side: np.ndarray, within: bool, need: dict[int, int], threshold: float) -> np.ndarray:
    """Pairs (i, j) of linked places: all within one block, or those between side 0 and side 1."""
    pairs = []
    second = np.flatnonzero(side == 1)
    for i in range(len(sets)):
        if within:
            found = i + 1 + surviving(sig[i], sig[i + 1 :], need)
        elif side[i] == 0:
            found = second[surviving(sig[i], sig[second], need)]
        else:
            continue
        if len(found):
            pairs.append(np.stack([np.full(len(found), i), found], 1))
    if not pairs:
        return np.zeros((0, 2), np.int64)
    pairs = np.concatenate(pairs)
    size = np.array([len(s) for s in sets])
    both = shared_windows(sets, pairs)
    union = size[pairs[:, 0]] + size[pairs[:, 1]] - both
    return pairs[both >= threshold * union - 1e-9]


def _compare(need: dict[int, int], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ("root", "lo", "hi")):
            first = [i for i, c in enumerate(g["class_id"]) if not i or c != g["class_id"][i - 1]]  # repeated rows come next to each other
            g = {k: [c[i] for i in first] for k, c in g.items()}
            sets = [np.frombuffer(x, np.uint64) for x in g["grams"]]
            sig = np.frombuffer(b"".join(g["sig"]), np.uint32).reshape(-1, HASHES)
            side = np.array([int(b != g["lo"][0]) for b in g["block"]])
            pairs = links_of(sets, sig, side, g["lo"][0] == g["hi"][0], need, threshold)
            if not len(pairs):
                continue
            copies, ids = np.array(g["copies"], np.int64), g["class_id"]
            links = np.bincount(pairs[:, 0], copies[pairs[:, 1]], len(ids)) + np.bincount(pairs[:, 1], copies[pairs[:, 0]], len(ids))
            forest = _Forest(len(ids))
            for i, j in pairs:
                forest.join(int(i), int(j))
            some = np.flatnonzero(links)
            node = [ids[i] for i in some] + [ids[i] for i, _ in forest.edges]
            other = [None] * len(some) + [ids[j] for _, j in forest.edges]
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array([int(links[i]) for i in some] + [0] * len(forest.edges), pa.int64()), pa.array(other, pa.int64())], ["class_id", "links", "other"])

    return run


def join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row a document: doc_id, text_class (the least doc_id of an equal set), class_id (the least doc_id of those
    connected by links) and n_links (other documents of a similarity of at least the threshold, copies included), and
    the columns ``keep`` of docs."""
    named = docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-(1 << 63))).alias("doc_id"), F.col(text).alias("text"), *keep)
    need = least_matches(threshold, tolerance, range(STEP, HASHES + 1, STEP))
    signed = shared.written(_signed(named, words, keep), "signatures")
    classes = shared.written(signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    total = classes.count()

    bands = classes.where("n > 0").select("class_id", "sig").mapInArrow(shared.tidy(_bands), "bucket bigint, class_id bigint")
    shared_buckets = bands.groupBy("bucket").agg(F.count("*").alias("size"), F.min("class_id").alias("lead")).where("size > 1")
    hits = shared.written(shared.lookup(bands, shared_buckets, ["bucket"], "size", max(1, total), "inner", spread=("class_id",)).select("bucket", "class_id", "size", "lead"), "candidates")
    signs = classes.select(F.col("class_id").alias("_id"), "sig")
    in_small = hits.where(F.col("size") <= MAX_BUCKET).join(signs, F.col("class_id") == F.col("_id")).select("bucket", "class_id", "sig")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pruned = in_small.repartition(partitions, "bucket").sortWithinPartitions("bucket", "class_id").mapInArrow(shared.tidy(_forest_of_buckets(need)), "a bigint, b bigint")
    stars = hits.where((F.col("size") > MAX_BUCKET) & (F.col("class_id") != F.col("lead"))).select(F.col("class_id").alias("a"), F.col("lead").alias("b"))
    groups = shared.written(components(pruned.unionAll(stars)), "groups")

    weighed = groups.join(classes.select(F.col("class_id").alias("node"), "copies", "n", "sig"), "node")
    shape = weighed.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("windows")).withColumn("blocks", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("windows") / BLOCK_WINDOWS)).cast("int"))
    placed = shared.lookup(weighed, shape, ["root"], "size", max(1, total), "inner", spread=("node",)).select(F.col("node").alias("class_id"), "root", "copies", "sig", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    active = shared.written(placed, "active")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in chunked(batch.column("text")):
                # Rows that repeat a doc_id with another text aren't the class's own.
                found = pa.array([s.tobytes() if signature(s).tobytes() == own else None for s, own in zip(window_sets(data, at, words), batch.column("sig").slice(i, j - i).to_pylist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("class_id", "root", "copies", "sig", "blocks", "block")), found], ["class_id", "root", "copies", "sig", "blocks", "block", "grams"])

    # Their ids alone, if not too many, keep other texts out of the shuffle.
    own = named.join(shared.small(active.select(F.col("class_id").alias("_id"))), F.col("doc_id") == F.col("_id"), "left_semi")
    texts = own.join(active, own.doc_id == active.class_id).select("class_id", "root", "copies", "sig", "blocks", "block", "text")
    sets = texts.mapInArrow(shared.tidy(grams), "class_id bigint, root bigint, copies bigint, sig binary, blocks int, block int, grams binary").where("grams is not null")
    met = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("root", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "class_id", "copies", "sig", "grams")
    found = shared.written(met.repartition(partitions, "root", "lo", "hi").sortWithinPartitions("root", "lo", "hi", "class_id").mapInArrow(shared.tidy(_compare(need, threshold)), "class_id bigint, links bigint, other bigint"), "links")

    counts = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    roots = components(found.where("other is not null").select(F.col("class_id").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("class_id"), "root")
    known = classes.select("k1", "k2", "class_id", "copies").join(counts, "class_id", "left").join(roots, "class_id", "left")
    known = known.select("k1", "k2", F.col("class_id").alias("text_class"), "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "class_id").alias("class_id"))
    rows = signed.select("doc_id", "k1", "k2", *keep)
    return shared.lookup(rows, known, ["k1", "k2"], "copies", max(1, total), "inner", spread=("doc_id",)).select("doc_id", "text_class", "class_id", "n_links", *keep)
