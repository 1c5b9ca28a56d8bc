"""Removal of long repeated substrings, decided by suffix arrays.

`suffix_array` sorts suffixes by linear grouping construction. Suffixes start in groups by their first symbol. Groups are
worked on in descending order: each member points to the nearest position before it that is in a lower group (its
previous-smaller pointer), and those positions move to new groups right after their own, by how many members point to
them. In the end a group holds the suffixes of one Lyndon prefix. One ascending pass then emits the order: the suffix
that follows a Lyndon prefix settles whose turn it is in its group. Nothing is renamed and nothing recurs.

A corpus doesn't fit one array, so strings that can be equal are brought together first. Each window of ``width`` bytes
belongs to the least hashed run of GRAM bytes within it; windows in a row with one such place are a fragment. Equal
windows have equal runs at equal places, so they are in fragments of one run hash. Equal fragments are counted before
anything moves. A run hash with a single fragment needs no order: its windows repeat if the fragment does. The distinct
fragments of any other are concatenated and sorted in one suffix array, and neighbours that agree in ``width`` bytes
are repeats. A run hash with more than MAX_FRAGMENTS distinct fragments is dealt by the hashes of its single windows
instead, so no task holds more than that.

Texts are bytes in UTF-8; null and empty texts have none. Rows are known by doc_id and a hash of their text: rows that
repeat both are documents of their own and repeat each other whole. Matches never cross documents. Very long texts are
cut into fragments piece by piece and lose nothing. Fragments, and the windows of hot run hashes, are known by 64 bits of
a BLAKE2b digest beside the run hash. An empty table gives no rows; columns beyond the named ones are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .textvec import UNBASE, chunked, digests, mix, powers, prefix_hash

WIDTH, GRAM = 200, 32
#: Bytes of a symbol of the suffix arrays; the bytes of a window beyond its whole words are a multiple of eight.
WORD = 32
MAX_FRAGMENTS = 2048
_PIECE = 4 << 20


def lyndon_groups(text: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """(group of each suffix, previous-smaller pointer of each, groups in ascending order)."""
    n = len(text)
    first: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        if c in first:
            first[c].append(i)
        else:
            first[c] = [i]
    members, group, before, after = [[]], [0] * n, [-1], [-1]  # group 0 stands before all
    last = 0
    for c in sorted(first):
        g = len(members)
        members.append(first[c])
        for i in first[c]:
            group[i] = g
        before.append(last)
        after.append(-1)
        after[last] = g
        last = g
    done = [False] * len(members)
    smaller = [-1] * n
    g = last
    while g:
        moved: dict[tuple[int, int], list[int]] = {}
        parent, count, size = -1, 0, 0
        done[g] = True  # members count as not lower
        if len(members[g]) == 1:  # as below, for the most common case
            i = members[g][0]
            if group[i] == g:
                j = i - 1
                while j >= 0 and done[group[j]]:
                    j = smaller[j]
                smaller[i] = j
                if j >= 0 and len(members[old := group[j]]) > 1:
                    new = len(members)
                    members.append([j])
                    done.append(False)
                    group[j] = new
                    behind = after[old]
                    before.append(old)
                    after.append(behind)
                    after[old] = new
                    before[behind] = new
            else:
                done[g] = False
            g = before[g]
            continue
        for i in members[g]:
            if group[i] != g:
                continue
            size += 1
            j = i - 1
            while j >= 0 and done[group[j]]:
                j = smaller[j]
            smaller[i] = j
            if j == parent:
                count += 1
            else:
                if parent >= 0:
                    moved.setdefault((count, group[parent]), []).append(parent)
                parent, count = j, 1
        if parent >= 0:
            moved.setdefault((count, group[parent]), []).append(parent)
        for count, old in sorted(moved, reverse=True) if len(moved) > 1 else moved:
            new = len(members)
            own = moved[count, old]
            members.append(own)
            done.append(False)
            for p in own:
                group[p] = new
            behind = after[old]
            before.append(old)
            after.append(behind)
            after[old] = new
            if behind >= 0:
                before[behind] = new
        if not size:
            done[g] = False
        g = before[g]
    order = []
    g = after[0]
    while g >= 0:
        if done[g]:
            order.append(g)
        g = after[g]
    return group, smaller, order


def suffix_array(text: Sequence[int]) -> list[int]:
    n = len(text)
    group, smaller, order = lyndon_groups(text)
    sizes = [0] * (max(order, default=0) + 1)
    for g in group:
        sizes[g] += 1
    free, at = [0] * len(sizes), 0
    for g in order:
        free[g] = at
        at += sizes[g]
    out, placed = [0] * n, [False] * (n + 1)
    placed[n] = True
    s = n - 1
    k = -1
    while True:
        while s >= 0 and not placed[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = True
            s = smaller[s]
        k += 1
        if k >= n:
            return out
        s = out[k] - 1


def repeats(fragments: list[bytes], copies: list[int], phases: list[int], width: int = WIDTH) -> list[list[tuple[int, int]]]:
    """For each fragment the ranges of its windows that stand elsewhere too: in another place, or in its own copies.

    Equal windows lie alike to their runs of GRAM bytes. So the symbols of the array are words of WORD bytes, counted
    from there (``phases``: the first word's place): a window holds width // WORD - 1 whole words, whose suffixes meet in
    the array, and some bytes before and after them, which then tell the windows of such a meeting apart.
    """
    whole = width // WORD - 1
    rest = width - WORD * whole
    text = np.frombuffer(b"".join(fragments) + bytes(2 * WORD), np.uint8)
    size, phase = np.array([len(f) for f in fragments]), np.array(phases)
    start = np.concatenate([[0], np.cumsum(size)])
    words = np.maximum(size - phase, 0) // WORD
    first = np.concatenate([[0], np.cumsum(words)])
    owner = np.repeat(np.arange(len(fragments)), words)
    place = (start[:-1] + phase)[owner] + WORD * (np.arange(first[-1]) - first[owner])  # of each word, in bytes
    wide = np.lib.stride_tricks.sliding_window_view(text, WORD)
    symbols = np.unique(np.ascontiguousarray(wide[place]).view(f"V{WORD}").ravel(), return_inverse=True)[1]
    order = np.array(suffix_array(symbols.tolist()), np.int64)
    order = order[order + whole <= first[owner[order] + 1]]
    # Meetings: neighbours in the array that agree in so many words.
    view = np.lib.stride_tricks.sliding_window_view(symbols, whole) if len(symbols) >= whole else np.zeros((0, whole), np.int64)
    new = np.ones(len(order), bool)
    new[1:] = (view[order[:-1]] != view[order[1:]]).any(1)
    which = np.cumsum(new) - 1
    meeting = np.full(len(symbols) + 1, -1)
    meeting[order] = np.where(np.bincount(which, minlength=1)[which] > 1, which, -1)
    # All windows: the first whole word of each, how far before it the window begins, and the bytes around the words.
    held = np.maximum(size - width + 1, 0)
    of = np.repeat(np.arange(len(fragments)), held)
    at = np.arange(held.sum()) - np.concatenate([[0], np.cumsum(held)])[of]
    skip = (phase[of] - at) % WORD
    met = meeting[first[of] + (at + skip - phase[of]) // WORD]
    some = np.flatnonzero(met >= 0)
    where, begin, before = met[some] * WORD + skip[some], (start[of] + at)[some], skip[some]
    around = np.arange(rest)
    key = np.ascontiguousarray(text[np.where(around < before[:, None], begin[:, None] + around, begin[:, None] + WORD * whole + around)])
    sort = np.lexsort((*(np.ascontiguousarray(key[:, i : i + 8]).view(np.uint64).ravel() for i in range(0, rest, 8)), where))
    same = np.zeros(len(sort) + 1, bool)
    same[1:-1] = (where[sort][1:] == where[sort][:-1]) & (key[sort][1:] == key[sort][:-1]).all(1)
    hit = (np.array(copies) > 1)[of]
    hit[some[sort[same[1:] | same[:-1]]]] = True
    edge = np.concatenate([[0], np.cumsum(held)])
    out = []
    for f in range(len(fragments)):
        change = np.flatnonzero(np.diff(np.concatenate([[0], hit[edge[f] : edge[f + 1]].astype(np.int8), [0]])))
        out.append([(int(a), int(b)) for a, b in change.reshape(-1, 2)])
    return out


def _sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """Minima of the n values from each place on, by block-wise running minima from both sides."""
    m = len(x) - n + 1
    pad = -len(x) % n
    top = np.iinfo(np.uint64).max
    blocks = np.concatenate([x, np.full(pad, top, np.uint64)]).reshape(-1, n)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(right[:m], left[n - 1 : n - 1 + m])


def cut(data: np.ndarray, at: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """(row, run hash, fragment hash, first window, windows, phase) of all fragments of a chunk; places count from a row's
    start, the phase is the run's place in the fragment modulo WORD."""
    empty = np.zeros(0, np.int64)
    if len(data) < width:
        return empty, empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    prefix = prefix_hash(data)
    n = len(data) - GRAM + 1
    grams = mix((prefix[GRAM:] - prefix[:n]) * powers(UNBASE, n))
    ranked = (grams & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64)
    least = (_sliding_least(ranked, width - GRAM + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
    # Windows that lie in one row, and where their place changes.
    row = np.searchsorted(at, np.arange(len(least)), "right") - 1
    inside = np.arange(len(least)) + width <= at[row + 1]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return row[a], grams[least[a]], digests(data, a, b - 1 + width)[:, 0], a - at[row[a]], b - a, (least[a] - a) % WORD


def _pieces(data: np.ndarray, at: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """cut() over a chunk; a very long text in pieces that overlap by less than a window."""
    if len(data) <= _PIECE:
        yield cut(data, at, width)
        return
    for k in range(len(at) - 1):
        for s in range(0, max(1, int(at[k + 1] - at[k]) - width + 1), _PIECE):
            part = data[at[k] + s : min(at[k + 1], at[k] + s + _PIECE + width - 1)]
            row, gram, fragment, first, count, phase = cut(part, np.array([0, len(part)]), width)
            yield row + k, gram, fragment, first + s, count, phase


def _fragments(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, at in chunked(batch.column("text")):
                for row, gram, fragment, first, count, phase in _pieces(data, at, width):
                    place = pa.array(row + i)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(place), batch.column("mark").take(place), pa.array(gram.view(np.int64)), pa.array(fragment.view(np.int64)), pa.array(first), pa.array(count.astype(np.int32)), pa.array(phase.astype(np.int32))], ["doc_id", "mark", "gram", "fragment", "first", "windows", "phase"])

    return run


_RANGES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _ranges(found: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"a": a, "b": b} for a, b in r] for r in found], _RANGES)


def _sorted(width: int, block: int = 128 << 10):
    """Covered ranges of fragments. Rows come sorted by run hash; several run hashes share an array, since their windows
    can't be equal, until it has ``block`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int, bytes]] = []
        size = 0

        def out() -> pa.RecordBatch:
            found = repeats([h[4] for h in held], [h[2] for h in held], [h[3] for h in held], width)
            return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()), _ranges(found)], ["gram", "fragment", "ranges"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("gram", "fragment", "copies", "phase", "raw")), strict=True):
                if held and row[:2] == held[-1][:2]:
                    continue  # rows that repeat a document bring their fragments again
                if size > block and row[0] != held[-1][0]:
                    yield out()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield out()

    return run


def _windows(width: int):
    """A row for each window of a fragment of a very common run hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                raw = batch.column("raw")[k].as_buffer().to_pybytes()
                a = np.arange(len(raw) - width + 1)
                keys = digests(raw, a, a + width)[:, 0]
                same = pa.array(np.full(len(a), k))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(same) for c in ("gram", "fragment", "copies")), pa.array(keys.view(np.int64)), pa.array(a.astype(np.int32))], ["gram", "fragment", "copies", "window", "a"])

    return run


def covered(named: DataFrame, width: int = WIDTH, max_fragments: int = MAX_FRAGMENTS) -> DataFrame:
    """doc_id, mark, ranges: the repeated windows of each document, as (first, last + 1) by fragment."""
    spark = named.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = shared.written(named.where(F.octet_length("text") >= width).mapInArrow(shared.tidy(_fragments(width)), "doc_id bigint, mark bigint, gram bigint, fragment bigint, first bigint, windows int, phase int"), "fragments")
    keys = ["gram", "fragment"]
    distinct = places.groupBy(*keys).agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "mark", "first", "windows", "phase")).alias("at"))
    distinct = shared.written(distinct, "distinct")
    total = max(1, distinct.count())
    grams = distinct.groupBy("gram").agg(F.count("*").alias("kinds"), F.sum("copies").alias("places")).where("places > 1")
    met = shared.written(shared.lookup(distinct, grams, ["gram"], "kinds", total, "inner", spread=("fragment",)), "met")

    whole = met.where("kinds = 1").select(*keys, F.array(F.struct(F.lit(0).alias("a"), F.col("at.windows").alias("b"))).alias("ranges"))
    wanted = met.where("kinds > 1")
    by_text = wanted.groupBy(F.col("at.doc_id").alias("_id"), F.col("at.mark").alias("_mark")).agg(F.collect_list(F.struct(*keys, "copies", "kinds", "at.first", "at.windows", "at.phase")).alias("parts"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k, parts in enumerate(batch.column("parts").to_pylist()):
                raw = memoryview(batch.column("text")[k].as_buffer())
                rows += [(p["gram"], p["fragment"], p["copies"], p["kinds"], p["phase"], bytes(raw[p["first"] : p["first"] + p["windows"] + width - 1])) for p in parts]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.binary())], ["gram", "fragment", "copies", "kinds", "phase", "raw"])

    texts = named.join(by_text, named.doc_id.eqNullSafe(F.col("_id")) & (named.mark == F.col("_mark"))).select("text", "parts")
    bytes_ = shared.written(texts.mapInArrow(shared.tidy(fetch), "gram bigint, fragment bigint, copies bigint, kinds bigint, phase bigint, raw binary"), "bytes")
    few = bytes_.where(F.col("kinds") <= max_fragments).repartition(partitions, "gram").sortWithinPartitions(*keys)
    ordered = few.mapInArrow(shared.tidy(_sorted(width)), "gram bigint, fragment bigint, ranges array<struct<a:int,b:int>>")
    single = bytes_.where(F.col("kinds") > max_fragments).dropDuplicates(keys).select(*keys, "copies", "raw").mapInArrow(shared.tidy(_windows(width)), "gram bigint, fragment bigint, copies bigint, window bigint, a int")
    often = single.groupBy("gram", "window").agg(F.sum("copies").alias("times")).where("times > 1")
    dealt = shared.lookup(single, often, ["gram", "window"], "times", total, "inner", spread=("fragment", "a")).groupBy(*keys).agg(F.collect_list(F.struct("a", (F.col("a") + 1).alias("b"))).alias("ranges"))

    cover = whole.unionAll(ordered).unionAll(dealt).where(F.size("ranges") > 0)
    cover = shared.written(cover.join(met.select(*keys, "copies"), keys), "cover")
    joined = shared.lookup(places, cover, keys, "copies", total, "inner", spread=("doc_id", "first"))
    moved = F.transform("ranges", lambda r: F.struct((F.col("first") + r["a"]).alias("a"), (F.col("first") + r["b"]).alias("b")))
    return joined.groupBy("doc_id", "mark").agg(F.flatten(F.collect_list(moved)).alias("ranges"))


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, max_fragments: int = MAX_FRAGMENTS) -> DataFrame:
    """doc_id, n_bytes, ``removed`` (array of start, end in bytes) and ``kept`` (binary) of each row."""
    named = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).withColumn("mark", F.coalesce(F.xxhash64("text"), F.lit(0)))
    ranges = shared.written(covered(named, width, max_fragments), "ranges").withColumnsRenamed({"doc_id": "_id", "mark": "_mark"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                size, removed, kept = [], [], []
                for k, found in enumerate(part.column("ranges").to_pylist()):
                    value = part.column("text")[k]
                    raw = value.as_buffer().to_pybytes() if value.is_valid else b""
                    spans: list[list[int]] = []
                    for a, b in sorted((r["a"], r["b"] + width - 1) for r in found or []):
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], b)
                        else:
                            spans.append([a, b])
                    free, out = 0, []
                    for a, b in spans:
                        out.append(raw[free:a])
                        free = b
                    size.append(len(raw))
                    removed.append([{"start": a, "end": b} for a, b in spans])
                    kept.append(b"".join([*out, raw[free:]]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    joined = named.join(ranges, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(shared.tidy(run), "doc_id bigint, n_bytes bigint, removed array<struct<start:bigint,end:bigint>>, kept binary")
