"""Best-fit packing of token sequences with large-item matching.

All pieces of one length are alike, so a packing is planned on how many pieces each length has: 2048 numbers, whatever
the corpus. Lengths above a third of the capacity go at most two to a bin: from the longest down, each is matched with
the longest that still fits. Smaller ones then go, from the longest down, to the tightest gaps that take them, many
bins at a time, and only what finds no gap opens bins. The plan says which ranks of a length go to which bins and
where; a piece finds its place from its rank among the pieces of its length, counted in two steps (within salted groups of bounded
share, then over the groups' totals), so no length, however common, is ranked by one task.

Null and empty texts give one piece that holds the end mark alone. An empty table gives no rows. Repeated rows give as
many pieces as they come; those get places of their own. Very long texts are cut into as many pieces as they need.
Columns beyond the named ones are not looked at.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .textvec import Words, chunked, mix, word_hash

CAPACITY, END = 2048, 0
#: Groups that the pieces of one length are ranked in, at most; the driver holds CAPACITY x SALTS counts.
SALTS = 1024
#: Words that a worker keeps the ids of.
CACHE = 1_500_000
_LATE = 100_000
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_MARKS, _ALNUM = np.zeros(256, bool), np.zeros(256, bool)
_MARKS[list(b".,;:!?")] = True
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True


def tokens_of(data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, keys) of the parts of a chunk's words whose ids don't depend on what is beside them: words, and up to
    four marks at a word's end by themselves where they follow a letter or digit. Case doesn't count, but in words that
    can be marks of the tokenizer's own. Two parts with different ids have one key of 64 bits by chance only."""
    stop = words.ends.copy()
    for _ in range(4):
        stop -= (stop - 1 > words.starts) & _MARKS[data[stop - 1]]
    last, lead = data[stop - 1], data[np.maximum(stop - 2, 0)]
    letter = _ALNUM[last] | ((lead == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7) & (stop - 2 >= words.starts))
    split = (stop < words.ends) & letter
    starts, ends = words.starts, np.where(split, stop, words.ends)
    if split.any():
        place = np.repeat(np.arange(len(starts)), 1 + split)
        second = np.concatenate([[False], place[1:] == place[:-1]])
        starts, ends = np.where(second, stop[place], starts[place]), np.where(second, words.ends[place], ends[place])
    keys = word_hash(_FOLD[data], starts, ends)
    if (bars := np.concatenate([[0], np.cumsum(data == 0x7C)]))[-1]:
        own = bars[ends] > bars[starts]
        keys = np.where(own, mix(word_hash(data, starts, ends) + np.uint64(1)), keys)
    return starts, ends, keys


class Encoder:
    """Token ids of texts, by a tokenizer that drops white space and case and cuts letters, digits and marks apart; each
    word is encoded once while there is room. Ids lie in one array; a sorted array of keys tells where."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self._clear()

    def _clear(self) -> None:
        # Sorted keys and the words' numbers, the late ones apart; of each word, where its ids begin.
        self.known = [(np.zeros(0, np.uint64), np.zeros(0, np.int64)) for _ in range(2)]
        self.at, self.ids, self.size = np.zeros(1, np.int64), np.zeros(1 << 16, np.uint32), 0

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of words, -1 for new ones."""
        out = np.full(len(keys), -1)
        for key, number in self.known:
            if len(key):
                k = np.minimum(np.searchsorted(key, keys), len(key) - 1)
                out = np.where(key[k] == keys, number[k], out)
        return out

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        """keys: sorted and new."""
        ids, count = [], []
        for i in range(0, len(words), 2000):
            for e in self.encode(words[i : i + 2000], add_special_tokens=False):
                ids += e.ids
                count.append(len(e.ids))
        first = int(self.at[-1])
        if first + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:first], np.zeros(first + 2 * len(ids) + len(self.ids), np.uint32)])
        self.ids[first : first + len(ids)] = ids
        numbers = self.size + np.arange(len(keys))
        self.at = np.concatenate([self.at, first + np.cumsum(count)])
        self.size += len(keys)
        add = lambda old, new: tuple(np.insert(o, np.searchsorted(old[0], new[0]), n) for o, n in zip(old, new, strict=True))
        late = add(self.known[1], (keys, numbers))
        self.known = [self.known[0], late] if len(late[0]) < _LATE else [add(self.known[0], late), (late[0][:0], late[1][:0])]

    def __call__(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row + 1, ids, len + 1 places of each text's first id) for runs of rows."""
        for i, j, data, at in chunked(column):
            words = Words(data, at)
            starts, ends, keys = tokens_of(data, words)
            distinct, one, which = np.unique(keys, return_index=True, return_inverse=True)
            number = self._find(distinct)
            if len(new := np.flatnonzero(number < 0)):
                if self.size + len(new) > CACHE:
                    self._clear()
                    new = np.arange(len(distinct))
                raw = data.tobytes()
                self._learn(distinct[new], [raw[starts[k] : ends[k]].decode() for k in one[new]])
                number = self._find(distinct)
            number = number[which]
            count = (self.at[number + 1] - self.at[number]) if len(number) else np.zeros(0, np.int64)
            edge = np.concatenate([[0], np.cumsum(count)])
            ids = self.ids[np.repeat(self.at[number] - edge[:-1], count) + np.arange(edge[-1])]
            yield i, j, ids, edge[np.searchsorted(starts, at)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end: int = END, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ``ids`` of each piece; one pass without a shuffle."""
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])]
    mark = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for i, j, every, edge in encode(batch.column(1)):
                row, piece, start, length, crc, own = [], [], [], [], [], []
                for k in range(j - i):
                    raw = every[edge[k] : edge[k + 1]].astype("<u4").tobytes() + mark
                    n = len(raw) // 4
                    for p, s in enumerate(range(0, n, capacity)):
                        cut = raw[4 * s : 4 * (s + capacity)]
                        row.append(i + k)
                        piece.append(p)
                        start.append(s)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        if ids:
                            own.append(np.frombuffer(cut, "<u4").astype(np.int32))
                more = [pa.array(own, pa.list_(pa.int32()))] if ids else []
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), *more], names)

    schema = f"doc_id {chosen.schema[0].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if ids else "")
    return chosen.mapInArrow(shared.tidy(run), schema)


class Plan:
    """placements: for each length, (first rank, first bin, offset) by rank; bins: how many there are."""

    def __init__(self, counts: Mapping[int, int], capacity: int = CAPACITY) -> None:
        self.capacity, self.bins = capacity, 0
        self.placements: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        self._ranks: dict[int, int] = defaultdict(int)
        self._gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first bin, number of bins)
        self._sizes: list[int] = []  # gaps there are, ascending
        left = {n: c for n, c in counts.items() if c > 0}
        if left and not 0 < min(left) <= max(left) <= capacity:
            raise ValueError("a piece is empty or over the capacity")
        large = sorted(n for n in left if 3 * n > capacity)
        while large:
            longest = large[-1]
            k = bisect.bisect_right(large, capacity - longest) - 1
            if k < 0:
                self._open(longest, left.pop(longest))
                large.pop()
                continue
            other = large[k]
            pairs = left[longest] // 2 if other == longest else min(left[longest], left[other])
            if other == longest and not pairs:
                # One is left of the length that pairs with itself: the next longest below it that there is, or none.
                large.pop()
                if k:
                    other = large[k - 1]
                    self._pair(longest, other, 1)
                    left[other] -= 1
                    if not left[other]:
                        large.remove(other)
                else:
                    self._open(longest, 1)
                left[longest] = 0
                continue
            self._pair(longest, other, pairs)
            for n in (longest, other):
                left[n] -= pairs
            large = [n for n in large if left[n]]
        for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
            self._fit(n, left[n])

    def _place(self, length: int, first: int, bins: int, offset: int) -> None:
        self.placements[length].append((self._ranks[length], first, offset))
        self._ranks[length] += bins
        self._add(self.capacity - offset - length, first, bins)

    def _add(self, gap: int, first: int, bins: int) -> None:
        if gap and bins:
            if not self._gaps[gap]:
                bisect.insort(self._sizes, gap)
            self._gaps[gap].append((first, bins))

    def _open(self, length: int, bins: int) -> None:
        if bins:
            self.bins += bins
            self._place(length, self.bins - bins, bins, 0)

    def _pair(self, a: int, b: int, bins: int) -> None:
        first, self.bins = self.bins, self.bins + bins
        for length, offset in ((a, 0), (b, a)):
            self.placements[length].append((self._ranks[length], first, offset))
            self._ranks[length] += bins
        self._add(self.capacity - a - b, first, bins)

    def _fit(self, length: int, count: int) -> None:
        while count:
            k = bisect.bisect_left(self._sizes, length)
            if k == len(self._sizes):
                # As many bins as are needed if each is filled with this length.
                bins = -(-count // (self.capacity // length))
                self._open(length, bins)
                count -= bins
                continue
            gap = self._sizes[k]
            first, bins = self._gaps[gap].pop()
            if not self._gaps[gap]:
                self._sizes.pop(k)
            used = min(bins, count)
            self._add(gap, first + used, bins - used)
            self._place(length, first, used, self.capacity - gap)
            count -= used


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``. found: doc_id, piece, length and more columns; read twice."""
    spark = found.sparkSession
    n = min(SALTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)).cast("int"))
    groups = salted.groupBy("length", "_salt").agg(F.count("*").alias("n")).toArrow()  # capacity x SALTS rows at most, whatever the partitions
    table = np.zeros((capacity + 1, n), np.int64)
    table[groups.column("length").to_numpy(), groups.column("_salt").to_numpy()] = groups.column("n").to_numpy()
    plan = Plan({int(k): int(table[k].sum()) for k in np.flatnonzero(table.any(1))}, capacity)
    table = np.cumsum(table, 1) - table  # the first rank of each salt
    ranks, bins, offsets = {}, {}, {}
    for length, rows in plan.placements.items():
        ranks[length], bins[length], offsets[length] = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    sent = spark.sparkContext.broadcast((table, ranks, bins, offsets))

    columns = found.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, ranks, bins, offsets = sent.value
        for batch in batches:
            length, salt, rank = (batch.column(k).to_numpy() for k in ("length", "_salt", "_rank"))
            rank = rank + table[length, salt]
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                k = np.searchsorted(ranks[x], rank[at], "right") - 1
                sequence[at] = bins[x][k] + rank[at] - ranks[x][k]
                offset[at] = offsets[x][k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id bigint, offset bigint"
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("_rank", F.row_number().over(order).cast("bigint") - 1)

    return ranked.select(*columns, "_salt", "_rank").mapInArrow(shared.tidy(place), schema)


def pack_documents(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    return pack(shared.written(pieces(docs, tokenizer, text, doc_id, capacity), "pieces"), capacity)
