"""Mixing sources to target weights by Sainte-Laguë apportionment.

The documents of a source are dealt by a seeded hash to shards, and lie in each shard on a line in seeded order. The
line is cut into blocks of ``block`` words (the last may be shorter). Blocks are apportioned by highest quotients,
first to sources by their targets, then to the shards of a source by their blocks; no quota exceeds ``repeats`` times
the blocks there are. A quota takes whole passes over the line and, of the rest, blocks spread evenly from a seeded
start. Which words of a document that takes is a closed form by block number, so no block is ever a row.

Null texts have size 0; a null source is a source of its own and comes last. Repeated rows count as often as they
come. An empty table gives no rows. The driver holds a row for each source and shard: at most SHARDS + sources.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Shards of all sources together, about, and documents in a shard at least.
SHARDS, SHARD_DOCS = 8192, 64
WORD = r"[^\x20\x09-\x0D]+"


def water_fill(sizes: Sequence[float], weights: Sequence[float], repeats: float = 3.0) -> list[float]:
    """Shares of sum(sizes) by weight, none above repeats times its size; the excess goes to the others by weight."""
    left, open_ = float(sum(sizes)), set(range(len(sizes)))
    out = [0.0] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in sorted(open_) if unit * weights[i] > repeats * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(repeats * sizes[i])
            left -= out[i]
            open_.discard(i)
    return out


def sainte_lague(weights: Sequence[float], caps: Sequence[int], seats: int) -> list[int]:
    """Seats by the highest quotients weight / (2 k + 1), ties to the first; none over its cap.

    Begins just below what the quotients give at the common divisor, so the number of heap steps is that of parties.
    """
    n, total = len(weights), float(sum(weights))
    seats = min(seats, sum(caps))
    if not n or total <= 0 or seats <= 0:
        return [0] * n
    low, high = 0.0, 4 * seats / total + 1
    at = lambda d: [min(c, max(0, math.floor(w * d + 0.5))) for w, c in zip(weights, caps, strict=True)]
    while sum(at(high)) < seats and high < 1e30:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if sum(at(mid)) <= seats:
            low = mid
        else:
            high = mid
    out = at(low)
    heap = [(-w / (2 * k + 1), i) for i, (w, k, c) in enumerate(zip(weights, out, caps, strict=True)) if k < c and w > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * out[i] + 1), i))
    return out


def _among(b: Column, blocks: Column, rest: Column, start: Column) -> Column:
    """Chosen blocks among the first b of a line."""
    upto = lambda c: F.floor(c * rest / blocks)  # noqa: E731  chosen among the first c, counted from the start
    return F.when(b + start <= blocks, upto(b + start) - upto(start)).otherwise(rest - upto(start) + upto(b + start - blocks))


def _ranges(begin: Column, end: Column, blocks: Column, rest: Column, start: Column, block: Column) -> Column:
    """For a document on the words begin to end of a line: (start, end) in its own words of each chosen block."""
    at = F.sequence(F.floor(begin / block), F.floor((end - 1) / block))
    chosen = F.filter(at, lambda b: _among(b + 1, blocks, rest, start) > _among(b, blocks, rest, start))
    spans = F.transform(chosen, lambda b: F.struct((F.greatest(b * block, begin) - begin).cast("int").alias("start"), (F.least((b + 1) * block, end) - begin).cast("int").alias("end")))
    return F.when((end > begin) & (rest > 0), spans).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def _chosen(x: Column, blocks: Column, rest: Column, start: Column, block: Column) -> Column:
    """Words of the chosen blocks in the first x words of a line."""
    among = lambda b: _among(b, blocks, rest, start)
    b = F.floor(x / block)
    return among(b) * block + F.when(b < blocks, (among(b + 1) - among(b)) * (x - b * block)).otherwise(F.lit(0))


def sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source, size."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))


def mix(docs: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), repeats: int = 3, block: int = 256, seed: int = 17, text: str = "text") -> DataFrame:
    """doc_id, source, size, source_size, target (of the source), taken (words of the document in the mix), passes (whole
    times that it is taken) and ranges (start and end, in its words, of the blocks taken besides)."""
    spark = docs.sparkSession
    sized = shared.written(sizes(docs, text), "sizes")
    found = sorted((tuple(r) for r in sized.groupBy("source").agg(F.sum("size"), F.count("*")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    targets = water_fill([r[1] for r in found], [weights[i % len(weights)] for i in range(len(found))], repeats)
    n_docs = max(1, sum(r[2] for r in found))
    sources = [(r[0], r[1], t, max(1, min(math.ceil(SHARDS * r[2] / n_docs), r[2] // SHARD_DOCS))) for r, t in zip(found, targets, strict=True)]
    known = F.broadcast(spark.createDataFrame(sources, "_source string, source_size bigint, target double, shards bigint"))
    dealt = sized.join(known, sized.source.eqNullSafe(known["_source"]), "left").drop("_source").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("shards")))
    lines = dealt.groupBy("source", "shard").agg(F.sum("size").alias("words")).collect()

    by_source: dict[str | None, list] = {r[0]: [] for r in found}
    for r in sorted(lines, key=lambda r: r[1]):
        by_source[r[0]].append((r[1], r[2], -(-r[2] // block)))
    blocks = [sum(x[2] for x in by_source[s[0]]) for s in sources]
    wanted = [s[2] * b / s[1] if s[1] else 0.0 for s, b in zip(sources, blocks, strict=True)]
    quotas = sainte_lague(wanted, [repeats * b for b in blocks], round(sum(wanted)))
    plan = []
    for s, quota in zip(sources, quotas, strict=True):
        own = by_source[s[0]]
        for (shard, _, n), q in zip(own, sainte_lague([x[2] for x in own], [repeats * x[2] for x in own], quota), strict=True):
            plan.append((s[0], shard, n, q // n if n else 0, q % n if n else 0))
    plan = F.broadcast(spark.createDataFrame(plan, "_source string, _shard bigint, blocks bigint, passes bigint, rest bigint"))

    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("end", F.sum("size").over(order)).join(plan, dealt.source.eqNullSafe(plan["_source"]) & (F.col("shard") == F.col("_shard")), "left")
    start = F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), F.greatest("blocks", F.lit(1)))
    args = (F.greatest("blocks", F.lit(1)), F.col("rest"), start, F.lit(block))
    taken = F.col("passes") * F.col("size") + _chosen(F.col("end"), *args) - _chosen(F.col("end") - F.col("size"), *args)
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("bigint").alias("taken"), "passes", _ranges(F.col("end") - F.col("size"), F.col("end"), *args).alias("ranges"))


def realise(docs: DataFrame, mixed: DataFrame, keep: Sequence[str] = ("lang", "source")) -> DataFrame:
    """The mix as rows: doc_id, text and the columns ``keep``, a row for each whole time that a document is taken and one
    for each run of adjacent chosen blocks. Rows of one doc_id and size are taken alike, as the one most taken."""
    most = mixed.groupBy(F.col("doc_id").alias("_id"), F.col("size").alias("_size")).agg(F.max(F.struct("taken", "passes", "ranges")).alias("m"))
    plan = most.where("m.taken > 0").select("_id", "_size", F.col("m.passes").alias("_passes"), F.col("m.ranges").alias("_ranges"))
    sized = docs.select("doc_id", "text", *keep).withColumn("_n", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint"))
    joined = sized.join(plan, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_n") == F.col("_size"))).select("doc_id", "text", *keep, "_passes", "_ranges")
    word = re.compile(WORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                row, out = [], []
                for k, (text, passes, ranges) in enumerate(zip(*(part.column(c).to_pylist() for c in ("text", "_passes", "_ranges")), strict=True)):
                    row += [k] * passes
                    out += [text] * passes
                    runs: list[list[int]] = []
                    for r in ranges:
                        if runs and runs[-1][1] == r["start"]:
                            runs[-1][1] = r["end"]
                        else:
                            runs.append([r["start"], r["end"]])
                    if runs:
                        words = [m.span() for m in word.finditer(text)]
                        row += [k] * len(runs)
                        out += [text if (a, b) == (0, len(words)) else text[words[a][0] : words[b - 1][1]] for a, b in runs]
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), pa.array(out, pa.string()), *(part.column(c).take(at) for c in keep)], ["doc_id", "text", *keep])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", "text", *keep))
    return joined.mapInArrow(shared.tidy(run), schema)
