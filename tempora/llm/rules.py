"""Quality rules with adaptive thresholds.

`measure` counts, for each text, what the rules look at. `sketch` gathers each measure per language and source into a
quantile sketch: a table of counts by bucket, the buckets exact up to 128 and of 1/64 of a power of two beyond. Two
sketches merge by adding their counts, so partial sketches combine before the shuffle, in any order, with one result;
a quantile is off by a 64th at most. `thresholds` takes from each sketch the quantile below which texts count as
ordinary, and puts the fence beyond it by a multiple of its distance from the median; `judge` joins the fences back.
Texts that fail the base rules are left out of the sketches. No fence is a fixed number: where a group's ordinary texts
are all alike, the distance taken is one bucket of the sketch.

A group of fewer than MIN_GROUP texts takes the merged sketch of its language, one of a small language that of all.
Null languages and sources are groups of their own. Null texts count as empty; repeated rows count as often as they
come, and give as many rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .textvec import Words, chunked, per_row, windows

#: Texts in a group for its own fences.
MIN_GROUP = 50
#: Measure: (whether low values fail too, share of a group's texts that is ordinary, fence in distances beyond those). The
#: share leaves out more where a group can hold much of what the rule is after. Shares are in thousandths of the words
#: (dup_line_share: of the lines that aren't empty); word_len is in hundredths of a code point.
FENCES = {
    "symbol_share": (False, 0.75, 4),
    "bang_share": (False, 0.9, 6),
    "upper_share": (False, 0.98, 3),
    "dup_line_share": (False, 0.98, 1),
    "repeat_share": (False, 0.95, 3),
    "echo_share": (False, 0.95, 3),
    "word_len": (True, 0.9, 4),
}
#: Leading bits of a number that its bucket keeps.
BITS = 7
_SYMBOL, _CONT, _UPPER = np.zeros(256, np.int64), np.ones(256, np.int64), np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_CONT[0x80:0xC0] = 0
_UPPER[list(range(0x41, 0x5B))] = 1
_WORD = pa.schema([(k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bangs", "n_upper_words", "n_echoes", "n_lines")])


def _lines(text: bytes) -> tuple[int, int]:
    """Lines that repeat an earlier one, and all lines, without empty ones."""
    lines = [x for x in text.split(b"\n") if x.strip(b"\t\n\x0b\x0c\r ")]
    return len(lines) - len(set(lines)), len(lines)


def _repeats(hashes: np.ndarray, words: Words, n: int = 5) -> np.ndarray:
    """For each word, whether an n-word window that its text has more than once covers it."""
    covered = np.zeros(len(hashes) + 1, np.int64)
    here, key = windows(hashes, words.doc, n)
    if len(here):
        key = key ^ (words.doc[here].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(here), bool)
        twice[1:] |= same
        twice[:-1] |= same
        at = here[order[twice]]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + n, -1)
    return np.cumsum(covered)[:-1] > 0


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, at in chunked(batch.column(batch.num_columns - 1)):
            words = Words(data, at)
            chars, symbols = _CONT[data] * words.inside, _SYMBOL[data]
            bangs = (data == 0x21).astype(np.int64)
            hashes = words.hashes(data)
            upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
            loud = (upper[words.ends] - upper[words.starts] >= 3) if len(words.starts) else np.zeros(0, bool)
            echo = np.zeros(len(hashes), bool)
            echo[1:] = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
            raw = data.tobytes()
            lines = np.array([_lines(raw[at[k] : at[k + 1]]) for k in range(j - i)], np.int64).reshape(-1, 2)
            columns = [words.counts, per_row(chars, at), per_row(symbols, at), lines[:, 0], per_row(_repeats(hashes, words), words.first), per_row(bangs, at), per_row(loud, words.first), per_row(echo, words.first), lines[:, 1]]
            yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:-1]), *(pa.array(np.asarray(c, np.int64)) for c in columns)], [*batch.schema.names[:-1], *_WORD.names])


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The columns ``keep`` and the counts of each text; one pass without a shuffle."""
    chosen = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]) + "".join(f", {k} bigint" for k in _WORD.names)
    return chosen.mapInArrow(shared.tidy(_measure), schema)


def _shares(counts: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda c, of=words: F.floor(F.lit(1000) * F.col(c) / of)
    return counts.withColumns({
        "symbol_share": share("n_symbols"), "bang_share": share("n_bangs"), "upper_share": share("n_upper_words"), "dup_line_share": share("n_dup_lines", F.greatest(F.col("n_lines"), F.lit(1))), "repeat_share": share("n_repeat_words"), "echo_share": share("n_echoes"),
        "word_len": F.floor(F.lit(100) * F.col("word_chars") / words),
    })


def bucket(value: Column) -> Column:
    """The bucket of a whole number from 0: itself up to 2 ** BITS, then its BITS leading bits and their place."""
    shift = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return (shift * (1 << BITS - 1) + F.call_function("shiftright", value, shift)).cast("int")


def least(number: Column) -> Column:
    """The smallest value of a bucket."""
    shift = F.greatest(F.floor(number / (1 << BITS - 1)) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", (number - shift * (1 << BITS - 1)).cast("bigint"), shift)


def sketch(shares: DataFrame, by: tuple[str, ...] = ("lang", "source"), measures: tuple[str, ...] = tuple(FENCES), weight: Column | None = None) -> DataFrame:
    """Rows (by..., measure, bucket, n). Counts of the same bucket add up: sketches merge by union and sum.

    A row counts ``weight`` times; a group of which no row counts has buckets of 0."""
    long = shares.select(*by, (F.lit(1) if weight is None else weight).alias("_weight"), F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in measures))).alias("x"))
    return long.groupBy(*by, "x.measure", "x.bucket").agg(F.sum("_weight").alias("n"))


def merge(sketches: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return sketches.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, by: tuple[str, ...], at: dict[str, float]) -> DataFrame:
    """Rows (by..., measure, total, a column for each of ``at``). A group has a few hundred buckets at most."""
    keys = [*by, "measure"]
    up = Window.partitionBy(*keys).orderBy("bucket")
    ranked = sketches.withColumn("upto", F.sum("n").over(up)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    return ranked.groupBy(*keys).agg(F.first("total").alias("total"), *(F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * q), F.col("bucket"))).alias(k) for k, q in at.items())).withColumns({k: least(F.col(k)) for k in at})


def thresholds(sketches: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """For each (lang, source): ``<measure>_low`` and ``<measure>_high``, the range that passes."""
    shares = {share for _, share, _ in FENCES.values()}
    at = {"mid": 0.5} | {f"high{share}": share for share in shares} | {f"low{share}": 1 - share for low, share, _ in FENCES.values() if low}
    at = {k.replace(".", "_"): v for k, v in at.items()}
    own = quantiles(sketches, ("lang", "source"), at)
    lang = quantiles(merge(sketches, ("lang",)), ("lang",), at)
    whole = quantiles(merge(sketches, ()), (), at)
    up = lambda df, p: df.withColumnsRenamed({k: f"{p}_{k}" for k in ("total", *at)})
    l, w = up(lang, "l").withColumnRenamed("lang", "_lang"), up(whole, "w").withColumnRenamed("measure", "_measure")  # noqa: E741
    joined = own.join(l.withColumnRenamed("measure", "_m"), (F.col("_m") == own.measure) & F.col("_lang").eqNullSafe(own.lang), "left").join(F.broadcast(w), F.col("_measure") == own.measure, "left")
    pick = lambda k: F.when(F.col("total") >= min_group, F.col(k)).when(F.col("l_total") >= min_group, F.col(f"l_{k}")).otherwise(F.col(f"w_{k}"))
    beyond = lambda end, times: F.greatest(F.abs(end - pick("mid")), least(bucket(end) + 1) - end) * times
    fences = []
    for m, (low, share, times) in FENCES.items():
        high, bottom = (pick(f"{side}{share}".replace(".", "_")) if side == "high" or low else None for side in ("high", "low"))
        fences.append(F.max(F.when(own.measure == m, high + beyond(high, times))).alias(f"{m}_high"))
        if low:
            fences.append(F.max(F.when(own.measure == m, bottom - beyond(bottom, times))).alias(f"{m}_low"))
    return joined.groupBy(own.lang, own.source).agg(*fences, F.max("total").alias("n_group"))


def judge(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_group: int = MIN_GROUP) -> DataFrame:
    """doc_id, the counts, ``base_failed``, ``kept`` and the first rule that a text breaks (``reason``)."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col(text).alias("text"))
    counts = shared.written(_shares(measure(named)), "measures")
    total = counts.count()
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    fences = shared.written(thresholds(sketch(counts, weight=F.when(failed, 0).otherwise(1)), min_group), "fences")
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    fences = fences.select(key("lang").alias("_l"), key("source").alias("_s"), *fences.columns[2:])
    rows = counts.withColumns({"_l": key("lang"), "_s": key("source")})
    if fences.limit(shared.BROADCAST_ROWS + 1).count() <= shared.BROADCAST_ROWS:
        joined = rows.join(F.broadcast(fences), ["_l", "_s"], "left")
    else:
        joined = shared.lookup(rows, fences, ["_l", "_s"], "n_group", total, spread=("doc_id", "n_words", "word_chars"))
    reason = F.when(failed, F.lit("base"))
    for m, (low, _, _) in FENCES.items():
        reason = reason.when(F.col(m) > F.col(f"{m}_high"), F.lit(m))
        if low:
            reason = reason.when(F.col(m) < F.col(f"{m}_low"), F.lit(m))
    return joined.select("doc_id", *_WORD.names[:5], failed.alias("base_failed"), reason.alias("reason")).withColumn("kept", F.col("reason").isNull())
