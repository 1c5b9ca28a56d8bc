"""The index: statuses, postings, document lengths, term and collection statistics as Parquet tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.sources import tables


def word_tokens(text: Column) -> Column:
    """Tokens by the plain analyzer: runs of ASCII letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def postings(statuses: DataFrame, analyze: Callable[[Column], Column] = word_tokens) -> DataFrame:
    """id, screen_name, term, tf. Tokens are counted within a partition before the shuffle."""
    words = statuses.select("id", F.lower("screen_name").alias("screen_name"), F.explode(analyze(F.col("text"))).alias("term"))
    return words.groupBy("id", "screen_name", "term").agg(F.count("*").alias("tf"))


def doc_lengths(found: DataFrame) -> DataFrame:
    """id, screen_name, dl (tokens), dt (distinct terms), mt (the most that a term comes)."""
    return found.groupBy("id", "screen_name").agg(F.sum("tf").alias("dl"), F.count("*").alias("dt"), F.max("tf").alias("mt"))


def term_stats(found: DataFrame) -> DataFrame:
    return found.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ctf"))


def coll_stats(statuses: DataFrame, terms: DataFrame) -> DataFrame:
    totals = terms.agg(F.count("*").alias("num_terms"), F.sum("df").alias("sum_df"), F.sum("ctf").alias("sum_ctf"))
    return statuses.agg(F.count("*").alias("num_docs")).crossJoin(totals)


@dataclass
class Index:
    """The tables of one collection, by the names that plans use."""

    frames: dict[str, DataFrame]
    path: str

    def __getitem__(self, name: str) -> DataFrame:
        return self.frames[name]


_open: dict[tuple[str, str], Index] = {}
_paths: list[tuple[SparkSession, str]] = []


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir; one is set where there is none)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        # Machines of a cluster share no temporary folder, but the warehouse.
        base = "file://" + tempfile.mkdtemp(prefix="tempora-") if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tempora"
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/tempora-{kind}-{uuid.uuid4().hex}"
    _paths.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _paths:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended before
            return


def counted(words: DataFrame) -> DataFrame:
    """id, screen_name, term, tf, dl of rows (id, screen_name, words) that lie in partitions by id. A document's words are
    sorted and its runs counted within its row, so that tasks hold documents and not counts of all their terms; rows of
    one document add up before. Terms come in order."""
    docs = words.groupBy("id", "screen_name").agg(F.sort_array(F.flatten(F.collect_list("words"))).alias("words"))
    docs = docs.withColumn("dl", F.sum(F.size("words")).over(Window.partitionBy("id"))).where(F.size("words") > 0)
    # Where each run of equal words ends.
    last = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: ~F.get("words", i).eqNullSafe(F.get("words", i + 1)))
    docs = docs.withColumn("last", last)
    runs = F.transform("last", lambda e, k: F.struct(F.get("words", e).alias("term"), (e - F.coalesce(F.get("last", k - 1), F.lit(-1))).cast("bigint").alias("tf")))
    return docs.select("id", "screen_name", "dl", F.inline(runs)).select("id", "screen_name", "term", "tf", "dl")


def build(statuses: DataFrame, path: str, analyze: Callable[[Column], Column] = word_tokens) -> None:
    """Writes the index (overwriting): statuses in files sorted by time, and each posting twice, in ranges of terms
    (postings) and of ids (vectors), so that filters on those skip files, row groups and pages."""
    spark = statuses.sparkSession
    statuses.sortWithinPartitions("epoch").write.mode("overwrite").parquet(f"{path}/statuses")
    kept = spark.read.parquet(f"{path}/statuses")
    # A posting carries its document's length, so that scoring needs no other table. Texts move once, to ranges of ids;
    # the counts of a document are then made where it lies. Ranges of terms are split by id within a common term.
    placed = kept.select("id", F.lower("screen_name").alias("screen_name"), "text").repartitionByRange(tables.pieces(kept), "id")
    counted(placed.select("id", "screen_name", analyze(F.col("text")).alias("words"))).write.mode("overwrite").parquet(f"{path}/vectors")
    found = spark.read.parquet(f"{path}/vectors")
    found.repartitionByRange(tables.pieces(found), "term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
    doc_lengths(found).repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/doclen")
    found = spark.read.parquet(f"{path}/postings")
    term_stats(found).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/term_stats")
    coll_stats(kept, spark.read.parquet(f"{path}/term_stats")).write.mode("overwrite").parquet(f"{path}/coll")


def read(spark: SparkSession, path: str) -> Index:
    frames = {n: spark.read.parquet(f"{path}/{n}") for n in ("statuses", "postings", "vectors", "doclen", "term_stats", "coll")}
    frames["topics"] = tables.topics(frames["statuses"].select("screen_name"))
    return Index(frames, path)


def of(spark: SparkSession, sf_dir: str) -> Index:
    """The index over the given tables, built once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _open:
        path = shared_path(spark, "index")
        build(tables.statuses(spark, sf_dir), path)
        _open[key] = read(spark, path)
    return _open[key]


def compact(spark: SparkSession, path: str, out: str, files: int = 1) -> None:
    """A table's files merged into a few."""
    spark.read.parquet(path).coalesce(files).write.mode("overwrite").parquet(out)
