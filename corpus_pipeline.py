"""A corpus pipeline: quality, near duplicates, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each as Parquet and reads it again as the
next one's docs. All but the last return the columns of ``documents``. The stages are defined for the cases that the
operators name (nulls, empty and long texts, ties, empty tables); columns beyond those of ``documents`` are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import jaccard, mixing, packing, pii, quality, shared
from tempora.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents with a lower score go.
LEAST_SCORE = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects. Labels train the model and are not looked at after that."""
    model = quality.train(docs, shared.table(spark, sf_dir, "labels"))
    return quality.score(docs, model, keep=COLUMNS, text="text").where(F.col("score") >= LEAST_SCORE).select(*COLUMNS)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one of the least doc_id, of each group connected by similarities of 0.8 or more."""
    shared.small_batches(spark)
    named = docs.select(*COLUMNS)
    mark = F.xxhash64("text")  # rows that repeat a doc_id with another text go or stay by themselves
    found = jaccard.join(named.withColumn("_mark", mark), keep=("_mark",))
    again = shared.written(found.where("doc_id <> class_id").select(F.col("doc_id").alias("_id"), "_mark").distinct(), "duplicates")
    kept = named.join(shared.small(again), (F.coalesce("doc_id", F.lit(-(1 << 63))) == F.col("_id")) & (mark == F.col("_mark")), "left_anti")
    if named.groupBy("doc_id").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the names of its kinds."""
    shared.small_batches(spark)
    found = pii.find_spans(docs, keep=("doc_id", "lang", "source", "n_chars"), redacted=True)
    changed = F.size("spans") > 0
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.when(changed, F.length("redacted").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and cuts documents so that sources meet their targets: a row for each whole time that a document is taken
    and one for each run of adjacent blocks of it that the mix chose besides. Documents that aren't taken go."""
    shared.small_batches(spark)
    named = docs.select(*COLUMNS)
    rows = mixing.realise(named, mixing.mix(named))
    return rows.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of 2048."""
    shared.small_batches(spark)
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicates_stage), ("pii", pii_stage), ("mixing", mixing_stage), ("packing", packing_stage)]
#: Language models of n-grams, locality-sensitive hashing and packing have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
