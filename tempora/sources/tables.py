"""Base views: statuses, topics, pages as an encyclopedia, judgements; and readers of external formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A status as JSON: what batch and live ingest read.
STATUS_JSON = """id bigint, created_at string, text string, lang string, in_reply_to_status_id bigint, in_reply_to_user_id bigint,
    retweet_count int, geo struct<lat:double,lon:double>, user struct<screen_name:string,friends_count:int,followers_count:int,statuses_count:int>,
    retweeted_status struct<id:bigint,retweet_count:int,user:struct<id:bigint>>"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(name: str) -> Column:
    """UTC seconds of a timestamp without zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', CAST({name} AS TIMESTAMP_NTZ))").cast("bigint")


#: Bytes of files for each partition of a step, whatever the session's number of partitions is.
PIECE = 16 << 20


def pieces(read: DataFrame, least: int | None = None) -> int:
    """In how many partitions a step deals a table that is read from files, so that no task's share grows with the table."""
    size = int(str(read._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(read.sparkSession.sparkContext.defaultParallelism if least is None else least, -(-size // PIECE))


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as statuses: each with its event's time, and counts of its event's user. Events meet their users first,
    so that texts move once."""
    events = table(spark, sf_dir, "events")
    users = events.groupBy("user_id").agg(F.count("*").alias("statuses_count"))
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", "lang", "source").repartition(pieces(docs), "doc_id")
    timed = events.join(users, "user_id")
    joined = docs.join(timed, docs.doc_id == timed.event_id)
    return joined.select(
        F.col("doc_id").alias("id"), F.col("source").alias("screen_name"), "text", "lang", seconds("ts").alias("epoch"),
        F.when(F.col("event_type") == "signup", F.col("doc_id") + 1000000).otherwise(F.lit(0)).cast("bigint").alias("retweeted_status_id"),
        F.when(F.col("event_type") == "view", F.col("doc_id") + 1).otherwise(F.lit(0)).cast("bigint").alias("in_reply_to_status_id"),
        F.floor("value").cast("int").alias("followers_count"), F.col("statuses_count").cast("bigint").alias("statuses_count"),
    )


def topics(statuses: DataFrame) -> DataFrame:
    """topic, source: a disjoint partition of the sources."""
    return statuses.select(F.lower("screen_name").alias("source")).distinct().select(F.concat(F.lit("t"), (F.substring("source", 4, 9).cast("int") % 5).cast("string")).alias("topic"), "source")


def wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as encyclopedia entries: id, title, body, category."""
    pages = table(spark, sf_dir, "pages")
    body = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "[\\x20\\x09-\\x0D]+", " "))
    return pages.select(F.col("page_id").alias("id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), body.alias("body"), F.regexp_extract("url", "^[a-z]+://[^/]+/([^/]+)", 1).alias("category"))


def json_statuses(spark: SparkSession, path: str) -> DataFrame:
    """Statuses from a folder of JSON lines. Absent numbers are 0; the count of retweets is the larger of both."""
    return flatten(spark.read.schema(STATUS_JSON).json(path))


def flatten(raw: DataFrame) -> DataFrame:
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    return raw.where("id is not null").select(
        "id", F.lower("user.screen_name").alias("screen_name"), "text", "lang", F.unix_timestamp(F.to_timestamp("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("epoch"),
        number("retweeted_status.id").alias("retweeted_status_id"), number("retweeted_status.user.id").alias("retweeted_user_id"), F.greatest(number("retweet_count"), number("retweeted_status.retweet_count")).alias("retweeted_count"),
        number("in_reply_to_status_id").alias("in_reply_to_status_id"), number("in_reply_to_user_id").alias("in_reply_to_user_id"), number("user.friends_count").alias("friends_count"), number("user.followers_count").alias("followers_count"), number("user.statuses_count").alias("statuses_count"), "geo",
    )


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """qid, docno, rel from lines of four fields; malformed lines and negative judgements go."""
    raw = spark.read.text(path).select(F.split(F.trim("value"), " ").alias("f")).where(F.size("f") == 4)
    return raw.select(F.element_at("f", 1).alias("qid"), F.element_at("f", 3).alias("docno"), F.expr("try_cast(element_at(f, 4) AS int)").alias("rel")).where("rel >= 0")


def term_statistics(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(term, df, ctf) and the totals of a tab-separated file, maybe gzipped, whose first line has the totals.

    The totals are the line of most occurrences of all: no term has as many. Malformed lines go.
    """
    raw = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") == 3)
    rows = raw.select(F.element_at("f", 1).alias("term"), F.expr("try_cast(element_at(f, 2) AS bigint)").alias("df"), F.expr("try_cast(element_at(f, 3) AS bigint)").alias("ctf")).where("df is not null and ctf is not null")
    totals = rows.orderBy(F.desc("ctf"), F.desc("df")).limit(1)
    return rows.join(F.broadcast(totals.select(F.col("term").alias("_t"), F.col("ctf").alias("_c"))), (F.col("term") == F.col("_t")) & (F.col("ctf") == F.col("_c")), "left_anti"), totals.select(F.col("df").alias("num_docs"), F.col("ctf").alias("sum_ctf"))


def stop_words(spark: SparkSession, path: str) -> frozenset[str]:
    """A stop list: one word a line."""
    return frozenset(r.value.strip() for r in spark.read.text(path).where("trim(value) <> ''").collect())
