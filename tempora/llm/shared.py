"""What the operators of this folder share: written tables and joins that survive hot keys."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: More rows than this are never broadcast.
BROADCAST_ROWS = 200_000
#: Copies of a hot key's row on the small side of a join.
SALTS = 64
#: A key is hot beyond this share of all rows, so that fewer keys than its inverse can be hot.
HOT_SHARE = 1 / 2000

_written: dict[str, SparkSession] = {}


#: Rows in an Arrow batch between Spark and Python. Texts are long, and a batch is held on both sides.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bounds what a batch of texts takes in a task; to be called before a query's plan is made."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def release() -> None:
    """Memory that isn't used any more goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving back what it held when its rows are through: a worker is used again, and waits between tasks."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, one is set here: a new one
    if Spark runs on one machine, else one in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tempora-") if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tempora"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def new_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder; what lies there goes when Python ends."""
    path = f"{shared_dir(spark)}/tempora-{kind}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def drop(*paths: str) -> None:
    for path in paths:
        if spark := _written.pop(path, None):
            _delete(spark, path)


@atexit.register
def _drop_all() -> None:
    for path, spark in list(_written.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended before
            return


def written(df: DataFrame, kind: str = "table") -> DataFrame:
    """df, cut from its lineage: written to the shared folder as Parquet and read again."""
    spark = df.sparkSession
    path = new_path(spark, kind)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows; as it is otherwise."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def lookup(rows: DataFrame, keyed: DataFrame, keys: Sequence[str], count: str, total: int, how: str = "left", spread: Iterable[str] = ()) -> DataFrame:
    """rows joined with keyed, which has one row a key and, in the column ``count``, how many rows hold the key.

    A hot key (over HOT_SHARE of ``total``) is dealt over SALTS partitions: its row of ``keyed`` is copied, and a row's
    place comes from the hash of the columns ``spread``. At most 1 / HOT_SHARE keys can be hot, so their list is broadcast.
    """
    keys = list(keys)
    limit = max(200, int(total * HOT_SHARE))
    hot = F.broadcast(keyed.where(F.col(count) > limit).select(*keys, F.lit(True).alias("_hot")))
    place = F.pmod(F.xxhash64(*spread), F.lit(SALTS)) if spread else F.floor(F.rand(7) * SALTS)
    left = rows.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), place.cast("int")).otherwise(F.lit(0))).drop("_hot")
    right = keyed.withColumn("_salt", F.explode(F.when(F.col(count) > limit, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
