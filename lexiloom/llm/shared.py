"""What the operators of this subpackage share: the cluster's shared folder, written tables, checked broadcasts."""

from __future__ import annotations

import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a side may have to be broadcast; beyond it, joins shuffle.
BROADCAST_ROWS = 50_000

#: Whole texts that a Python worker gets at once; what follows from them may be many times larger.
TEXT_BATCH = 4000

#: The columns of the documents table, in order.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``; only a local master may fall back to a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lexiloom-")
        spark.sparkContext.setCheckpointDir(found)
        import atexit

        atexit.register(shutil.rmtree, found, ignore_errors=True)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage and survives lost executors.

    The files go when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexiloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def bounded_join(df: DataFrame, small: DataFrame, on: list[str], how: str = "left", most: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``small`` by broadcast if its counted rows are at most ``most``, else by a shuffle that AQE may split."""
    rows = small.limit(most + 1).count()
    return df.join(F.broadcast(small) if rows <= most else small, on, how)


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space, tab, LF, VT, FF and CR; null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of the text; null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def power_of_two(n: float) -> int:
    """The least power of two that is at least ``n``, 1 at least."""
    return 1 << max(0, int(-(-n // 1)) - 1).bit_length()


def release(df: DataFrame) -> None:
    """Let Spark's cleaner drop the shuffle files of steps that are done; it waits for collected references."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for temporary columns that no column of ``df`` has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def lean_batches(spark: SparkSession, rows: int = TEXT_BATCH) -> None:
    """Let Python workers get at most ``rows`` whole texts at once, from here on in this session; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) plus rid, unlike for all rows, which orders documents.

    Usually rid is the doc_id. If doc_ids are null or repeat, rows are sorted by doc_id (null last), then by a hash of the text, wholly equal
    rows in any order, and numbered in that order; the range sort spreads equal rows by a hash of their place, so no task gets them all.
    """
    known = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids")).first()
    if known["n"] == known["ids"] == docs.select("doc_id").distinct().count():
        return docs.withColumn("rid", F.col("doc_id").cast("long"))
    keyed = docs.withColumn("_hash", F.xxhash64("text")).withColumn("_place", F.xxhash64(F.monotonically_increasing_id()))
    order = keyed.orderBy(F.col("doc_id").asc_nulls_last(), "_hash", F.sha2(F.coalesce("text", F.lit("")), 256), "_place")
    return written(order.withColumn("rid", F.monotonically_increasing_id()).drop("_hash", "_place"), "numbered")
