"""Text files of any size: lines and records read in many tasks, numbered as one reader would, sections and samples.

Spark splits a file at line ends and says which split a row comes from; within a split rows are in order. So a line's number is its place
in its split plus the counts of the splits before: one row a split, not a row a line, is ordered.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Splits that may be broadcast to the lines they number.
SPLITS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; only a local master may do with one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lexiloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there goes when the JVM ends."""
    path = f"{shared_dir(spark)}/lexiloom-{label}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a written table in the shared folder: later steps don't compute it again, and a lost executor takes nothing with it."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def passing(spark: SparkSession, writers: int = 0) -> Iterator[None]:
    """What is written inside leaves nothing behind but its files: shuffles go when the write ends. A task may have ``writers`` files of different folders open at once, so that rows needn't be sorted by folder. The settings are the session's, so nothing else should run in it meanwhile."""
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxConcurrentOutputFileWriters": str(writers)}
    old = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sized(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner", most: int = SPLITS) -> DataFrame:
    """Join ``small`` by broadcast if it has at most ``most`` rows, counted first, else by a shuffle."""
    return df.join(F.broadcast(small) if small.limit(most + 1).count() <= most else small, on, how)


def read_records(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(file, start, value): the records of text files, apart by line ends or ``separator``; (file, start) is the split."""
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    own = F.col("_metadata")
    return reader.text(path).select(own["file_path"].alias("file"), own["file_block_start"].alias("start"), "value")


def numbered(records: DataFrame, among: str = "file") -> DataFrame:
    """``records`` plus file_no, the file's place by name, and line_no, gapless from 0 within each file or, ``among`` = corpus, over all files by name.

    Splits are counted in a first pass over the same scan; the second numbers each record where it is read. Nothing but the counts is moved.
    """
    if among not in ("file", "corpus"):
        raise ValueError(f"lines are numbered among file or corpus, not {among!r}")
    records = records.withColumn("at", F.monotonically_increasing_id())
    splits = kept(records.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first")), "splits")
    files = splits.select("file").distinct().withColumn("file_no", F.row_number().over(Window.orderBy("file")) - 1)  # a row a file
    before = Window.orderBy("file", "start") if among == "corpus" else Window.partitionBy("file").orderBy("start")  # a row a split
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    splits = kept(splits.join(files, "file").select("file", "start", "first", "before", F.col("file_no").cast("long").alias("file_no")), "offsets")
    placed = sized(records, splits, ["file", "start"])
    return placed.withColumn("line_no", F.col("before") + F.col("at") - F.col("first")).drop("before", "first", "at", "start")


def read_lines(spark: SparkSession, path: str, among: str = "file") -> DataFrame:
    """(doc_id, line_no, text) of text files: doc_id the file's place by name, lines in order; with ``among`` = corpus, doc_id is 0 and line_no runs on over the files.

    Large files are read by many tasks. Empty lines count; an empty file has none, and what follows the last line end is a line only if it isn't empty.
    """
    rows = numbered(read_records(spark, path), among)
    file_no = F.lit(0).cast("long") if among == "corpus" else F.col("file_no")
    return rows.select(file_no.alias("doc_id"), "line_no", F.col("value").alias("text"))


def read_parses(spark: SparkSession, path: str, ignore_firsts: int = 0, keep_incomplete: bool = False, among: str = "file", ranges: int = 10_000) -> DataFrame:
    """(sample, utterance, text) of a stream of parses: one utterance a line, samples apart by empty lines, numbered over all files by name.

    The end of a file ends a sample; with ``among`` = corpus, all files by name are one stream. A sample may be of any size: a first pass says of each
    64 lines in turn which are empty, a second numbers each line where it is read, so that no text is moved or written. What is ordered apart from
    the lines is one row a range of lines and one a sample. The first ``ignore_firsts`` samples are left out, and
    those that lack utterances of the first that stays (a run that was stopped) unless they are to be kept. Several empty lines in a row, or at the
    ends, are as one. Lines lose white space at both ends.
    """
    if among not in ("file", "corpus"):
        raise ValueError(f"samples end among file or corpus, not {among!r}")
    lines = read_records(spark, path, "\n").withColumn("blank", ~F.col("value").rlike(r"[^ \t\r]"))
    # lines of other white space count for nothing
    lines = lines.filter(F.col("blank") | F.col("value").rlike(r"\S")).withColumn("at", F.monotonically_increasing_id()).withColumn("_range", F.expr(f"at div {ranges}"))
    place = F.expr(f"cast(at - _range * {ranges} as int)")
    lines = lines.withColumns({"_block": F.shiftright(place, 6), "_bit": place.bitwiseAND(63)})
    split = ["file", "start", "_range"]
    blocks = lines.groupBy(*split, "_block").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.expr("bit_or(if(blank, shiftleft(1L, _bit), 0L))").alias("empty"))
    before = Window.partitionBy(*split).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("blanks", F.coalesce(F.sum(F.bit_count("empty")).over(before), F.lit(0)))
    # a row a range: what its lines are, and if some are empty, all its blocks
    own = blocks.groupBy(*split).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.sum(F.bit_count("empty")).alias("k"), F.sort_array(F.collect_list(F.struct("_block", "blanks", "empty"))).alias("blocks"))
    own = kept(own.withColumn("blocks", F.when(F.col("k") > 0, F.col("blocks"))), "ranges")
    files = own.select("file").distinct().withColumn("file_no", F.row_number().over(Window.orderBy("file")).cast("long") - 1)  # a row a file
    earlier = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sums = {c: F.coalesce(F.sum(x).over(earlier), F.lit(0)) for c, x in (("_lines", "n"), ("_blanks", "k"))}
    own = kept(own.withColumns(sums).join(files, "file"), "offsets")
    # samples begin after empty lines, at the start and, among files, where a file does; each ends where the next begins
    empty = own.select("file_no", "_range", "_lines", "first", F.explode("blocks").alias("b")).select("*", F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("b.empty", i) == 1)).alias("i"))
    empty = empty.select("file_no", (F.col("_lines") + F.col("_range") * ranges + F.col("b._block") * 64 + F.col("i") - F.col("first")).alias("stop")).withColumn("first", F.col("stop") + 1)
    starts = own.groupBy("file_no" if among == "file" else F.lit(0).cast("long").alias("file_no")).agg(F.min("_lines").alias("stop")).withColumn("first", F.col("stop"))
    marks, order = empty.unionByName(starts), Window.orderBy("stop", "first")  # a row a sample
    file_of = F.col("file_no") if among == "file" else F.lit(0).cast("long")
    run = lambda blanks: F.struct(file_of.alias("file"), blanks.alias("blanks")).alias("run")
    samples = marks.select(run(F.sum(F.col("first") - F.col("stop")).over(order)), "first", F.lead("stop").over(order).alias("next"))
    samples = samples.crossJoin(F.broadcast(own.agg(F.sum("n").alias("end")))).select("run", "first", (F.coalesce("next", "end") - F.col("first")).alias("size")).filter("size > 0")
    samples = samples.withColumn("sample", F.row_number().over(Window.orderBy("run")).cast("long") - 1 - ignore_firsts).filter("sample >= 0")  # a row a sample
    samples = kept(samples, "samples")
    if not keep_incomplete:
        whole = samples.filter("sample = 0").select(F.col("size").alias("whole"))  # one row
        samples = samples.join(F.broadcast(whole), F.col("size") >= F.col("whole"))
    placed = sized(lines.filter("not blank"), own.select(*split, F.col("first").alias("_first"), "_lines", "_blanks", "blocks", "file_no"), split, "left")
    lost = F.raise_error(F.lit("lines come in other splits than when they were counted")).cast("long")
    block = F.get("blocks", F.col("_block") - F.col("blocks")[0]["_block"])
    inside = block["blanks"] + F.bit_count(block["empty"].bitwiseAND(F.expr("~shiftleft(-1L, _bit)")))
    text = F.regexp_replace("value", r"^\s+|\s+$", "").alias("text")
    placed = placed.select(run(F.col("_blanks") + F.coalesce(inside, F.lit(0))), (F.coalesce("_lines", lost) + F.col("at") - F.col("_first")).alias("line_no"), text)
    return sized(placed, samples.select("run", "first", "sample"), ["run"]).select("sample", (F.col("line_no") - F.col("first")).cast("int").alias("utterance"), "text")


def sections(lines: DataFrame, mark, ranges: int = 10_000) -> DataFrame:
    """``lines`` (line_no, ...) plus section: what the last row at or before it where ``mark`` isn't null says there; rows before the first mark have null.

    The last mark of each range of line numbers is carried to the ranges after it, one row a range; inside a range it is carried by a window.
    """
    rows = lines.withColumns({"_mark": mark, "_range": F.floor(F.col("line_no") / ranges)})
    last = rows.groupBy("_range").agg(F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.col("line_no"))).alias("_own"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    last = last.select("_range", F.last("_own", ignorenulls=True).over(earlier).alias("_carried"))
    inside = Window.partitionBy("_range").orderBy("line_no")
    rows = sized(rows, last, ["_range"]).withColumn("section", F.coalesce(F.last("_mark", ignorenulls=True).over(inside), F.col("_carried")))
    return rows.drop("_mark", "_range", "_carried")


def read_stimuli(spark: SparkSession, path: str) -> DataFrame:
    """(section, line_no, text, other) of a file of experimental stimuli: training utterances under a line that begins with Training, test pairs with a tab between under one that begins with Test.

    Lines before the first mark count for nothing, empty lines neither. A test line without a tab fails the job, and so does a file without a test section.
    """
    lines = read_lines(spark, path, "corpus").filter("text <> ''").select("line_no", "text")
    mark = F.when(F.col("text").startswith("Training"), "training").when(F.col("text").startswith("Test"), "test")
    rows = sections(lines, mark).filter(mark.isNull() & F.col("section").isNotNull())
    if lines.filter(F.col("text").startswith("Test")).isEmpty():
        raise ValueError(f"no test section in {path}")
    test, cut = F.col("section") == "test", F.instr("text", "\t")
    lost = F.raise_error(F.concat(F.lit("no tab in test line: "), F.col("text"))).cast("string")
    first = F.when(~test, F.col("text")).when(cut == 0, lost).otherwise(F.substring("text", F.lit(1), cut - 1))
    return rows.select("section", "line_no", first.alias("text"), F.when(test, F.expr("substring(text, instr(text, '\t') + 1)")).alias("other"))
