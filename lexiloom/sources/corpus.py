"""Corpora: one utterance a row, ordered by (doc_id, line_no)."""

from __future__ import annotations

import json
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.separator import Separator, trimmed
from .text import read_lines, read_parses, read_stimuli  # noqa: F401

KEY = ["doc_id", "line_no"]


def numbered_lines(table: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, line_no, line) of the lines of a text column; null texts have none."""
    return table.select(F.col(key).cast("long").alias("doc_id"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))


def letters_only(line):
    """Lower-case a-z words of a line: everything else goes, spaces are squeezed."""
    return F.trim(squeezed_letters(line, " "))


def squeezed_letters(text, gaps: str):
    """a-z of a text and the characters of ``gaps``, runs of spaces as one."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)  # a class of two ranges takes ten times as long to read
    return F.regexp_replace(F.regexp_replace(lower, f"[^a-z{gaps}]+", ""), "  +", " ")


def derived_corpus(table: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, line_no, text): the cleaned, non-empty lines of a table of prose, as gold utterances with words apart by a space."""
    # letters are cleaned in whole texts, before the lines come apart: once for a text, and no filter on lines takes it along
    lines = numbered_lines(table.select(key, squeezed_letters(F.col(text), " \n").alias(text)), text, key)
    return lines.select("doc_id", "line_no", F.trim("line").alias("text")).filter("text <> ''")


def tagged(gold: DataFrame, separator: Separator = Separator()) -> DataFrame:
    """Gold utterances as tagged ones: letters are phones, words end in the word separator."""
    phone, _, word = separator
    gap, phone = "\u0001", phone or ""
    spaced = F.array_join(F.split(F.replace("text", F.lit(" "), F.lit(gap)), ""), phone)
    return gold.withColumn("text", F.concat(F.replace(spaced, F.lit(gap + phone), F.lit(word)), F.lit(phone + word)))


def read_items(spark: SparkSession, path: str) -> list[str]:
    """Distinct non-empty lines of a small list (onsets, vowels), in file order."""
    rows = spark.read.text(path).select(trimmed(F.col("value")).alias("v")).filter("v <> ''").collect()
    return list(dict.fromkeys(r["v"] for r in rows))


def write_utterances(df: DataFrame, path: str, text: str = "text", parts: int | None = None) -> None:
    """Text files in corpus order: file names sort as their utterances do. ``parts`` = 1 gives a single file."""
    ordered = df.orderBy(*KEY) if parts is None else df.repartitionByRange(parts, *KEY).sortWithinPartitions(*KEY)
    ordered.select(text).write.text(path)


def score_lines(scores: dict) -> list[str]:
    """``name<TAB>value`` with four significant digits, None for undefined."""
    return [f"{k}\t{'None' if v is None else format(v, '.4g')}" for k, v in scores.items()]


def json_text(value) -> str:
    return json.dumps(value, indent=4, ensure_ascii=False)


def raw_lines(stats: dict) -> list[str]:
    """``level name value`` of nested statistics."""
    return [f"{level} {name} {value}" for level, own in stats.items() for name, value in own.items()]


def write_text(spark: SparkSession, lines: list[str], path: str) -> None:
    """A few lines as one text file under ``path``."""
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_json(spark: SparkSession, value, path: str) -> None:
    write_text(spark, json_text(value).split("\n"), path)


CATEGORIES = ("correct", "over", "under", "mis")


def summary_lines(errors: DataFrame) -> DataFrame:
    """(value): the lines of {category: {word: n}} as JSON, the most frequent words first, of an error summary (category, word, n).

    Each word is a line that is written where it is; only the last word of each category, which takes no comma, is found beforehand.
    """
    place = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category")).cast("int")
    rows = errors.select(place.alias("c"), (-F.col("n")).alias("k"), "word", "n")
    last = rows.groupBy("c").agg(F.max(F.struct("k", "word")).alias("last"))  # a row a category
    quoted = F.regexp_extract(F.to_json(F.array("word")), r"^\[(.*)\]\z", 1)
    comma = F.when(F.struct("k", "word") == F.col("last"), "").otherwise(",")
    words = rows.join(F.broadcast(last), "c").select("c", F.lit(1).alias("part"), "k", "word", F.concat(F.lit(" " * 8), quoted, F.lit(": "), F.col("n").cast("string"), comma).alias("value"))
    marks = errors.sparkSession.createDataFrame([(i + 1, c, "" if i + 1 == len(CATEGORIES) else ",") for i, c in enumerate(CATEGORIES)], "c int, name string, comma string")
    marks = marks.join(F.broadcast(last), "c", "left").select("c", F.col("last").isNull().alias("none"), "name", "comma")
    head = F.concat(F.lit('    "'), F.col("name"), F.when(F.col("none"), F.concat(F.lit('": {}'), "comma")).otherwise(F.lit('": {')))
    heads = marks.select("c", F.lit(0).alias("part"), F.lit(0).cast("long").alias("k"), F.lit("").alias("word"), head.alias("value"))
    tails = marks.filter("not none").select("c", F.lit(2).alias("part"), F.lit(0).cast("long").alias("k"), F.lit("").alias("word"), F.concat(F.lit("    }"), "comma").alias("value"))
    ends = errors.sparkSession.createDataFrame([(0, "{"), (len(CATEGORIES) + 1, "}")], "c int, value string").select("c", F.lit(0).alias("part"), F.lit(0).cast("long").alias("k"), F.lit("").alias("word"), "value")
    return words.unionByName(heads).unionByName(tails).unionByName(ends).orderBy("c", "part", "k", "word").select("value")


def write_summary(errors: DataFrame, path: str) -> None:
    """An error summary as JSON, in text files whose names sort as their lines do."""
    summary_lines(errors).write.mode("overwrite").text(path)


def write_prepared(tagged: DataFrame, prepared: DataFrame, separator: Separator, path: str, gold_path: str) -> None:
    """The prepared text and the gold text of the same utterances, side by side: both in corpus order, row for row."""
    from ..operators.prepare import gold

    write_utterances(prepared, path)
    write_utterances(gold(tagged.join(prepared.select(*KEY), KEY, "left_semi"), separator), gold_path)


def diphone_lines(diphones: DataFrame) -> DataFrame:
    """(value): ``count a b`` of (a, b, internal, spanning), the most frequent first."""
    counted = diphones.withColumn("n", F.col("internal") + F.col("spanning")).orderBy(F.desc("n"), "a", "b")
    return counted.select(F.concat_ws(" ", F.col("n").cast("string"), "a", "b").alias("value"))


def read_options(spark: SparkSession, path: str, defaults) -> dict:
    """Options of a file of lines ``name = value`` (dashes or underscores, # for comments), as the types of ``defaults``' fields; unknown ones fail."""
    out = {}
    for row in spark.read.text(path).collect():
        line = row["value"].split("#", 1)[0].strip()
        if not line:
            continue
        name, _, value = (x.strip() for x in line.partition("="))
        name = name.lstrip("-").replace("-", "_")
        if not hasattr(defaults, name):
            raise ValueError(f"unknown option {name!r} in {path}")
        kind = type(getattr(defaults, name))
        out[name] = value.lower() in ("1", "true", "yes") if kind is bool else kind(value)
    return out


def read_gold_spaced(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, text, gold) of lines whose spaces are gold boundaries: units are characters, apart by a space in text. A space at the end fails."""
    ended = F.when(F.col("text").endswith(" "), F.raise_error(F.concat(F.lit("line ends with a space: "), F.col("text")))).otherwise(F.col("text"))
    rows = lines.withColumn("gold", ended)
    return rows.withColumn("text", F.trim(F.regexp_replace(F.replace("gold", F.lit(" "), F.lit("")), "(.)", "$1 ")))


def encoded_units(prepared: DataFrame, first: int = 3001) -> tuple[DataFrame, DataFrame]:
    """(rows with one character for each unit, (unit, letter)): distinct units in order get characters from ``first`` on, whitespace left out."""
    units = prepared.select(F.explode(F.split(F.trim("text"), " +")).alias("unit")).distinct()
    letters = [chr(c) for c in range(first, first + 70_000) if not chr(c).isspace() and not 0xD800 <= c < 0xE000]
    known = sorted(r["unit"] for r in units.limit(len(letters) + 1).collect())
    if len(known) > len(letters):
        raise ValueError(f"more than {len(letters)} kinds of units")
    table = prepared.sparkSession.createDataFrame(list(zip(known, letters, strict=False)), "unit string, letter string")
    held = table.agg(F.map_from_entries(F.collect_list(F.struct("unit", "letter"))).alias("m")).scalar()
    return prepared.withColumn("_m", held).withColumn("text", F.array_join(F.transform(F.split(F.trim("text"), " +"), lambda u: F.element_at("_m", u)), "")).drop("_m"), table
