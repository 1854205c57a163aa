"""Grammar files of adaptor grammars: reading, checks, and the generated one-level grammar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rules of a grammar file, as ``parsed`` gives them."""
    return parsed(spark.read.text(path))


def parsed(lines: DataFrame) -> DataFrame:
    """(weight, a, b, parent, rhs) of lines (value) ``[weight [a [b]]] Parent --> Child ...``; numbers left out are null. Rules adapt unless a is 1."""
    parts = F.split(F.col("value"), r"\s-->\s*", 2)
    left = F.filter(F.split(F.trim(parts[0]), r"\s+"), lambda x: x != "")
    number = lambda i: F.when(F.size(left) > i + 1, F.get(left, F.lit(i)).cast("double"))
    rhs = F.filter(F.split(F.trim(F.get(parts, F.lit(1))), r"\s+"), lambda x: x != "")
    rows = lines.filter(F.trim("value") != "")
    return rows.select(number(0).alias("weight"), number(1).alias("a"), number(2).alias("b"), F.element_at(left, -1).alias("parent"), rhs.alias("rhs"))


def has_category(rules: DataFrame, category: str) -> bool:
    return not rules.filter(F.col("parent") == category).isEmpty()


def generated(units: DataFrame, category: str = "Colloc0") -> DataFrame:
    """(value): lines of a grammar whose utterances are sequences of words of the given ``units`` (unit)."""
    spark = units.sparkSession
    fixed = [f"1 1 Sentence --> {category}s", f"1 1 {category}s --> {category}", f"1 1 {category}s --> {category} {category}s", f"{category} --> Phonemes", "1 1 Phonemes --> Phoneme", "1 1 Phonemes --> Phoneme Phonemes"]
    head = spark.createDataFrame([(i, x) for i, x in enumerate(fixed)], "_i int, value string")
    leaves = units.select("unit").distinct().select(F.lit(len(fixed)).alias("_i"), F.concat(F.lit("1 1 Phoneme --> "), "unit").alias("value"))
    return head.unionByName(leaves).orderBy("_i", "value").select("value")
