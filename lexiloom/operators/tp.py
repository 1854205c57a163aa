"""Segmentation by transitional probabilities between adjacent units."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.pairs import cut_by_scores
from ..sources.text import kept
from .prepare import ends_of_corpus, units_of, with_ends

KEY = ["doc_id", "line_no"]
#: Stands between utterances; no unit can be a space.
EDGE = " "


def bigram_counts(prepared: DataFrame, ends: Row | None = None) -> DataFrame:
    """(a, b, n): adjacent units of the corpus, with EDGE between utterances but not at its two ends.

    Pairs are exploded and counted where they are; what shuffles is one row a pair and task.
    """
    rows = with_ends(prepared.withColumn("_u", units_of(F.col("text"))), KEY, ends or ends_of_corpus(prepared, KEY))
    left = F.when(F.col("_first"), F.array().cast("array<string>")).otherwise(F.array(F.lit(EDGE)))
    right = F.when(F.col("_last"), F.array().cast("array<string>")).otherwise(F.array(F.lit(EDGE)))
    rows = rows.select(F.concat(left, "_u", right).alias("_u"))
    n = F.size("_u")
    zipped = F.arrays_zip(F.slice("_u", 1, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice("_u", 2, F.greatest(n - 1, F.lit(0))).alias("b"))
    return rows.select(F.explode(zipped).alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n"))


def unit_counts(prepared: DataFrame) -> DataFrame:
    """(unit, n), with EDGE once less than there are utterances."""
    units = prepared.select(F.explode(F.concat(units_of(F.col("text")), F.array(F.lit(EDGE)))).alias("unit")).groupBy("unit").agg(F.count("*").alias("n"))
    return units.withColumn("n", F.when(F.col("unit") == EDGE, F.col("n") - 1).otherwise(F.col("n"))).filter("n > 0")


def fit(prepared: DataFrame, dependency: str = "ftp", ends: Row | None = None) -> DataFrame:
    """(a, b, score) over pair types: ftp f(ab)/f(a), btp f(ab)/f(b), mi log2(f(ab) / (f(a) f(b)))."""
    ends = ends or ends_of_corpus(prepared, KEY)
    # a unit starts as many pairs as it has occurrences, less one for the last of the corpus, and ends all but the first
    joined = bigram_counts(prepared, ends).withColumns({"na": F.sum("n").over(Window.partitionBy("a")), "nb": F.sum("n").over(Window.partitionBy("b"))})
    joined = joined.withColumns({"na": F.col("na") + F.when(F.col("a").eqNullSafe(F.lit(ends["last"])), 1).otherwise(0), "nb": F.col("nb") + F.when(F.col("b").eqNullSafe(F.lit(ends["first"])), 1).otherwise(0)})
    score = {"ftp": F.col("n") / F.col("na"), "btp": F.col("n") / F.col("nb"), "mi": F.log2(F.col("n") / (F.col("na") * F.col("nb")))}
    if dependency not in score:
        raise ValueError(f"dependency must be ftp, btp or mi, it is '{dependency}'")
    return joined.select("a", "b", score[dependency].alias("score"))


def apply(prepared: DataFrame, model: DataFrame, threshold: str = "relative", ends: Row | None = None) -> DataFrame:
    """``prepared`` with its text segmented. Unseen pairs score 0.

    relative: a boundary where the score is below both neighbours'; the first two units of the corpus stay together and nothing
    is cut before its last unit. absolute: where the score is at most the mean over pair types.
    """
    if threshold not in ("relative", "absolute"):
        raise ValueError(f"threshold must be relative or absolute, it is '{threshold}'")
    rows = with_ends(prepared, KEY, ends or ends_of_corpus(prepared, KEY))
    if threshold == "absolute":
        mean = model.agg(F.sum("score") / F.count("score")).first()[0]
        mean = float("-inf") if mean is None else float(mean)  # without pairs nothing is below the mean
        out = cut_by_scores(rows.drop("_first", "_last"), model, 0.0, lambda before, own, after: own <= mean, KEY)
    else:
        out = cut_by_scores(rows, model, 0.0, lambda before, own, after: (before > own) & (own < after), KEY, EDGE)
    return out.select(*prepared.columns)


def segment(prepared: DataFrame, train: DataFrame | None = None, threshold: str = "relative", dependency: str = "ftp", units: str | None = None) -> DataFrame:
    """Train on ``train`` (default: the input itself) and segment ``prepared``; ``units`` names a column that takes the text as it was."""
    beside = lambda df: df if units is None else df.withColumn(units, F.col("text"))
    if train is not None:
        return apply(beside(prepared), fit(train, dependency), threshold)
    prepared = kept(prepared, "prepared")  # three passes read it: its ends, the counts, the cuts
    ends = ends_of_corpus(prepared, KEY)
    return apply(beside(prepared), fit(prepared, dependency, ends), threshold, ends)
