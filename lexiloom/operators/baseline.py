"""Random word boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.separator import Separator


def uniform(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) that only the seed and the columns decide, so that reruns and lost tasks agree."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)) / F.lit(float(1 << 52))


def segment(prepared: DataFrame, probability: float = 0.5, seed: int = 0) -> DataFrame:
    """``prepared`` with a boundary after each unit at the given probability, after the last one too (a trailing space)."""
    if not isinstance(probability, float) or not 0 <= probability <= 1:
        raise ValueError(f"probability must be a float in [0, 1], it is {probability!r}")
    units = F.split("text", " ", -1)
    cut = lambda i: uniform(seed, F.col("doc_id"), F.col("line_no"), i) < F.lit(probability)
    pieces = F.transform(units, lambda u, i: F.concat(u, F.when(cut(i), F.lit(" ")).otherwise(F.lit(""))))
    return prepared.withColumn("text", F.array_join(pieces, ""))


def word_share(tagged: DataFrame, separator: Separator = Separator(), level: str = "phone") -> DataFrame:
    """One row, probability: words by units of a tagged corpus, 0 without units."""
    n = lambda at: F.sum(F.size(separator.tokenize(F.col("text"), at, keep_boundaries=False)))
    return tagged.agg(F.coalesce(F.try_divide(n("word"), n(level)), F.lit(0.0)).alias("probability"))


def oracle_probability(tagged: DataFrame, separator: Separator = Separator(), level: str = "phone") -> float:
    return word_share(tagged, separator, level).first()["probability"]


def segment_oracle(prepared: DataFrame, tagged: DataFrame, separator: Separator = Separator(), level: str = "phone", seed: int = 0) -> DataFrame:
    return segment(prepared, float(oracle_probability(tagged, separator, level)), seed)
