"""Rotated folds of an ordered corpus for learners that depend on order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prepare import dense_order, units_of

KEY = ["doc_id", "line_no"]
#: Utterances that one sequential learner reads at most (the last of a corpus up to twice as many).
CHAIN_ROWS = 50_000


def blocks(df: DataFrame, nfolds: int, fold_boundaries: list[int] | None = None) -> DataFrame:
    """``df`` plus _ord and block: nfolds blocks of equal size in corpus order, the rest in the last; or blocks that start at ``fold_boundaries``."""
    n = df.count()
    if nfolds < 1 or n < nfolds:
        raise ValueError(f"can't make {nfolds} folds of {n} utterances")
    if fold_boundaries is None:
        return dense_order(df, KEY).withColumn("block", F.least(F.floor(F.col("_ord") / (n // nfolds)), F.lit(nfolds - 1)).cast("int"))
    if len(fold_boundaries) != nfolds or fold_boundaries != sorted(set(fold_boundaries)) or fold_boundaries[0] != 0 or fold_boundaries[-1] >= n:
        raise ValueError(f"fold boundaries must be {nfolds} rising places from 0 below {n}: {fold_boundaries}")
    begun = F.array(*[F.lit(b) for b in fold_boundaries])
    return dense_order(df, KEY).withColumn("block", (F.size(F.filter(begun, lambda b: b <= F.col("_ord"))) - 1).cast("int"))


def fold_starts(df: DataFrame, nfolds: int, least_units: int = 2) -> DataFrame:
    """(block, start): where each of ``nfolds`` blocks of equal size begins, moved on to the next utterance of ``least_units`` units or more.

    One aggregate finds the first such utterance of every block; a block that has none takes that of the next. Fails where the corpus
    itself begins with a shorter one, and where two blocks would begin at one place or a block nowhere.
    """
    placed = blocks(df, nfolds)
    ready = F.size(units_of(F.col("text"))) >= least_units
    rows = placed.groupBy("block").agg(F.min("_ord").alias("begin"), F.min(F.when(ready, F.col("_ord"))).alias("own"))  # a row a block
    after = Window.orderBy("block").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("start", F.min("own").over(after)).withColumn("before", F.lag("start").over(Window.orderBy("block")))
    failed = F.when((F.col("begin") == 0) & (F.coalesce("start", F.lit(-1)) != 0), F.lit("the first utterance is too short: put another first"))
    failed = failed.when(F.col("start").isNull() | (F.col("start") <= F.col("before")), F.lit("folds can't begin with utterances that are long enough: shuffle the text"))
    return rows.select("block", F.when(failed.isNotNull(), F.raise_error(failed).cast("long")).otherwise(F.col("start")).alias("start"))


def repaired_blocks(df: DataFrame, nfolds: int, least_units: int = 2) -> DataFrame:
    """``df`` plus _ord and block, the blocks beginning at ``fold_starts``; one row a block is sent to the rows."""
    starts = fold_starts(df, nfolds, least_units).agg(F.sort_array(F.collect_list("start")).alias("starts"))
    return dense_order(df, KEY).crossJoin(F.broadcast(starts)).withColumn("block", (F.size(F.filter("starts", lambda b: b <= F.col("_ord"))) - 1).cast("int")).drop("starts")


def turned(rows: DataFrame, nfolds: int) -> DataFrame:
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(nfolds - 1))))
    return rows.withColumn("turn", F.pmod(F.col("block") + F.col("fold"), F.lit(nfolds)).cast("int"))


def fold(df: DataFrame, nfolds: int, fold_boundaries: list[int] | None = None, least_units: int = 1) -> DataFrame:
    """Each row once for each fold, plus fold, block and turn: in fold f, block b comes at turn (b + f) mod nfolds, so the last is nfolds - 1 - f.

    With ``least_units`` above 1, blocks of equal size begin with the next utterance of so many units.
    """
    if least_units > 1 and fold_boundaries is not None:
        raise ValueError("boundaries that are given can't be moved on")
    return turned(repaired_blocks(df, nfolds, least_units) if least_units > 1 else blocks(df, nfolds, fold_boundaries), nfolds)


def chained_fold(df: DataFrame, nfolds: int, chain_rows: int | None = None) -> DataFrame:
    """As ``fold``, plus chain: the corpus is first cut into runs of ``chain_rows`` utterances, folded apart, so that a learner of one (chain, fold) is bounded.

    A corpus of under twice that is one run.
    """
    n, rows = df.count(), chain_rows or CHAIN_ROWS
    runs = max(1, n // rows)
    if nfolds < 1 or n < nfolds:
        raise ValueError(f"can't make {nfolds} folds of {n} utterances")
    chain = F.least(F.floor(F.col("_ord") / rows), F.lit(runs - 1))
    size = F.when(F.col("chain") == runs - 1, F.lit(n - (runs - 1) * rows)).otherwise(F.lit(rows))
    placed = dense_order(df, KEY).withColumn("chain", chain)
    block = F.floor((F.col("_ord") - F.col("chain") * rows) / F.floor(size / nfolds))
    return turned(placed.withColumn("block", F.least(block, F.lit(nfolds - 1)).cast("int")), nfolds)


def unfold(folds: DataFrame, nfolds: int) -> DataFrame:
    """The last block of each fold: every row once."""
    return folds.filter(F.col("block") == nfolds - 1 - F.col("fold")).drop("fold", "block", "turn", "_ord")
