"""Mix sources to target weights with DataFrame functions only.

Every document gets a hash-random key. Within its source, documents are ordered by that key and a distributed
prefix sum of their token counts is taken; the source's budget cuts the order at its exact token. A budget above
the source's own size starts whole epochs first.

The order is range-partitioned by the leading bits of the key, which is uniform by construction: each range holds
about ``ROWS_PER_RANGE`` rows however large its source is. Range totals are a small aggregate, their running sums
give each range its offset, and a window inside the range does the rest; no task sees a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_join, free_names, power_of_two, word_count, written

ROWS_PER_RANGE = 20_000
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_EPOCHS = 2


def source_key(source: Column) -> Column:
    """A string that is never null and sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_epochs: float = MOST_EPOCHS) -> DataFrame:
    """Token budget of each source: (_src, source_size, target).

    Sources weigh ``weights`` in turn, in code point order, null last, and divide ``share`` times all tokens by weight.
    A target stops at ``most_epochs`` times its source; the excess goes to the others by weight until none is above.
    That fixed point is found in closed form: sources sorted by the level at which they fill up, the first level that
    the remaining budget does not reach is the common one. Only one row per source is sorted.
    """
    if share > most_epochs:
        raise ValueError("the share can't exceed what the epochs allow")
    by_name, by_level = Window.orderBy("_src"), Window.orderBy("_level", "_src")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    stats = sized.groupBy("_src").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    stats = stats.withColumn("_weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    stats = stats.withColumn("_full", F.col("source_size") * F.lit(float(most_epochs))).withColumn("_level", F.col("_full") / F.col("_weight"))
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("_full").over(before), F.lit(0.0))) / (
        F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    )
    stats = stats.withColumn("_common", level).withColumn("_place", F.row_number().over(by_level))
    held = F.min_by(F.when(F.col("_common") <= F.col("_level"), F.col("_common")), F.when(F.col("_common") <= F.col("_level"), F.col("_place")))
    stats = stats.withColumn("_common", F.coalesce(held.over(whole), F.lit(0.0)))
    return stats.select("_src", "source_size", F.least("_full", F.col("_common") * F.col("_weight")).alias("target"))


def order_key(seed: int, doc_id: Column, salt: Column | None = None) -> Column:
    """The hash-random key of a document: 32 hexadecimal digits; null parts of the salt are left out."""
    parts = [F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null"))]
    return F.md5(F.concat_ws(":", *parts, *([] if salt is None else [salt])))


def ranged(rows: DataFrame) -> DataFrame:
    """``rows`` (_key, anything else) plus _range, the leading bits of the key: about ROWS_PER_RANGE rows each over all sources."""
    ranges = min(power_of_two(rows.count() / ROWS_PER_RANGE), 1 << 31)
    lead = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    return rows.withColumn("_range", F.floor(lead / F.lit((1 << 32) // ranges)).cast("long"))


def range_offsets(rows: DataFrame, *options) -> DataFrame:
    """(_src, _range, _total, _offset, source_size, target, _budget, _epochs) of ``rows`` (_src, _range, size)."""
    totals = rows.groupBy("_src", "_range").agg(F.sum("size").alias("_total"))
    ahead = Window.partitionBy("_src").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(ahead), F.lit(0))).join(source_targets(rows, *options), "_src")
    offsets = offsets.withColumn("_budget", F.floor(F.col("target") + F.lit(1e-6)).cast("long"))
    return offsets.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("_budget") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_epochs: float = MOST_EPOCHS, seed: int = 7, salt: str | None = None) -> DataFrame:
    """``docs`` (doc_id, source, size, anything else) plus source_size, target and taken, the words the mix takes.

    The document at the cut gives the part of its words that is left in the budget, so a source's taken words add
    up to its target rounded down. Null doc_ids and repeated rows are ordinary rows; ``salt`` names a column that sets apart rows of one
    doc_id (a hash of their text, say), so that many null ids spread over the ranges. Ties, rows of one key, go by size; equal ones are
    alike, so reruns agree. A source of empty documents has target 0. Null sizes count as 0. Texts play no part, however long. An empty
    table gives an empty result. Input columns named like the three results are replaced, all others stay, whatever their names.
    Sources are sorted in one task, one narrow row each: meant for up to some millions of them.
    """
    docs = docs.drop("source_size", "target", "taken")
    columns = [c for c in docs.columns if c != "size"]
    packed = F.struct(*[F.col(c) for c in columns]).alias("_row")
    key = order_key(seed, F.col("doc_id"), None if salt is None else F.col(salt))
    rows = docs.select(packed, F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"), source_key(F.col("source")).alias("_src"), key.alias("_key"))
    rows = ranged(rows)
    offsets = range_offsets(rows, weights, share, most_epochs)
    inside = Window.partitionBy("_src", "_range").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("_end", F.sum("size").over(inside)).join(offsets, ["_src", "_range"])
    start = F.col("_offset") + F.col("_end") - F.col("size")
    part = F.least(F.greatest(F.col("_budget") - F.col("_epochs") * F.col("source_size") - start, F.lit(0)), F.col("size"))
    taken = (F.col("_epochs") * F.col("size") + part).cast("long")
    return placed.select(*[F.col("_row").getField(c).alias(c) for c in columns], "size", "source_size", "target", taken.alias("taken"))


def source_cuts(rows: DataFrame, *options) -> DataFrame:
    """One row for each source of ``rows`` (_src, _key, size): _epochs, and where its budget cuts the order of its rows.

    _cut is the key there (null if whole epochs use up the budget), _cut_size and _alike the size and number of the rows that tie there,
    _part the words that they have left together. Only the range that holds the cut is sorted, and ties are counted, not sorted.
    """
    rows = ranged(rows)
    offsets = range_offsets(rows, *options).withColumn("_rest", F.col("_budget") - F.col("_epochs") * F.col("source_size"))
    offsets = written(offsets.select("_src", "_range", "_total", "_offset", "_epochs", "_rest"), "mix-offsets")
    holding = offsets.filter("_offset < _rest and _rest <= _offset + _total").select("_src", "_range", (F.col("_rest") - F.col("_offset")).alias("_left"))
    ties = bounded_join(rows, holding, ["_src", "_range"], "inner").groupBy("_src", "_key", "size", "_left").agg(F.count("*").alias("_alike"))
    ahead = Window.partitionBy("_src").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("size") * F.col("_alike")).over(ahead), F.lit(0))
    ties = ties.withColumn("_part", F.col("_left") - before).filter("_part > 0 and _part <= size * _alike")
    ties = ties.select("_src", F.col("_key").alias("_cut"), F.col("size").alias("_cut_size"), "_alike", "_part")
    return written(offsets.select("_src", "_epochs").distinct().join(ties, "_src", "left"), "mix-cuts")


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_epochs: float = MOST_EPOCHS, seed: int = 7) -> DataFrame:
    """The mixed corpus itself: each row of ``docs`` (with its text) as often as the mix takes it, its columns as they are.

    Only (source, key, size) is sorted; texts, however long, are filtered and repeated where they stand, by one row of cuts for each
    source. A document that the cut takes in part stays whole if more than half of its words are taken; of rows that tie there, as many as
    the budget has words for, chosen by a hash of their place. Documents without words carry no tokens and stay once. Nulls, repeated rows,
    empty tables as in ``mix``; null ids are told apart by a hash of the text.
    """
    src, key, size, copies = free_names(docs, "_src", "_key", "_size", "_copies")
    salt = F.when(F.col("doc_id").isNull(), F.md5(F.coalesce("text", F.lit(""))))
    rows = docs.withColumns({src: source_key(F.col("source")), key: order_key(seed, F.col("doc_id"), salt), size: word_count(F.col("text"))})
    narrow = written(rows.select(F.col(src).alias("_src"), F.col(key).alias("_key"), F.col(size).alias("size")), "mix-sizes")
    made = ("_epochs", "_cut", "_cut_size", "_alike", "_part")
    names = free_names(rows, *made)
    cuts = source_cuts(narrow, weights, share, most_epochs).select(F.col("_src").alias(src), *[F.col(c).alias(n) for c, n in zip(made, names, strict=True)])
    epochs, cut, cut_size, alike, part = (F.col(n) for n in names)
    words = part / F.col(size)
    chance = F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(1 << 52)) / F.lit(float(1 << 52))
    inside = F.when(F.col(key) == cut, F.col(size) < cut_size).otherwise(F.col(key) < cut)
    tied = (F.col(key) == cut) & (F.col(size) == cut_size)
    more = F.when(inside, 1).when(tied, F.when(F.when(alike == 1, words >= 0.5).otherwise(chance < words / alike), 1).otherwise(0)).otherwise(0)
    out = bounded_join(rows, cuts, [src], "inner").withColumn(copies, F.when(F.col(size) > 0, epochs + more).otherwise(F.lit(1)).cast("int"))
    return out.filter(F.col(copies) > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copies)).select(*docs.columns)
