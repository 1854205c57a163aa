"""Scores of segmented against gold utterances.

Both sides stand in one row an utterance; the ends of all words of a batch of utterances are arrays of numbers, in which positions, boundaries, overlaps
and chunks are found together. What leaves a batch is sums and counts of its words, which are added up by a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import computed
from ..functions.separator import squeezed

KEY = ["doc_id", "line_no"]
CATEGORIES = ("correct", "over", "under", "mis")
FAMILIES = ("token", "type", "boundary_all", "boundary_noedge")


def word_ends(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, at) of each word of texts with single spaces, in order: where it ends, in characters without spaces. No text may be empty."""
    texts = texts.cast(pa.large_string())
    _, places, data = texts.buffers()
    stops = np.frombuffer(places, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data, stops = np.frombuffer(data, dtype=np.uint8)[stops[0] : stops[-1]], stops - stops[0]
    space = data == 32
    before = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(~space & ((data & 0xC0) != 0x80))])  # characters begin at bytes that go on with none
    place = np.sort(np.concatenate([np.flatnonzero(space), stops[1:]]))
    row = np.searchsorted(stops, place, side="left") - 1
    return row, before[place] - before[stops[row]]


def steps(row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Differences inside each row of ascending places, the first from 0."""
    last = np.concatenate([np.zeros(1, dtype=np.int64), at[:-1]])
    first = np.ones(len(at), dtype=bool)
    first[1:] = row[1:] != row[:-1]
    return at - np.where(first, 0, last)


def on_one_line(*sides: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """The (row, at) of each side as one number that rises from row to row; the same on all sides."""
    wide = max(int(at.max()) for _, at in sides) + 1
    return [row * wide + at for row, at in sides]


def by_batch(pairs: DataFrame, columns: list[str], schema: str, count: Callable[..., list[pa.RecordBatch]]) -> DataFrame:
    """What ``count`` makes of the ``columns`` of each batch of utterances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from count(*[batch.column(c) for c in columns])

    return pairs.select(*columns).mapInArrow(run, schema)


def paired(text: DataFrame, gold: DataFrame | None, **more: Column) -> DataFrame:
    """(key, t, g): squeezed texts of both sides. Utterances must match and have the same letters, else the job fails.

    Without ``gold``, ``text`` has a column gold: both sides come from one row and nothing is joined; ``more`` of its columns may stand beside them.
    """
    at = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("line_no").cast("string"))
    letters = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    checked = F.when(F.col("t").isNull() | F.col("g").isNull(), F.raise_error(F.concat(F.lit("only one side has utterance "), at)).cast("string"))
    checked = checked.when(letters("t") != letters("g"), F.raise_error(F.concat(F.lit("letters differ in utterance "), at)).cast("string")).otherwise(F.col("t"))
    if gold is None:
        rows = computed(text, KEY, t=squeezed(F.col("text")), g=squeezed(F.col("gold")), **more)
    else:
        rows = text.select(*KEY, squeezed(F.col("text")).alias("t")).join(gold.select(*KEY, squeezed(F.col("text")).alias("g")), KEY, "full")
    # empty rows go after the join: a filter before it would be pushed down with all that computes the text
    return rows.filter("coalesce(t, '') <> '' or coalesce(g, '') <> ''").withColumn("t", checked)


def score_counts(pairs: DataFrame) -> DataFrame:
    """(family, test, gold, correct): one row each for tokens, types, boundaries with and without edges."""
    names = [f"{name}{k}" for name in FAMILIES if name != "type" for k in range(3)]

    def count(t: pa.Array, g: pa.Array) -> list[pa.RecordBatch]:
        te, ge = on_one_line(word_ends(t), word_ends(g))
        shared, rows = np.intersect1d(te, ge, assume_unique=True), len(t)
        # a word is right if shared ends are neighbours on both sides
        right = (np.diff(np.searchsorted(te, shared), prepend=-1) == 1) & (np.diff(np.searchsorted(ge, shared), prepend=-1) == 1)
        sizes = (len(te), len(ge), len(shared))
        numbers = [*sizes[:2], int(right.sum()), *(n + rows for n in sizes), *(n - rows for n in sizes)]
        words = [pc.unique(pc.split_pattern(x, " ").flatten()) for x in (t, g)]
        n = [len(w) for w in words]
        word = pa.concat_arrays([pa.array([None], pa.string()), *(w.cast(pa.string()) for w in words)])
        sides = [pa.array([0] * (1 + n[0] * side) + [1] * n[side] + [0] * (n[1] * (1 - side)), pa.int32()) for side in (0, 1)]
        sums = [pa.array(np.concatenate([[k], np.zeros(sum(n), dtype=np.int64)])) for k in numbers]
        return [pa.RecordBatch.from_arrays([word, *sides, *sums], ["word", "_t", "_g", *names])]

    made = by_batch(pairs, ["t", "g"], "word string, _t int, _g int, " + ", ".join(f"{n} long" for n in names), count)
    by = made.groupBy("word").agg(F.max("_t").alias("_t"), F.max("_g").alias("_g"), *[F.sum(n).alias(n) for n in names])
    type_ = F.col("word").isNotNull() & (F.col("word") != "_")
    of = lambda c: F.count_if(type_ & c)
    sums = by.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names], of(F.col("_t") == 1).alias("type0"), of(F.col("_g") == 1).alias("type1"), of((F.col("_t") == 1) & (F.col("_g") == 1)).alias("type2"))
    rows = F.array(*[F.struct(F.lit(name).alias("family"), *[F.col(f"{name}{k}").alias(n) for k, n in enumerate(("test", "gold", "correct"))]) for name in FAMILIES])
    return sums.select(F.inline(rows))


def scores(text: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """(family, precision, recall, fscore), null where undefined; ``gold`` as in ``paired``."""
    counts = score_counts(paired(text, gold))
    return counts.select("family", F.try_divide("correct", "test").alias("precision"), F.try_divide("correct", "gold").alias("recall"), F.try_divide(2 * F.col("correct"), F.col("test") + F.col("gold")).alias("fscore"))


def evaluate(text: DataFrame, gold: DataFrame, units: DataFrame | None = None) -> dict:
    """The twelve scores in report order, and with the prepared ``units`` the adjusted Rand index."""
    found = {r["family"]: r for r in scores(text, gold).collect()}
    out = {f"{family}_{name}": found[family][name] for family in FAMILIES for name in ("precision", "recall", "fscore")}
    if units is not None:
        out["adjusted_rand_index"] = adjusted_rand_index(text, gold, units).first()["adjusted_rand_index"]
    return out


def adjusted_rand_index(text: DataFrame, gold: DataFrame | None = None, units: DataFrame | str | None = None) -> DataFrame:
    """One row: the index over units, each word token a class of its own.

    Both sides partition the same letters, so the cells of the contingency table are the stretches between boundaries of either
    side. ``units`` has the prepared utterances or, without ``gold``, names their column in ``text``, so that nothing is joined; without it, units are characters.
    A word's units are those that end in it.
    """
    if isinstance(units, str):
        if gold is not None:
            raise ValueError("a column of units needs gold in the same row")
        rows = paired(text, None, u=squeezed(F.col(units))).filter("u <> ''")
    else:
        rows = paired(text, gold)
    if isinstance(units, DataFrame):
        rows = rows.join(units.select(*KEY, squeezed(F.col("text")).alias("u")).filter("u <> ''"), KEY)

    def count(t: pa.Array, g: pa.Array, u: pa.Array | None = None) -> list[pa.RecordBatch]:
        sides = [word_ends(t), word_ends(g), *([] if u is None else [word_ends(u)])]
        te, ge, *ue = on_one_line(*sides)
        wide = max(int(at.max()) for _, at in sides) + 1
        own = ue[0] if ue else None
        n = len(own) if ue else int(sides[0][1][np.append(np.flatnonzero(np.diff(sides[0][0])), len(te) - 1)].sum())

        def twos(ends: np.ndarray) -> int:
            row, at = ends // wide, ends % wide
            if ue:
                at = np.searchsorted(own, ends, side="right") - np.searchsorted(own, row * wide, side="right")
            size = steps(row, at)
            return int((size * (size - 1) // 2).sum())

        return [pa.RecordBatch.from_pydict({"both": [twos(np.union1d(te, ge))], "a": [twos(te)], "b": [twos(ge)], "n": [n]})]

    made = by_batch(rows, ["t", "g"] + ["u"] * (units is not None), "both long, a long, b long, n long", count)
    sums = made.agg(*[F.sum(c).cast("double").alias(c) for c in ("both", "a", "b", "n")])
    expected = F.col("a") * F.col("b") / (F.col("n") * (F.col("n") - 1) / 2)
    most = (F.col("a") + F.col("b")) / 2
    same = (F.col("both") == F.col("a")) & (F.col("both") == F.col("b"))
    index = F.when(same, F.lit(1.0)).otherwise((F.col("both") - expected) / (most - expected))
    return sums.select(index.alias("adjusted_rand_index"))


def error_summary(text: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """(category, word, n): gold words by what became of them: correct, over-, under- or mis-segmented.

    The utterance is cut at boundaries that both sides share; a chunk of one word on each side is correct, one gold word in several pieces
    is over-, several gold words in one piece under-segmented, anything else mis-segmented. The places of shared boundaries among those of each side
    say how many words of it a chunk has; only the (category, word) counts of batches shuffle.
    """

    def count(t: pa.Array, g: pa.Array) -> list[pa.RecordBatch]:
        te, ge = on_one_line(word_ends(t), word_ends(g))
        shared = np.intersect1d(te, ge, assume_unique=True)
        ours, theirs = (np.diff(np.searchsorted(e, shared), prepend=-1) for e in (te, ge))
        kind = np.where(theirs == 1, np.where(ours == 1, 0, 1), np.where(ours == 1, 2, 3))
        words = pc.dictionary_encode(pc.split_pattern(g, " ").flatten())
        found, n = np.unique(words.indices.to_numpy().astype(np.int64) * 4 + np.repeat(kind, theirs), return_counts=True)
        category = pa.array(CATEGORIES).take(pa.array(found % 4))
        return [pa.RecordBatch.from_arrays([category, words.dictionary.take(pa.array(found // 4)).cast(pa.string()), pa.array(n.astype(np.int64))], ["category", "word", "n"])]

    made = by_batch(paired(text, gold), ["t", "g"], "category string, word string, n long", count)
    return made.groupBy("category", "word").agg(F.sum("n").alias("n"))
