"""Scores of adjacent units, looked up in a model table (a, b, score)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .separator import squeezed

#: Pairs that a model may have to travel to every task; larger models are joined.
MAP_PAIRS = 20_000
#: Kinds of units up to which their pairs are a square table in memory; beyond, they are sorted.
SQUARE = 2000


class Table:
    """Scores of pairs of units by the numbers of the units; ``default`` for others."""

    def __init__(self, pairs: list[tuple], default: float) -> None:
        self.places: dict[str, int] = {}
        place = lambda unit: self.places.setdefault(unit, len(self.places))
        rows = [(place(a), place(b), default if score is None else score) for a, b, score in pairs if a is not None and b is not None]
        self.n, self.default = len(self.places) + 1, default  # the last number is that of unknown units
        a, b, scores = (np.array([r[k] for r in rows], dtype=kind) for k, kind in enumerate((np.int64, np.int64, np.float64)))
        order = np.argsort(a * self.n + b)
        self.keys, self.scores = (a * self.n + b)[order], scores[order]
        if self.n <= SQUARE:
            self.square = np.full(self.n * self.n, default)
            self.square[self.keys] = self.scores

    def numbers(self, units: list[str]) -> np.ndarray:
        return np.array([self.places.get(u, self.n - 1) for u in units], dtype=np.int64)

    def adjacent(self, units: np.ndarray) -> np.ndarray:
        """Scores of each unit with the next."""
        keys = units[:-1] * self.n + units[1:]
        if self.n <= SQUARE:
            return self.square[keys]
        if not len(self.keys):
            return np.full(len(keys), self.default)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.scores[at], self.default)


def cut_texts(texts: pa.Array, first: np.ndarray, last: np.ndarray, table: Table, rule: Callable, edge: str) -> pa.Array:
    """Texts of units apart by single spaces, joined to words: ``rule`` says of the scores of a pair, of the one before and the one after whether it is cut.

    Beyond both ends of a text stands ``edge``. Rows that ``first`` marks keep their first two units together, those that ``last`` marks their last two.
    """
    lists = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), " ")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat, stops = pc.dictionary_encode(lists.flatten()), lists.offsets.to_numpy().astype(np.int64)
    stops = stops - stops[0]
    codes, names = flat.indices.to_numpy().astype(np.int64), flat.dictionary
    # one row of numbers: an edge, the units of the first text, an edge, those of the second, ...
    at = np.arange(len(codes)) + np.repeat(np.arange(1, len(stops)), np.diff(stops))
    line = np.full(len(codes) + len(stops), table.numbers([edge])[0])
    line[at] = table.numbers(names.to_pylist())[codes]
    scores = table.adjacent(line)
    after = rule(scores[at - 1], scores[at], scores[np.minimum(at + 1, len(scores) - 1)])
    ends = stops[1:] - 1
    after[ends] = False
    after[stops[:-1][first]] = False
    after[np.maximum(ends - 1, stops[:-1])[last]] = False
    words = pa.concat_arrays([names, pc.binary_join_element_wise(pa.scalar(" ", names.type), names, pa.scalar("", names.type))])
    begun = np.concatenate([np.zeros(1, dtype=bool), after[:-1]])
    # the pieces stand one after another in memory, so a text is where its first piece begins up to where that of the next text does
    pieces = words.take(pa.array(codes + begun * len(names)))
    _, places, letters = pieces.buffers()
    out = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(np.frombuffer(places, dtype=np.int64)[stops])), letters)
    return pc.if_else(pc.is_null(texts), pa.scalar(None, pa.string()), out.cast(pa.string()))


def cut_by_scores(df: DataFrame, model: DataFrame, default: float, rule: Callable, key: list[str], edge: str | None = None) -> DataFrame:
    """``df`` (``key``, text, ...) with its text of units cut to words by the scores of adjacent pairs in ``model`` (a, b, score).

    ``rule`` takes the scores of the pair before, the pair and the pair after, as arrays or columns (with ``edge`` beyond the ends of a text, without it only the
    pair counts), and says where a boundary stands. Columns _first and _last, if there, mark the rows of the ends of the corpus, which keep two units together.

    A model of few pairs goes to every task, and texts are cut where they are, a batch at a time in arrays of numbers. Other models are joined to the exploded pairs.
    """
    model = model.select("a", "b", F.col("score").cast("double").alias("score"))
    held = model.limit(MAP_PAIRS + 1).collect()  # also spares computing the model again for every use
    ends = [F.col(c) if c in df.columns else F.lit(False) for c in ("_first", "_last")]
    if len(held) <= MAP_PAIRS:
        table, beyond = Table([tuple(r) for r in held], default), " " if edge is None else edge

        def cut(texts: pa.Array, first: pa.Array, last: pa.Array) -> pa.Array:
            flags = [x.to_numpy(zero_copy_only=False).astype(bool) for x in (first, last)]
            return cut_texts(texts, *flags, table, rule, beyond)

        return df.withColumn("text", F.arrow_udf(cut, "string")(squeezed(F.col("text")), *ends))
    units = F.array_remove(F.split(squeezed(F.col("text")), " ", -1), "")
    rows = df.withColumn("_u", units)
    wide = F.col("_u") if edge is None else F.concat(F.array(F.lit(edge)), "_u", F.array(F.lit(edge)))
    rows = pair_scores(rows.withColumn("_e", wide), "_e", model, default, "_s", key)
    if edge is None:
        cuts = F.transform("_s", lambda s: rule(s, s, s))
    else:
        n = F.greatest(F.size("_s") - 2, F.lit(0))
        cuts = F.transform(F.arrays_zip(*[F.slice("_s", k + 1, n).alias(c) for k, c in enumerate("xyz")]), lambda p: rule(p["x"], p["y"], p["z"]))
    n = F.size("_u") - 1
    cuts = F.transform(cuts, lambda c, i: c & ~(ends[0] & (i == 0)) & ~(ends[1] & (i == n - 1)))
    return rows.withColumn("text", joined_units(F.col("_u"), cuts)).drop("_u", "_e", "_s")


def pair_scores(df: DataFrame, units: str, model: DataFrame, default: float, to: str, key: list[str]) -> DataFrame:
    """``df`` plus ``to``: for the array ``units`` of each row (rows have unique ``key``), the scores of its adjacent pairs.

    The model is joined to the exploded pairs.
    """
    count = F.size(units)
    pairs = df.select(*key, F.posexplode(F.arrays_zip(F.slice(units, 1, F.greatest(count - 1, F.lit(0))).alias("a"), F.slice(units, 2, F.greatest(count - 1, F.lit(0))).alias("b"))).alias("_i", "_p"))
    scored = pairs.select(*key, "_i", F.col("_p.a").alias("a"), F.col("_p.b").alias("b")).join(model.select("a", "b", "score"), ["a", "b"], "left")
    scored = scored.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_i", F.coalesce("score", F.lit(default)).alias("s")))).alias("_scored"))
    out = df.join(scored, key, "left")
    return out.withColumn(to, F.coalesce(F.transform("_scored", lambda x: x["s"]), F.array().cast("array<double>"))).drop("_scored")


def joined_units(units: Column, cuts: Column) -> Column:
    """Words from units and, for each adjacent pair, whether a boundary stands there: one string, words apart by a space.

    Zipped, so that long arrays are read once; an expression inside a lambda would be evaluated for every element.
    """
    pieces = F.zip_with(units, F.concat(F.array(F.lit(False)), cuts), lambda u, c: F.when(c, F.concat(F.lit(" "), u)).otherwise(u))
    return F.array_join(F.filter(pieces, lambda x: x.isNotNull()), "")
