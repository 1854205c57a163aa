"""Diphone-based segmentation: a boundary stands where the probability of a word boundary inside a diphone is high."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import computed, let
from ..functions.pairs import cut_by_scores
from ..functions.separator import Separator
from ..sources.text import kept

KEY = ["doc_id", "line_no"]


MARK = "\u0001"
#: Pairs of units that are counted in a table; beyond, they are sorted.
CELLS = 1 << 22


def plain_separators(separator: Separator, level: str) -> bool:
    """Whether units are apart by spaces and the other separators are literal, printable and without spaces."""
    literal = lambda s: s is None or re.fullmatch(r"[!-~]+", s) and re.escape(s) == s
    return level == "phone" and separator.phone == " " and separator.word is not None and all(map(literal, separator.upper_levels("phone") and (separator.syllable, separator.word)))


def marked(text: Column, separator: Separator) -> Column:
    """Units of a printable text apart by single spaces, MARK between words; words without units are left out."""
    mark = f" {MARK} "
    # a space before a separator goes with it, so that most texts have no spaces in a row and no pattern is needed
    text = F.replace(F.replace(text, F.lit(" " + separator.word), F.lit(mark)), F.lit(separator.word), F.lit(mark))
    text = F.replace(text, F.lit(separator.syllable), F.lit(" ")) if separator.syllable else text
    text = let(text, lambda t: F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, "  +", " ")).otherwise(t))
    text = let(text, lambda t: F.when(F.contains(t, F.lit(f"{MARK} {MARK}")), F.regexp_replace(t, f"{MARK}(?: {MARK})+", MARK)).otherwise(t))
    return F.btrim(text, F.lit(f" {MARK}"))


def batch_counts(texts: pa.Array) -> pa.RecordBatch:
    """(kind, a, b, x, y) of a batch of texts as ``marked`` makes them, in arrays of numbers."""
    full = texts.filter(pc.not_equal(texts, ""))
    lists = pc.split_pattern(full.cast(pa.large_string()), " ")
    flat, stops = pc.dictionary_encode(lists.flatten()), lists.offsets.to_numpy()
    names = flat.dictionary.cast(pa.string())
    codes, row, n = flat.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(full)), np.diff(stops)), len(names)
    at = np.flatnonzero(codes != pc.index(names, MARK).as_py())
    units, row = codes[at], row[at]
    # a mark is never alone at an end, nor beside another, so units that a mark parts stand two apart
    first = np.ones(len(at), dtype=bool)
    first[1:] = row[1:] != row[:-1]
    keys = ((units[:-1] * n + units[1:]) * 2 + (np.diff(at) == 2))[~first[1:]]
    pairs, k = np.unique(keys, return_counts=True) if 2 * n * n > CELLS else (np.flatnonzero(own := np.bincount(keys, minlength=1)), own[own > 0])
    edges = [np.unique(units[e], return_counts=True) for e in (first, np.append(first[1:], True)[: len(at)])]
    apart = pairs % 2 == 1
    none = pa.nulls(2, pa.string())
    take = lambda x: names.take(pa.array(x))
    kind = ["line", "size", *["initial"] * len(edges[0][0]), *["final"] * len(edges[1][0]), *["pair"] * len(pairs)]
    left = pa.concat_arrays([none, *(take(e) for e, _ in edges), take(pairs // 2 // n if n else pairs)])
    right = pa.concat_arrays([none, pa.nulls(sum(len(e) for e, _ in edges), pa.string()), take(pairs // 2 % n if n else pairs)])
    x = np.concatenate([[len(texts), len(codes) - len(at) + len(full)], *(c for _, c in edges), np.where(apart, 0, k)])
    y = np.concatenate([[0, len(at)], *(0 * c for _, c in edges), np.where(apart, k, 0)])
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), left, right, pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["kind", "a", "b", "x", "y"])


def marked_counts(lines: DataFrame) -> DataFrame:
    """(kind, a, b, x, y), a batch's counts in a few rows, of texts ``t`` as ``marked`` makes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_counts(batch.column(0))

    return lines.select("t").mapInArrow(run, "kind string, a string, b string, x long, y long")


def general_counts(lines: DataFrame, separator: Separator, units: Callable[[Column], Column]) -> DataFrame:
    """(kind, a, b, x, y) of tagged texts with any separators."""
    words = separator.tokenize(F.col("text"), "word", keep_boundaries=True)
    rows = lines.select(F.filter(words, lambda w: w != "").alias("w"))
    rows = rows.withColumn("u", F.transform("w", units)).withColumn("f", F.flatten("u"))
    # for each unit, whether its word ends there
    rows = rows.withColumn("e", F.flatten(F.transform("u", lambda w: F.transform(w, lambda x, i: i == F.size(w) - 1))))
    n = F.greatest(F.size("f") - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice("f", 1, n).alias("a"), F.slice("f", 2, n).alias("b"), F.slice("e", 1, n).alias("cut"))
    row = lambda kind, a, b, x, y: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), x.cast("long").alias("x"), y.cast("long").alias("y"))
    none, one, zero = F.lit(None).cast("string"), F.lit(1), F.lit(0)
    edges = F.filter(F.array(row("initial", F.get("f", F.lit(0)), none, one, zero), row("final", F.get("f", F.size("f") - 1), none, one, zero)), lambda r: r["a"].isNotNull())
    seen = F.array(row("line", none, none, one, zero), row("size", none, none, F.size("w"), F.size("f")))
    found = F.concat(seen, edges, F.transform(pairs, lambda p: row("pair", p["a"], p["b"], F.when(p["cut"], 0).otherwise(1), F.when(p["cut"], 1).otherwise(0))))
    return rows.select(F.inline(found))


def word_types(lines: DataFrame, separator: Separator) -> DataFrame:
    """(word): the different words of tagged texts, with their inner separators. What stands between word separators is made distinct before it is stripped."""
    raw = F.split("text", separator.word, -1) if separator.word else F.array("text")
    types = lines.select(F.explode(raw).alias("raw")).distinct().filter("raw <> ''")
    bare = separator.strip(separator.strip(F.col("raw"), "word")) if separator.word else separator.strip(F.col("raw"))
    return types.select(bare.alias("word")).filter("word <> ''").distinct()


def marked_words(lines: DataFrame) -> DataFrame:
    """(word): the words, repeated, of texts ``t`` as ``marked`` makes them."""
    return lines.select(F.explode(F.split("t", MARK, -1)).alias("word")).select(F.trim("word").alias("word")).filter("word <> ''")


def summary(tagged: DataFrame, separator: Separator = Separator(), level: str = "phone") -> dict:
    """Counts of a tagged corpus: nlines, nwords, nphones, and the tables diphones (a, b, internal, spanning), initial, final and words."""
    units = lambda w: separator.tokenize(w, level, keep_boundaries=False)
    # the text is computed once: filters and all that is read of it would otherwise take along what makes it
    lines = computed(tagged, [], text=F.col("text")).filter(F.trim("text") != "")
    if plain_separators(separator, level):
        strange = F.col("text").rlike("[^ -~]")
        # what marked texts don't tell of words: their syllables, and spaces in a row
        inner = ~strange & (F.contains("text", F.lit("  ")) | (F.contains("text", F.lit(separator.syllable)) if separator.syllable else F.lit(False)))
        held = kept(lines.select(F.when(~strange, marked(F.col("text"), separator)).alias("t"), F.when(strange, F.col("text")).alias("text"), F.when(inner, F.col("text")).alias("inner")), "marked")
        found = marked_counts(held.filter("t is not null")).unionByName(general_counts(held.filter("text is not null"), separator, units))
        words = word_types(held.select(F.coalesce("text", "inner").alias("text")).filter("text is not null"), separator)
        words = words.unionByName(marked_words(held.filter("t is not null and inner is null"))).distinct()
    else:
        found, words = general_counts(lines, separator, units), word_types(lines, separator)
    # the table of pair types is kept for what is drawn from it
    table = found.groupBy("kind", "a", "b").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).persist()
    own = lambda kind: table.filter(F.col("kind") == kind)
    total = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(c))), F.lit(0)).cast("long")
    edge = lambda kind: own(kind).select(F.col("a").alias("unit"), F.col("x").alias("n"))
    return {
        "counts": table.agg(total("line", "x").alias("nlines"), total("size", "x").alias("nwords"), total("size", "y").alias("nphones")),
        "diphones": own("pair").select("a", "b", F.col("x").alias("internal"), F.col("y").alias("spanning")),
        "initial": edge("initial"),
        "final": edge("final"),
        "words": words,
        "units": units,
    }


def fit(trained: dict, kind: str = "phrasal", pwb: float | None = None, unit_edges: bool = False) -> DataFrame:
    """(a, b, score): the probability of a boundary inside each diphone.

    gold: share of spanning occurrences. phrasal and lexical: P(a ends) pwb P(b begins) / P(ab), at most 1, with the edges of phrases or
    of word types. Lexical edges are first and last characters; ``unit_edges`` takes whole units. ``pwb`` of 0 or None is estimated.
    """
    diphones = trained["diphones"]
    if kind == "gold":
        return diphones.select("a", "b", (F.col("spanning") / (F.col("internal") + F.col("spanning"))).alias("score"))
    if kind == "phrasal":
        first, last = trained["initial"], trained["final"]
    elif kind == "lexical":
        word = F.col("word")
        ends = trained["words"].select(
            (F.get(trained["units"](word), F.lit(0)) if unit_edges else F.substring(word, 1, 1)).alias("first"),
            (F.element_at(trained["units"](word), -1) if unit_edges else F.expr("right(word, 1)")).alias("last"),
        )
        # word types are made once; both sides and their totals come from the pairs of their ends
        ends = kept(ends.groupBy("first", "last").agg(F.count("*").alias("n")), "ends")
        side = lambda c: ends.groupBy(F.col(c).alias("unit")).agg(F.sum("n").alias("n"))
        first, last = side("first"), side("last")
    else:
        raise ValueError(f"kind must be gold, phrasal or lexical, it is '{kind}'")
    if not pwb:
        c = trained["counts"].first()
        pwb = (c["nwords"] - c["nlines"]) / (c["nphones"] - c["nlines"]) if c["nphones"] != c["nlines"] else 0.0
    share = lambda df, at: df.select(F.col("unit").alias(at), (F.col("n") / F.lit(df.agg(F.sum("n")).first()[0])).alias(f"p_{at}"))
    total = diphones.agg(F.sum(F.col("internal") + F.col("spanning"))).first()[0]
    joined = diphones.join(share(last, "a"), "a", "left").join(share(first, "b"), "b", "left")
    over = F.coalesce("p_a", F.lit(0.0)) * F.lit(float(pwb)) * F.coalesce("p_b", F.lit(0.0))
    under = (F.col("internal") + F.col("spanning")) / F.lit(total)
    return joined.select("a", "b", F.when(over >= under, F.lit(1.0)).otherwise(over / under).alias("score"))


def apply(prepared: DataFrame, model: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``prepared`` with its text cut where the score is above the threshold; unseen diphones score 1."""
    return cut_by_scores(prepared, model, 1.0, lambda before, own, after: own > threshold, KEY)


KINDS = ("phrasal", "lexical", "gold")


def segment(prepared: DataFrame, trained: dict, type: str = "phrasal", threshold: float = 0.5, pwb: float | None = None, scores: Callable[[dict, float | None], DataFrame] | None = None) -> DataFrame:
    """``prepared`` segmented with a trained summary. ``scores`` may give another model (a, b, score) of the summary and ``pwb``."""
    if scores is None and type not in KINDS:
        raise ValueError(f"unknown segmenter {type}, must be phrasal, lexical or gold")
    for name, value in (("pwb", pwb), ("threshold", threshold)):
        if value is not None and not 0 <= value <= 1:
            raise ValueError(f"{name} must be a float in [0, 1], it is: {value}")
    return apply(prepared, scores(trained, pwb) if scores else fit(trained, type, pwb), threshold)
