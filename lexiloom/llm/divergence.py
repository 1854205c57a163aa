"""How the sources of each language diverge in their words, by exact arithmetic, and the terms that set each source apart.

Texts become (lang, source, term) counts inside tasks, a few dozen megabytes of text at once; one shuffle by (lang, term) sums them,
decides what a language keeps and gives its counts. Divergence of two sources sums over all kept terms, of which most stand in neither or one
of the two: each pair of sources starts from the value of absent terms; terms of one source correct it by a histogram of that source's
values, terms of both by a sparse pass over blocks of terms and tiles of sources, summed inside the task. The best terms of a
source come from a radix select: histograms over value bits narrow every group's threshold at once, ties by their UTF-8 bytes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_join, written

#: Documents of a language that must hold a term for it to be kept.
LEAST_DOCUMENTS = 10

#: Bytes of text that a task counts at once; rows of a block of terms; sources of a tile.
CHUNK, ROWS, TILE = 24_000_000, 12_500, 64

#: Terms are runs of ASCII letters and of bytes above 0x7F; only A to Z are lowered.
LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def counted(groups: list[tuple[str, str]], texts: list[bytes]) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of some documents: occurrences, and documents that hold the term."""
    names = {g: i for i, g in enumerate(dict.fromkeys(groups))}
    group = np.array([names[g] for g in groups], dtype=np.int64)
    data = np.frombuffer(b" ".join(texts).translate(LETTERS) + b" ", dtype=np.uint8)
    letter = data != 32
    edge = np.flatnonzero(np.diff(letter.astype(np.int8), prepend=0))
    starts, ends = edge[::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[letter])]).dictionary_encode()
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
    size = max(1, len(words.dictionary))
    held, n = np.unique(doc * size + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
    key, back = np.unique(group[held // size] * size + held % size, return_inverse=True)
    sums = np.bincount(back, weights=n, minlength=len(key)).astype(np.int64)
    docs = np.bincount(back, minlength=len(key)).astype(np.int64)
    own = list(names)
    lang, source = (pa.array([g[k] for g in own], pa.string()).take(pa.array(key // size)) for k in (0, 1))
    return pa.RecordBatch.from_arrays([lang, source, words.dictionary.take(pa.array(key % size)).cast(pa.string()), pa.array(sums), pa.array(docs)], names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs), a few rows for each: what tasks found. Nulls count as ''."""

    def count(batches):
        groups, texts, size = [], [], 0
        for batch in batches:
            lang, source, text = (c.to_pylist() for c in batch.columns)
            for g, t in zip(zip(lang, source, strict=True), text, strict=True):
                data = t.encode()
                if size and size + len(data) > CHUNK:
                    yield counted(groups, texts)
                    groups, texts, size = [], [], 0
                groups.append(g)
                texts.append(data)
                size += len(data) + 1
        if texts:
            yield counted(groups, texts)

    named = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return named.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def kept_terms(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, term, n, total, first): terms in at least ``least`` documents of the language; total is its count there, first marks one row of a term."""
    each = counts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    each = each.withColumns({"total": F.sum("n").over(term), "all_docs": F.sum("docs").over(term), "first": F.row_number().over(term.orderBy("source")) == 1})
    return each.filter(F.col("all_docs") >= least).select("lang", "source", "term", "n", "total", "first")


def share(count: str, size: str) -> str:
    """1 + floor(10^9 * (count + 2) / size), in two whole steps that don't overflow below 2.9e14."""
    high = f"31250 * ({count} + 2)"
    return f"(1 + 32000 * (({high}) div ({size})) + (32000 * (({high}) % ({size}))) div ({size}))"


def gap(p: str, q: str) -> str:
    """floor((p - q)^2 / (p + q))."""
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div (({p}) + ({q}))"


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """A row for each (lang, source), with or without terms: place among the language's sources, size and lang_size (n + 2 V), terms (V), blocks, tiles, base (value of an absent term)."""
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    langs = kept.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("terms"), F.sum("n").alias("all"), F.ceil(F.count("*") / F.lit(ROWS)).alias("blocks"))
    named = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    out = named.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["own", "terms", "all"]).na.fill(1, ["blocks"])
    lang = Window.partitionBy("lang")
    out = out.withColumns({"place": F.row_number().over(lang.orderBy("source")) - 1, "tiles": F.ceil(F.count("*").over(lang) / F.lit(TILE)).cast("int")})
    out = out.withColumns({"size": F.col("own") + 2 * F.col("terms"), "lang_size": F.col("all") + 2 * F.col("terms")})
    base = F.when(F.col("terms") > 0, F.expr(share("0", "size"))).otherwise(0)
    return out.select("lang", "source", "place", "tiles", "blocks", "terms", "size", "lang_size", base.alias("base"))


def shared_terms(pdf: pd.DataFrame) -> pd.DataFrame:
    """What the terms of one block add to each pair of its sources that both hold them, beyond the values of absent terms."""
    term, place = pd.factorize(pdf["term"])[0], pdf["place"].to_numpy()
    known, seen = np.unique(place, return_index=True)
    tile = pdf["tile"].to_numpy()[seen]
    column = np.searchsorted(known, place)
    p = np.zeros((term.max() + 1, len(known)), dtype=np.int64)
    held = np.zeros(p.shape, dtype=bool)
    p[term, column], held[term, column] = pdf["p"], True
    base = np.zeros(len(known), dtype=np.int64)
    base[column] = pdf["base"]
    low, high = pdf["low"].iloc[0], pdf["high"].iloc[0]
    out = []
    for g in np.flatnonzero(tile == low):
        later = np.flatnonzero((known > known[g]) & (tile == high))
        rows = held[:, g]
        if len(later) and rows.any():
            own, other, both = p[rows, g][:, None], p[rows][:, later], held[rows][:, later]
            more = gaps(own, np.where(both, other, 1)) - gaps(own, base[later]) - gaps(base[g], np.where(both, other, 1)) + gaps(base[g], base[later])
            out += [(known[g], h, v) for h, v in zip(known[later], np.where(both, more, 0).sum(axis=0), strict=True)]
    return pd.DataFrame(out, columns=["one", "two", "more"]).assign(lang=pdf["lang"].iloc[0])[["lang", "one", "two", "more"]]


def pair_values(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of sources of a language; a row for each pair is the result itself."""
    own = groups.select("lang", F.col("place").alias("one"), F.col("base").alias("a"), "terms", "source")
    other = groups.select("lang", F.col("place").alias("two"), F.col("base").alias("b"), F.col("source").alias("item"))
    pairs = own.join(other, "lang").filter("one <> two")
    absent = F.when(F.col("terms") > 0, F.col("terms") * F.expr(gap("a", "greatest(b, 1)"))).otherwise(0)
    seen = rows.groupBy("lang", F.col("place").alias("one"), F.col("base").alias("a"), "p").agg(F.count("*").alias("m")).join(other, "lang").filter("one <> two")
    single = seen.select("lang", F.least("one", "two").alias("one"), F.greatest("one", "two").alias("two"), F.expr(f"m * ({gap('p', 'b')} - {gap('a', 'b')})").alias("more"))
    single = single.groupBy("lang", "one", "two").agg(F.sum("more").alias("more"))
    tile = F.floor(F.col("place") / TILE).cast("int")
    met = rows.withColumns({"tile": tile, "other": F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))}).withColumn("block", F.pmod(F.xxhash64("term"), "blocks"))
    met = met.select("lang", "block", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "term", "place", "p", "base")
    both = met.groupBy("lang", "block", "low", "high").applyInPandas(shared_terms, "lang string, one int, two int, more long")
    more = single.unionByName(both).groupBy("lang", "one", "two").agg(F.sum("more").alias("more"))
    out = pairs.withColumns({"absent": absent, "low": F.least("one", "two"), "high": F.greatest("one", "two")})
    out = out.join(more.select("lang", F.col("one").alias("low"), F.col("two").alias("high"), "more"), ["lang", "low", "high"], "left")
    return out.select("lang", "source", "item", (F.col("absent") + F.coalesce("more", F.lit(0))).alias("value"))


def leaders(rows: DataFrame, keys: list[str], value: str, item: str, k: int, few: int = 256) -> DataFrame:
    """``rows`` of the k largest ``value`` (whole numbers from 0) of each group of ``keys``, ties to the smaller ``item`` by UTF-8 bytes, and rank.

    Radix select: each round is a histogram of the next eight bits of the values that share their group's prefix so far, and moves all groups' thresholds
    at once. Where more than ``few`` values tie with a threshold, rounds over the items' bytes go on in the same way. Only
    what lies at or above the thresholds is sorted. Keys hold no nulls; items of a group differ.
    """
    most = rows.agg(F.max(value)).first()[0] or 0

    def narrow(open_: DataFrame, digit: Column, order, join) -> DataFrame:
        counts = open_.groupBy(*keys, "prefix", "need", digit.alias("digit")).agg(F.count("*").alias("held"))
        seen = F.sum("held").over(Window.partitionBy(*keys).orderBy(order(F.col("digit"))))
        last = F.sum("held").over(Window.partitionBy(*keys))
        counts = counts.withColumns({"seen": seen, "last": last}).filter("seen - held < need and (seen >= need or seen = last)")
        return counts.select(*keys, join("prefix", "digit").alias("prefix"), (F.col("need") - F.col("seen") + F.col("held")).alias("need"), "held")

    bound = None
    for shift in range((max(1, most.bit_length()) - 1) // 8 * 8, -1, -8):
        open_ = rows.withColumns({"prefix": F.lit(0).cast("long"), "need": F.lit(k).cast("long")}) if bound is None else bounded_join(rows, bound, keys, "inner").filter(F.shiftright(value, shift + 8) == F.col("prefix"))
        bound = written(narrow(open_, F.shiftright(value, shift).bitwiseAND(255), F.desc, lambda p, d: F.col(p) * 256 + F.col(d)), "thresholds")
    bytes_ = F.col(item).cast("binary")
    ties = bound.select(*keys, F.col("prefix").alias("least"), "need", "held", F.lit(b"").alias("prefix"))
    settled, at = ties.filter(f"held <= need or held <= {few}"), 0
    ties = ties.filter(f"held > need and held > {few}")
    while not ties.isEmpty():
        least = ties.select(*keys, "least")
        open_ = bounded_join(rows, ties.drop("held"), keys, "inner").filter(F.col(value) == F.col("least")).withColumn("_bytes", bytes_).filter("substring(_bytes, 1, length(prefix)) = prefix")
        ties = narrow(open_, F.expr(f"substring(_bytes, {at + 1}, 1)"), F.asc, lambda p, d: F.concat(p, d)).join(least, keys)
        ties, at = written(ties.select(*keys, "least", "need", "held", "prefix"), "ties"), at + 1
        settled = settled.unionByName(ties.filter(f"held <= need or held <= {few}"))
        ties = ties.filter(f"held > need and held > {few}")
    bound = settled.select(*keys, "least", "prefix")
    near = bounded_join(rows, bound, keys, "inner").withColumn("_bytes", bytes_).filter(F.expr(f"{value} > least or {value} = least and substring(_bytes, 1, length(prefix)) <= prefix"))
    order = Window.partitionBy(*keys).orderBy(F.desc(value), item)
    return near.drop("least", "prefix", "_bytes").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def audit(docs: DataFrame, k: int = 10, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, part, item, value, rank): of each source of each language its divergence from every other (``pair``) and its k telling terms (``term``).

    Null text, lang and source count as ''. Repeated rows are documents of their own. Groups without kept terms have pairs, of value 0 where
    their language keeps none, and no terms. Ties go to the smaller item by UTF-8 bytes. A text above ``CHUNK`` bytes is counted alone. All numbers
    are whole and exact below 2.9e14 words of a language. Columns other than text, lang and source are ignored, whatever their names.
    An empty table gives an empty result.
    """
    docs = docs.select("lang", "source", "text")
    kept = written(kept_terms(term_counts(docs), least), "kept-terms")
    groups = written(groups_of(docs.select("lang", "source"), kept), "sources")
    rows = bounded_join(kept.drop("first"), groups, ["lang", "source"], "inner").withColumns({"p": F.expr(share("n", "size")), "q": F.expr(share("total", "lang_size"))})
    rows = written(rows.select("lang", "source", "place", "tiles", "blocks", "term", "p", "q", "base"), "shares")
    pairs = pair_values(rows, groups)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumns({"part": F.lit("pair"), "rank": F.row_number().over(order)})
    telling = rows.filter("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(gap("p", "q")).alias("value"))
    terms = leaders(telling, ["lang", "source"], "value", "item", k).withColumn("part", F.lit("term"))
    wanted = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*wanted).unionByName(terms.select(*wanted))
