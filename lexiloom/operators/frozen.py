"""Best splits under a frozen lexicon: batches of utterances in arrays of numbers, or a fold over arrays where a lexicon is too large to be held.

The lexicon is a table of words and counts; with its letters it gives every word a cost, minus the logarithm of its probability in a restaurant
that is open to new words (concentration ``b``, base by letters), in whole millionths, so that sums are exact and equal splits tie everywhere.
A lexicon of few words goes to every task; for others stretches of units that are words meet their costs in a join. A new word costs the sum of its units and a constant, so the
best new word that ends at a place follows from a running minimum, and a fold reads an utterance once: linear in its units and the
words that it holds.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.separator import squeezed
from ..functions.splits import Words, split_texts
from ..sources.text import kept, sized
from .prepare import units_of

KEY = ["doc_id", "line_no"]

#: Rows of a lexicon that are broadcast; a larger one is joined by a shuffle.
WORDS = 500_000
MICRO = 1_000_000
#: Words of a lexicon that goes to every task as a tree.
TREE = 50_000

#: Starts that a chunk holds.
CHUNK = 256


def lexicon(segmented: DataFrame) -> DataFrame:
    """(word, n) of a segmented corpus."""
    return segmented.select(F.explode(F.split("text", " ")).alias("word")).filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def micro(x: Column) -> Column:
    """Minus ln x in whole millionths."""
    return F.round(-MICRO * F.ln(x)).cast("long")


class Costs:
    """A lexicon's words with their costs (``words``: word, cost, size in letters), costs of letters, and what a new word and an unknown letter cost."""

    def __init__(self, counts: DataFrame, b: float = 1.0) -> None:
        if b <= 0:
            raise ValueError(f"the concentration must be positive, it is {b}")
        counts = kept(counts.select("word", F.col("n").cast("long").alias("n")), "lexicon")
        letters = F.filter(F.split("word", ""), lambda c: c != "")
        chars = counts.select(F.explode(letters).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
        known = counts.agg(F.count("*").alias("types"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.max(F.length("word")), F.lit(0)).alias("longest")).first()
        drawn = chars.agg(F.count("*").alias("kinds"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
        types, total, self.longest = known["types"], known["total"], known["longest"]
        ends, spare = drawn["n"] + types + 1, 1 / (drawn["kinds"] + 1)
        self.letter, self.new = round(-MICRO * math.log(spare / ends)), round(-MICRO * math.log(b / (total + b))) + round(-MICRO * math.log((types + 1) / ends))
        # a row for each letter of the alphabet, as one map
        cost = chars.select("c", micro((F.col("n") + spare) / ends).alias("cost"))
        self.letters = kept(cost.agg(F.map_from_entries(F.collect_list(F.struct("c", "cost"))).alias("letters")), "letters")
        base = F.exp(-self.spelled(letters, F.col("letters")) / MICRO) * ((types + 1) / ends)
        self.words = kept(counts.crossJoin(F.broadcast(self.letters)).select("word", micro((F.col("n") + b * base) / (total + b)).alias("cost"), F.length("word").alias("size")), "word-costs")

    def spelled(self, letters: Column, table: Column) -> Column:
        """Sum of the letters' costs."""
        return F.aggregate(letters, F.lit(0).cast("long"), lambda s, c: s + F.coalesce(F.try_element_at(table, c), F.lit(self.letter)))


def best_cuts(events: Column, new: int, reach: int) -> Column:
    """(cost, back) of the best split: ``back[j]`` is where the last word of the best split of the first j units starts.

    ``events`` are (stop, start, word, unit): a known word (its cost, else null) of the units from start to stop, in the order of stop
    and start; that of one unit comes last and has the unit's own cost. Ties go to the earlier start. Words begin at most ``reach`` units
    before their end, so only so many costs are carried on; the starts are kept in chunks, so that a long utterance isn't copied at each of its units.
    """
    pair = "struct<cost:bigint,start:int>"
    none = F.struct(F.lit(1 << 60).alias("cost"), F.lit(-1).alias("start")).cast(pair)
    begin = F.struct(
        F.array(F.lit(0).cast("long")).alias("costs"), F.array(F.array(F.lit(0))).alias("full"), F.array().cast("array<int>").alias("chunk"),
        none.alias("now"), none.alias("open"), F.lit(0).cast("long").alias("spelled"),
    )

    def known(s: Column, e: Column) -> Column:
        by_word = F.struct((F.element_at(s["costs"], e["start"] - e["stop"]) + e["word"]).alias("cost"), e["start"].alias("start")).cast(pair)
        return F.when(e["word"].isNotNull(), F.least(s["now"], by_word)).otherwise(s["now"])

    def close(s: Column, e: Column) -> Column:
        from_here = F.struct((F.element_at(s["costs"], -1) - s["spelled"]).alias("cost"), e["start"].alias("start")).cast(pair)
        as_new = lambda o: F.struct((o["cost"] + s["spelled"] + e["unit"] + F.lit(new)).alias("cost"), o["start"].alias("start")).cast(pair)
        return let(F.least(s["open"], from_here), lambda o: let(F.least(known(s, e), as_new(o)), lambda best: let(F.concat(s["chunk"], F.array(best["start"])), lambda chunk: moved(s, e, o, best, chunk))))

    def moved(s: Column, e: Column, o: Column, best: Column, chunk: Column) -> Column:
        costs = F.concat(F.when(F.size(s["costs"]) < reach, s["costs"]).otherwise(F.slice(s["costs"], 2, reach - 1)), F.array(best["cost"]))
        room = F.size(chunk) < CHUNK
        full, rest = F.when(room, s["full"]).otherwise(F.concat(s["full"], F.array(chunk))), F.when(room, chunk).otherwise(F.array().cast("array<int>"))
        return F.struct(costs.alias("costs"), full.alias("full"), rest.alias("chunk"), none.alias("now"), o.alias("open"), (s["spelled"] + e["unit"]).alias("spelled"))

    def read(s: Column, e: Column) -> Column:
        stayed = F.struct(*[(known(s, e) if c == "now" else s[c]).alias(c) for c in ("costs", "full", "chunk", "now", "open", "spelled")])
        return F.when(e["start"] + 1 == e["stop"], close(s, e)).otherwise(stayed)

    return F.aggregate(events, begin, read, lambda s: F.struct(F.element_at(s["costs"], -1).alias("cost"), F.flatten(F.concat(s["full"], F.array(s["chunk"]))).alias("back")))


def cut_starts(back: Column) -> Column:
    """Starts of the words, in order, from the places where the best words start."""
    down = F.reverse(F.sequence(F.lit(1), F.size(back) - 1))
    state = F.struct((F.size(back) - 1).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(s: Column, j: Column) -> Column:
        start = F.element_at(back, j + 1)
        return F.when(s["at"] == j, F.struct(start.alias("at"), F.concat(F.array(start), s["starts"]).alias("starts"))).otherwise(s)

    return F.aggregate(down, state, step)["starts"]


def viterbi(prepared: DataFrame, costs: Costs, most: int = WORDS) -> DataFrame:
    """(doc_id, line_no, text, cost): each utterance of ``prepared`` by its best split, and what it costs in millionths.

    A lexicon of at most ``TREE`` words, and ``most``, goes to every task, and utterances are split where they are. For a larger one, stretches of at most as many units as the longest word has letters are looked up, by a broadcast of the lexicon below ``most`` words, counted
    first. Utterances of nothing stay as they are, with cost 0.
    """
    rows = prepared.select(*KEY, "text")
    held = costs.words.select("word", "cost").limit(min(most, TREE) + 1).collect()
    if len(held) <= min(most, TREE):
        words = Words(dict(map(tuple, held)), costs.letters.first()["letters"] or {}, costs.letter, costs.new)
        kind = pa.struct([("text", pa.string()), ("cost", pa.int64())])

        def split(texts: pa.Array) -> pa.Array:
            found, own = split_texts(texts, words)
            return pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(own)], fields=list(kind))

        return rows.select(*KEY, F.arrow_udf(split, "text string, cost long")(squeezed(F.col("text"))).alias("_best")).select(*KEY, "_best.text", "_best.cost")
    most_units = F.lit(max(1, costs.longest))
    stretch = lambda u, i, k: F.struct((i + k).alias("stop"), i.alias("start"), F.array_join(F.slice(u, i + 1, k), "").alias("word"))
    from_ = lambda u, i: F.transform(F.sequence(F.lit(1), F.least(most_units, F.size(u) - i)), lambda k: stretch(u, i, k))
    # the units are bound: an expression inside a lambda would be computed for every stretch
    all_ = let(units_of(F.col("text")), lambda u: F.when(F.size(u) > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.size(u) - 1), lambda i: from_(u, i)))))
    looked = rows.select(*KEY, F.inline(all_))
    met = sized(looked, costs.words.select("word", "cost"), ["word"], "left", most).filter("cost is not null or stop = start + 1")
    letters = F.filter(F.split("word", ""), lambda c: c != "")
    unit = F.when(F.col("stop") == F.col("start") + 1, costs.spelled(letters, F.col("letters")))
    met = met.crossJoin(F.broadcast(costs.letters)).select(*KEY, F.struct("stop", "start", F.col("cost").alias("word"), unit.alias("unit")).alias("event"))
    found = met.groupBy(*KEY).agg(F.sort_array(F.collect_list("event")).alias("events")).select(*KEY, best_cuts(F.col("events"), costs.new, max(1, costs.longest)).alias("best"))
    found = found.select(*KEY, F.col("best.cost").alias("cost"), cut_starts(F.col("best.back")).alias("starts"))
    out = rows.join(found, KEY, "left")
    stops = lambda u: F.concat(F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0))), F.array(F.size(u)))
    words = let(units_of(F.col("text")), lambda u: F.array_join(F.zip_with("starts", stops(u), lambda x, y: F.array_join(F.slice(u, x + 1, y - x), "")), " "))
    return out.select(*KEY, F.coalesce(words, F.lit("")).alias("text"), F.coalesce("cost", F.lit(0)).alias("cost"))


def item_costs(items: DataFrame, costs: Costs, column: str, most: int = WORDS) -> DataFrame:
    """``items`` plus ``column``_cost: what the word in ``column`` costs as one word, known or new."""
    letters = F.filter(F.split(column, ""), lambda c: c != "")
    met = sized(items, costs.words.select(F.col("word").alias(column), F.col("cost").alias("_cost")), [column], "left", most).crossJoin(F.broadcast(costs.letters))
    new = costs.spelled(letters, F.col("letters")) + F.lit(costs.new)
    return met.withColumn(f"{column}_cost", F.coalesce("_cost", new)).drop("_cost", "letters")


def forced_choice(pairs: DataFrame, costs: Costs, first: str = "text", second: str = "other") -> DataFrame:
    """``pairs`` plus ``choice``: how likely the first of two items is the word, p1 / (p1 + p2), by a frozen lexicon."""
    both = item_costs(item_costs(pairs, costs, first), costs, second)
    odds = F.exp((F.col(f"{first}_cost") - F.col(f"{second}_cost")) / MICRO)
    return both.withColumn("choice", 1 / (1 + odds))
