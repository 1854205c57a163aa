"""Incremental lexicon learner: known words with known edges cut an utterance, and what is cut is learned.

A learner reads its utterances in order, so one learner is one group of rows: a document, a conversation, or a fold. Learners run side
by side, their models add up as tables, and a frozen model segments any number of utterances in parallel.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import known as known_words
from . import folding

KEY = ["doc_id", "line_no"]
MODEL = "kind string, item string, n long"
#: Rows that a frozen model may have to be sent to every task.
MODEL_ROWS = 500_000
#: Letters by which words are looked up together with how long they may be, and rows of models that are sent on together.
HEAD, ROWS = 4, 10_000


class Learner:
    """Counts of words and of the units at their edges. With ``memory``, only so many words stay after an utterance: those learned last."""

    def __init__(self, window: int = 2, by_frequency: bool = False, memory: int = 0) -> None:
        self.window, self.by_frequency, self.memory = window, by_frequency, memory
        self.words, self.begins, self.ends = Counter(), Counter(), Counter()
        self.touched: set[str] = set()
        self.sizes: dict[str, Counter] = {}  # numbers of the known words by their first letters and their length, from HEAD letters on

    def know(self, word: str, n: int = 1) -> None:
        if word not in self.words:
            if len(word) >= HEAD:
                self.sizes.setdefault(word[:HEAD], Counter())[len(word)] += 1
        elif self.memory:
            n += self.words.pop(word)  # the order of the words is that of learning
        self.words[word] += n
        self.touched.add(word)

    def forget(self) -> None:
        """Let go of the words that were learned longest ago, beyond the memory; edges stay, their number is that of the runs of units."""
        while self.memory and len(self.words) > self.memory:
            word = next(iter(self.words))
            del self.words[word]
            if len(word) >= HEAD:
                sizes = self.sizes[word[:HEAD]]
                sizes[len(word)] -= 1
                if not sizes[len(word)]:
                    del sizes[len(word)]
                if not sizes:
                    del self.sizes[word[:HEAD]]

    def known_ends(self, units: list[str] | str, i: int) -> list[int]:
        """The j for which units i to j make a known word; units of one letter may be a string."""
        plain = isinstance(units, str)
        head = units[i : i + HEAD] if plain else "".join(units[i : i + HEAD])[:HEAD]
        out = [k for k in range(1, HEAD) if head[:k] in self.words and k <= len(head)]
        if head in self.sizes:
            sizes = self.sizes[head]
            text = units if plain else "".join(units)
            at = i if plain else sum(map(len, units[:i]))
            out += [k for k in (sorted(sizes) if len(sizes) > 1 else sizes) if at + k <= len(text) and text[at : at + k] in self.words]
        if plain or not out:
            return [i + k - 1 for k in out]
        ends = dict(zip(accumulate(map(len, units[i:])), range(i, len(units)), strict=True))
        return [ends[k] for k in out if k in ends]

    def learn(self, units: list[str], i: int, j: int) -> None:
        """Units i to j of an utterance are a word. Edges are slices of the utterance, so with wide windows they may pass the word's own ends."""
        self.know("".join(units[i : j + 1]))
        if j > i:
            self.begins["".join(units[i : i + self.window])] += 1
            self.ends["".join(units[j + 1 - self.window : j + 1])] += 1

    def find(self, units: list[str] | str) -> tuple[int, int] | None:
        """First (start, end) of a known word whose edges fit: the units before end words, those after begin words."""
        n, w, begins, ends = len(units), self.window, self.begins, self.ends
        plain = isinstance(units, str)
        joined = str if plain else "".join
        for i in range(n):
            if i and (units[i - w : i] if plain else "".join(units[i - w : i])) not in ends:
                continue
            known = self.known_ends(units, i)
            if self.by_frequency:  # each candidate gives way to the most frequent of those as long or longer, the longest of equals
                known = [max((self.words[joined(units[i : k + 1])], k) for k in known[at:])[1] for at in range(len(known))]
            for j in known:
                if joined(units[j + 1 : j + 1 + w]) in begins:
                    return i, j
        return None

    def segment(self, units: list[str], update: bool = True) -> list[str]:
        out, text = [], "".join(units)
        if len(text) == len(units):  # of units of one letter, slices of the text are slices of the units
            units = text
        while units:
            found = self.find(units)
            cuts = [(0, len(units) - 1)] if found is None else [(0, found[0] - 1), found]
            for i, j in cuts:
                if j >= i:
                    if update:
                        self.learn(units, i, j)
                    out.append("".join(units[i : j + 1]))
            units = [] if found is None else units[found[1] + 1 :]
        if update:
            self.forget()
        return out

    def rows(self) -> list[tuple[str, str, int]]:
        return [(kind, k, n) for kind, c in (("word", self.words), ("begin", self.begins), ("end", self.ends)) for k, n in c.items()]

    def load(self, rows) -> Learner:
        for kind, item, n in rows:
            if kind == "word":
                self.know(item, int(n))
            else:
                {"begin": self.begins, "end": self.ends}[kind][item] += int(n)
        return self


def in_turn(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with those of a ``group`` one after the other in one task, by ``order``, null last."""
    return rows.repartition(*group).sortWithinPartitions(*group, *[F.col(c).asc_nulls_last() for c in order])


def with_text(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
    at = batch.schema.get_field_index("text")
    return batch.set_column(at, batch.schema.field(at), pa.array(texts, type=batch.schema.field(at).type))


def segment_online(prepared: DataFrame, group: list[str] = ("doc_id",), order: list[str] = ("line_no",), window: int = 2, by_frequency: bool = False, memory: int = 0) -> DataFrame:
    """``prepared`` segmented while learning, one fresh learner for each ``group``, whose rows come in ``order``.

    Rows stream through a task, which holds one learner at a time and no whole group.
    """
    group, order = list(group), list(order)

    def run(batches):
        last, learner = None, None
        for batch in batches:
            out = []
            for *own, text in zip(*(batch.column(c).to_pylist() for c in [*group, "text"]), strict=True):
                if learner is None or own != last:
                    last, learner = own, Learner(window, by_frequency, memory)
                out.append(" ".join(learner.segment(text.split())))
            yield with_text(batch, out)

    return in_turn(prepared, group, order).mapInArrow(run, prepared.schema)


def train(prepared: DataFrame, group: list[str] = ("doc_id",), order: list[str] = ("line_no",), window: int = 2, by_frequency: bool = False) -> DataFrame:
    """(kind, item, n): the summed models of one learner for each group."""
    group, order = list(group), list(order)

    def rows_of(held):
        kinds, items, counts = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(items, pa.string()), pa.array(counts, pa.int64())], names=["kind", "item", "n"])

    def run(batches):
        last, learner, held = None, None, []
        for batch in batches:
            for *own, text in zip(*(batch.column(c).to_pylist() for c in [*group, "text"]), strict=True):
                if learner is None or own != last:
                    held += learner.rows() if learner else []
                    last, learner = own, Learner(window, by_frequency)
                    if len(held) >= ROWS:
                        yield rows_of(held)
                        held = []
                learner.segment(text.split())
        held += learner.rows() if learner else []
        if held:
            yield rows_of(held)

    return in_turn(prepared, group, order).mapInArrow(run, MODEL).groupBy("kind", "item").agg(F.sum("n").alias("n"))


def known(words: DataFrame, window: int = 2) -> DataFrame:
    """(kind, item, n): the model of a learner that has met each row of ``words`` (units: a word's array of units) as a word.

    Edges are slices of the word, and as in learning only words of two units or more have them. Words without units have no part; an empty table
    gives an empty model.
    """
    joined = lambda units: F.array_join(units, "")
    n = F.size("units")
    edges = F.when(n > 1, F.array(F.struct(F.lit("begin").alias("kind"), joined(F.slice("units", 1, window)).alias("item")), F.struct(F.lit("end").alias("kind"), joined(F.slice("units", F.greatest(n - window, F.lit(0)) + 1, window)).alias("item"))))
    word = F.array(F.struct(F.lit("word").alias("kind"), joined("units").alias("item")))
    rows = words.filter(n > 0).select(F.inline(F.concat(word, F.coalesce(edges, F.slice(word, 1, 0)))))
    return rows.groupBy("kind", "item").agg(F.count("*").alias("n"))


def apply(prepared: DataFrame, model: DataFrame, window: int = 2, by_frequency: bool = False) -> DataFrame:
    """``prepared`` segmented by a frozen model, every row by itself.

    A model of at most ``MODEL_ROWS`` rows, counted first, goes to every task. Of a larger one each batch of utterances gets its own part: the
    items that can occur in them, joined by the strings of their units.
    """
    rows = model.select("kind", "item", "n").limit(MODEL_ROWS + 1).collect()
    if len(rows) > MODEL_ROWS:
        return apply_joined(prepared, model, window, by_frequency)
    held = prepared.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])

    def run(batches):
        learner = Learner(window, by_frequency).load(held.value)
        edges = learner.begins, learner.ends
        arrays = known_words.Model(learner.words, *edges, window, by_frequency) if known_words.Model.fits(*edges, window) else None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            # of units of one letter, apart by single spaces, the letters are cut all at once
            plain = [k for k, t in enumerate(texts) if t[1::2] == " " * (len(t) // 2) and t[::2].split() == [t[::2]]] if arrays else []
            out = dict(zip(plain, arrays.cut([texts[k][::2] for k in plain]), strict=True)) if plain else {}
            yield with_text(batch, [out[k] if k in out else " ".join(learner.segment(t.split(), update=False)) for k, t in enumerate(texts)])

    return prepared.mapInArrow(run, prepared.schema)


def apply_joined(prepared: DataFrame, model: DataFrame, window: int, by_frequency: bool) -> DataFrame:
    """As ``apply``, for models of any size: each utterance meets the model rows among the strings of its stretches of units.

    Stretches are at most as long as the longest item, so their number grows with the utterance, not with its square. A batch of utterances shares a
    learner of all the items they met: these are part of the one model, and hold all of it that can occur in each of them.
    """
    longest = max(1, model.agg(F.max(F.length("item"))).first()[0] or 0)
    units = F.split(F.trim("text"), " +")
    n = F.size(units)
    stretch = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), n - i)), lambda k: F.array_join(F.slice(units, i + 1, k), ""))
    items = F.array_distinct(F.concat(F.array(F.lit("")), F.flatten(F.transform(F.sequence(F.lit(0), n - 1), stretch))))
    met = prepared.select(*KEY, F.explode(items).alias("item")).join(model.select("kind", "item", "n"), "item")
    met = met.groupBy(*KEY).agg(F.collect_list(F.struct("kind", "item", "n")).alias("_model"))

    def run(batches):
        for pdf in batches:
            rows = {(r["kind"], r["item"]): r["n"] for own in pdf["_model"] if own is not None for r in own}
            learner = Learner(window, by_frequency).load((*k, n) for k, n in rows.items())
            yield pdf.assign(text=[" ".join(learner.segment(text.split(), update=False)) for text in pdf["text"]])[columns]

    columns = prepared.columns
    return prepared.join(met, KEY, "left").mapInPandas(run, prepared.schema)


def segment(prepared: DataFrame, train_on: DataFrame | None = None, window: int = 2, by_frequency: bool = False, nfolds: int = 5) -> DataFrame:
    """``prepared`` (doc_id, line_no, text) segmented; without ``train_on`` by learners that read the folds of runs of the corpus in turn.

    Each utterance comes from the learner that reads its block last. Utterances of nothing go.
    """
    if train_on is not None:
        rows = folding.chained_fold(train_on, 1)
        return apply(prepared, train(rows, ["chain"], ["_ord"], window, by_frequency), window, by_frequency).filter("text <> ''")
    rows = folding.chained_fold(prepared, nfolds)
    read = segment_online(rows, ["chain", "fold"], ["turn", "_ord"], window, by_frequency)
    return read.filter(F.col("block") == nfolds - 1 - F.col("fold")).filter("text <> ''").select(*prepared.columns)
