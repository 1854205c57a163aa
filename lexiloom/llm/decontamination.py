"""Benchmark decontamination by pigeonhole pieces and bit-parallel edit distance.

An item of m words may differ from a passage in ``budget = floor((1 - similarity) * m)`` word edits. Cut into budget + 1
pieces, some piece must stand unchanged in every passage within the budget, so exact piece hits lose nothing. Each hit opens
a window of the text; overlapping windows of an item are joined and verified with Myers' bit-parallel distance over words.

Pieces are found in one of two ways. A benchmark of at most ``BLOCK_BYTES`` of text, counted first, is broadcast, and one Aho-Corasick
pass over the normalised text finds the pieces. A larger one stays a table: hashes of its pieces, which have few
lengths, meet hashes of the documents' word runs of those lengths in a shuffle, and hits are verified after the texts join.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_names, lean_batches, numbered, written

#: UTF-8 bytes of item texts that may be broadcast; what is sent is a small multiple.
BLOCK_BYTES = 8 << 20
SIMILARITY = 0.8

#: Scripts written without spaces: Thai, Lao, Myanmar, Khmer, kana, Han. Each of their letters is a word.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of word characters; a letter of a script without spaces is a word."""
    return WORD.findall((text or "").lower())


class Item:
    """A benchmark item as a pattern over words."""

    def __init__(self, item_id, words: list[str], similarity: float) -> None:
        self.item_id, self.words = item_id, words
        self.budget = int((1 - similarity) * len(words) + 1e-9)
        self.places: dict[str, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            self.places[w].append(i)

    def pieces(self) -> Iterator[tuple[int, list[str]]]:
        m, n = len(self.words), self.budget + 1
        for i in range(n):
            yield (start := i * m // n), self.words[start : (i + 1) * m // n]

    def search(self, text: list[str], turned: bool = False) -> tuple[int, int]:
        """Least edits of the pattern (read backwards if ``turned``) against any stretch of ``text``, and where the first such stretch ends.

        The masks are made here, for words of the text only: an item held between searches takes memory in proportion to its words.
        """
        m = len(self.words)
        masks = {w: sum(1 << (m - 1 - i if turned else i) for i in self.places[w]) for w in set(text) if w in self.places}
        full, top = (1 << m) - 1, 1 << (m - 1)
        plus, minus, score, best, at = full, 0, m, m, -1
        for j, w in enumerate(text):
            equal = masks.get(w, 0)
            vertical = equal | minus
            horizontal = (((equal & plus) + plus) ^ plus) | equal
            up = minus | (full & ~(horizontal | plus))
            down = plus & horizontal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up, down = up << 1, down << 1
            plus = (down | ~(vertical | up)) & full
            minus = up & vertical & full
            if score < best:
                best, at = score, j
        return best, at

    def match(self, text: list[str]) -> tuple[int, int, int] | None:
        """(edits, first, last) of the best stretch within the budget."""
        edits, last = self.search(text)
        if edits > self.budget or last < 0:
            return None
        m = len(self.words)
        low = max(0, last + 1 - m - self.budget)
        _, back = self.search(text[low : last + 1][::-1], True)
        return edits, last - max(back, 0), last


    def best(self, words: list[str], starts: list[int]) -> tuple[int, int, int] | None:
        """(edits, first, last) of the best stretch of a text, the first of equals, by where the item would start after its piece hits."""
        found, reach = None, len(self.words) + self.budget
        starts = sorted(starts)
        low, high = starts[0] - self.budget, starts[0] + reach
        for s in [*starts[1:], None]:
            if s is not None and s - self.budget <= high:
                high = s + reach
                continue
            low = max(low, 0)
            own = self.match(words[low:high])
            if own and (found is None or own[0] < found[0]):
                found = (own[0], own[1] + low, own[2] + low)
            if s is not None:
                low, high = s - self.budget, s + reach
        return found


class Matcher:
    """All items of a benchmark behind one automaton of their pieces."""

    def __init__(self, items: list[tuple], similarity: float) -> None:
        self.items = [Item(i, w, similarity) for i, t in items if (w := words_of(t))]
        pieces = defaultdict(list)
        for n, item in enumerate(self.items):
            for start, piece in item.pieces():
                pieces[f" {' '.join(piece)} "].append((n, start, len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if pieces:
            self.automaton.make_automaton()
        self.any = bool(pieces)

    def leaks(self, text: str | None) -> Iterator[tuple]:
        """(item_id, edits, item_words, first_word, last_word), at most one for each item: its best stretch."""
        if not self.any or not text:
            return
        words = words_of(text)
        line = f" {' '.join(words)} "
        hits: dict[int, list[int]] = defaultdict(list)
        passed, counted = 0, 0  # spaces in line[:passed]
        for end, (length, owners) in self.automaton.iter(line):
            begin = end - length + 1
            if begin < passed:
                counted -= line.count(" ", begin, passed)
            else:
                counted += line.count(" ", passed, begin)
            passed = begin
            for n, start, _ in owners:
                hits[n].append(counted - start)
        for n, starts in hits.items():
            item = self.items[n]
            if found := item.best(words, starts):
                yield item.item_id, found[0], len(item.words), found[1], found[2]


_built: dict[str, Matcher] = {}


def matcher(name: str, block) -> Matcher:
    """The worker's matcher of a broadcast benchmark, built once. Broadcasts go by a name of their own, as workers outlive them."""
    if name not in _built:
        _built.clear()
        _built[name] = Matcher(*block.value)
    return _built[name]


def small(benchmark: DataFrame, most: int) -> list[tuple] | None:
    """(item_id, text) of a benchmark whose counted bytes of text are at most ``most``, else null."""
    rows = benchmark.select("item_id", "text").filter("text is not null")
    held = rows.agg(F.coalesce(F.sum(F.octet_length("text") + F.lit(64)), F.lit(0)).alias("b")).first()["b"]
    return [(r["item_id"], r["text"]) for r in rows.collect()] if held <= most else None


LEAK = "doc_id long, item_id long, edits int, item_words int, first_word long, last_word long"
LEAK_NAMES = [c.split()[0] for c in LEAK.split(", ")]


def joined_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float) -> DataFrame:
    """(rid, and as ``find_leaks``) for ``docs`` with a unique rid: pieces and word runs meet by hash, whatever the size of the benchmark."""
    items = written(benchmark.select("item_id", "text").filter("text is not null").withColumn("no", F.monotonically_increasing_id()), "items")

    def cut(batches):
        for pdf in batches:
            rows = []
            for no, text in zip(pdf["no"], pdf["text"], strict=True):
                if words := words_of(text):
                    rows += [(xxhash.xxh3_64_intdigest(" ".join(p)) - (1 << 63), no, at, len(p)) for at, p in Item(None, words, similarity).pieces()]
            yield pd.DataFrame(rows, columns=["h", "no", "at", "length"])

    pieces = written(items.mapInPandas(cut, "h long, no long, at int, length int"), "pieces")
    lengths = sorted(r["length"] for r in pieces.select("length").distinct().collect())  # of m words, 1 to 5 at similarity 0.8

    def runs(batches):
        for pdf in batches:
            for rid, text in zip(pdf["rid"], pdf["text"], strict=True):
                words = words_of(text)
                for n in lengths:
                    if len(words) >= n:
                        h = [xxhash.xxh3_64_intdigest(" ".join(words[i : i + n])) - (1 << 63) for i in range(len(words) - n + 1)]
                        yield pd.DataFrame({"h": h, "rid": rid, "place": np.arange(len(h), dtype=np.int32)})

    met = docs.select("rid", "text").mapInPandas(runs, "h long, rid long, place int").join(pieces.select("h", "no", "at"), "h")
    met = met.select("rid", "no", (F.col("place") - F.col("at")).alias("start")).distinct().groupBy("rid", "no").agg(F.collect_list("start").alias("starts"))
    met = met.join(docs.select("rid", "doc_id", "text"), "rid").join(items.select("no", "item_id", F.col("text").alias("item")), "no")

    def verify(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                item = Item(r.item_id, words_of(r.item), similarity)
                if found := item.best(words_of(r.text), [int(s) for s in r.starts]):
                    rows.append((r.rid, r.doc_id, r.item_id, found[0], len(item.words), found[1], found[2]))
            if rows:
                yield pd.DataFrame(rows, columns=["rid", *LEAK_NAMES]).astype({"doc_id": "Int64", "item_id": "Int64"})

    return met.select("rid", "no", "doc_id", "item_id", "text", "item", "starts").mapInPandas(verify, "rid long, " + LEAK)


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, edits, item_words, first_word, last_word): for each document the items it holds, best stretch each.

    Words are runs of word characters, lower-cased, single letters in scripts without spaces; positions count from 0. Items under five
    words have a budget of 0: they are held where they stand word for word, so a one-word item is held by every text with that word. Null and
    empty texts hold nothing; null and empty items are held by nothing. Repeated documents or items give repeated rows; null ids pass
    through. Among stretches with equal edits the first counts. A very long text is one list of words in one task; a very long item
    takes memory in proportion to its words, and time for each word of a window. Other columns are ignored, whatever their names.
    Empty tables give an empty result.
    """
    lean_batches(docs.sparkSession)
    items = small(benchmark, block_bytes)
    if items is None:
        return joined_leaks(written(numbered(docs.select("doc_id", "text")), "texts"), benchmark, similarity).drop("rid")
    name, block = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast((items, similarity))

    def scan(batches):
        found = matcher(name, block)
        for pdf in batches:
            rows = [(d, *leak) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for leak in found.leaks(t)]
            if rows:
                yield pd.DataFrame(rows, columns=LEAK_NAMES).astype({"doc_id": "Int64", "item_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(scan, LEAK)


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no item; all columns stay, whatever their names. Edge cases as in ``find_leaks``."""
    lean_batches(docs.sparkSession)
    items = small(benchmark, block_bytes)
    if items is None:
        (rid,) = free_names(docs, "_rid")
        docs = written(docs.withColumn(rid, F.monotonically_increasing_id()), "texts")
        leaks = joined_leaks(docs.select(F.col(rid).alias("rid"), "doc_id", "text"), benchmark, similarity)
        return docs.join(leaks.select(F.col("rid").alias(rid)).distinct(), rid, "left_anti").drop(rid)
    name, block = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast((items, similarity))

    @F.pandas_udf("boolean")
    def leaks(texts: pd.Series) -> pd.Series:
        found = matcher(name, block)
        return pd.Series([next(found.leaks(t), None) is not None for t in texts], dtype=bool)

    return docs.filter(~leaks(F.col("text")))
