"""Unigram Pitman-Yor segmentation by flip sampling, one chain for each group of utterances, and the vote over samples."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.text import kept, sized

KEY = ["doc_id", "line_no"]


def temperature(sweep: int, sweeps: int, start: float = 10.0, bins: int = 9) -> float:
    """Annealing: ``bins`` equal stretches of falling temperature, 1 from the last on."""
    at = min(bins, sweep * bins // max(1, sweeps) + 1)
    return max(1.0, 1 + (start - 1) * (bins / at - 1) / (bins - 1)) if at < bins else 1.0


class Chain:
    """Words of the utterances of a chain as customers; one table a word (the discount acts on types)."""

    def __init__(self, utterances: list[list[str]], a: float, b: float, seed: int, p_start: float = 0.5) -> None:
        self.units, self.a, self.b = utterances, a, b
        self.rng = np.random.Generator(np.random.MT19937(seed))
        letters = Counter(u for line in utterances for u in line)
        total = sum(letters.values()) + len(letters)
        stop = 0.5
        self.letter = {u: math.log(1 - stop) + math.log((n + 1) / total) for u, n in letters.items()}
        self.stop = math.log(stop)
        self.cuts = [self.rng.random(max(0, len(line) - 1)) < p_start for line in utterances]
        self.words = Counter("".join(w) for i in range(len(utterances)) for w in self.split(i))
        self.base = {}
        self.n, self.lines = sum(self.words.values()), len(utterances)

    def split(self, i: int) -> list[list[str]]:
        line, at = self.units[i], [0, *(np.flatnonzero(self.cuts[i]) + 1).tolist(), len(self.units[i])]
        return [line[x:y] for x, y in zip(at, at[1:], strict=False) if y > x]

    def probability(self, units: list[str], more: int = 0) -> float:
        word = "".join(units)
        if word not in self.base:
            self.base[word] = math.exp(sum(self.letter[u] for u in units) + self.stop)
        n = self.words.get(word, 0)
        types = len(self.words)
        return ((n - self.a if n else 0.0) + (self.a * types + self.b) * self.base[word]) / (self.n + more + self.b)

    def move(self, units: list[str], by: int) -> None:
        word = "".join(units)
        self.words[word] += by
        self.n += by
        if not self.words[word]:
            del self.words[word]

    def sweep(self, heat: float = 1.0) -> None:
        for i, line in enumerate(self.units):
            cuts, draws = self.cuts[i], self.rng.random(max(0, len(line) - 1))
            for k in range(len(line) - 1):
                low = k
                while low > 0 and not cuts[low - 1]:
                    low -= 1
                high = k + 1
                while high < len(line) - 1 and not cuts[high]:
                    high += 1
                left, right, whole = line[low : k + 1], line[k + 1 : high + 1], line[low : high + 1]
                for w in (left, right) if cuts[k] else (whole,):
                    self.move(w, -1)
                more = (self.n - self.lines + 1 + 1.0) / (self.n + 1 + 2.0)
                apart = (self.probability(left) * self.probability(right, 1) * more) ** (1 / heat)
                together = self.probability(whole) ** (1 / heat)
                cuts[k] = draws[k] * (apart + together) < apart
                for w in (left, right) if cuts[k] else (whole,):
                    self.move(w, 1)


def samples(prepared: DataFrame, group: list[str] = ("doc_id",), sweeps: int = 20, keep: int = 5, a: float = 0.0, b: float = 1.0, seed: int = 1) -> DataFrame:
    """(key, run, sample, text): the last ``keep`` states of a chain for each group; seeds depend on the group alone."""
    group = list(group)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(KEY, ignore_index=True)
        chain = Chain([t.split() for t in pdf["text"]], a, b, (seed * 1_000_003 + sum(hash(int(k)) * 31**i for i, k in enumerate(key))) % (1 << 32))
        out = []
        for s in range(sweeps):
            chain.sweep(temperature(s, sweeps))
            if s >= sweeps - keep:
                text = [" ".join("".join(w) for w in chain.split(i)) for i in range(len(pdf))]
                out.append(pd.DataFrame({"doc_id": pdf["doc_id"], "line_no": pdf["line_no"], "run": 0, "sample": s, "text": text}))
        return pd.concat(out, ignore_index=True)

    return prepared.groupBy(*group).applyInPandas(run, "doc_id long, line_no int, run int, sample int, text string")


def vote(samples_: DataFrame) -> DataFrame:
    """(doc_id, line_no, text): the most frequent segmentation of each utterance, ties to the earliest sample."""
    counted = samples_.groupBy(*KEY, "text").agg(F.count("*").alias("n"), F.min(F.struct("run", "sample")).alias("at"))
    best = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("n"), "at"))
    return counted.withColumn("_r", best).filter("_r = 1").select(*KEY, "text")


def vote_in_place(parses: DataFrame, block: int = 4096) -> DataFrame:
    """(utterance, text) of (sample, utterance, text), utterances being numbers from 0, without nulls: what ``vote`` finds, but no text is moved.

    SHA-256 digests of the texts are counted. Which sample wins goes back to where the texts are, as bits: one row a sample and ``block`` utterances, a multiple of 64.
    """
    at = {"_block": F.expr(f"utterance div {block}"), "_word": F.expr(f"cast(utterance % {block} div 64 as int)"), "_bit": F.expr("cast(utterance % 64 as int)")}
    seen = parses.select("utterance", "sample", F.unhex(F.sha2("text", 256)).alias("_digest"), at["_block"].alias("_block")).repartition("_block")
    # all groups below hold _block, so that they are made where its rows are
    counted = seen.groupBy("_block", "utterance", "_digest").agg(F.count("*").alias("n"), F.min("sample").alias("sample"))
    best = F.row_number().over(Window.partitionBy("_block", "utterance").orderBy(F.desc("n"), "sample"))
    won = counted.withColumn("_r", best).filter("_r = 1").withColumns({k: at[k] for k in ("_word", "_bit")})
    words = won.groupBy("sample", "_block", "_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("won"))
    words = words.groupBy("sample", "_block").agg(F.map_from_entries(F.collect_list(F.struct("_word", "won"))).alias("_own"))
    bits = words.select("sample", "_block", F.transform(F.sequence(F.lit(0), F.lit(block // 64 - 1)), lambda k: F.coalesce(F.try_element_at("_own", k), F.lit(0))).alias("_won"))
    rows = sized(parses.withColumns(at), kept(bits, "won"), ["sample", "_block"])
    return rows.filter(F.getbit(F.get("_won", F.col("_word")), F.col("_bit")) == 1).select("utterance", "text")
