"""Bayesian word segmentation: Pitman-Yor restaurants of words over a learned letter model, sampled one boundary or one utterance at a time.

A chain is sequential, so it is one group of rows: a fold of a run of at most ``folding.CHAIN_ROWS`` utterances. Chains run side by side
over the cluster; what they yield are tables of utterances and of traces.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import folding

EDGE = "\n"  # the sentence marker of the bigram model


@dataclass(frozen=True)
class Options:
    """estimator: flip, tree, viterbi or decayed; online reads each utterance once in order. Unigrams use a1 and b1, bigrams a2 and b2 too."""

    ngram: int = 1
    estimator: str = "flip"
    online: bool = False
    sweeps: int = 20
    a1: float = 0.0
    b1: float = 1.0
    a2: float = 0.0
    b2: float = 1.0
    aeos: float = 2.0
    init_pboundary: float = 0.0
    anneal_sweeps: int = 0
    anneal_start: float = 1.0
    anneal_stop: float = 1.0
    anneal_a: float = 0.0
    anneal_b: float = 0.2
    hypersamp_ratio: float = 0.0
    samples_per_utt: int = 100
    decay_rate: float = 1.0
    forget: str = ""
    memory: int = 0
    seed: int = 1

    def __post_init__(self) -> None:
        if self.ngram not in (1, 2) or self.estimator not in ("flip", "tree", "viterbi", "decayed") or self.forget not in ("", "utterances", "types", "tokens"):
            raise ValueError(f"unknown model, estimator or way to forget: {self}")
        if self.online and self.estimator == "flip" or not self.online and self.estimator == "decayed":
            raise ValueError("flip is a batch estimator, decayed an online one")
        if self.ngram == 2 and self.estimator in ("tree", "viterbi"):
            raise ValueError("whole utterances are sampled with unigrams only")


def temperature(sweep: int, o: Options) -> float:
    """Stop temperature from ``anneal_sweeps`` on; before, nine falling steps, or a sigmoid if ``anneal_a`` is given."""
    if sweep >= o.anneal_sweeps:
        return o.anneal_stop
    if not o.anneal_a:
        step = sweep * 9 // o.anneal_sweeps + 1
        return o.anneal_stop + (o.anneal_start - o.anneal_stop) * (10 / step - 1) / 9
    sigmoid = lambda x: 1 / (1 + math.exp(o.anneal_a * (x - o.anneal_b)))
    at = sigmoid(sweep / o.anneal_sweeps)
    return o.anneal_stop + (o.anneal_start - o.anneal_stop) * (at - sigmoid(1)) / (sigmoid(0) - sigmoid(1))


class Letters:
    """Words as letters and an end, drawn one by one from counts over a uniform base."""

    def __init__(self, n_letters: int) -> None:
        self.counts, self.total, self.uniform = Counter(), 0, 1 / (n_letters + 1)

    def prob(self, word: tuple) -> float:
        p = 1.0
        for c in (*word, None):
            p *= (self.counts[c] + self.uniform) / (self.total + 1)
        return p

    def insert(self, word: tuple, rng=None, by: int = 1) -> None:
        for c in (*word, None):
            self.counts[c] += by
            self.total += by

    def erase(self, word: tuple, rng=None) -> None:
        self.insert(word, by=-1)

    def log_prob(self) -> float:
        drawn = sum(math.lgamma(n + self.uniform) - math.lgamma(self.uniform) for n in self.counts.values() if n)
        return drawn + math.lgamma(1.0) - math.lgamma(self.total + 1.0)


class Restaurant:
    """Customers of a word sit at tables; a new table is a draw from the base."""

    def __init__(self, a: float, b: float, base) -> None:
        self.a, self.b, self.base = a, b, base
        self.tables: dict[tuple, list[int]] = {}
        self.n, self.m = Counter(), 0
        self.total = 0

    def prob(self, word: tuple) -> float:
        own = self.n[word] - self.a * len(self.tables.get(word, ())) if word in self.n else 0.0
        return (own + (self.a * self.m + self.b) * self.base.prob(word)) / (self.total + self.b)

    def insert(self, word: tuple, rng) -> None:
        own = self.tables.setdefault(word, [])
        old, new = self.n[word] - self.a * len(own), (self.a * self.m + self.b) * self.base.prob(word)
        draw = rng.random() * (old + new)
        if own and draw <= old:
            at = bisect_right(list(accumulate(size - self.a for size in own)), rng.random() * old)
            own[min(at, len(own) - 1)] += 1
        else:
            own.append(1)
            self.m += 1
            self.base.insert(word, rng)
        self.n[word] += 1
        self.total += 1

    def erase(self, word: tuple, rng) -> None:
        own = self.tables[word]
        at = min(bisect_right(list(accumulate(own)), rng.random() * self.n[word]), len(own) - 1)
        own[at] -= 1
        if not own[at]:
            own.pop(at)
            self.m -= 1
            self.base.erase(word, rng)
        self.n[word] -= 1
        self.total -= 1
        if not self.n[word]:
            del self.n[word], self.tables[word]

    def log_prob(self, a: float | None = None, b: float | None = None) -> float:
        """Of the seating, without the draws from the base."""
        a, b = self.a if a is None else a, self.b if b is None else b
        seated = sum(math.lgamma(size - a) - math.lgamma(1 - a) for own in self.tables.values() for size in own)
        opened = self.m * math.log(a) + math.lgamma(self.m + b / a) - math.lgamma(b / a) if a else self.m * math.log(b)
        return seated + opened - math.lgamma(self.total + b) + math.lgamma(b)


class Chain:
    """The state of a chain over utterances, each a list of units: a boundary after each unit, and the restaurants that the words sit in."""

    def __init__(self, utterances: list[list[str]], options: Options, seed: int) -> None:
        self.o, self.lines = options, utterances
        self.rng = np.random.Generator(np.random.MT19937(seed))
        self.letters = Letters(len({u for line in utterances for u in line}))
        self.words = Restaurant(options.a1, options.b1, self.letters)
        self.after: dict[tuple, Restaurant] = {}
        self.seen = 0
        self.cuts = [[bool(x < options.init_pboundary) for x in self.rng.random(max(len(line) - 1, 0))] for line in utterances]
        if not options.online:
            for i in range(len(utterances)):
                self.seat(i)

    def split(self, i: int) -> list[tuple]:
        line, at = self.lines[i], [0, *(k + 1 for k, c in enumerate(self.cuts[i]) if c), len(self.lines[i])]
        return [tuple(line[x:y]) for x, y in zip(at, at[1:], strict=False) if y > x]

    def prob(self, left: tuple, word: tuple) -> float:
        own = self.after.get(left) if self.o.ngram == 2 else None
        return own.prob(word) if own is not None and own.total else self.words.prob(word)

    def add(self, left: tuple, word: tuple) -> None:
        if self.o.ngram == 2:
            if left not in self.after:
                self.after[left] = Restaurant(self.o.a2, self.o.b2, self.words)
            self.after[left].insert(word, self.rng)
        else:
            self.words.insert(word, self.rng)

    def take(self, left: tuple, word: tuple) -> None:
        (self.after[left] if self.o.ngram == 2 else self.words).erase(word, self.rng)

    def pairs(self, words: list[tuple]) -> list[tuple[tuple, tuple]]:
        """(left, word); with bigrams the end of the utterance is a word too."""
        line = [(EDGE,), *words, *([(EDGE,)] if self.o.ngram == 2 else [])]
        return list(zip(line, line[1:], strict=False))

    def seat(self, i: int) -> None:
        for left, word in self.pairs(self.split(i)):
            self.add(left, word)
        self.seen += 1

    def leave(self, i: int) -> None:
        for left, word in self.pairs(self.split(i)):
            self.take(left, word)
        self.seen -= 1

    def flip(self, i: int, k: int, heat: float) -> None:
        """Draw anew whether a word ends after unit k of utterance i."""
        line, cuts = self.lines[i], self.cuts[i]
        low = max((j + 1 for j in range(k) if cuts[j]), default=0)
        high = next((j + 1 for j in range(k + 1, len(cuts)) if cuts[j]), len(line))
        left, right, whole = tuple(line[low : k + 1]), tuple(line[k + 1 : high]), tuple(line[low:high])
        before = max((j + 1 for j in range(low - 1) if cuts[j]), default=0)
        after = next((j + 1 for j in range(high, len(cuts)) if cuts[j]), len(line))
        first = tuple(line[before:low]) or (EDGE,)
        last = [tuple(line[high:after]) or (EDGE,)] if self.o.ngram == 2 else []
        chain = lambda *words: list(zip([first, *words], [*words, *last], strict=False))
        for pair in chain(left, right) if cuts[k] else chain(whole):
            self.take(*pair)
        apart, joined = (math.prod(self.prob(*pair) for pair in chain(*words)) for words in ((left, right), (whole,)))
        if self.o.ngram == 1:
            n, eta = self.words.total, self.o.aeos
            apart *= (n - self.seen + 1 + eta / 2) / (n + 1 + eta)
        apart, joined = apart ** (1 / heat), joined ** (1 / heat)
        cuts[k] = bool(self.rng.random() * (apart + joined) < apart)
        for pair in chain(left, right) if cuts[k] else chain(whole):
            self.add(*pair)

    def draw(self, i: int, heat: float, best: bool) -> None:
        """Draw all words of an utterance that has no customers: the best split, or one by its probability."""
        line, n = self.lines[i], len(self.lines[i])
        more = ((max(self.words.total - self.seen, 0) + self.o.aeos / 2) / (self.words.total + self.o.aeos)) ** (1 / heat)
        sums, parts = [1.0], []
        for j in range(1, n + 1):
            own = [self.words.prob(tuple(line[x:j])) ** (1 / heat) * (more if x else 1.0) * sums[x] for x in range(j)]
            parts.append(own)
            sums.append(max(own) if best else sum(own))
        cuts, j = [False] * max(n - 1, 0), n
        while j:
            own = parts[j - 1]
            x = own.index(max(own)) if best else min(bisect_right(list(accumulate(own)), self.rng.random() * sums[j]), j - 1)
            if x:
                cuts[x - 1] = True
            j = x
        self.cuts[i] = cuts

    def sweep(self, heat: float = 1.0) -> None:
        """One pass of a batch estimator."""
        for i, line in enumerate(self.lines):
            if self.o.estimator == "flip":
                for k in range(len(line) - 1):
                    self.flip(i, k, heat)
            else:
                self.leave(i)
                self.draw(i, heat, self.o.estimator == "viterbi")
                self.seat(i)

    def forget(self, i: int) -> None:
        """Let go of what exceeds the memory: the oldest utterance, or words by chance."""
        if self.o.forget == "utterances" and i >= self.o.memory:
            self.leave(i - self.o.memory)
        while self.o.ngram == 1 and self.o.forget in ("types", "tokens"):
            if (len(self.words.n) if self.o.forget == "types" else self.words.total) <= self.o.memory:
                break
            known = list(self.words.n)
            size = [self.words.n[w] if self.o.forget == "tokens" else 1 for w in known]
            word = known[min(bisect_right(list(accumulate(size)), self.rng.random() * sum(size)), len(known) - 1)]
            for _ in range(self.words.n[word] if self.o.forget == "types" else 1):
                self.words.erase(word, self.rng)

    def read(self, heat: float = 1.0) -> None:
        """The one pass of an online estimator."""
        places: list[tuple[int, int]] = []
        for i, line in enumerate(self.lines):
            if self.o.estimator != "decayed":
                self.draw(i, heat, self.o.estimator == "viterbi")
            self.seat(i)
            if self.o.estimator == "decayed":
                places += [(i, k) for k in range(len(line) - 1)]
                weights = np.cumsum(np.arange(1, len(places) + 1, dtype=float) ** -self.o.decay_rate)
                if places:
                    back = np.searchsorted(weights, self.rng.random(self.o.samples_per_utt) * weights[-1])
                    for b in np.minimum(back, len(places) - 1).tolist():
                        self.flip(*places[-1 - b], heat)
            elif self.o.memory:
                self.forget(i)

    def propose(self, heat: float) -> None:
        """Metropolis steps for a and b of each kind of restaurant: a normal proposal about the value, refused outside its range."""
        kinds = [("1", [self.words]), ("2", list(self.after.values()))] if self.o.ngram == 2 else [("1", [self.words])]
        for _, held in kinds:
            for name, top in (("a", 1.0), ("b", math.inf)):
                if not held or not (old := getattr(held[0], name)):
                    continue
                width = lambda v, top=top: self.o.hypersamp_ratio * (1 - v if top == 1.0 and v > 0.5 else v)
                new = float(self.rng.normal(old, width(old)))
                if not 0 < new < top:
                    continue
                gain = sum(r.log_prob(**{name: new}) - r.log_prob() for r in held)
                ways = math.log(width(old) / width(new)) + (new - old) ** 2 / 2 * (width(old) ** -2 - width(new) ** -2)
                if math.log(self.rng.random() + 1e-300) < (gain + ways) / heat:
                    for r in held:
                        setattr(r, name, new)

    def log_posterior(self) -> float:
        out = self.letters.log_prob() + self.words.log_prob() + sum(r.log_prob() for r in self.after.values() if r.total)
        if self.o.ngram == 1:
            n, s, t = self.words.total, self.seen, self.o.aeos / 2
            out += math.lgamma(s + t) + math.lgamma(max(n - s, 0) + t) + math.lgamma(2 * t) - 2 * math.lgamma(t) - math.lgamma(n + 2 * t)
        return out

    def run(self) -> list[tuple[int, float, float, float, float]]:
        """All sweeps; (sweep, temperature, -log posterior, a1, b1) after each."""
        trace = []
        for s in range(1 if self.o.online else self.o.sweeps):
            heat = temperature(s, self.o)
            (self.read if self.o.online else self.sweep)(heat)
            if self.o.hypersamp_ratio:
                self.propose(heat)
            trace.append((s, heat, -self.log_posterior(), self.words.a, self.words.b))
        return trace


def mbdp(word_count: int, tokens: int, types: int, sentences: int, base: float, base_sum: float) -> float:
    """Brent's probability of a word seen ``word_count`` times so far, among ``tokens`` of ``types`` words in ``sentences``."""
    k, n, t = word_count + 1, tokens + sentences + 2, types + 2
    if word_count:
        return ((k - 1) / k) ** 2 * k / n
    return 6 / math.pi**2 * (t / n) * ((t - 1) / t) ** 2 * base / (1 - (t - 1) / t * base_sum)


def chains(prepared: DataFrame, nfolds: int, options: Options, schema: str, give) -> DataFrame:
    rows = folding.chained_fold(prepared, nfolds)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["turn", "_ord"], ignore_index=True)
        chain = Chain([t.split() for t in pdf["text"]], options, (options.seed + 7919 * int(key[0]) + int(key[1])) % (1 << 32))
        return give(chain, chain.run(), pdf, key)

    return rows.groupBy("chain", "fold").applyInPandas(run, schema)


def segment(prepared: DataFrame, nfolds: int = 5, options: Options = Options()) -> DataFrame:
    """``prepared`` (doc_id, line_no, text) segmented: each utterance by the chain of the fold that has its block last."""
    last = lambda chain, _, pdf, key: pdf.assign(text=[" ".join("".join(w) for w in chain.split(i)) for i in range(len(pdf))])[pdf["block"] == nfolds - 1 - int(key[1])][["doc_id", "line_no", "text"]]
    return chains(prepared, nfolds, options, "doc_id long, line_no int, text string", last)


def traces(prepared: DataFrame, nfolds: int = 5, options: Options = Options()) -> DataFrame:
    """(chain, fold, sweep, temperature, minus_log_posterior, a1, b1, customers): the course of every chain."""
    names = ["sweep", "temperature", "minus_log_posterior", "a1", "b1"]
    give = lambda chain, trace, pdf, key: pd.DataFrame(trace, columns=names).assign(chain=int(key[0]), fold=int(key[1]), customers=chain.words.total)[["chain", "fold", *names, "customers"]]
    return chains(prepared, nfolds, options, "chain long, fold int, sweep int, temperature double, minus_log_posterior double, a1 double, b1 double, customers long", give)
