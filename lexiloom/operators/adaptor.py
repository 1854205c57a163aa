"""Adaptor grammars: a probabilistic grammar whose adapted categories remember whole trees, sampled by Metropolis-Hastings.

A chain is one run over one part of the corpus (`folding.chained_fold`: at most 50,000 utterances, twice that in the last), so
runs and parts spread over the cluster. The trees of its utterances are drawn anew, one after the other, from an inside chart
under all other trees, and accepted by how the drawing and the true probability differ. Samples of all runs meet in `sampling.vote`.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import folding, grammars, sampling

#: Rules that a grammar may have; they are sent with every task.
MOST_RULES = 100_000


@dataclass(frozen=True)
class Options:
    """Sweeps of a chain; temperatures from ``start_heat`` to ``stop_heat`` over the first ``anneal`` sweeps; what rules without numbers get;
    every how many sweeps the discounts and concentrations are drawn anew (0: never) and whether remembered trees are too;
    priors of a (beta) and b (gamma: shape, scale)."""

    sweeps: int = 2000
    anneal: int = 100
    start_heat: float = 1.0
    stop_heat: float = 1.0
    weight: float = 1.0
    a: float = 0.1
    b: float = 1000.0
    hyper_every: int = 1
    relabel: bool = False
    beta: tuple[float, float] = (1.0, 1.0)
    gamma: tuple[float, float] = (10.0, 0.1)
    seed: int = 1


class Tree:
    """A node: its rule, its children (trees, or code points of units) and yield. ``count`` are the customers of a remembered tree."""

    __slots__ = ("symbol", "rule", "kids", "code", "count")

    def __init__(self, symbol: str, rule: int, kids: list, code: str) -> None:
        self.symbol, self.rule, self.kids, self.code, self.count = symbol, rule, kids, code, 0


def heat(sweep: int, o: Options) -> float:
    """Geometric from ``start_heat`` to ``stop_heat``, which holds from then on."""
    if sweep >= o.anneal or o.anneal < 2:
        return o.stop_heat
    return o.start_heat * (o.stop_heat / o.start_heat) ** (sweep / (o.anneal - 1))


def slice_draw(log_density: Callable[[float], float], x: float, low: float, high: float, width: float, rng: np.random.Generator) -> float:
    """One slice-sampling step from ``x`` inside (low, high): step out, then shrink."""
    level = log_density(x) - rng.exponential()
    left = x - rng.random() * width
    right = left + width
    while left > low and log_density(left) > level:
        left -= width
    while right < high and log_density(right) > level:
        right += width
    left, right = max(left, low), min(right, high)
    while right - left > 1e-12:
        new = left + rng.random() * (right - left)
        if low < new < high and log_density(new) > level:
            return new
        left, right = (new, right) if new < x else (left, new)
    return x


class Chain:
    """Trees of the utterances ``lines`` under ``rules`` (weight, a, b, parent, rhs); a parent with a below 1 is adapted."""

    def __init__(self, lines: list[list[str]], rules: list[tuple], start: str, o: Options, seed: int) -> None:
        self.o, self.start, self.rng = o, start, np.random.Generator(np.random.MT19937(seed))
        parents = {r[3] for r in rules}
        self.units = sorted({u for line in lines for u in line} | {x for r in rules for x in r[4] if x not in parents})
        code = {u: i for i, u in enumerate(self.units, 0xF0000)}
        self.rules = [(r[3], tuple(x if x in parents else code[x] for x in r[4])) for r in rules]
        self.weight = [o.weight if r[0] is None else r[0] for r in rules]
        self.n = [0] * len(rules)
        self.of, self.a, self.b = defaultdict(list), dict.fromkeys(parents, o.a), dict.fromkeys(parents, o.b)
        for i, (_, a, b, parent, _) in enumerate(rules):
            self.of[parent].append(i)
            self.a[parent] = self.a[parent] if a is None else a
            self.b[parent] = self.b[parent] if b is None else b
        self.mass = {p: sum(self.weight[i] for i in ids) for p, ids in self.of.items()}
        self.uses, self.customers, self.tables = (dict.fromkeys(parents, 0) for _ in range(3))
        self.cache: dict[str, dict[str, list[Tree]]] = {p: {} for p in parents if self.a[p] < 1}
        starts = {rhs[:k] for _, rhs in self.rules for k in range(2, len(rhs) + 1)}
        self.joins = [(s, s[:-1] if len(s) > 2 else s[0], s[-1]) for s in sorted(starts, key=len)]
        self.chains = [(i, p, rhs[0]) for i, (p, rhs) in enumerate(self.rules) if len(rhs) == 1 and isinstance(rhs[0], str)]
        self.charted = {*parents, *starts, *(x for s in starts for x in s)}
        self.scale = 2.0 * len(self.units)
        self.lines = ["".join(chr(code[u]) for u in line) for line in lines]
        self.trees: list[Tree] = []
        self.started = 0.0
        for line in self.lines:
            tree = self.draw(start, line, self.chart(line))
            self.trees.append(tree)
            self.started += self.insert(tree)

    # probabilities under the trees in place

    def fresh(self, parent: str) -> float:
        """The probability that a category makes a tree of its own."""
        if parent not in self.cache or not self.customers[parent]:
            return 1.0
        a, b = self.a[parent], self.b[parent]
        return (self.tables[parent] * a + b) / (self.customers[parent] + b)

    def rule_probability(self, i: int) -> float:
        parent = self.rules[i][0]
        return (self.weight[i] + self.n[i]) / (self.mass[parent] + self.uses[parent])

    def again(self, tree: Tree) -> float:
        return (tree.count - self.a[tree.symbol]) / (self.customers[tree.symbol] + self.b[tree.symbol])

    def insert(self, tree: Tree) -> float:
        """Put a tree in place; the log of its probability before."""
        out, stack = 0.0, [tree]
        while stack:
            t = stack.pop()
            if t.symbol in self.cache:
                p = self.again(t) if t.count else self.fresh(t.symbol)
                out += math.log(p)
                t.count += 1
                self.customers[t.symbol] += 1
                if t.count > 1:
                    continue
                self.tables[t.symbol] += 1
                self.cache[t.symbol].setdefault(t.code, []).append(t)
            out += self.expand(t, stack)
        return out

    def expand(self, t: Tree, stack: list[Tree]) -> float:
        out = math.log(self.rule_probability(t.rule))
        self.n[t.rule] += 1
        self.uses[t.symbol] += 1
        stack += [k for k in t.kids if isinstance(k, Tree)]
        return out

    def remove(self, tree: Tree) -> float:
        """Take a tree out; the log of its probability without it."""
        out, stack = 0.0, [tree]
        while stack:
            t = stack.pop()
            if t.symbol in self.cache:
                t.count -= 1
                self.customers[t.symbol] -= 1
                if t.count:
                    out += math.log(self.again(t))
                    continue
                self.tables[t.symbol] -= 1
                self.forget(t)
                out += math.log(self.fresh(t.symbol))
            out += self.contract(t, stack)
        return out

    def contract(self, t: Tree, stack: list[Tree]) -> float:
        self.n[t.rule] -= 1
        self.uses[t.symbol] -= 1
        stack += [k for k in t.kids if isinstance(k, Tree)]
        return math.log(self.rule_probability(t.rule))

    def forget(self, t: Tree) -> None:
        same = self.cache[t.symbol][t.code]
        same[:] = [x for x in same if x is not t]
        if not same:
            del self.cache[t.symbol][t.code]

    def drawn(self, tree: Tree, own: bool = False) -> float:
        """The log of the probability with which ``draw`` gives a tree, but for what all trees of the yield share."""
        out, stack = 0.0, [tree]
        while stack:
            t = stack.pop()
            if t.symbol in self.cache and not own:
                out += math.log(self.again(t) if t.count else self.fresh(t.symbol))
                if t.count:
                    continue
            own = False
            out += math.log(self.rule_probability(t.rule))
            stack += [k for k in t.kids if isinstance(k, Tree)]
        return out

    def shape(self, tree: Tree) -> tuple:
        """What tells apart the trees that don't stand yet: rules in preorder, remembered trees by identity, units."""
        out, stack = [], [tree]
        while stack:
            t = stack.pop()
            if not isinstance(t, Tree):
                out.append(-t)
            elif t.symbol in self.cache and t.count:
                out.append(("known", id(t)))
            else:
                out.append(t.rule)
                stack += reversed(t.kids)
        return tuple(out)

    def seats(self, tree: Tree, choose: bool = False, own: bool = False) -> float:
        """The log of the probability that equal new trees inside a tree are shared as they are; with ``choose`` they become so.

        Each such tree is, with equal chances, any of the equal ones before it or one of its own.
        """
        out, met = 0.0, defaultdict(list)
        stack = [(None, 0, tree)]
        while stack:
            into, at, t = stack.pop()
            if t.symbol in self.cache and not own:
                if t.count:
                    continue
                same = met[t.symbol, self.shape(t)]
                out -= math.log(len(same) + 1)
                if choose and (k := int(self.rng.integers(len(same) + 1))) < len(same):
                    into[at] = same[k]
                    continue
                if any(t is x for x in same):
                    continue
                same.append(t)
            own = False
            stack += [(t.kids, k, x) for k, x in reversed(list(enumerate(t.kids))) if isinstance(x, Tree)]
        return out

    # chart and drawing

    def chart(self, code: str) -> tuple[dict, dict, list[float]]:
        """(left, right, p): inside values by (start, width) and by (end, width), times ``scale`` a unit, and probabilities of the rules."""
        n = len(code)
        left, right = ({s: np.zeros((n + 1, n + 1)) for s in self.charted} for _ in range(2))
        p = [self.rule_probability(i) * self.fresh(r[0]) for i, r in enumerate(self.rules)]
        for w in range(1, n + 1):
            m = n - w + 1
            total: dict = defaultdict(lambda m=m: np.zeros(m))
            if w == 1:
                points = np.array([ord(c) for c in code])
                for i, (parent, rhs) in enumerate(self.rules):
                    if len(rhs) == 1 and isinstance(rhs[0], int):
                        total[parent] += p[i] * self.scale * (points == rhs[0])
                for s in self.charted:
                    if isinstance(s, int):
                        left[s][:n, 1] = right[s][1:, 1] = self.scale * (points == s)
            else:
                for s, before, last in self.joins:
                    v = np.einsum("ij,ij->i", left[before][:m, 1:w], right[last][w:, w - 1 : 0 : -1])
                    left[s][:m, w] = right[s][w:, w] = v
                for i, (parent, rhs) in enumerate(self.rules):
                    if len(rhs) > 1:
                        total[parent] += p[i] * left[rhs][:m, w]
            for parent, known in self.cache.items():
                for i in range(m if known else 0):
                    for t in known.get(code[i : i + w], ()):
                        total[parent][i] += self.again(t) * self.scale**w
            added = dict(total)
            while added:
                more: dict = defaultdict(lambda m=m: np.zeros(m))
                for i, parent, child in self.chains:
                    if child in added:
                        more[parent] += p[i] * added[child]
                added = {s: v for s, v in more.items() if (v > 1e-7 * (total[s] + v)).any()}
                for s, v in more.items():
                    total[s] = total[s] + v
            for s, v in total.items():
                left[s][:m, w] = right[s][w:, w] = v
        return left, right, p

    def pick(self, weights) -> int:
        sums = np.cumsum(weights)
        if not len(sums) or not 0 < sums[-1] < math.inf:
            raise ValueError("the grammar has no parse for an utterance")
        return int(min(np.searchsorted(sums, self.rng.random() * sums[-1], side="right"), len(sums) - 1))

    def draw(self, symbol: str, code: str, made: tuple[dict, dict, list[float]], own: bool = False) -> Tree:
        """A tree of ``code`` in proportion to its probability; with ``own`` the top is no remembered tree."""
        left, right, p = made
        top: list = [None]
        stack = [(symbol, 0, len(code), top, 0)]
        while stack:
            s, i, w, into, at = stack.pop()
            if isinstance(s, int):
                into[at] = s
                continue
            known = [] if own else self.cache.get(s, {}).get(code[i : i + w], [])
            own = False
            weights = [self.again(t) * self.scale**w for t in known]
            for r in self.of[s]:
                rhs = self.rules[r][1]
                if len(rhs) == 1 and isinstance(rhs[0], int):
                    weights.append(p[r] * self.scale * (w == 1 and ord(code[i]) == rhs[0]))
                else:
                    weights.append(p[r] * left[rhs if len(rhs) > 1 else rhs[0]][i, w])
            choice = self.pick(weights)
            if choice < len(known):
                into[at] = known[choice]
                continue
            rule = self.of[s][choice - len(known)]
            rhs = self.rules[rule][1]
            into[at] = Tree(s, rule, [None] * len(rhs), code[i : i + w])
            for k in range(len(rhs) - 1, 0, -1):
                before = rhs[:k] if k > 1 else rhs[0]
                u = 1 + self.pick(left[before][i, 1:w] * right[rhs[k]][i + w, w - 1 : 0 : -1])
                stack.append((rhs[k], i + u, w - u, into[at].kids, k))
                w = u
            stack.append((rhs[0], i, w, into[at].kids, 0))
        return top[0]

    def accepted(self, log_ratio: float, at: float) -> bool:
        return log_ratio >= 0 or self.rng.random() < math.exp(log_ratio / at)

    def sweep(self, at: float = 1.0) -> None:
        for k, line in enumerate(self.lines):
            old = self.trees[k]
            before = self.remove(old) - self.drawn(old) - self.seats(old)
            new = self.draw(self.start, line, self.chart(line))
            ratio = -self.drawn(new) - self.seats(new, choose=True)
            ratio += self.insert(new) - before
            if self.accepted(ratio, at):
                self.trees[k] = new
            else:
                self.remove(new)
                self.insert(old)
        if self.o.relabel:
            self.relabel(at)

    def relabel(self, at: float = 1.0) -> None:
        """Draw the inside of every remembered tree anew; all utterances that use it change."""
        for t in [t for known in self.cache.values() for same in known.values() for t in same]:
            if not t.count:  # went with a tree that held it
                continue
            rule, kids = t.rule, t.kids
            self.forget(t)
            before = self.swap(t) - self.drawn(t, own=True) - self.seats(t, own=True)
            new = self.draw(t.symbol, t.code, self.chart(t.code), own=True)
            ratio = -self.drawn(new, own=True) - self.seats(new, choose=True, own=True) - before
            t.rule, t.kids = new.rule, new.kids
            ratio += self.swap(t, put=True)
            if not self.accepted(ratio, at):
                self.swap(t)
                t.rule, t.kids = rule, kids
                self.swap(t, put=True)
            self.cache[t.symbol].setdefault(t.code, []).append(t)

    def swap(self, t: Tree, put: bool = False) -> float:
        """Take out or put in place what hangs below the top of a remembered tree; its log probability."""
        below: list[Tree] = []
        out = (self.expand if put else self.contract)(t, below)
        return out + sum((self.insert if put else self.remove)(k) for k in below)

    # parameters and what comes out

    def restaurant(self, parent: str, a: float, b: float) -> float:
        m, n = self.tables[parent], self.customers[parent]
        if not n:
            return 0.0
        out = sum(math.log(b + k * a) for k in range(1, m)) - math.lgamma(b + n) + math.lgamma(b + 1)
        return out + sum(math.lgamma(t.count - a) - math.lgamma(1 - a) for same in self.cache[parent].values() for t in same)

    def log_prob(self) -> float:
        """Of all trees in place."""
        out = sum(self.restaurant(p, self.a[p], self.b[p]) for p in self.cache)
        out += sum(math.lgamma(self.mass[p]) - math.lgamma(self.mass[p] + self.uses[p]) for p in self.mass)
        return out + sum(math.lgamma(w + n) - math.lgamma(w) for w, n in zip(self.weight, self.n, strict=True))

    def hyper(self) -> None:
        """Draw discount and concentration of every adapted category anew; a discount of 0 stays."""
        (up, down), (shape, size) = self.o.beta, self.o.gamma
        for s in self.cache:
            if not self.customers[s]:
                continue
            self.b[s] = slice_draw(lambda b, s=s: self.restaurant(s, self.a[s], b) + (shape - 1) * math.log(b) - b / size if b > 0 else -math.inf, self.b[s], 0.0, 1e9, max(self.b[s] / 2, 1e-3), self.rng)
            if self.a[s] > 0:
                self.a[s] = slice_draw(lambda a, s=s: self.restaurant(s, a, self.b[s]) + (up - 1) * math.log(a) + (down - 1) * math.log(1 - a) if 0 < a < 1 else -math.inf, self.a[s], 0.0, 1.0, 0.1, self.rng)

    def words(self, tree: Tree, category: str) -> str:
        """Yields of the outermost nodes of ``category``, space between; units outside them are words of their own."""
        out, stack = [], [tree]
        while stack:
            t = stack.pop()
            if isinstance(t, int):
                out.append(self.units[t - 0xF0000])
            elif t.symbol == category:
                out.append("".join(self.units[ord(c) - 0xF0000] for c in t.code))
            else:
                stack += reversed(t.kids)
        return " ".join(out)

    def run(self) -> Iterator[tuple[int, float, float]]:
        """(sweep, temperature, log probability) after each sweep."""
        for s in range(self.o.sweeps):
            at = heat(s, self.o)
            self.sweep(at)
            if self.o.hyper_every and (s + 1) % self.o.hyper_every == 0:
                self.hyper()
            yield s, at, self.log_prob()


def chains(prepared: DataFrame, rules: DataFrame, category: str, start: str, nruns: int, o: Options, schema: str, give) -> DataFrame:
    if not (grammars.has_category(rules, category) and grammars.has_category(rules, start)):
        raise ValueError(f"the grammar has no rules for {category} or {start}")
    held = [(r["weight"], r["a"], r["b"], r["parent"], tuple(r["rhs"])) for r in rules.limit(MOST_RULES + 1).collect()]
    if len(held) > MOST_RULES:
        raise ValueError(f"a grammar may have {MOST_RULES} rules")
    held.sort(key=lambda r: (r[3], r[4]))
    rows = folding.chained_fold(prepared.filter(F.trim("text") != ""), 1).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(nruns - 1))))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_ord", ignore_index=True)
        chain = Chain([t.split() for t in pdf["text"]], held, start, o, (o.seed + int(key[1]) + 7919 * int(key[0])) % (1 << 32))
        return give(chain, pdf, key)

    # a number of its own, as small rows would be gathered into one task otherwise, whatever their work
    parts = int(prepared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "chain", "run").groupBy("chain", "run").applyInPandas(run, schema)


def samples(prepared: DataFrame, rules: DataFrame, category: str = "Colloc0", start: str = "Sentence", nruns: int = 8, keep: int = 1, options: Options = Options()) -> DataFrame:
    """(doc_id, line_no, run, sample, text): the last ``keep`` states of every run, cut into yields of ``category``.

    ``prepared`` has doc_id, line_no and text, units apart by space; utterances without units give no rows. Each run's seed follows from that of the options.
    """

    def give(chain: Chain, pdf: pd.DataFrame, key) -> pd.DataFrame:
        out = []
        for s, _, _ in chain.run():
            if s >= options.sweeps - keep:
                text = [chain.words(t, category) for t in chain.trees]
                out.append(pd.DataFrame({"doc_id": pdf["doc_id"], "line_no": pdf["line_no"], "run": int(key[1]), "sample": s, "text": text}))
        return pd.concat(out, ignore_index=True)

    return chains(prepared, rules, category, start, nruns, options, "doc_id long, line_no int, run int, sample int, text string", give)


def traces(prepared: DataFrame, rules: DataFrame, start: str = "Sentence", nruns: int = 8, options: Options = Options()) -> DataFrame:
    """(chain, run, sweep, temperature, log_prob): the course of every run."""

    def give(chain: Chain, pdf: pd.DataFrame, key) -> pd.DataFrame:
        return pd.DataFrame([(int(key[0]), int(key[1]), *x) for x in chain.run()], columns=["chain", "run", "sweep", "temperature", "log_prob"])

    return chains(prepared, rules, start, start, nruns, options, "chain long, run int, sweep int, temperature double, log_prob double", give)


def segment(prepared: DataFrame, rules: DataFrame, category: str = "Colloc0", start: str = "Sentence", nruns: int = 8, keep: int = 1, options: Options = Options()) -> DataFrame:
    """(doc_id, line_no, text): what most samples of all runs say of each utterance, ties to the earliest."""
    return sampling.vote(samples(prepared, rules, category, start, nruns, keep, options))
