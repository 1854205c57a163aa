"""Adaptor grammars: inside values and drawing against plain sums, probabilities of trees in place, samples over Spark."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import adaptor, grammars

RULES = [
    (1.0, 1.0, None, "S", ("Ws",)),
    (2.0, 1.0, None, "Ws", ("W",)),
    (1.0, 1.0, None, "Ws", ("W", "Ws")),
    (1.0, 0.3, 2.0, "W", ("Ps",)),
    (0.5, 0.3, 2.0, "W", ("a", "P", "b")),
    (1.0, 1.0, None, "Ps", ("P",)),
    (1.0, 1.0, None, "Ps", ("P", "Ps")),
    (1.0, 1.0, None, "P", ("a",)),
    (3.0, 1.0, None, "P", ("b",)),
]
LINES = ["abab", "ab", "babab", "aab", "ab"]
OPTIONS = adaptor.Options(sweeps=6, hyper_every=2, relabel=True, anneal=3, start_heat=2.0)


def chain(lines=LINES, options=OPTIONS, seed=3):
    return adaptor.Chain([list(x) for x in lines], RULES, "S", options, seed)


def plain(c, symbol, code):
    """The inside value by all derivations, without a chart."""
    if isinstance(symbol, int):
        return float(code == chr(symbol))
    out = sum(c.again(t) for t in c.cache.get(symbol, {}).get(code, []))

    def row(rhs, code):
        if len(rhs) == 1:
            return plain(c, rhs[0], code)
        return sum(plain(c, rhs[0], code[:k]) * row(rhs[1:], code[k:]) for k in range(1, len(code) - len(rhs) + 2))

    return out + sum(c.fresh(symbol) * c.rule_probability(i) * row(c.rules[i][1], code) for i in c.of[symbol])


def test_inside_values_and_draws():
    c = chain()
    for line in c.lines + ["".join(c.lines[1:3])]:
        left, _, _ = c.chart(line)
        assert left["S"][0, len(line)] / c.scale ** len(line) == pytest.approx(plain(c, "S", line), rel=1e-6)
    line, made = c.lines[3], c.chart(c.lines[3])
    trees = [c.draw("S", line, made) for _ in range(4000)]
    whole = plain(c, "S", line)
    by_shape = Counter(round(c.drawn(t), 9) for t in trees)
    for log_p, n in by_shape.items():
        # derivations of equal probability share a count, so the share is a multiple of it
        times = n / 4000 / (math.exp(log_p) / whole)
        assert n < 200 or abs(times - round(times)) < 0.25 * max(1, round(times))
    assert len({round(math.exp(x) / whole, 12) for x in by_shape}) > 1


def test_unary_cycles_settle():
    rules = [(1.0, 1.0, None, "S", ("A",)), (1.0, 1.0, None, "A", ("S",)), (1.0, 1.0, None, "A", ("x",))]
    c = adaptor.Chain([], [*rules], "S", OPTIONS, 1)
    code = chr(0xF0000)
    left, _, _ = c.chart(code)
    assert left["S"][0, 1] / c.scale == pytest.approx(1.0, rel=1e-5)  # a half, and a half of that again, and so on


def test_probabilities_of_trees_in_place():
    c = chain()
    assert c.started == pytest.approx(c.log_prob())
    for _ in range(4):
        c.sweep()
        c.hyper()
    assert [t.code for t in c.trees] == c.lines
    assert sum(c.customers.values()) == sum(t.count for known in c.cache.values() for same in known.values() for t in same)
    assert 0 < c.a["W"] < 1 and c.b["W"] > 0
    known = c.log_prob()
    assert sum(c.remove(t) for t in c.trees) == pytest.approx(known)
    assert not any(c.n) and not any(c.uses.values()) and not any(c.customers.values()) and not any(c.tables.values()) and not c.cache["W"]


@pytest.mark.parametrize("relabel", [False, True])
def test_stationary_cut(relabel):
    """Two utterances, all states summed by hand: how often the second is one word."""
    rules = [(1.0, 1.0, None, "S", ("W",)), (1.0, 1.0, None, "S", ("W", "W")), (1.0, 0.5, 1.0, "W", ("x",)), (1.0, 0.5, 1.0, "W", ("x", "x"))]
    o = adaptor.Options(hyper_every=0, relabel=relabel)
    # a single chain of 10,000 sweeps strays by 0.02, so several are taken together
    shares = Counter()
    for seed in range(8):
        c = adaptor.Chain([list("xx"), list("xx")], rules, "S", o, seed)
        for _ in range(4000):
            c.sweep()
            shares[tuple(len(t.kids) for t in c.trees)] += 1

    # each state's probability: all ways to seat the words one after the other
    def total(trees):
        def walk(left, tables, n, rule_n, rule_s):
            if not left:
                return 1.0
            kind, *rest = left
            if kind == "s1" or kind == "s2":
                i = int(kind == "s2")
                more = list(rule_s)
                more[i] += 1
                return (1 + rule_s[i]) / (2 + sum(rule_s)) * walk(rest, tables, n, rule_n, tuple(more))
            i = int(kind == "xx")
            out = 0.0
            for k, (of, m) in enumerate(tables):
                if of == kind:
                    out += (m - 0.5) / (n + 1) * walk(rest, tables[:k] + ((of, m + 1),) + tables[k + 1 :], n + 1, rule_n, rule_s)
            more = list(rule_n)
            more[i] += 1
            new = (len(tables) * 0.5 + 1) / (n + 1) * (1 + rule_n[i]) / (2 + sum(rule_n))
            return out + new * walk(rest, (*tables, (kind, 1)), n + 1, tuple(more), rule_s)

        return walk([x for t in trees for x in (("s1", "xx") if t == 1 else ("s2", "x", "x"))], (), 0, (0, 0), (0, 0))

    states = {(i, j): total((i, j)) for i in (1, 2) for j in (1, 2)}
    for state, p in states.items():
        assert shares[state] / 32000 == pytest.approx(p / sum(states.values()), abs=0.04)


def test_slice_sampler():
    rng, x, seen = np.random.default_rng(1), 0.5, []
    for _ in range(4000):
        x = adaptor.slice_draw(lambda v: math.log(v) if 0 < v < 1 else -math.inf, x, 0.0, 1.0, 0.1, rng)
        seen.append(x)
    assert np.mean(seen) == pytest.approx(2 / 3, abs=0.03)
    assert [round(adaptor.heat(s, OPTIONS), 3) for s in range(4)] == [2.0, 1.414, 1.0, 1.0]


def test_segment(spark):
    given = spark.createDataFrame([(0, i, " ".join(x)) for i, x in enumerate(["abab", "ab", "cab", "", "c"])], "doc_id long, line_no int, text string")
    units = given.select(F.explode(F.split("text", " ")).alias("unit")).filter("unit <> ''")
    rules = grammars.generated(units)
    table = grammars.parsed(rules)
    options = adaptor.Options(sweeps=4)
    drawn = adaptor.samples(given, table, nruns=2, keep=2, options=options)
    assert drawn.groupBy("run", "sample").count().count() == 4 and drawn.count() == 16
    rows = adaptor.segment(given, table, nruns=2, keep=2, options=options).orderBy("line_no").collect()
    assert [r.text.replace(" ", "") for r in rows] == ["abab", "ab", "cab", "c"]
    assert sorted(drawn.collect()) == sorted(adaptor.samples(given, table, nruns=2, keep=2, options=options).collect())
    course = adaptor.traces(given, table, nruns=2, options=options).collect()
    assert len(course) == 8 and all(r.log_prob < 0 for r in course)
    with pytest.raises(ValueError, match="no rules"):
        adaptor.samples(given, table, category="Other")
