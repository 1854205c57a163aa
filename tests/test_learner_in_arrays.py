"""Queries of the incremental learner join nothing and hold no group; a frozen model cuts batches as a learner cuts utterance by utterance."""

import random

import pytest

from lexiloom.functions import known
from lexiloom.operators import puddle
from lexiloom.plans import catalog


@pytest.mark.parametrize("name", ["puddle_online", "puddle_frozen", "baseline_random"])
def test_conserved_letters_join_and_group_nothing(spark, data, name):
    plan = catalog.queries()[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "FlatMapGroups" not in plan


def test_letters_that_are_lost_show(spark):
    rows = [(0, 0, "ab c", "abc"), (0, 1, "ab", "a bc"), (0, 2, None, "a"), (0, 3, "b a", "a b")]
    found = catalog.conserved(spark.createDataFrame(rows, "doc_id long, line_no int, text string, gold string"))
    assert [r.conserved for r in found.orderBy("line_no").collect()] == [True, False, False, False]


@pytest.mark.parametrize("by_frequency", [False, True])
@pytest.mark.parametrize("window", [1, 2, 3])
def test_a_frozen_model_cuts_batches_as_utterance_by_utterance(spark, monkeypatch, window, by_frequency):
    draw = random.Random(window)
    words = ["".join(draw.choice("abcdé\U00020000") for _ in range(draw.randint(1, 5))) for _ in range(40)]
    texts = [" ".join("".join(draw.choices(words, k=draw.randint(1, 6)))) for _ in range(300)] + ["", "a", "a b", "x", "\U00020001 a b", "a  b", " a b", "ab c d", "ab cd a b", "a\tb c"]
    model = spark.createDataFrame([("word", w, draw.randint(1, 4)) for w in set(words)] + [("begin", w[:window], 1) for w in words if len(w) > 1] + [("end", w[-window:], 1) for w in words if len(w) > 1], "kind string, item string, n long")
    model = model.groupBy("kind", "item").sum("n").withColumnRenamed("sum(n)", "n")
    learner = puddle.Learner(window, by_frequency).load([tuple(r) for r in model.collect()])
    wanted = [" ".join(learner.segment(t.split(), update=False)) for t in texts]
    monkeypatch.setattr(known, "CELLS", 200)
    plain = [k for k, t in enumerate(texts) if t[1::2] == " " * (len(t) // 2) and t[::2].split() == [t[::2]]]
    if window < 3:
        arrays = known.Model(learner.words, learner.begins, learner.ends, window, by_frequency)
        assert arrays.cut([texts[k][::2] for k in plain]) == [wanted[k] for k in plain]
    rows = spark.createDataFrame([(0, k, t) for k, t in enumerate(texts)], "doc_id long, line_no int, text string")
    found = [r.text for r in puddle.apply(rows, model, window, by_frequency).orderBy("line_no").collect()]
    assert found == wanted and sum(" " in w for w in wanted) > 50


def test_groups_of_many_keys_and_batches_are_read_in_order(spark):
    draw = random.Random(5)
    rows = [(g, h, k, " ".join("".join(draw.choices(["abc", "ca", "bb", "dab"], k=3)))) for g in ("x", None, "y") for h in (0, 1) for k in range(60)]
    wanted = {}
    for g in ("x", None, "y"):
        for h in (0, 1):
            learner = puddle.Learner()
            wanted |= {r[:3]: " ".join(learner.segment(r[3].split())) for r in rows if r[:2] == (g, h)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        given = spark.createDataFrame(draw.sample(rows, len(rows)), "g string, h int, k int, text string")
        found = {(r.g, r.h, r.k): r.text for r in puddle.segment_online(given, ["g", "h"], ["k"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == wanted
