"""Round 4: streams of parses are numbered and voted on where they are read."""

import random

import pytest

from lexiloom.operators import dibs, evaluate, sampling
from lexiloom.plans import catalog
from lexiloom.sources import text


def modelled(files, among, ignore_firsts, keep_incomplete):
    """(sample, utterance, text) of files of lines, line by line."""
    streams = files if among == "file" else [[line for lines in files for line in lines]]
    samples = []
    for lines in streams:
        own = [[]]
        for line in lines:
            if line.strip(" \t\r") == "":
                own.append([])
            elif line.strip(" \t\r\x0b\x0c"):
                own[-1].append(line.strip())
        samples += [s for s in own if s]
    samples = samples[ignore_firsts:]
    rows = [(k, i, x) for k, s in enumerate(samples) if keep_incomplete or len(s) >= len(samples[0]) for i, x in enumerate(s)]
    return sorted(rows)


@pytest.mark.parametrize("blank", [0.002, 0.2, 0.9])
@pytest.mark.parametrize("among", ["file", "corpus"])
def test_streams_of_many_blocks_are_read_as_line_by_line(spark, tmp_path, among, blank):
    draw = random.Random(blank)
    odd = ["", " ", "\t", "\x0b", " a b ", "c\t"]
    files = [[draw.choice(odd[:3]) if draw.random() < blank else draw.choice([*odd[3:], "d e"]) for _ in range(n)] for n in (700, 1, 130, 64, 300)]
    for k, lines in enumerate(files):
        (tmp_path / f"part-{k}.txt").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size, ranges, options in (("128m", 10_000, {}), ("500b", 100, {"ignore_firsts": 1}), ("500b", 1000, {"keep_incomplete": True})):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found = text.read_parses(spark, str(tmp_path), among=among, ranges=ranges, **options)
            assert sorted(map(tuple, found.collect())) == modelled(files, among, options.get("ignore_firsts", 0), options.get("keep_incomplete", False))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_texts_of_parses_are_neither_moved_nor_written(spark, tmp_path):
    (tmp_path / "parses").write_text("a b\nc\n\nab\nc\n\na b\nc\n")
    votes = sampling.vote_in_place(text.read_parses(spark, str(tmp_path / "parses")))
    plan = votes._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" in plan and "Exchange hashpartitioning" not in plan
    assert sorted(map(tuple, votes.collect())) == [(0, "a b"), (1, "c")]


def test_the_vote_in_place_is_the_vote(spark):
    draw = random.Random(5)
    rows = [(s, u, draw.choice("abc")) for u in [*range(200), 4095, 4096, 70_000] for s in range(6) if draw.random() < 0.8]
    parses = spark.createDataFrame(rows, "sample long, utterance int, text string")
    plain = sampling.vote(parses.selectExpr("1 as doc_id", "utterance as line_no", "0 as run", "sample", "text")).select("line_no", "text")
    wanted = sorted(map(tuple, plain.collect()))
    assert len(wanted) > 190
    for block in (64, 4096):
        assert sorted(map(tuple, sampling.vote_in_place(parses, block).collect())) == wanted


def test_settings_of_a_passing_write_are_given_back(spark):
    key, old = "spark.sql.maxConcurrentOutputFileWriters", spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    with pytest.raises(ZeroDivisionError), text.passing(spark, writers=4):
        assert spark.conf.get(key) == "4"
        1 / 0
    assert spark.conf.get(key) == old


def random_tagged(draw):
    """Tagged texts, most of them plain; some with syllables, runs of spaces, other white space, letters beyond ASCII, empty words, no separator at the end."""
    unit = lambda: draw.choice(["a", "b", "c", "ab", "ch"])
    word = lambda gap: gap.join(unit() for _ in range(draw.randint(1, 4)))
    out = ["", " ", ";eword", " ;eword ;eword ", "a", "é ;eword", "a\tb ;eword", ";eworda ;eword", "a ;eword;eword b ;eword", "a ;esyll ;eword", " a  b ;eword a b ;eword"]
    for _ in range(300):
        gap = draw.choice([" "] * 6 + [" ;esyll ", "  "])
        out.append("".join(word(gap) + draw.choice([" ;eword", " ;eword", ";eword ", " ;eword "]) for _ in range(draw.randint(1, 6))))
    return out


def test_diphones_and_word_types_in_batches_are_those_of_any_separators(spark, monkeypatch):
    texts = random_tagged(random.Random(11))
    tagged = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "doc_id long, line_no int, text string").repartition(3)

    def found():
        own = dibs.summary(tagged)
        return {k: sorted(map(tuple, own[k].collect()), key=str) for k in ("counts", "diphones", "initial", "final", "words")}

    fast = found()
    monkeypatch.setattr(dibs, "CELLS", 0)
    assert found() == fast
    monkeypatch.setattr(dibs, "plain_separators", lambda *a: False)
    assert found() == fast and len(fast["words"]) > 100


def test_word_types_are_made_once_for_a_lexical_model(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(1)
            yield batch

    tagged = spark.createDataFrame([(0, 0, "a b ;eword b a c ;eword"), (0, 1, "c a ;eword a b ;eword")], "doc_id long, line_no int, text string")
    trained = dibs.summary(tagged)
    wanted = sorted(map(tuple, dibs.fit(trained, "lexical").collect()))
    words = spark.createDataFrame(trained["words"].collect(), "word string").coalesce(1).mapInArrow(run, "word string")
    assert sorted(map(tuple, dibs.fit(trained | {"words": words}, "lexical").collect())) == wanted
    assert seen.value == 1


def test_the_index_over_units_joins_nothing(spark, data):
    gold = spark.createDataFrame([(0, 0, "chat sat"), (0, 1, "the mat"), (1, 0, "a"), (1, 1, "")], "doc_id long, line_no int, text string")
    text_ = spark.createDataFrame([(0, 0, "cha tsat"), (0, 1, "the mat"), (1, 0, "a"), (1, 1, "")], "doc_id long, line_no int, text string")
    units = spark.createDataFrame([(0, 0, "ch a t s a t"), (0, 1, "th e  m a t"), (1, 0, "a"), (1, 1, "")], "doc_id long, line_no int, text string")
    joined = evaluate.adjusted_rand_index(text_, gold, units).first()[0]
    beside = text_.join(gold.withColumnRenamed("text", "gold"), ["doc_id", "line_no"]).join(units.withColumnRenamed("text", "u"), ["doc_id", "line_no"])
    assert evaluate.adjusted_rand_index(beside, units="u").first()[0] == joined != 1.0
    with pytest.raises(ValueError, match="same row"):
        evaluate.adjusted_rand_index(beside, gold, "u")
    plan = catalog.queries()["ari_units_tp"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
