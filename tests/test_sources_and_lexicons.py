"""Text files over many splits, parse streams, stimuli, frozen lexicons, fold repair, the one-pass report, observed counts and forgetting learners."""

import itertools
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from lexiloom.functions.separator import Separator
from lexiloom.functions.sql import Split
from lexiloom.operators import evaluate, folding, frozen, prepare, puddle, statistics
from lexiloom.sources import corpus, text

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def lines(spark):
    return lambda texts: spark.createDataFrame([(0, i, x) for i, x in enumerate(texts)], "doc_id long, line_no int, text string")


@pytest.fixture
def small_splits(spark):
    old, cost = spark.conf.get(SPLIT), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set(SPLIT, "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set(SPLIT, old)
    spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_lines_are_numbered_over_splits_as_one_reader_does(spark, tmp_path, small_splits):
    rng = random.Random(1)
    given = {}
    for name, end in (("b.txt", "\n"), ("a.txt", "\r\n"), ("c.txt", "\n")):
        given[name] = ["" if rng.random() < 0.2 else " ".join(rng.choice(["é", "abc", "x y"]) for _ in range(rng.randint(1, 60))) for _ in range(300)]
        (tmp_path / name).write_bytes((end.join(given[name]) + end * (name != "c.txt")).encode())
    (tmp_path / "d.txt").write_text("")
    assert text.read_records(spark, str(tmp_path)).rdd.getNumPartitions() > 20
    found = sorted(map(tuple, text.read_lines(spark, str(tmp_path)).collect()))
    wanted = [(k, i, x) for k, name in enumerate(("a.txt", "b.txt", "c.txt")) for i, x in enumerate(given[name])]
    assert found == [w for w in wanted if w[:2] != (2, 299) or w[2]]
    found = sorted(map(tuple, text.read_lines(spark, str(tmp_path), "corpus").collect()))
    assert [(d, i) for d, i, _ in found] == [(0, i) for i in range(len(found))] and [x for *_, x in found] == [x for *_, x in wanted][: len(found)]
    with pytest.raises(ValueError):
        text.read_lines(spark, str(tmp_path), "other")


def test_parse_streams(spark, tmp_path, small_splits):
    samples = [[f"{k} {i} " + "ab " * (i % 7) for i in range(40)] for k in range(9)]
    samples[5] = samples[5][:11]
    (tmp_path / "parses").write_text("\n\n" + "\n  \n".join("\n".join(s) for s in samples[:4]) + "\n\n\n\n" + "\n\n".join("\n".join(s) for s in samples[4:]) + "\n\n")
    path = str(tmp_path / "parses")
    whole = [(k, i, x.strip()) for k, s in enumerate(samples) for i, x in enumerate(s)]
    assert sorted(map(tuple, text.read_parses(spark, path, keep_incomplete=True).collect())) == whole
    assert sorted(map(tuple, text.read_parses(spark, path).collect())) == [w for w in whole if w[0] != 5]
    assert sorted(map(tuple, text.read_parses(spark, path, ignore_firsts=7).collect())) == [(k - 7, i, x) for k, i, x in whole if k >= 7]


def test_stimuli(spark, tmp_path, small_splits):
    training = [f"a b{i} c" for i in range(200)]
    (tmp_path / "s").write_text("skipped\n\nTraining set\n" + "\n\n".join(training) + "\nTest:\nab\tba\n\nabc\tc\tb\n")
    rows = [tuple(r) for r in text.read_stimuli(spark, str(tmp_path / "s")).orderBy("line_no").select("section", "text", "other").collect()]
    assert rows == [("training", x, None) for x in training] + [("test", "ab", "ba"), ("test", "abc", "c\tb")]
    (tmp_path / "t").write_text("Training\na\nTest\nab\n")
    with pytest.raises(Exception, match="no tab"):
        text.read_stimuli(spark, str(tmp_path / "t")).collect()
    (tmp_path / "u").write_text("Training\na\n")
    with pytest.raises(ValueError, match="no test section"):
        text.read_stimuli(spark, str(tmp_path / "u"))


def test_sections_are_carried_over_ranges(spark):
    rows = spark.createDataFrame([(i, "m" + str(i) if i in (3, 4, 17) else None) for i in range(40)], "line_no long, m string")
    found = [r.section for r in text.sections(rows.repartition(3), F.col("m"), ranges=5).orderBy("line_no").collect()]
    assert found == [None] * 3 + ["m3"] + ["m4"] * 13 + ["m17"] * 23


def plain_best(units, split):
    """Least cost over all splits, earlier starts of later words first."""
    n, best = len(units), None
    for cuts in itertools.product([False, True], repeat=max(n - 1, 0)):
        starts = [0, *(i + 1 for i, c in enumerate(cuts) if c)]
        words = ["".join(units[a:b]) for a, b in zip(starts, [*starts[1:], n])]
        cost = sum(split.words.get(w, split.new + sum(split.letters.get(c, split.letter) for c in w)) for w in words)
        best = min(best, (cost, starts[::-1], words)) if best else (cost, starts[::-1], words)
    return best


@pytest.mark.parametrize("most", [frozen.WORDS, 0])
def test_frozen_lexicon(spark, lines, most, monkeypatch):
    monkeypatch.setattr(frozen, "CHUNK", 3)
    rng = random.Random(7)
    counts = {"ab": 9, "cd": 9, "a": 2, "abc": 1, "dd": 4, "éa": 3, "b": 1}
    given = [" ".join(rng.choice(["a", "b", "c", "d", "é", "ab", "z"]) for _ in range(rng.randint(1, 10))) for _ in range(60)] + ["a b c d", "", "  ", " ".join("abcd" * 200)]
    costs = frozen.Costs(spark.createDataFrame(list(counts.items()), "word string, n long"))
    found = frozen.viterbi(lines(given), costs, most).orderBy("line_no").collect()
    split = Split(counts)
    assert split.new == costs.new and split.letter == costs.letter and split.words == {r.word: r.cost for r in costs.words.collect()}
    for r, own in zip(found, given, strict=True):
        assert r.text == " ".join(split.best(own.split()))
        if 0 < len(own.split()) <= 10:
            cost, _, words = plain_best(own.split(), split)
            assert (r.text, r.cost) == (" ".join(words), cost)
    pairs = frozen.forced_choice(spark.createDataFrame([("ab", "ba"), ("zz", "zz"), ("ba", "ab")], "text string, other string"), costs, ).collect()
    chosen = {(r.text, r.other): r.choice for r in pairs}
    assert chosen["zz", "zz"] == 0.5 and chosen["ab", "ba"] > 0.9 and chosen["ab", "ba"] + chosen["ba", "ab"] == pytest.approx(1)
    with pytest.raises(ValueError):
        frozen.Costs(spark.createDataFrame([("a", 1)], "word string, n long"), b=0.0)


def test_fold_starts_move_to_long_utterances(lines):
    starts = lambda texts, n, least=2: [r.start for r in folding.fold_starts(lines(texts), n, least).orderBy("block").collect()]
    assert starts(["a b", "a", "a", "a b"], 2) == [0, 3]
    assert starts(["a b", "a b", "a", "a", "a b c"], 2) == [0, 4]
    rows = folding.fold(lines(["a b", "a", "a", "a b"]), 2, least_units=2).orderBy("fold", "turn", "line_no").collect()
    assert [(r.fold, r.line_no) for r in rows] == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 3), (1, 0), (1, 1), (1, 2)]
    with pytest.raises(Exception, match="too short"):
        starts(["a", "b c"], 2)
    with pytest.raises(Exception, match="shuffle"):
        starts(["a b", "a", "b", "c"], 2)
    with pytest.raises(Exception, match="shuffle"):
        starts(["a b", "a", "b", "c", "a b", "d"], 3)


def test_report_is_what_the_single_statistics_say(lines):
    own = Separator(" ", ";esyll", ";eword")
    tagged = lines(["a b ;esyll c ;esyll ;eword a ;esyll ;eword", "a ;esyll ;eword", " ", "c d ;esyll ;eword a b ;esyll c ;esyll ;eword"])
    found = {(r.level, r.name): r.value for r in statistics.report(tagged, own).collect()}
    for level in ("word", "syllable", "phone"):
        for name, n in statistics.describe_tokens(statistics.tokens(tagged, level, own)).first().asDict().items():
            assert found[f"{level}s", name] == n
    for name, n in statistics.describe_utterances(tagged, own).first().asDict().items():
        assert found["corpus", name] == n
    assert found["corpus", "entropy"] == pytest.approx(statistics.entropy(tagged, own).first().entropy)
    assert statistics.describe(tagged, own)["words"] == {"tokens": 5, "types": 3, "hapaxes": 1}


def test_moving_ratio_against_windows(lines):
    rng = random.Random(3)
    words = [[rng.choice("abcdef") for _ in range(rng.choice([1, 2, 3, 25]))] for _ in range(60)]
    flat = [w for own in words for w in own]
    wanted = [len(set(flat[i : i + 10])) / 10 for i in range(len(flat) - 10)]
    given = lines([" ".join(own) for own in words]).withColumn("tokens", F.split("text", " "))
    for bucket in (20_000, 12):
        assert statistics.moving_ratio(given, bucket=bucket).first().mattr == pytest.approx(sum(wanted) / len(wanted))


def test_counts_come_with_the_prepared_rows(lines):
    tagged = lines(["a ;esyll ;eword", "a! ;esyll ;eword", "", "b", " c ;esyll ;eword", "d ;esyll ;eword"])
    seen = Observation("prepared")
    assert prepare.prepare(tagged, tolerant=True, observation=seen).count() == 2
    errors = {r.error: r.n for r in prepare.validate(tagged.filter("text <> ''")).groupBy("error").agg(F.count("*").alias("n")).collect()}
    assert seen.get["utterances"] == 5 and seen.get["kept"] == errors[None] == 2
    assert {k: seen.get[k] for k in prepare.MESSAGES} == {k: errors.get(m, 0) for k, m in prepare.MESSAGES.items()}


def test_learner_forgets_what_it_learned_longest_ago():
    learner = puddle.Learner(memory=2)
    for x in ("a b", "c d", "e f"):
        learner.segment(x.split())
    assert list(learner.words) == ["cd", "ef"] and list(learner.known_ends(list("ab"), 0)) == [] and list(learner.known_ends(list("cd"), 0)) == [1]
    learner.segment(["c", "d"])
    learner.segment(["g", "h"])
    assert list(learner.words) == ["cd", "gh"] and learner.words["cd"] == 2


def test_models_of_any_size_give_the_same_split(lines):
    given = ["a b c d", "c d a b", "a b", "b a b c", "d c"]
    model = puddle.train(lines(given))
    found = [sorted((r.line_no, r.text) for r in rows.collect()) for rows in (puddle.apply(lines(given), model), puddle.apply_joined(lines(given), model, 2, False))]
    assert found[0] == found[1]


def test_gold_beside_the_text_scores_as_a_join_does(lines):
    own, gold = lines(["ab c d", "abc", ""]), lines(["a bc d", "abc", ""])
    beside = own.join(gold.select("doc_id", "line_no", F.col("text").alias("gold")), ["doc_id", "line_no"])
    rows = lambda df: sorted(map(str, df.collect()))
    for score in (evaluate.scores, evaluate.error_summary, evaluate.adjusted_rand_index):
        assert rows(score(beside)) == rows(score(own, gold))
    units = lines(["a b c d", "a b c", ""])
    assert rows(evaluate.adjusted_rand_index(own, gold, units)) == rows(evaluate.adjusted_rand_index(own, gold))
    assert [r.value for r in corpus.summary_lines(evaluate.error_summary(own, gold)).collect()][:5] == ["{", '    "correct": {', '        "abc": 1,', '        "d": 1', "    },"]
