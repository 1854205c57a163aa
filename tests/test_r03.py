"""Faster ways of round 3 against the slow ones, on odd texts."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import splits, sql
from lexiloom.functions.separator import Separator
from lexiloom.operators import frozen, syllables
from lexiloom.sources import text

ODD = ["", " ", "a ;esyll b c ;esyll ;eword ", "a;esyllb;eword", ";eword;eword a ;eword", ";ewo;esyllrd a ;eword", "a\t;esyll b ;eword", "a;b ;eword c", "é ;esyll ;eword", "  a   b ;esyll;eword", "a ;esyll ;esyll ;eword ;eword", ";", "a ;es yll b ;eword", None]


@pytest.mark.parametrize("level", [None, "word", "syllable", "phone"])
def test_plain_tokens_are_those_piece_by_piece(spark, level):
    own = Separator()
    rows = spark.createDataFrame([(t,) for t in ODD], "text string")
    slow = own._nested(F.col("text")) if level is None else own._tokens(F.col("text"), level, False)
    found = rows.select(own.tokenize(F.col("text"), level, keep_boundaries=False).alias("x"), slow.alias("y")).collect()
    assert [r.x for r in found] == [r.y for r in found]
    assert own._odd()


@pytest.mark.parametrize("strip", [False, True])
@pytest.mark.parametrize("phones", [False, True])
def test_plain_syllables_are_those_letter_by_letter(spark, monkeypatch, phones, strip):
    own, draw = Separator(phone=";", syllable="/", word=" "), random.Random(7)
    words = ["".join(draw.choice("aeprtsx") for _ in range(draw.randint(1, 7))) for _ in range(400)] + ["", "a;", "?a"]
    texts = [" ".join(draw.choices(words, k=draw.randint(1, 2))) for _ in range(600)] + ["", " ", "pa ", "pa  ta", " pa", None]
    if phones:
        texts = [t and "".join(c if c == " " or draw.random() < 0.002 else c + ";" for c in t) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def found():
        out = syllables.syllabify(rows, ["p", "t", "r", "tr", "pr", "s", "str", "spr", "pa"], list("aei") + ["oo"], own, strip=strip, tolerant=True)
        return sorted(map(tuple, out.select("doc_id", "text").collect()))

    fast = found()
    monkeypatch.setattr(syllables.Plain, "holds", lambda self, text: F.lit(False))
    assert fast == found() and len(fast) > 20



def test_best_splits_in_arrays_are_those_letter_by_letter():
    draw = random.Random(3)
    counts = {"".join(draw.choice("abcde") for _ in range(draw.randint(1, 6))): draw.randint(1, 50) for _ in range(60)}
    texts = [" ".join("".join(draw.choice("abcdef\u00e9") for _ in range(draw.choice([1, 1, 1, 2]))) for _ in range(draw.randint(0, 50))) for _ in range(300)] + [None, "", "a"]
    for lexicon in (counts, {"a": 1}):
        own = sql.Split(lexicon)
        found, _ = splits.split_texts(pa.array(texts), splits.Words(own.words, own.letters, own.letter, own.new))
        assert found == [" ".join(own.best((t or "").split())) for t in texts]


def test_a_lexicon_in_memory_gives_what_a_joined_one_does(spark):
    rows = spark.createDataFrame([(0, 0, "a b c a b"), (0, 1, "ab c  d a"), (0, 2, ""), (0, 3, None), (0, 4, "x yz a")], "doc_id long, line_no int, text string")
    costs = frozen.Costs(spark.createDataFrame([("ab", 5), ("abc", 2), ("c", 3), ("da", 1)], "word string, n long"))
    held, joined = frozen.viterbi(rows, costs), frozen.viterbi(rows, costs, 0)
    assert sorted(map(tuple, held.collect())) == sorted(map(tuple, joined.collect()))
    assert "Join" not in held._jdf.queryExecution().optimizedPlan().toString()


def test_a_sample_runs_on_over_files_and_ranges(spark, tmp_path):
    for k, part in enumerate(["a b\nc\r\n", "d\n\n \na\n", "\x0b\nc\nd\n\t\r\n", "stopped\n"]):
        (tmp_path / f"part-{k}.txt").write_bytes(part.encode())
    read = lambda **options: sorted(map(tuple, text.read_parses(spark, str(tmp_path), **options).collect()))
    whole = [(0, 0, "a b"), (0, 1, "c"), (0, 2, "d"), (1, 0, "a"), (1, 1, "c"), (1, 2, "d")]
    assert read(among="corpus", ranges=2) == read(among="corpus") == whole
    assert read(among="corpus", keep_incomplete=True) == [*whole, (2, 0, "stopped")]
    assert read(keep_incomplete=True, ranges=3) == [(0, 0, "a b"), (0, 1, "c"), (1, 0, "d"), (2, 0, "a"), (3, 0, "c"), (3, 1, "d"), (4, 0, "stopped")]
