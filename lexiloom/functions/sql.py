"""What users of SQL call: temporary functions of a session.

Most are SQL themselves, so queries stay in the JVM; separators are arguments, taken literally. ``syllable_rows`` and ``best_words`` are table functions in
Python over one text at a time, for rows that SQL alone can't make; whole corpora have ``syllables.syllabify`` and ``frozen.viterbi``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf, udtf

from .splits import Words, split_texts


def pieces(text: str, separator: str) -> str:
    """The expression of what stands between literal separators, nothing left out but empty pieces; a table function's generator may not call another function."""
    return f"filter(transform(split({text}, concat('\\\\Q', {separator}, '\\\\E')), x -> trim(x)), x -> x <> '')"


# name, parameters, result, body; default separators
FUNCTIONS = [
    # the class of Unicode is read only where a text has more than printable ASCII
    ("squeeze", "t STRING", "STRING", "trim(CASE WHEN t RLIKE '[^ -~]' THEN regexp_replace(t, '(?U)[\\\\s\\\\x1c-\\\\x1f]+', ' ') ELSE regexp_replace(t, '  +', ' ') END)"),
    ("prepare_phones", "t STRING", "STRING", "squeeze(replace(replace(t, ';esyll', ''), ';eword', ''))"),
    ("prepare_syllables", "t STRING", "STRING", "squeeze(replace(replace(replace(t, ';eword', ''), ' ', ''), ';esyll', ' '))"),
    ("gold_words", "t STRING", "STRING", "squeeze(replace(replace(replace(t, ';esyll', ''), ' ', ''), ';eword', ' '))"),
    ("prepare_text", "t STRING, phone STRING, syllable STRING, word STRING, unit STRING", "STRING",
     "squeeze(CASE unit WHEN 'phone' THEN replace(replace(t, coalesce(syllable, ''), ''), coalesce(word, ''), '')"
     " WHEN 'syllable' THEN replace(replace(replace(t, coalesce(word, ''), ''), ' ', ''), coalesce(syllable, ''), ' ')"
     " ELSE raise_error('unit must be phone or syllable') END)"),
    ("gold_text", "t STRING, phone STRING, syllable STRING, word STRING", "STRING",
     "squeeze(replace(replace(replace(t, coalesce(syllable, ''), ''), coalesce(phone, ''), ''), coalesce(word, ''), ' '))"),
    ("pieces", "t STRING, separator STRING", "ARRAY<STRING>", pieces("t", "separator")),
    ("units", "t STRING", "ARRAY<STRING>", "filter(split(squeeze(t), ' '), u -> u <> '')"),
]
#: Table functions: name, parameters, rows, body.
TABLES = [
    ("word_rows", "t STRING", "pos INT, word STRING",
     "SELECT pos, col AS word FROM posexplode(filter(split(trim(regexp_replace(t, '(?U)[\\\\s\\\\x1c-\\\\x1f]+', ' ')), ' '), u -> u <> ''))"),
    ("token_rows", "t STRING, phone STRING, syllable STRING, word STRING", "word_no INT, syllable_no INT, phone_no INT, phone STRING",
     f"SELECT * FROM inline(flatten(transform({pieces('t', 'word')}, (w, i) -> flatten(transform({pieces('w', 'syllable')},"
     f" (s, j) -> transform({pieces('s', 'phone')}, (p, k) -> struct(i AS word_no, j AS syllable_no, k AS phone_no, p AS phone)))))))"),
]


def maximal_onsets(word: str, onsets: set[str], vowels: set[str]) -> list[str]:
    """Syllables of a word of one-character phones, each with the longest known onset; fails where letters are left over."""
    out, end, i = [], len(word), len(word) - 1
    while i >= 0:
        if word[i] not in vowels:
            i -= 1
            continue
        start = i
        while start and word[start - 1] not in vowels and word[start - 1 : i] in onsets:
            start -= 1
        out.append(word[start:end])
        end, i = start, start - 1
    if end:
        raise ValueError(f'no syllables in word "{word}"')
    return out[::-1]


@udtf(returnType="word_no int, syllable_no int, syllable string")
class SyllableRows:
    """The syllables of words apart by a space; a word that has none fails."""

    def eval(self, t: str | None, onsets: list[str], vowels: list[str]) -> Iterator[tuple]:
        for w, word in enumerate((t or "").split()):
            yield from ((w, k, s) for k, s in enumerate(maximal_onsets(word, set(onsets), set(vowels))))


class Split:
    """Best splits under a small lexicon, with the costs of ``frozen.Costs``: minus logarithms in whole millionths."""

    def __init__(self, counts: dict[str, int], b: float = 1.0) -> None:
        letters = Counter(c for w in counts for c in w)
        ends, spare, total = sum(letters.values()) + len(counts) + 1, 1 / (len(letters) + 1), sum(counts.values())
        micro = lambda x: int(math.floor(-1e6 * math.log(x) + 0.5))
        self.letters, self.letter = {c: micro((n + spare) / ends) for c, n in letters.items()}, micro(spare / ends)
        self.new = micro(b / (total + b)) + micro((len(counts) + 1) / ends)
        base = {w: math.exp(-sum(self.letters[c] for c in w) / 1e6) * ((len(counts) + 1) / ends) for w in counts}
        self.words, self.longest = {w: micro((n + b * base[w]) / (total + b)) for w, n in counts.items()}, max(map(len, counts), default=0)

    def best(self, units: list[str]) -> list[str]:
        best, back, spelled, open_ = [0], [0], 0, (math.inf, -1)
        for stop in range(1, len(units) + 1):
            open_ = min(open_, (best[-1] - spelled, stop - 1))
            spelled += sum(self.letters.get(c, self.letter) for c in units[stop - 1])
            ways = [(open_[0] + spelled + self.new, open_[1])]
            for start in range(max(0, stop - self.longest), stop):
                if (cost := self.words.get("".join(units[start:stop]))) is not None:
                    ways.append((best[start] + cost, start))
            cost, start = min(ways)
            best.append(cost)
            back.append(start)
        out, stop = [], len(units)
        while stop:
            out.append("".join(units[back[stop] : stop]))
            stop = back[stop]
        return out[::-1]


@udtf(returnType="pos int, word string")
class BestWords:
    """The words of the best split of units apart by a space, under a lexicon of words and counts that comes as an argument."""

    def __init__(self) -> None:
        self.known = self.split = None

    def eval(self, t: str | None, lexicon: dict[str, int]) -> Iterator[tuple]:
        if lexicon != self.known:
            self.known, self.split = lexicon, Split(lexicon)
        yield from enumerate(self.split.best((t or "").split()))


def register_lexicon(spark: SparkSession, name: str, counts: dict[str, int], b: float = 1.0) -> None:
    """Make ``name(text)`` known to ``spark``: a text of units apart by single spaces as the words of its best split under a small lexicon, which goes to each task once.

    ``best_words`` is handed its lexicon with every row, and is for few rows.
    """
    own = Split(counts, b)
    words = Words(own.words, own.letters, own.letter, own.new)

    def split(texts: pa.Array) -> pa.Array:
        return pa.array(split_texts(texts, words)[0], pa.string())

    spark.udf.register(name, arrow_udf(split, "string"))


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to ``spark``: scalar ones, and the table functions; their names."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    for name, parameters, result, body in TABLES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({result}) RETURN {body}")
    for name, function in (("syllable_rows", SyllableRows), ("best_words", BestWords)):
        spark.udtf.register(name, function)
    return [name for name, *_ in [*FUNCTIONS, *TABLES]] + ["syllable_rows", "best_words"]
