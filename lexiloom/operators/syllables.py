"""Syllables by maximal onsets, as array functions over the letters of a word."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import computed, let
from ..functions.separator import Separator, one_of


def word_syllables(word: Column, onsets: list[str], vowels: list[str]) -> Column:
    """A struct of the syllables of a word of one-character phones, and an error.

    Letters are read from the end. A vowel closes the syllable before it; if no vowel stands before the vowel, letters to its left join
    while they and the onset so far are a known onset. Letters that no syllable takes are an error.
    """
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit("").alias("onset"), F.lit(False).alias("grow"))
    known = F.array(*[F.lit(o) for o in onsets]) if onsets else F.array().cast("array<string>")
    sounds = F.array(*[F.lit(v) for v in vowels]) if vowels else F.array().cast("array<string>")

    # open: coda and, once grow holds, the syllable's vowel too; onset: what has joined on its left so far
    def read(s: Column, c: Column) -> Column:
        is_vowel = F.array_contains(sounds, c)
        joins = s["grow"] & ~is_vowel & F.array_contains(known, F.concat(c, s["onset"]))
        closed = F.when(s["grow"], F.concat(F.array(F.concat(s["onset"], s["open"])), s["done"])).otherwise(s["done"])
        pending = F.when(s["grow"], c).otherwise(F.concat(c, s["open"]))
        grown = F.struct(s["done"].alias("done"), s["open"].alias("open"), F.concat(c, s["onset"]).alias("onset"), F.lit(True).alias("grow"))
        other = F.struct(closed.alias("done"), pending.alias("open"), F.lit("").alias("onset"), is_vowel.alias("grow"))
        return F.when(joins, grown).otherwise(other)

    def whole(end: Column) -> Column:
        return F.when(end["grow"], F.concat(F.array(F.concat(end["onset"], end["open"])), end["done"])).otherwise(end["done"])

    symbols = F.array(*[F.lit(c) for c in sorted(set("".join([*onsets, *vowels])))])

    def checked(word: Column, letters: Column, found: Column) -> Column:
        unknown = F.get(F.filter(F.reverse(letters), lambda c: ~F.array_contains(symbols, c)), F.lit(0))
        error = F.when(unknown.isNotNull(), F.concat(F.lit('unknown symbol "'), unknown, F.lit('" in word "'), word, F.lit('"')))
        error = error.when(~F.exists(letters, lambda c: F.array_contains(sounds, c)), F.concat(F.lit('no vowel in word "'), word, F.lit('"')))
        error = error.when(F.array_join(found, "") != word, F.concat(F.lit('onset not found in "'), word, F.lit('"')))
        return F.struct(found.alias("syllables"), error.alias("error"))

    of_letters = lambda w, letters: let(F.aggregate(letters, state, read), lambda end: let(whole(end), lambda found: checked(w, letters, found)))
    return let(word, lambda w: let(F.reverse(F.filter(F.split(w, ""), lambda c: c != "")), lambda letters: of_letters(w, letters)))


class Plain:
    """Patterns for utterances of one-character phones, of words apart by one separator, that all have syllables: these are cut by one replacement.

    A vowel's syllable ends after the fewest consonants that leave a whole onset, or nothing, before the next vowel. Onsets count that letters
    can join one by one: all their ends are onsets too. ``apart`` says whether a phone separator follows each phone.
    """

    def __init__(self, onsets: list[str], vowels: list[str], separator: Separator, apart: bool) -> None:
        symbols, sounds = set("".join([*onsets, *vowels])), {v for v in vowels if len(v) == 1}
        whole = [o for o in dict.fromkeys(onsets) if o and not sounds & set(o) and all(o[k:] in onsets for k in range(1, len(o)))]
        self.word, self.phone, self.syllable = separator.word, separator.phone if apart else "", separator.syllable
        own, marks = [c for c in (separator.word, separator.phone) if c], {*(separator.word or ""), *(separator.phone or ""), *(separator.syllable or "")}
        self.possible = bool(self.word and self.syllable and sounds) and all(len(c) == 1 and re.escape(c).replace("\\ ", " ") == c for c in own) and not symbols & marks
        if not self.possible:
            return
        vowel, letter, consonant, mark = one_of(sounds), one_of(symbols), one_of(symbols - sounds), self.phone
        onset = one_of(o for o in whole if len(o) == 1) + mark if all(len(o) == 1 for o in whole) else "(?:" + "|".join("".join(re.escape(c) + mark for c in o) for o in whole) + ")"
        begun = (f"(?:{onset})?" if whole else "") + vowel
        breaks = [f"{letter}(?!{mark})", f"(?<!{letter}){mark}"] if apart else []
        self.breaks = "|".join([one_of({*symbols, *self.word, *mark}, "^"), *breaks, f"(?:^|{self.word})(?!{begun})"])
        self.open = f"({vowel}{mark}(?:{consonant}{mark})*?)(?={begun})" if symbols - sounds else f"({vowel}{mark})(?={begun})"

    def holds(self, text: Column) -> Column:
        """Whether ``text`` is such an utterance."""
        return F.coalesce(~text.rlike(self.breaks), F.lit(False)) if self.possible else F.lit(False)

    def cut(self, text: Column, strip: bool) -> Column:
        """The utterance with syllable separators, as ``syllabify`` gives it."""
        out = F.regexp_replace(text, self.open, f"$1{self.syllable}")
        if not strip:
            return F.concat(F.replace(out, F.lit(self.word), F.lit(self.syllable + self.word)), F.lit(self.syllable + self.word))
        if not self.phone:
            return out
        ends = F.replace(F.replace(out, F.lit(self.phone + self.syllable), F.lit(self.syllable)), F.lit(self.phone + self.word), F.lit(self.word))
        return F.substring(ends, F.lit(1), F.length(ends) - 1)


def syllabify(df: DataFrame, onsets: list[str], vowels: list[str], separator: Separator = Separator(), strip: bool = False, filling_vowel: bool = False, tolerant: bool = False) -> DataFrame:
    """``df`` with syllable separators, plus error (null if none).

    Utterances that ``Plain`` knows are cut whole, others letter by letter. In utterances with phone separators, these are set aside and put back after each phone; a phone that would fall into two syllables is an error.

    ``strip`` leaves out separators at the ends of words' last syllables and utterances. ``filling_vowel`` gives a word without vowel
    a silent one at its end. Rows in error fail the job, or go when ``tolerant``; a syllable separator in the input always fails.
    """
    if not onsets or not vowels:
        raise ValueError("onsets and vowels can't be empty")
    silent = next(chr(c) for c in range(1, 1 << 16) if chr(c) not in set("".join([*onsets, *vowels]))) if filling_vowel else None
    sounds = [*vowels, silent] if silent else vowels
    present = F.col("text").contains(separator.syllable)
    text = F.when(present, F.raise_error(F.lit("syllable separator found in text"))).otherwise(F.col("text"))
    rows = computed(df, [c for c in df.columns if c != "text"], text=text).select(*df.columns)
    words = separator.tokenize(F.col("text"), "word", keep_boundaries=True)
    apart = F.lit(False) if separator.phone is None else F.col("_apart")

    def stops(parts: Column) -> Column:
        """Where each part ends, in letters."""
        return F.transform(parts, lambda x, i: F.aggregate(F.slice(parts, 1, i + 1), F.lit(0), lambda s, p: s + F.length(p)))

    def restored(word: Column, phones: Column) -> Column:
        """The struct of a word's syllables with a separator after each phone."""

        def joined(at: Column) -> Column:
            before = F.concat(F.array(F.lit(0)), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))))
            parts = F.zip_with(before, at, lambda x, y: F.array_join(F.slice(phones, x + 1, F.greatest(y - x, F.lit(0))), separator.phone))
            parts = parts if strip else F.transform(parts, lambda x: F.concat(x, F.lit(separator.phone)))
            cut = F.when(F.exists(at, lambda x: x == 0), F.concat(F.lit('syllables cut a phone in word "'), F.array_join(phones, separator.phone), F.lit('"')))
            return F.struct(parts.alias("syllables"), F.coalesce(word["error"], cut).alias("error"))

        places = lambda ends: F.transform(stops(word["syllables"]), lambda e: F.array_position(ends, e).cast("int"))
        return let(stops(phones), lambda ends: let(places(ends), joined))

    def silenced(word: Column) -> Column:
        """The word with a silent vowel at its end, if it has no vowel."""
        bare = ~F.exists(F.split(word, ""), lambda c: F.array_contains(F.array(*[F.lit(v) for v in vowels]), c))
        return F.when(bare, F.concat(word, F.lit(silent))).otherwise(word)

    def ended(word: Column) -> Column:
        joined = F.array_join(word["syllables"], separator.syllable)
        return F.struct((joined if strip else F.concat(joined, F.lit(separator.syllable))).alias("text"), word["error"].alias("error"))

    def one(raw: Column) -> Column:
        bare = separator.remove(raw)
        found = word_syllables(silenced(bare) if silent else bare, onsets, sounds)
        if silent:
            loud = lambda word: F.struct(F.transform(word["syllables"], lambda s: F.replace(s, F.lit(silent), F.lit(""))).alias("syllables"), word["error"].alias("error"))
            found = let(found, loud)
        if not separator.phone:
            return let(found, ended)
        phones = F.filter(F.split(raw, separator.phone, -1), lambda x: x != "")
        return let(found, lambda word: let(F.when(apart, let(phones, lambda p: restored(word, p))).otherwise(word), ended))

    plain, parted = Plain(onsets, vowels, separator, apart=False), Plain(onsets, vowels, separator, apart=True)
    if separator.phone:
        rows = rows.withColumn("_apart", F.col("text").rlike(separator.phone))
    # a last word separator goes, as empty words do
    ended_ = F.col("text").endswith(separator.word) if separator.word else F.lit(False)
    rows = rows.withColumn("_whole", F.when(ended_, F.substring("text", F.lit(1), F.length("text") - len(separator.word or ""))).otherwise(F.col("text")))
    rows = rows.withColumn("_plain", F.when(apart, parted.holds(F.col("_whole"))).otherwise(plain.holds(F.col("_whole"))))
    rows = rows.withColumn("_w", F.when(~F.col("_plain"), F.transform(words, one)))
    rows = rows.withColumn("error", F.get(F.filter(F.transform("_w", lambda w: w["error"]), lambda e: e.isNotNull()), F.lit(0)))
    joined = F.array_join(F.transform("_w", lambda w: w["text"]), separator.word)
    joined = joined if strip else F.concat(joined, F.lit(separator.word))
    cut = lambda own: own.cut(F.col("_whole"), strip) if own.possible else F.col("_whole")
    cut_ = F.when(F.col("_plain") & apart, cut(parted)).when(F.col("_plain"), cut(plain)).otherwise(joined)
    rows = computed(rows, [c for c in rows.columns if c != "text" and not c.startswith("_")], text=cut_).select(*df.columns, "error")
    if tolerant:
        return rows.filter("error is null")
    return rows.withColumn("text", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("text")))
