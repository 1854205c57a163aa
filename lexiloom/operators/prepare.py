"""Validation, prepared units and gold words of tagged utterances."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Observation, Row, Window
from pyspark.sql import functions as F

from ..functions.binding import computed, let
from ..functions.separator import Separator, dropped, escaped, is_blank, squeezed

# ASCII punctuation, as a regular expression class; one of ranges takes ten times as long to read.
PUNCTUATION = r"\p{Punct}"

# What is said of an utterance that breaks a rule.
MESSAGES = {
    "empty": "utterance is an empty string",
    "punctuation": "punctuation found in utterance",
    "begins": "utterance begins with a separator",
    "ends": "utterance does not end with a word separator",
    "syllable": "a word does not end with a syllable separator",
}


def utterance_error(text: Column, separator: Separator = Separator(), check_punctuation: bool = True) -> Column:
    """The first rule that a tagged utterance breaks, null if it is valid."""
    rule = F.when(separator.is_empty(text), F.lit(MESSAGES["empty"]))
    if check_punctuation:
        rule = rule.when(bare(text, separator).rlike(PUNCTUATION), F.lit(MESSAGES["punctuation"]))
    for own in separator:
        if own:
            rule = rule.when(text.startswith(own), F.lit(MESSAGES["begins"]))
    if separator.word:
        rule = rule.when(~text.endswith(separator.word), F.lit(MESSAGES["ends"]))
    if separator.syllable and separator.phone and separator.word:
        rule = rule.when(text.contains(separator.syllable) & unended(text, separator), F.lit(MESSAGES["syllable"]))
    return rule


def bare(text: Column, separator: Separator) -> Column:
    """Text without the separators that hold punctuation, and those that go before them: what is left has punctuation where the text without all of them has."""
    own = [s for s in (separator.word, separator.syllable, separator.phone) if s]
    while own and not set(own[-1]) & set(string.punctuation):
        own.pop()
    for s in own:
        text = dropped(text, s)
    return text


def unended(text: Column, separator: Separator) -> Column:
    """Whether a word separator, alone between phone separators, follows something else than a syllable separator; at the start it may stand."""
    phone, syllable, word = (escaped(s) for s in separator)
    if len(separator.phone) == 1 and separator.phone not in separator.syllable + separator.word:
        return text.rlike(rf"{phone}{word}(?={phone}|\z)(?<!(?:\A|{phone}){syllable}{phone}{word})")
    wrong = lambda parts: F.exists(F.arrays_zip(parts.alias("x"), F.concat(F.array(F.lit(None).cast("string")), parts).alias("before")), lambda p: (p["x"] == separator.word) & (p["before"] != separator.syllable))
    return F.coalesce(let(F.split(text, phone, -1), wrong), F.lit(False))


def validate(tagged: DataFrame, separator: Separator = Separator(), check_punctuation: bool = True) -> DataFrame:
    """``tagged`` plus ``error`` and ``line``, the 1-based number in the corpus order of a document, empty lines counted."""
    return tagged.withColumn("line", F.col("line_no") + 1).withColumn("error", utterance_error(F.col("text"), separator, check_punctuation))


def prepared_text(text: Column, separator: Separator = Separator(), unit: str = "phone") -> Column:
    """Units apart by one space. Unit phone keeps phone separators other than a space; unit syllable deletes plain spaces."""
    if unit == "phone":
        return squeezed(separator.literal_remove(text, "syllable", "word"))
    if unit != "syllable":
        raise ValueError(f"unit must be 'phone' or 'syllable', it is '{unit}'")
    joined = F.replace(separator.literal_remove(text, "word"), F.lit(" "), F.lit(""))
    return squeezed(F.replace(joined, F.lit(separator.syllable), F.lit(" ")) if separator.syllable else joined)


def watched(rows: DataFrame, observation: Observation) -> DataFrame:
    """Validated ``rows`` whose numbers ``observation`` takes while they run: utterances, kept, and those that break each rule (the names of ``MESSAGES``)."""
    broken = [F.count_if(F.col("error") == message).alias(rule) for rule, message in MESSAGES.items()]
    return rows.observe(observation, F.count("*").alias("utterances"), F.count_if(F.col("error").isNull()).alias("kept"), *broken)


def prepare(tagged: DataFrame, separator: Separator = Separator(), unit: str = "phone", check_punctuation: bool = True, tolerant: bool = False, observation: Observation | None = None) -> DataFrame:
    """Prepared utterances of the non-empty rows. Invalid rows fail the job, or go when ``tolerant``.

    An ``observation`` gets the counts of ``watched`` from the job that writes the result, not from one of its own.
    """
    # the text is computed once: filters and rules would otherwise take along all that makes it
    rows = computed(tagged, [c for c in tagged.columns if c != "text"], text=F.col("text")).select(*tagged.columns)
    rows = validate(rows.filter(~is_blank(F.col("text"))), separator, check_punctuation)
    rows = rows if observation is None else watched(rows, observation)
    if tolerant:
        rows = rows.filter("error is null")
    else:
        message = F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "), F.col("error"))
        # in the projected value, so that no pruning drops the check
        rows = rows.withColumn("text", F.when(F.col("error").isNotNull(), F.raise_error(message)).otherwise(F.col("text")))
    return rows.withColumn("text", prepared_text(F.col("text"), separator, unit)).drop("line", "error")


def gold_text(text: Column, separator: Separator = Separator()) -> Column:
    """Words apart by one space, without inner separators."""
    inner = separator.literal_remove(text, "syllable", "phone")
    return squeezed(F.replace(inner, F.lit(separator.word), F.lit(" ")) if separator.word else inner)


def gold(tagged: DataFrame, separator: Separator = Separator()) -> DataFrame:
    """Gold utterances; rows aren't validated, empty results go."""
    return tagged.withColumn("text", gold_text(F.col("text"), separator)).filter("text <> ''")


def units_of(text: Column) -> Column:
    """Array of the units of a prepared utterance."""
    return F.array_remove(F.split(squeezed(text), " ", -1), "")


def ends_of_corpus(df: DataFrame, key: list[str]) -> Row:
    """One row: lo and hi, the first and last ``key`` of a prepared corpus, and the units that stand there first and last; one pass."""
    rows = df.select(F.struct(*key).alias("_key"), "text")
    found = rows.agg(F.min("_key").alias("lo"), F.max("_key").alias("hi"), F.min_by("text", "_key").alias("_first"), F.max_by("text", "_key").alias("_last"))
    head, tail = units_of(F.col("_first")), units_of(F.col("_last"))
    return found.select("lo", "hi", F.get(head, F.lit(0)).alias("first"), F.get(tail, F.size(tail) - 1).alias("last")).first()


def with_ends(df: DataFrame, key: list[str], ends: Row) -> DataFrame:
    """``df`` plus _first and _last: whether a row is the first or the last of the corpus by ``key``."""
    same = lambda end: F.lit(False) if end is None else F.coalesce(F.forall(F.array(*[F.col(k) == F.lit(end[k]) for k in key]), lambda x: x), F.lit(False))
    return df.withColumn("_first", same(ends["lo"])).withColumn("_last", same(ends["hi"]))


def dense_order(df: DataFrame, key: list[str], range_rows: int = 50_000) -> DataFrame:
    """``df`` plus _ord, gapless from 0 in the order of ``key``.

    Rows go to ranges of the whole key, cut by a sample of the rows so that ranges hold about ``range_rows`` rows each, however the key is
    spread; they are numbered inside their range and offset by the counts of the ranges before. The ranged rows are kept, so that counts
    and numbers speak of the same ranges.
    """
    ranges = max(1, -(-df.count() // range_rows))
    rows = df.repartitionByRange(ranges, *key).sortWithinPartitions(*key).withColumn("_at", F.monotonically_increasing_id()).persist()
    part, before = F.shiftright("_at", 33), Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # a row for each range
    return numbered.withColumn("_ord", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_at", "_before")
