"""Transcripts in CHAT format: speakers, clean-up, and rule-based phonologisation, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codes of speakers who are left out, children and others.
LEFT_OUT = "SI. BR. CHI TO. ENV BOY NON MAG JEN CEC PAU ANN JOA SAN BRU CAR LEN JEM JOS STV LAR MAD MAR SOP"

# What the clean-up replaces, in this order.
CLEANING = [
    (r"^....:.", ""), ("_", " "), (r"\x15[0-9_]*\x15?.*$", ""), (r'["^/]', ""), (r"\+", " "), (r"[.?!;<>,:]", ""), (r"&=[^ ]*", ""), (r"&[^ ]*", ""),
    (r"\[[^\[]*\]", ""), (r"[()]", ""), ("xxx|www|XXX|yyy", ""), ("0", ""), (r"[^ ]*@s:[^ ]*", ""), (r"@[^ ]*", ""), ("' ", " "), (" +", " "), ("^ | $", ""),
]

# Spellings and sounds of two languages, in this order, after lower-casing.
SOUNDS = {
    "qom": [("ch", "C"), ("sh", "S"), ("ñ", "N"), ("'", "Q")],
    "raspanish": [
        ("x", "ks"), ("ch", "T"), ("ñ", "N"), ("j", "x"), ("v", "b"), ("z", "s"), ("c", "k"), ("rr", "R"), (" r", " R"), ("y ", "i "), ("y$", "i"), ("y", "S"),
        ("ll", "S"), ("qu", "k"), ("á", "a"), ("é", "e"), ("í", "i"), ("ó", "o"), ("ú", "u"), ("ü", "u"), ("h", ""),
    ],
}


def replaced(text: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, rule: F.regexp_replace(t, *rule), rules, text)


def select_speakers(lines: DataFrame, left_out: str = LEFT_OUT, only: str | None = None, text: str = "text") -> DataFrame:
    """Rows of main tiers, which begin with a star, of speakers that aren't left out; or those of ``only``."""
    kept = lines.filter(F.col(text).startswith("*"))
    return kept.filter(F.col(text).rlike(only)) if only else kept.filter(~F.col(text).rlike("|".join(left_out.split())))


def cleaned(lines: DataFrame, text: str = "text") -> DataFrame:
    """Orthographic utterances of selected tiers: without codes, comments, marks and punctuation; rows with nothing left, or a tab, go."""
    spoken = lines.filter(~F.col(text).rlike(r"^....:.0\(.*\) .$"))
    out = spoken.withColumn(text, replaced(F.col(text), CLEANING))
    return out.filter((F.col(text) != "") & ~F.col(text).contains("\t"))


def phonologised(text: Column, language: str) -> Column:
    if language not in SOUNDS:
        raise ValueError(f"language must be one of {', '.join(SOUNDS)}, it is {language!r}")
    return replaced(F.lower(text), SOUNDS[language])
