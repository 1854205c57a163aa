"""Separators of phones, syllables and words, as column expressions.

A separator is a regular expression (unescaped: ``[ab]`` is a class). All methods take and give columns, so they run inside
the scan's stage without Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels from the smallest to the largest.
LEVELS = ("phone", "syllable", "word")

# Characters that a separator may not hold.
ILLEGAL = "!#$%&'*+-.^`|~:\\\""

#: What counts as whitespace; Java's own class is narrower than that of Unicode.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def trimmed(text: Column) -> Column:
    """Text without whitespace at both ends."""
    return F.regexp_replace(F.regexp_replace(text, "^" + SPACE, ""), SPACE + r"\z", "")


def squeezed(text: Column) -> Column:
    """Text with runs of whitespace as one space, none at the ends; plain single spaces are passed over. The class of Unicode is read only where a text has more than printable ASCII."""
    plain = F.regexp_replace(text, "  +", " ")
    return F.trim(F.when(text.rlike(r"[^ -~]"), F.regexp_replace(text, r"(?U) ?[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*|  +", " ")).otherwise(plain))


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)[^\s\x1c-\x1f]")


def dropped(text: Column, pattern: str) -> Column:
    """Text without the matches of a pattern; one without special characters is taken as plain text, which is faster."""
    if re.escape(pattern).replace("\\ ", " ") == pattern:
        return F.replace(text, F.lit(pattern))
    return F.regexp_replace(text, pattern, "")


def one_of(letters: Iterable[str], no: str = "") -> str:
    """The class of some characters, or of all others with ``no`` = ^."""
    return "[" + no + "".join(c if c.isalnum() else rf"\x{{{ord(c):x}}}" for c in sorted(letters)) + "]"


@dataclass(frozen=True)
class Separator:
    phone: str | None = " "
    syllable: str | None = ";esyll"
    word: str | None = ";eword"

    def __post_init__(self) -> None:
        for level in LEVELS:
            own = getattr(self, level)
            object.__setattr__(self, level, str(own) if own else None)
            if bad := [c for c in ILLEGAL if c in (own or "")]:
                raise ValueError(f"separator {own!r} holds {bad[0]!r}; these characters are illegal: {ILLEGAL}")
        own = [s for s in self if s]
        if len(set(own)) != len(own):
            raise ValueError(f"separators must differ: {own}")

    def __iter__(self) -> Iterator[str | None]:
        return iter((self.phone, self.syllable, self.word))

    def iterate(self, type: str = "value") -> Iterator:
        """The three separators from the smallest level, as values or as pairs with the names of their levels."""
        if type not in ("value", "pair"):
            raise ValueError(f"type must be value or pair, it is {type!r}")
        return iter(self) if type == "value" else zip(LEVELS, self, strict=True)

    def __str__(self) -> str:
        return "(" + ", ".join(f'{level}: "{own}"' for level, own in self.iterate("pair") if own) + ")"

    def check(self, level: str) -> str:
        """The level, if it is defined."""
        if level not in self.levels():
            raise ValueError(f'level "{level}" undefined, choose in: {", ".join(self.levels())}')
        return level

    def levels(self) -> list[str]:
        """Defined levels, from the smallest."""
        return [level for level in LEVELS if getattr(self, level)]

    def upper_levels(self, level: str) -> list[str]:
        """Defined levels above ``level``, from the smallest."""
        return [up for up in self.levels() if LEVELS.index(up) > LEVELS.index(self.check(level))]

    def strip(self, text: Column, level: str | None = None) -> Column:
        """Text without separators (of one level, or any) at both ends, and without whitespace there."""
        names = [self.check(level)] if level else ["word", "syllable", "phone"]
        own = [f"({getattr(self, n)})" for n in names if getattr(self, n)]
        if not own:
            return trimmed(text)
        any_ = "|".join(own)
        run = rf"(?:{any_})(?:{any_}|[\s\x1c-\x1f])*"
        return trimmed(F.regexp_replace(F.regexp_replace(text, rf"(?U)^{run}", ""), rf"(?U){run}\z", ""))

    def is_empty(self, text: Column) -> Column:
        """Whether nothing but separators and whitespace is there."""
        own = "|".join(f"(?:{s})" for s in self if s)
        return text.isNull() | text.rlike(rf"(?U)^(?:{own}{'|' if own else ''}[\s\x1c-\x1f])*\z")

    def remove(self, text: Column, level: str | None = None) -> Column:
        """Text without separators (of one level, or all); runs of spaces become one."""
        for name in [self.check(level)] if level else ["word", "syllable", "phone"]:
            if getattr(self, name):
                text = dropped(text, getattr(self, name))
        return F.regexp_replace(text, "  +", " ")

    def split(self, text: Column, level: str, keep_boundaries: bool = False) -> Column:
        """Array of what stands between the separators of a level, empty tokens too."""
        pattern = getattr(self, self.check(level))
        clean = (lambda x: F.regexp_replace(x, " +", " ")) if keep_boundaries else self.remove
        return F.transform(F.split(text, pattern, -1), lambda x: F.regexp_replace(clean(x), "^ +", ""))

    def _pieces(self, text: Column, level: str, plain: bool = False) -> Column:
        pattern = getattr(self, level)
        if pattern is None:
            return F.array(text)
        if plain:  # no white space but spaces
            return F.transform(F.array_remove(F.split(text, pattern, -1), ""), lambda x: F.trim(x))
        return F.transform(F.filter(F.split(text, pattern, -1), lambda x: x != ""), lambda x: self.strip(x, level))

    def _deeper(self, tokens: Column, level: str) -> Column:
        return F.flatten(F.transform(tokens, lambda x: self._pieces(x, level)))

    def tokenize(self, text: Column, level: str | None = None, keep_boundaries: bool = True) -> Column:
        """Array of tokens of a level; without a level, nested arrays of words of syllables of phones (undefined levels left out)."""
        if level is None:
            if (odd := self._odd()) is None:
                return self._nested(text)
            return F.when(text.rlike(odd), self._nested(text)).otherwise(self._nested(text, plain=True))
        if level not in LEVELS:
            raise ValueError(f'level "{level}" undefined, choose in: {", ".join(LEVELS)}')
        if not keep_boundaries and (odd := self._odd()) is not None and getattr(self, level):
            return F.when(text.rlike(odd), self._tokens(text, level, keep_boundaries)).otherwise(self._plain_tokens(text, level))
        return self._tokens(text, level, keep_boundaries)

    def _odd(self) -> str | None:
        """What texts hold that must be read piece by piece: other than printable ASCII, or the first character of an inner separator elsewhere. Null if these separators always must be."""
        own = [s for s in (self.syllable, self.word) if s]
        plain = all(len(s) > 1 and s.isascii() and s.isprintable() and " " not in s and re.escape(s) == s.replace("-", r"\-") for s in own)
        if self.phone != " " or not own or not plain or any(s[0] in other[1:] or s != other and s.startswith(other) for s in own for other in own):
            return None
        firsts = one_of({s[0] for s in own})
        return f"[^ -~]|(?={firsts})(?!{'|'.join(own)})"

    def _plain_tokens(self, text: Column, level: str) -> Column:
        """Tokens without boundaries of a text that isn't odd: separators of other levels become that of this one or go."""
        own = getattr(self, level)
        for other in ("word", "syllable", "phone"):
            if other != level and getattr(self, other):
                up = LEVELS.index(other) > LEVELS.index(level)
                text = F.replace(text, F.lit(getattr(self, other)), F.lit(own if up else ""))
        return F.array_remove(F.split(text, own, -1), "")

    def _tokens(self, text: Column, level: str, keep_boundaries: bool) -> Column:
        tokens = self._pieces(text, "word")
        for down in ("syllable", "phone"):
            if LEVELS.index(level) <= LEVELS.index(down) and getattr(self, down):
                tokens = self._deeper(tokens, down)
        tokens = F.transform(tokens, lambda x: self.strip(x))
        if not keep_boundaries:
            tokens = F.transform(tokens, lambda x: self.remove(x))
        return F.filter(tokens, lambda x: x != "")

    def _nested(self, text: Column, plain: bool = False) -> Column:
        def syllables(word: Column) -> Column:
            own = self._pieces(word, "syllable", plain)
            if self.phone:
                own = F.transform(own, lambda s: F.array_remove(F.split(s, " ", -1), "") if plain else self._pieces(s, "phone"))
            return own if self.syllable else own[0]

        words = F.transform(self._pieces(text, "word", plain), syllables)
        return words if self.word else words[0]

    def literal_remove(self, text: Column, *names: str) -> Column:
        """Text without the separators of some levels, taken literally."""
        for name in names:
            if getattr(self, name):
                text = F.replace(text, F.lit(getattr(self, name)))
        return text


def escaped(separator: str) -> str:
    """The separator as a literal pattern."""
    return re.escape(separator)
