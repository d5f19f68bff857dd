"""Column expressions over words and texts. All run in the JVM but ``nfc``."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.functions.alphabet import LATIN, Profile

WORD = r"\p{L}+"
#: Salt of the split: other salts give other splits, so it is a parameter everywhere.
SALT = "lexicon"
#: Upper bounds of the training and validation parts.
TRAIN, VALIDATION = 0.90, 0.95
LONGEST = 24


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode normal form C, which Spark has no function for."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def words_of(text: Column, pattern: str = WORD) -> Column:
    """The words of a text, lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def characters(word: Column) -> Column:
    return F.split(word, "")


def fraction(key: Column, salt: str = SALT) -> Column:
    """A number in [0, 1) from the first 64 bits of SHA-256 of salt, a bar and the key."""
    head = F.substring(F.sha2(F.concat(F.lit(salt + "|"), key), 256), 1, 16)
    return F.conv(head, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def split_of(key: Column, salt: str = SALT, train: float = TRAIN, validation: float = VALIDATION) -> Column:
    u = fraction(key, salt)
    return F.when(u < train, "train").when(u < validation, "val").otherwise("test")


def problem(word: Column, profile: Profile = LATIN, longest: int = LONGEST) -> Column:
    """The first reason a word is no word of the profile, or null."""
    return (
        F.when(~word.rlike(profile.within), "character outside the alphabet")
        .when(word.rlike(profile.starts_badly), "starts with a sign")
        .when(~word.rlike(profile.joiner_ok), "joiner not between two consonants")
        .when(F.length(word) > longest, "too long")
    )


def syllables(word: Column, profile: Profile = LATIN) -> Column:
    return F.regexp_extract_all(word, F.lit(profile.syllable), F.lit(0))


def syllable_kind(syllable: Column, profile: Profile = LATIN) -> Column:
    """C, CV, CVC, CC or other, by onset, vowel sign and final."""
    onset = f"[{profile.letters}]" + (f"(?:{profile.joiner}[{profile.letters}])*" if profile.joiner else "")
    if profile is LATIN:
        return F.when(syllable.rlike(f"^{onset}$"), "C").when(syllable.rlike(f"^{onset}[{profile.signs}]+$"), "CV").otherwise("other")
    nung, vowel = r"\x{ABEA}", r"[\x{ABE3}-\x{ABE9}]"
    final = f"[{profile.finals}{nung}{profile.loose}]"
    return (
        F.when(syllable.rlike(f"^{onset}$"), "C")
        .when(syllable.rlike(f"^{onset}{vowel}$"), "CV")
        .when(syllable.rlike(f"^{onset}{vowel}{final}+$"), "CVC")
        .when(syllable.rlike(f"^{onset}{final}+$"), "CC")
        .otherwise("other")
    )


def standard_spelling(word: Column, after: str = "aou", loose: str = "i", final: str = "y") -> Column:
    """The loose letter after one of some signs becomes the final; each decision looks at the original text."""
    return F.regexp_replace(word, f"(?<=[{after}]){loose}", final)


def wilson(k: Column, n: Column, upper: bool) -> Column:
    """A bound of the 95 % score interval of k in n; NaN for n = 0."""
    z = 1.959964
    p, sign = k / n, 1 if upper else -1
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))
    return F.when(n == 0, F.lit(float("nan"))).otherwise((centre + sign * half) / (1 + z * z / n))


def natural_key(name: Column) -> Column:
    """The numbers in a name, as numbers: arrays sort as lists do."""
    return F.transform(F.regexp_extract_all(name, F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("bigint"))
