"""Labels: which words may be asked for, cleaning, class numbers, made-up words and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordloom.functions.alphabet import LATIN, Profile
from wordloom.functions.text import characters, fraction, problem, split_of


def usable(word: Column, split: str, shortest: int, longest: int, profile: Profile = LATIN) -> Column:
    """Whether a word belongs to a part, has a length asked for, is a word of the profile and holds no digit and no stop."""
    barred = word.rlike(f"[{profile.digits}{profile.stop}]")
    return (split_of(word) == split) & F.length(word).between(shortest, longest) & problem(word, profile).isNull() & ~barred


def cleaned(text: Column, alphabet: str) -> tuple[Column, Column]:
    """What the alphabet can write of a text, and the characters left out, in order. ``alphabet`` is the inside of brackets."""
    return F.regexp_replace(text, f"[^{alphabet}]", ""), F.regexp_replace(text, f"[{alphabet}]", "")


def encode(text: Column, alphabet: str, strict: bool = True) -> Column:
    """The class of each character, its place in the alphabet from 1; one outside fails, or is null if not strict."""
    def place(c: Column) -> Column:
        at = F.instr(F.lit(alphabet), c)
        odd = F.raise_error(F.concat(F.lit("character outside the alphabet: "), c)).cast("int") if strict else F.lit(None).cast("int")
        return F.when(at > 0, at).otherwise(odd)

    return F.when(text == "", F.array().cast("array<int>")).otherwise(F.transform(characters(text), place))


def decode(classes: Column, alphabet: str, blank: int = 0) -> Column:
    """The text of classes; blanks are left out."""
    return F.array_join(F.transform(F.filter(classes, lambda c: c != blank), lambda c: F.substring(F.lit(alphabet), c, F.lit(1))), "")


def _pick(pool: str, u: Column) -> Column:
    return F.substring(F.lit(pool), F.floor(u * len(pool)).cast("int") + 1, F.lit(1))


def number(item: Column, digits: str = "0123456789", longest: int = 4, seed: str = "number") -> Column:
    """A number of 1 to ``longest`` digits for an item, without a leading zero unless it is one digit. Hashes of the item decide."""
    key = item.cast("string")
    length = F.floor(fraction(key, seed + " length") * longest).cast("int") + 1
    rest = F.array_join(F.transform(F.sequence(F.lit(2), F.lit(longest)), lambda i: F.when(i <= length, _pick(digits, fraction(F.concat_ws("/", key, i.cast("string")), seed))).otherwise("")), "")
    first = fraction(F.concat(key, F.lit("/1")), seed)
    return F.concat(F.when(length > 1, _pick(digits[1:], first)).otherwise(_pick(digits, first)), rest)


def scrambled(word: Column, item: Column, pools: tuple[str, ...], profile: Profile = LATIN, tries: int = 10, seed: str = "scramble") -> Column:
    """The word with each character of a pool replaced by one of the same pool, others kept: the first of some tries that is a word, else the word itself."""
    def attempt(k: int) -> Column:
        def other(c: Column, i: Column) -> Column:
            u = fraction(F.concat_ws("/", item.cast("string"), F.lit(str(k)), i.cast("string")), seed)
            out = c
            for pool in pools:
                out = F.when(F.instr(F.lit(pool), c) > 0, _pick(pool, u)).otherwise(out)
            return out

        return F.array_join(F.transform(characters(word), other), "")

    made = F.array(*[attempt(k) for k in range(tries)])
    return F.coalesce(F.get(F.filter(made, lambda w: problem(w, profile).isNull()), F.lit(0)), word)


def percent(share: Column) -> Column:
    """A share as text, two decimals."""
    return F.format_string("%.2f%%", share * 100)
