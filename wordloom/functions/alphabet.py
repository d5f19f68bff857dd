"""Alphabet profiles: which characters are letters, signs, finals and digits, and the patterns made from them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Profile:
    """Character classes, each the inside of a regular expression's brackets that Java and RE2 both read."""

    name: str
    letters: str
    finals: str
    signs: str
    digits: str
    joiner: str = ""
    stop: str = ""
    #: A vowel that may follow one of ``closing`` in the same syllable, and the final that is spelled the same.
    loose: str = ""
    closing: str = ""
    loose_final: str = ""

    @property
    def alphabet(self) -> str:
        return f"[{self.letters}{self.finals}{self.signs}{self.digits}{self.joiner}{self.stop}]"

    @property
    def within(self) -> str:
        """Words of the alphabet alone."""
        return f"^{self.alphabet}+$"

    @property
    def starts_badly(self) -> str:
        """Words that begin with what can only follow: a sign, a final or a joiner."""
        return f"^[{self.signs}{self.joiner}]"

    @property
    def joiner_ok(self) -> str:
        """Words in which each joiner stands between two consonants."""
        if not self.joiner:
            return "^.*$"
        consonant = f"[{self.letters}{self.finals}]"
        return f"^(?:[^{self.letters}{self.finals}{self.joiner}]|{consonant}(?:{self.joiner}?{consonant})*)*$"

    @property
    def syllable(self) -> str:
        """One syllable: an onset and all that hangs on it."""
        other = f"[^{self.letters}{self.digits}{self.stop}]"
        tail = other
        if self.joiner:
            tail = f"(?:{self.joiner}[{self.letters}]|[{self.closing}][{self.loose}]|{other})"
        return f"(?:[{self.letters}]|[{self.digits}{self.stop}]|^{tail}){tail}*"


LATIN = Profile("latin", letters="bcdfghjklmnpqrstvwxyz", finals="", signs="aeiou", digits="0-9")

# The code points of the Meitei Mayek block by kind.
MEITEI = Profile(
    "meitei",
    letters=r"\x{ABC0}-\x{ABDA}",
    finals=r"\x{ABDB}-\x{ABE2}",
    signs=r"\x{ABE3}-\x{ABEA}",
    digits=r"\x{ABF0}-\x{ABF9}",
    joiner=r"\x{ABED}",
    stop=r"\x{ABEB}",
    loose=r"\x{ABCF}",
    closing=r"\x{ABE5}\x{ABE3}\x{ABE8}",
    loose_final=r"\x{ABE2}",
)
PROFILES = {p.name: p for p in (LATIN, MEITEI)}
