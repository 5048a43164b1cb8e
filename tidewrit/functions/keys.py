"""Keys of spoken forms: accent-folded, phonetic, and the sequence of number words."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

from .lexicon import SIGNATURE_WORDS

#: Sounds that are written in several ways.
SOUNDS = {"ngh": "N", "ng": "N", "nh": "N", "gh": "G", "kh": "K", "ph": "F", "th": "T", "tr": "C", "ch": "C", "gi": "J", "qu": "K", "c": "K", "k": "K", "q": "K", "g": "G", "n": "N", "m": "M", "p": "P", "b": "P", "t": "T", "d": "J", "j": "J", "r": "J", "x": "S", "s": "S", "z": "Z", "f": "F", "v": "V", "w": "V", "h": "H", "l": "L", "y": "I", "i": "I", "e": "E", "a": "A", "o": "O", "u": "U"}
_SOUND = re.compile("|".join(sorted(SOUNDS, key=len, reverse=True)))
_NUMBER = re.compile("|".join(map(re.escape, SIGNATURE_WORDS)))


def fold(text: str) -> str:
    """Without accents; đ becomes d."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return plain.translate(str.maketrans("đĐ", "dD"))


def spoken_key(text: str) -> str:
    return re.sub(r"[\s_]+", "", unicodedata.normalize("NFC", text).lower())


def once(text: str) -> str:
    return re.sub(r"(.)\1+", r"\1", text)


def phonetic_key(text: str) -> str:
    plain = re.sub("[^a-z]", "", once(fold(text).lower()))
    return once(_SOUND.sub(lambda m: SOUNDS[m[0]], plain))


def signature(key: str) -> list[str]:
    """The number words of a key, from left to right."""
    return _NUMBER.findall(key)


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()
