"""Spoken numbers as a backtracking grammar.

small(), below_thousand() and number() yield every way to read a number that begins at a word, with the place behind it,
longest first. A reader takes the first way that uses all its words, so a word too many is a miss, never overlooked.
"""

from __future__ import annotations

from collections.abc import Iterator

from .lexicon import DIGITS, FILLERS, NEGATIVE, SCALES, SHORT_UNITS, STRUCTURE


class Miss(ValueError):
    """The words are no sentence of the grammar."""


def small(words: list[str], i: int) -> Iterator[tuple[int, int]]:
    """0 to 99."""
    if i >= len(words):
        return
    w, nxt = words[i], words[i + 1] if i + 1 < len(words) else ""
    unit = lambda k: DIGITS.get(words[k], 0) if k < len(words) and words[k] != "linh" else 0
    if w == "mười":
        if unit(i + 1):
            yield 10 + unit(i + 1), i + 2
        yield 10, i + 1
    elif w in DIGITS:
        d = DIGITS[w]
        if d and nxt == "mươi":
            if unit(i + 2):
                yield 10 * d + unit(i + 2), i + 3
            yield 10 * d, i + 2
        if d and nxt in SHORT_UNITS:
            yield 10 * d + SHORT_UNITS[nxt], i + 2
        yield d, i + 1
    elif w.isdigit():
        yield int(w), i + 1


def below_thousand(words: list[str], i: int) -> Iterator[tuple[int, int]]:
    """[digit trăm] [filler] [small]; a scale word alone is no number."""
    if i + 1 < len(words) and (words[i] in DIGITS or words[i].isdigit()) and words[i + 1] == "trăm":
        hundreds = 100 * (DIGITS[words[i]] if words[i] in DIGITS else int(words[i]))
        at = i + 3 if i + 2 < len(words) and words[i + 2] in FILLERS else i + 2
        for v, j in small(words, at):
            yield hundreds + v, j
        yield hundreds, i + 2
    if i < len(words) and words[i] in FILLERS:
        yield from small(words, i + 1)
    yield from small(words, i)


def number(words: list[str], i: int = 0, under: int = 10**18) -> Iterator[tuple[int, int]]:
    """Groups before falling scales; scale words in a row multiply (hai nghìn tỷ)."""
    for v, j in below_thousand(words, i):
        scale, k = 1, j
        while k < len(words) and words[k] in SCALES:
            scale *= SCALES[words[k]]
            k += 1
        if scale > 1 and scale < under:
            for rest, end in number(words, k, scale):
                if rest < scale:
                    yield v * scale + rest, end
            yield v * scale, k
        yield v, j


def _whole(ways: Iterator[tuple[int, int]], words: list[str]) -> int | None:
    return next((v for v, j in ways if j == len(words)), None)


def read_cardinal(words: list[str]) -> int:
    v = _whole(number(words), words)
    if v is None:
        raise Miss(f"no number: {' '.join(words)!r}")
    return v


def read_digits(words: list[str]) -> str:
    """Digits as spoken, one by one or in groups of two; leading zeros stay."""
    out, i = [], 0
    while i < len(words):
        if words[i].isdigit():
            out.append(words[i])
            i += 1
            continue
        way = next(small(words, i), None)
        if way is None:
            raise Miss(f"no digit: {words[i]!r}")
        out.append(str(way[0]))
        i = way[1]
    if not out:
        raise Miss("no digit")
    return "".join(out)


def read_number(words: list[str]) -> int:
    """A value inside a type whose grammar is known: a cardinal if a word says so, else digits."""
    if not words:
        raise Miss("no number")
    return read_cardinal(words) if any(w in STRUCTURE for w in words) else int(read_digits(words))


def read_year(words: list[str]) -> int:
    for lead, base in ((["hai", "không"], 2000), (["một", "chín"], 1900)):
        if words[:2] == lead and len(words) > 2:
            tail = words[2:]
            v = _whole(small(tail, 0), tail)
            if v is None and all(w in DIGITS for w in tail) and len(tail) == 2:
                v = int(read_digits(tail))
            if v is not None:
                return base + v
    if len(words) == 4 and all(w in DIGITS for w in words):
        return int(read_digits(words))
    if len(words) == 1 and words[0].isdigit():
        return int(words[0])
    return read_cardinal(words)


def signed(words: list[str]) -> tuple[str, list[str]]:
    return ("-", words[1:]) if words[:1] and words[0] in NEGATIVE else ("", words)


def grouped(value: int) -> str:
    return f"{value:,}".replace(",", ".")
