"""Normalisers as Spark expressions, for types whose grammar an expression can hold: names, ranks and sequences of digits.

Each gives struct(normalized, valid, reason, resolved), the same as its Python form in functions.normalizers, and is used
where the type of a column is known when the plan is made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

#: A letter for each word of a digit. Words that only follow tens have letters of their own; a raw number stands in <>.
_SYMBOLS = {w: str(v) for w, v in L.DIGITS.items()} | {"linh": "l", "mười": "M", "mươi": "m"} | {w: {1: "a", 4: "d", 5: "e"}[v] for w, v in L.SHORT_UNITS.items()}
#: How a run of letters is cut, the longest way first: eleven to nineteen, ten, tens with and without mươi, a digit.
_PIECE = "M[1-9ade]|M|[1-9ade]m[1-9ade]|[1-9ade]m|[1-9ade][ade]|[0-9adel]|<[0-9]+>"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def _struct(written: Column, reason: Column, kind: str) -> Column:
    """reason is null where the text is read."""
    empty = F.coalesce(reason, F.when(written == "", "empty result"))
    return F.struct(F.when(empty.isNull(), written).alias("normalized"), empty.isNull().alias("valid"), F.coalesce(empty, F.lit("")).alias("reason"), F.lit(kind).alias("resolved"))


def _empty(words: Column) -> Column:
    return F.when(F.size(words) == 0, "empty")


def _titled(text: Column) -> Column:
    return F.array_join(F.transform(words_of(F.replace(text, F.lit("_"), F.lit(" "))), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), " ")


def title(text: Column, kind: str) -> Column:
    return _struct(_titled(text), _empty(words_of(text)), kind)


def rank(text: Column, kind: str) -> Column:
    words = words_of(text)
    english = F.forall(words, lambda w: F.lower(w).isin(sorted(L.ENGLISH_RANKS)))
    plain = F.lower(F.replace(F.array_join(words, " "), F.lit("_"), F.lit(" ")))
    return _struct(F.when(english, _titled(text)).otherwise(F.concat(F.upper(F.substring(plain, 1, 1)), F.substr(plain, F.lit(2)))), _empty(words), kind)


def digits(text: Column, kind: str) -> Column:
    words = words_of(text)
    table = F.create_map(*(F.lit(x) for pair in _SYMBOLS.items() for x in pair))
    symbols = F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), F.when(w.rlike("^[0-9]+$"), F.concat(F.lit("<"), w, F.lit(">"))), F.lit("?"))), "")
    read = F.regexp_extract(symbols, f"^(?:{_PIECE})*", 0)
    value = lambda c: F.translate(c, "adel", "1450")

    def written(p: Column) -> Column:
        one, last = F.substring(p, 1, 1), F.substring(p, -1, 1)
        tens = F.when(one == "M", "1").otherwise(value(one))
        return F.when(one == "<", F.regexp_replace(p, "[<>]", "")).when((F.length(p) == 1) & (one != "M"), value(one)).otherwise(F.concat(tens, F.when(last.isin("M", "m"), "0").otherwise(value(last))))

    at = F.length(F.regexp_replace(read, "<[0-9]+>", "x"))
    odd = F.get(words, at)
    quote = F.when(odd.contains("'") & ~odd.contains('"'), '"').otherwise("'")
    reason = F.coalesce(_empty(words), F.when(read != symbols, F.concat(F.lit("parser: no digit: "), quote, odd, quote)))
    return _struct(F.array_join(F.transform(F.regexp_extract_all(read, F.lit(f"({_PIECE})"), F.lit(1)), written), ""), reason, kind)


NATIVE: dict[str, Callable[[Column, str], Column]] = {"PERSON_NAME": title, "LOCATION_NAME": title, "RANK": rank, "DIGIT_SEQ": digits}
