"""Numbers, dates and times as spoken words, natively: inputs for round trips from the numeric tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = "không một hai ba bốn năm sáu bảy tám chín".split()


def digits(text: Column) -> Column:
    """Each digit of a text by name."""
    out = text
    for i, d in enumerate(DIGITS):
        out = F.replace(out, F.lit(str(i)), F.lit(f" {d}"))
    return F.trim(out)


def below_thousand(n: int, full: bool) -> str:
    """A group of three digits; full: behind a higher group, where its hundreds are always said."""
    h, t, u = n // 100, n // 10 % 10, n % 10
    unit = "lăm" if u == 5 else DIGITS[u]
    words = [DIGITS[h], "trăm"] if h or full else []
    if t == 1:
        words += ["mười", unit] if u else ["mười"]
    elif t:
        words += [DIGITS[t], "mươi", *(["mốt" if u == 1 else unit] if u else [])]
    elif u:
        words += ["lẻ", DIGITS[u]] if words else [DIGITS[u]]
    return " ".join(words)


def _named(words: list[str], i: Column) -> Column:
    return F.get(F.split(F.lit("|".join(words)), "[|]"), i.cast("int"))


#: What follows the hundreds, and numbers below a hundred: short constants, as long ones make plans slow to work on.
BEHIND = [below_thousand(100 + i, True).removeprefix("một trăm").strip() for i in range(100)]
ALONE = [below_thousand(i, False) for i in range(100)]


def _group(n: Column, full: Column) -> Column:
    """Three digits; full: behind a higher group, where its hundreds are always said."""
    h = F.floor(n / 100)
    return F.when((h > 0) | full, F.rtrim(F.concat(_named(DIGITS, h), F.lit(" trăm "), _named(BEHIND, n % 100)))).otherwise(_named(ALONE, n))


def number(n: Column) -> Column:
    """0 to 999,999,999,999 as a cardinal."""
    n = n.cast("long")
    parts = []
    for scale, word in ((10**9, " tỷ"), (10**6, " triệu"), (10**3, " nghìn"), (1, "")):
        g = F.floor(n / scale) % 1000
        parts.append(F.when(g > 0, F.concat(_group(g, n >= scale * 1000 if scale < 10**9 else F.lit(False)), F.lit(word))))
    return F.when(n == 0, DIGITS[0]).otherwise(F.concat_ws(" ", *parts))


def date(ts: Column) -> Column:
    small = lambda n: F.coalesce(_named(ALONE, n), F.lit(""))  # noqa: E731  below a hundred, one look-up
    return F.concat_ws(" ", F.lit("ngày"), small(F.dayofmonth(ts)), F.lit("tháng"), small(F.month(ts)), F.lit("năm"), number(F.year(ts)))


def time(ts: Column) -> Column:
    return F.concat_ws(" ", number(F.hour(ts)), F.lit("giờ"), number(F.minute(ts)), F.lit("phút"), number(F.second(ts)), F.lit("giây"))
