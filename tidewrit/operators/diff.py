"""Alignment of spoken and written words: difflib at word level, in Arrow functions."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import forms, keys
from ..functions.numbers import Miss, read_cardinal
from . import spans as S

REGION = "array<struct<written:string,spoken:string,start:int,end:int>>"


OPCODES = "array<struct<op:string,i1:int,i2:int,j1:int,j2:int>>"
#: An ordinary word in lower case, and letters said one by one at the beginning of a stretch.
_ORDINARY = re.compile(r"[^\W\d_A-Z]{2,}")
_LETTERS_FIRST = re.compile(r"((?:[a-zA-ZđĐ]\s+)+[a-zA-ZđĐ])(?:\s|$)")


def opcodes(a: list[str], b: list[str]) -> list[tuple[str, int, int, int, int]]:
    return SequenceMatcher(None, [x.lower() for x in a], [x.lower() for x in b], autojunk=False).get_opcodes()


def regions(written: list[str], spoken: list[str]) -> list[tuple[str, str, int, int]]:
    """(written, spoken, first and last spoken word) of every stretch that differs."""
    return [(" ".join(written[a:b]), " ".join(spoken[c:d]), c, d - 1) for op, a, b, c, d in opcodes(written, spoken) if op != "equal"]


def _diff_all(written: pd.Series, spoken: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("written", "spoken", "start", "end"), r)) for r in regions((w or "").split(), (s or "").split())] for w, s in zip(written, spoken)])


def diff_regions(written, spoken) -> Column:
    """Array of (written, spoken, start, end)."""
    return F.pandas_udf(_diff_all, REGION)(written, spoken)


def _opcodes_all(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("op", "i1", "i2", "j1", "j2"), o)) for o in opcodes(list(x), list(y))] if x is not None and y is not None else None for x, y in zip(a, b)])


def word_opcodes(a, b) -> Column:
    """How words a become words b: array of (op, i1, i2, j1, j2), ends exclusive; case makes no difference."""
    return F.pandas_udf(_opcodes_all, OPCODES)(a, b)


def changed_regions(a: Column, b: Column, ops: Column) -> Column:
    """(written, spoken, start, end) of the stretches that differ and have spoken words."""
    return S.let(a, b, lambda a, b: F.transform(F.filter(ops, lambda o: (o["op"] != "equal") & (o["j1"] < o["j2"])), lambda o: region_of(a, b, o)))


def region_of(a: Column, b: Column, o: Column) -> Column:
    return F.struct(S.text_of(a, o["i1"], o["i2"] - 1).alias("written"), S.text_of(b, o["j1"], o["j2"] - 1).alias("spoken"), o["j1"].alias("start"), (o["j2"] - 1).alias("end"))


def candidate_regions(a: Column, b: Column, ops: Column) -> Column:
    """The stretches that differ and are empty on neither side, and within equal ones the runs of capitalised words, but
    not the one that begins the sentence: (written, spoken, start, end), in order."""

    def found(a: Column, b: Column) -> Column:
        def of(o: Column) -> Column:
            own = F.transform(F.slice(a, o["i1"] + 1, o["i2"] - o["i1"]), lambda w: F.when(forms.is_capitalized(w), "C").otherwise("O"))
            runs = F.filter(S.runs(own), lambda r: o["i1"] + r["start"] > 0)
            capital = F.transform(runs, lambda r: F.struct(S.text_of(a, o["i1"] + r["start"], o["i1"] + r["end"]).alias("written"), S.text_of(b, o["j1"] + r["start"], o["j1"] + r["end"]).alias("spoken"), (o["j1"] + r["start"]).alias("start"), (o["j1"] + r["end"]).alias("end")))
            both = (o["i1"] < o["i2"]) & (o["j1"] < o["j2"])
            return F.when(o["op"] == "equal", capital).when(both, F.array(region_of(a, b, o))).otherwise(F.array().cast(REGION))

        return F.flatten(F.transform(ops, of))

    return S.let(a, b, found)


def garbage(written: str, spoken: str) -> int:
    """Regions in which an ordinary lower-case word was spelled letter by letter."""
    out = 0
    for w, s, _, _ in regions(written.split(), spoken.split()):
        if m := _LETTERS_FIRST.match(s.strip()):
            spelled = re.sub(r"\s", "", m[1]).lower()
            out += any(x == spelled and x.islower() and _ORDINARY.fullmatch(x) is not None for x in w.split())
    return out


def _garbage_all(written: pd.Series, spoken: pd.Series) -> pd.Series:
    return pd.Series([garbage(w or "", s or "") for w, s in zip(written, spoken)], dtype="int32")


def garbage_score(written, spoken) -> Column:
    return F.pandas_udf(_garbage_all, "int")(written, spoken)


def pick_variant(written, variants) -> Column:
    """The least garbled variant, then the shortest; the lower-cased text where there is none."""
    return F.pandas_udf(_pick_all, "string")(written, variants)


def _pick_all(written: pd.Series, variants: pd.Series) -> pd.Series:
    return pd.Series([(w or "").lower() if v is None or not len(v) else v[0] if len(v) == 1 else min(v, key=lambda x: (garbage(w or "", x), len(x))) for w, v in zip(written, variants)])


def find_runs(words, phrases, soft=None, starts=None) -> Column:
    """For each phrase the leftmost run of words that equals it and is not taken; null where there is none. A phrase that is
    soft is found but takes nothing where its run begins at one of starts (booleans of words)."""
    if soft is None:
        return F.pandas_udf(_find_all, "array<struct<start:int,end:int>>")(words, phrases)
    return F.pandas_udf(_find_soft, "array<struct<start:int,end:int,free:boolean>>")(words, phrases, soft, starts)


def _runs_of(words: list[str], phrases: list[str], soft: list[bool], starts: list[bool]) -> list:
    taken, row = set(), []
    for p, s in zip(phrases, soft):
        t = p.split()
        at = next((i for i in range(len(words) - len(t) + 1) if t and words[i : i + len(t)] == t and not taken & set(range(i, i + len(t)))), None)
        free = at is not None and bool(s) and bool(starts[at])
        row.append(None if at is None else {"start": at, "end": at + len(t) - 1, "free": free})
        taken |= set() if at is None or free else set(range(at, at + len(t)))
    return row


def _find_all(words: pd.Series, phrases: pd.Series) -> pd.Series:
    return pd.Series([_runs_of(list(ws), list(ps), [False] * len(ps), []) if ws is not None and ps is not None else [] for ws, ps in zip(words, phrases)])


def _find_soft(words: pd.Series, phrases: pd.Series, soft: pd.Series, starts: pd.Series) -> pd.Series:
    return pd.Series([_runs_of(list(ws), list(ps), list(so), list(st)) if ws is not None and ps is not None else [] for ws, ps, so, st in zip(words, phrases, soft, starts)])


def placed_in_text(text, written) -> Column:
    """For each written form its first place in the text that overlaps none before it: (begin, end), exclusive; null if none."""
    return F.pandas_udf(_place_all, "array<struct<begin:int,end:int>>")(text, written)


def _place_all(text: pd.Series, written: pd.Series) -> pd.Series:
    out = []
    for t, ws in zip(text, written):
        used, row = [], []
        for w in ws if ws is not None else []:
            spots = (m.start() for m in re.finditer(re.escape(w), t or "")) if w else iter(())
            at = next((i for i in spots if all(i + len(w) <= a or i >= b for a, b in used)), None)
            row.append(None if at is None else {"begin": at, "end": at + len(w)})
            used += [] if at is None else [(at, at + len(w))]
        out.append(row)
    return pd.Series(out)


def reconstruct(words: Column, placed: Column) -> Column:
    """The words with the written forms of placed (start, end, written) put back."""
    return S.let(placed, lambda p: _reconstruct(words, p))


def _reconstruct(words: Column, placed: Column) -> Column:
    def piece(w: Column, i: Column) -> Column:
        s = F.get(F.filter(placed, lambda p: (p["start"] <= i) & (i <= p["end"])), F.lit(0))
        return F.when(s.isNull(), w).when(i == s["start"], s["written"])

    return F.array_join(F.filter(F.transform(words, piece), lambda x: x.isNotNull()), " ")


def pair_files(written: DataFrame, spoken: DataFrame, keys: list[str]) -> DataFrame:
    """Files of both sides by key: keys, text and spoken_text, of which one is null where the other side lacks the file."""
    return written.join(spoken.withColumnRenamed("text", "spoken_text"), keys, "full_outer")


def pair_sentences(written: DataFrame, spoken: DataFrame, by: list[str], order: str = "n", text: str = "text") -> DataFrame:
    """Sentences of the same file, aligned in order; only stretches of equal length are paired."""

    def align(key, w: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        a, b = w.sort_values(order)[text].tolist(), s.sort_values(order)[text].tolist()
        m = SequenceMatcher(None, [_file_key(x) for x in a], [_file_key(x) for x in b], autojunk=False)
        rows = [(*key, x, y) for op, i, j, k, l in m.get_opcodes() if j - i == l - k for x, y in zip(a[i:j], b[k:l])]
        return pd.DataFrame(rows, columns=[*by, "written", "spoken"])

    schema = ", ".join([*(f"{k} {dict(written.dtypes)[k]}" for k in by), "written string", "spoken string"])
    return written.groupBy(*by).cogroup(spoken.groupBy(*by)).applyInPandas(align, schema)


def _file_key(text: str) -> str:
    return " ".join(re.findall("[a-z0-9]+", keys.fold(text).lower()))


def _is_number(text: str) -> bool:
    try:
        read_cardinal(text.split())
        return True
    except (Miss, ValueError, IndexError):
        return False


def _numbers_all(text: pd.Series) -> pd.Series:
    return pd.Series([_is_number(t or "") for t in text])


def acronyms(pairs: DataFrame, known: DataFrame, min_count: int = 2) -> DataFrame:
    """(written, spoken, n): capitals, but no Roman numbers, with a reading of two to eight words that is no number, occurs
    often and does not resolve to them yet (known: spoken, canonical)."""
    found = pairs.select(F.explode(diff_regions("written", "spoken")).alias("r")).select(forms.no_edges(F.col("r.written")).alias("written"), F.lower("r.spoken").alias("spoken"))
    shape = F.col("written").rlike("^[A-ZĐ]{2,8}$") & ~F.col("written").rlike("^[IVXLCDM]+$") & ~F.col("spoken").rlike(r"\p{Nd}") & F.size(F.split("spoken", " ")).between(2, 8)
    counted = found.where(shape).groupBy("written", "spoken").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    counted = counted.where(~F.pandas_udf(_numbers_all, "boolean")("spoken"))
    return counted.join(known.select("spoken", F.col("canonical").alias("written")).distinct(), ["spoken", "written"], "left_anti").select("written", "spoken", "n")
