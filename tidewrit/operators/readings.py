"""Growing catalogues: proposed readings of canonical forms through four gates, over tables."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalogues, forms, keys
from ..functions import lexicon as L
from ..functions.numbers import Miss, read_number
from . import corpus
from .normalize import Normalization

#: The type that reads each catalogue, and English letter names as Vietnamese syllables (one for several letters).
TYPE_OF = {"equipment": "EQUIPMENT_ID", "acronyms": "ACRONYM", "foreign_names": "FOREIGN_NAME", "maritime_terms": "MARITIME_TERM", "legal_docs": "LEGAL_DOC_ID"}
ENGLISH_LETTERS = {"ây": "A", "ê": "AE", "a": "AR", "bi": "B", "bê": "B", "xi": "C", "si": "C", "sê": "C", "đi": "D", "đê": "D", "i": "EI", "ép": "F", "ep": "F", "gi": "G", "giê": "G", "ết": "HS", "hát": "H", "ây chờ": "H", "ai": "I", "giay": "J", "giây": "J", "kây": "K", "ca": "K", "eo": "L", "en lờ": "L", "em": "M", "en": "N", "ô": "O", "âu": "O", "pi": "P", "pê": "P", "kiu": "Q", "quy": "Q", "rờ": "R", "e rờ": "R", "ơ": "R", "ét": "S", "ti": "T", "tê": "T", "diu": "U", "iu": "U", "u": "U", "vi": "V", "vê": "V", "đắp bờ liu": "W", "vê kép": "W", "ích": "X", "quai": "Y", "oai": "Y", "dét": "Z", "dét tờ": "Z"}
SEPARATORS = {"gạch", "ngang", "nối", "trừ", "xẹt", "xẹc", "chéo", "dấu"}
MOST_SYLLABLES, LEAST_LIKENESS = 8, 0.60


def _letter_names() -> dict[str, set[str]]:
    names: dict[str, set[str]] = {}
    for letter, said in L.LETTERS.items():
        for n in said:
            names.setdefault(n, set()).add(keys.fold(letter))
    for n, letters in ENGLISH_LETTERS.items():
        names.setdefault(n, set()).update(letters)
    return names


NAMES = _letter_names()


def spells(reading: str, canonical: str) -> bool:
    """Whether the syllables can be names of the form's letters, one or two syllables a letter, in order."""
    want, words = re.sub("[^A-Za-z]", "", canonical).upper(), reading.split()
    reached = {0}  # letters matched by the first i words
    ways = [reached, *(set() for _ in words)]
    for i in range(len(words)):
        for n in (1, 2):
            letters = NAMES.get(" ".join(words[i : i + n]), set()) if i + n <= len(words) else set()
            ways[min(i + n, len(words))] |= {k + 1 for k in ways[i] if k < len(want) and want[k] in letters}
    return bool(want) and len(want) in ways[-1]


def _number(words: list[str]) -> str:
    try:
        return re.sub(r"\D", "", str(read_number(words)))
    except (Miss, ValueError, IndexError):
        return ""


def implausible(reading: str, canonical: str) -> str | None:
    """Why a reading cannot be one of a form: its digits must be its last words; a form without digits must be spelled or sound
    alike."""
    words = reading.split()
    if not words or words[0] in SEPARATORS or words[-1] in SEPARATORS:
        return "separator at an edge"
    digits = re.sub(r"\D", "", canonical)
    if not digits:
        alike = keys.ratio(keys.phonetic_key(reading), keys.phonetic_key(canonical))
        return None if spells(reading, canonical) or alike >= LEAST_LIKENESS else "sounds otherwise"
    k = len(words)
    while k and words[k - 1] in L.NUMBER_WORDS:
        k -= 1
    if k == len(words) or not k:
        return "no number" if k else "no letters"
    if digits not in (_number(words[k:]), "".join(_number([w]) for w in words[k:])):
        return "another number"
    return None


def _implausible_all(reading: pd.Series, canonical: pd.Series) -> pd.Series:
    return pd.Series([implausible(r or "", c or "") for r, c in zip(reading, canonical)], dtype=object)


def form_reason(reading: Column) -> Column:
    return corpus.reason(
        ("empty", reading == ""), ("digit", reading.rlike(r"\p{Nd}")), ("too long", F.size(F.split(reading, " ")) > MOST_SYLLABLES), ("foreign letters", ~F.replace(reading, F.lit(" "), F.lit("")).rlike(f"^[a-z{forms.VIETNAMESE}]+$")),
    )


def _resolved(norm: Normalization, kind: Column, reading: Column) -> Column:
    out = F.get(norm.parsed(F.array(kind), F.array(reading)), F.lit(0))
    return F.when(out["valid"], out["normalized"])


def _kind(catalogue: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for k, v in TYPE_OF.items() for x in (k, v))), catalogue)


def gated(spark: SparkSession, proposals: DataFrame, entries: dict[str, dict[str, list[str]]] | None = None) -> DataFrame:
    """(catalogue, canonical, reading) with the reason for which a reading is refused; null if the catalogue may take it.

    1 the form of the reading, 2 what reads it now, 3 whether it can be a reading of the form, 4 all accepted readings
    together must be read and must leave every reading of the catalogues as it was; those of a form that disturbs one go.
    """
    entries = entries or catalogues.defaults()
    known = spark.createDataFrame([(c, f) for c, e in entries.items() for f in e], "catalogue string, canonical string")
    df = proposals.withColumn("reading", forms.reading(F.col("reading")))
    rows = df.select("catalogue", "canonical", "reading").distinct().join(F.broadcast(known.withColumn("known", F.lit(True))), ["catalogue", "canonical"], "left")
    norm = Normalization(spark, entries)
    rows = rows.withColumns({"now": _resolved(norm, _kind(F.col("catalogue")), F.col("reading")), "odd": F.pandas_udf(_implausible_all, "string")("reading", "canonical")})
    why = F.coalesce(
        F.when(F.col("known").isNull() | _kind(F.col("catalogue")).isNull(), "no such form"), form_reason(F.col("reading")), F.when(F.col("now") == F.col("canonical"), "redundant"), F.when(F.col("now").isNotNull(), "reads as another form"), F.col("odd"),
    )
    rows = rows.withColumn("reason", why).select("catalogue", "canonical", "reading", "reason")
    accepted = [tuple(r) for r in rows.where("reason is null").select("catalogue", "canonical", "reading").orderBy("catalogue", "canonical", "reading").collect()]  # additions to a catalogue, which is sent to every task
    grown = {c: {f: list(r) for f, r in e.items()} for c, e in entries.items()}
    for catalogue, canonical, reading in accepted:
        grown[catalogue][canonical].append(reading)
    if accepted:
        after = Normalization(spark, grown)
        lost = rows.where("reason is null").withColumn("then", _resolved(after, _kind(F.col("catalogue")), F.col("reading"))).where(~F.col("then").eqNullSafe(F.col("canonical"))).select("catalogue", "canonical", "reading", F.lit("not read although added").alias("late"))
        old = spark.createDataFrame([(c, f, r) for c, e in entries.items() if c in TYPE_OF for f, rs in e.items() for r in rs], "catalogue string, canonical string, reading string")
        old = old.withColumns({"before": _resolved(norm, _kind(F.col("catalogue")), F.col("reading")), "then": _resolved(after, _kind(F.col("catalogue")), F.col("reading"))})
        disturbed = old.where((F.col("before") == F.col("canonical")) & ~F.col("then").eqNullSafe(F.col("canonical"))).select("catalogue", F.col("then").alias("canonical")).distinct().withColumn("disturbs", F.lit("disturbs another reading"))
        rows = rows.join(lost, ["catalogue", "canonical", "reading"], "left").join(disturbed, ["catalogue", "canonical"], "left")
        rows = rows.withColumn("reason", F.coalesce("reason", "late", "disturbs")).select("catalogue", "canonical", "reading", "reason")
    return df.join(rows, ["catalogue", "canonical", "reading"], "left")
