"""Catalogue lookup as joins: exact, accent-folded and phonetic keys, then the fuzzy tier for what is left.

The catalogue is a table (catalogue, canonical, spoken, ord). Its keys are small enough to be sent to every task up to
``most_broadcast`` rows and are joined by a shuffle beyond. The fuzzy tier joins only distinct misses with readings that
share a block (two of the folded key's bigrams would be needed for any ratio that is accepted), never all with all.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import catalogues, keys
from .stored import keep


def _keys(text: pd.Series) -> pd.DataFrame:
    key = text.map(lambda t: keys.spoken_key(t or ""))
    return pd.DataFrame({"key": key, "flat": key.map(keys.fold), "sound": key.map(keys.phonetic_key), "signature": key.map(lambda k: " ".join(keys.signature(k)))})


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([keys.ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def key_columns(text: Column) -> Column:
    return F.pandas_udf(_keys, "key string, flat string, sound string, signature string")(text)


def ratio(a, b) -> Column:
    return F.pandas_udf(_ratios, "double")(a, b)


def table(spark, entries: dict[str, dict[str, list[str]]] | None = None) -> DataFrame:
    """(catalogue, canonical, spoken, ord) of catalogues; a canonical form is a reading of itself, behind all others."""
    rows = [(name, c, s, i) for name, e in (entries or catalogues.defaults()).items() for i, (c, s) in enumerate([(c, s) for c, ss in e.items() for s in ss] + [(c, c) for c in e])]
    return spark.createDataFrame(rows, "catalogue string, canonical string, spoken string, ord int")


def index(book: DataFrame) -> DataFrame:
    """With keys; numbered says whether the canonical form has a digit."""
    return book.withColumns({"k": key_columns(F.col("spoken")), "numbered": F.col("canonical").rlike("[0-9]")}).select("catalogue", "canonical", "ord", "numbered", "k.*", (F.lower("spoken") == F.lower("canonical")).alias("own"))


def _first(df: DataFrame, key: str, last: bool) -> DataFrame:
    """One canonical form for each key: the last reading (but any before the canonical form itself), or the first."""
    order = [F.col("own").asc(), F.col("ord").desc() if last else F.col("ord").asc()]
    w = Window.partitionBy("catalogue", key).orderBy(*order)
    return df.where(F.col(key) != "").withColumn("n", F.row_number().over(w)).where("n = 1").select("catalogue", F.col(key).alias(f"by_{key}"), F.col("canonical").alias(f"{key}_hit"))


def lookup(df: DataFrame, book: DataFrame, catalogue: str, text: Column, fuzzy: bool = True, most_broadcast: int = 200_000) -> DataFrame:
    """df with canonical, score and tier (exact, folded, phonetic, fuzzy or none) for the text. A table is broadcast if it has
    most_broadcast rows at most: the catalogue, and apart from it that of its bigrams."""
    own = keep(index(book.where(F.col("catalogue") == catalogue)), "catalogue")
    sized = lambda x: F.broadcast(x) if x.count() <= most_broadcast else x
    hint = F.broadcast if own.count() <= most_broadcast else lambda x: x
    out = df.withColumn("__text", F.coalesce(text, F.lit(""))).withColumn("__k", key_columns(F.col("__text")))
    for key, last, some in (("key", True, own), ("flat", False, own), ("sound", False, own.where("not numbered"))):
        out = out.join(hint(_first(some, key, last).drop("catalogue")), F.col(f"__k.{key}") == F.col(f"by_{key}"), "left").drop(f"by_{key}")
    tier = F.when(F.col("key_hit").isNotNull(), "exact").when(F.col("flat_hit").isNotNull(), "folded").when(F.col("sound_hit").isNotNull(), "phonetic")
    out = out.withColumns({"tier": tier, "canonical": F.coalesce("key_hit", "flat_hit", "sound_hit")}).drop("key_hit", "flat_hit", "sound_hit")
    score = F.when(F.col("tier") == "exact", 1.0).when(F.col("tier") == "folded", 0.97).when(F.col("tier") == "phonetic", 0.94)
    out = out.withColumn("score", score)
    if fuzzy:
        misses = out.where("tier is null and __k.key <> ''").select("__k.*").distinct()
        grams = lambda c: F.array_distinct(F.when(F.length(c) > 1, F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, 2))).otherwise(F.array(c)))
        left = misses.withColumn("gram", F.explode(F.array_union(grams(F.col("flat")), F.transform(grams(F.col("sound")), lambda x: F.concat(F.lit("~"), x)))))
        right = own.select("canonical", "ord", "numbered", *(F.col(c).alias(f"r_{c}") for c in ("key", "flat", "sound", "signature")))
        right = right.withColumn("gram", F.explode(F.array_union(grams(F.col("r_flat")), F.transform(grams(F.col("r_sound")), lambda x: F.concat(F.lit("~"), x)))))
        near = (F.abs(F.length("r_key") - F.length("key")) <= F.greatest(F.lit(3), F.floor(F.length("key") / 3))) & (~F.col("numbered") | (F.col("signature") == F.col("r_signature")))
        pairs = left.join(sized(right), "gram").where(near).drop("gram").distinct()
        value = F.greatest(ratio("flat", "r_flat"), F.when(~F.col("numbered"), ratio("sound", "r_sound")).otherwise(0.0))
        best = pairs.withColumn("s", value).groupBy("key").agg(F.max(F.struct("s", (-F.col("ord")).alias("o"), F.col("canonical").alias("c"))).alias("b"))
        out = out.join(best.withColumnRenamed("key", "__miss"), F.when(F.col("tier").isNull(), F.col("__k.key")) == F.col("__miss"), "left")
        ok = F.col("b.s") >= catalogues.ACCEPT
        out = out.withColumns({"canonical": F.coalesce("canonical", F.when(ok, F.col("b.c"))), "tier": F.coalesce("tier", F.when(ok, "fuzzy")), "score": F.coalesce("score", F.col("b.s"))}).drop("__miss", "b")
    return out.withColumns({"tier": F.coalesce("tier", F.lit("none")), "score": F.coalesce("score", F.lit(0.0))}).drop("__text", "__k")
