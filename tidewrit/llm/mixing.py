"""Mixing sources to target weights, with DataFrame functions only.

A source's share p is its part of all words. Its weight is p**a / sum(p**a): a = 1 keeps the natural shares, a = 0 makes
them equal. The entropy of the weights and the most repeated source both fall as a grows, so bisection finds the least a
in 0..64 whose entropy is at most the target and whose most repeated source is read at most ``max_repeats`` times. Each
job bisects 6 times at once: it evaluates 65 exponents over the table of sources, which is never collected. Where no
exponent meets the target, as with equal sources and a lower entropy, the natural shares are kept and ``met`` is false.

Weights become budgets of words. Each source's documents lie in blocks of about ``block_docs`` by the keyed hash of the
row. A budget pays for whole epochs and then for the blocks of one more epoch in keyed random order; of the block in
which it ends, documents follow in keyed order as long as they fit. The end is found from sums of words alone: first of
1,024 ranges of blocks, then of the blocks of one range, then of the documents of one block. So a source has one place
where its budget ends, every row can tell by itself on which side of it it lies, and no text is ever shuffled.

``budget`` is a number of words, or None for the least that reads every source at least once whole. Words are runs of
non-blank characters. Null sources are one source of their own. Documents without words cost nothing and stay once, in
epoch 0. Rows with one id and text are one unit: the part of an epoch takes all of them or none. An empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

STEPS, MOST_EXPONENT, RANGES = 64, 64.0, 1024


@dataclass
class Mixture:
    exponent: float
    met: bool
    budget: float
    sources: DataFrame  # src, words, docs, share, weight, epochs


def word_count(text_col: str):
    t = F.trim(F.regexp_replace(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.length(t) - F.length(F.translate(t, " ", "")) + 1).cast("long")


def source_key(source_col: str):
    """A source as text; null, which no text equals, is empty."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit(""))


def solve(shares: DataFrame, total: float, budget: float | None, target_entropy: float | None, max_repeats: float | None) -> float | None:
    """The exponent for shares (share > 0), to about 2**-24; None if there is none."""

    def fits(k_col_lo: float, hi: float):
        grid = shares.select("share", F.explode(F.sequence(F.lit(0), F.lit(STEPS))).alias("k")).withColumn("a", F.lit(k_col_lo) + F.col("k") * F.lit((hi - k_col_lo) / STEPS))
        power = F.exp(F.col("a") * F.ln("share"))
        sums = grid.groupBy("k").agg(F.first("a").alias("a"), F.sum(power).alias("s0"), F.sum(power * F.ln("share")).alias("s1"), F.max(power / F.col("share")).alias("most"), F.min(power / F.col("share")).alias("least"))
        entropy = F.ln("s0") - F.col("a") * F.col("s1") / F.col("s0")
        repeats = F.col("most") / F.col("least") if budget is None else F.col("most") / F.col("s0") * F.lit(budget / total)
        ok = F.lit(True)
        if target_entropy is not None:
            ok &= entropy <= target_entropy + 1e-12
        if max_repeats is not None:
            ok &= repeats <= max_repeats + 1e-9
        return [r["k"] for r in sums.where(ok).select("k").collect()]

    lo, hi = 0.0, 1.0
    while not (good := fits(lo, hi)):
        if hi == MOST_EXPONENT:
            return None
        lo, hi = hi, hi * 4
    for _ in range(4):
        k = min(good)
        if k == 0:
            return lo
        lo, hi = lo + (hi - lo) * (k - 1) / STEPS, lo + (hi - lo) * k / STEPS
        good = fits(lo, hi) or [STEPS]
    return hi


def mixture(rows: DataFrame, budget: float | None, target_entropy: float | None, entropy_share: float | None, max_repeats: float | None, keep=lambda df, name: df) -> Mixture:
    """The weights for rows with the columns __src and mix_words."""
    counted = rows.select(F.col("__src").alias("src"), F.col("mix_words").alias("words"))
    counted = keep(counted.groupBy("src").agg(F.sum("words").alias("words"), F.count("*").alias("docs")), "sources")
    used = counted.where("words > 0")
    total, n = used.agg(F.coalesce(F.sum("words"), F.lit(0)), F.count("*")).first()
    if not n:
        return Mixture(1.0, True, 0.0, counted.withColumns({"share": F.lit(0.0), "weight": F.lit(0.0), "epochs": F.lit(0.0)}))
    shares = used.withColumn("share", F.col("words") / F.lit(float(total)))
    if entropy_share is not None:
        from math import log

        target_entropy = entropy_share * log(n) if target_entropy is None else target_entropy
    found = solve(shares, float(total), budget, target_entropy, max_repeats)
    a = 1.0 if found is None else found
    weight = shares.withColumn("power", F.exp(F.lit(a) * F.ln("share")))
    s0, least = weight.agg(F.sum("power"), F.min(F.col("power") / F.col("share"))).first()
    words = float(budget) if budget is not None else float(total) * s0 / least
    weight = weight.withColumn("weight", F.col("power") / F.lit(s0)).withColumn("epochs", F.col("weight") * F.lit(words) / F.col("words")).drop("power")
    rest = counted.where("words = 0").withColumns({"share": F.lit(0.0), "weight": F.lit(0.0), "epochs": F.lit(0.0)})
    return Mixture(a, found is not None, words, weight.unionByName(rest))


def mix(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", budget: float | None = None, target_entropy: float | None = None, entropy_share: float | None = 0.98, max_repeats: float | None = 1.25, block_docs: int = 1000, seed: int = 2024, columns: list[str] | None = None, *, keep) -> DataFrame:
    """The columns (all, if None) of the rows of docs, each as often as the mixture reads it, with the added columns
    mix_words, mix_weight, mix_epoch and mix_block (they replace any of these names that docs has)."""
    plain = docs.drop("mix_words", "mix_weight", "mix_epoch", "mix_block")
    columns = columns or plain.columns
    row = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    # the wanted columns are one, so none of their names can clash; they are kept with the words only if they hold no text
    given = plain.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("given"), source_key(source_col).alias("__src"), word_count(text_col).alias("mix_words"), row.alias("__row"))
    narrow = keep(given.drop("given") if text_col in columns else given, "rows")
    rows = given if text_col in columns else narrow
    m = mixture(narrow, budget, target_entropy, entropy_share, max_repeats, keep)
    whole = F.floor(F.col("epochs") + 1e-9)
    sources = m.sources.select(F.col("src").alias("__src"), F.expr(f"greatest(1L, cast(ceil(docs / {block_docs}) as bigint))").alias("blocks"), F.col("weight").alias("mix_weight"), whole.alias("whole"), F.greatest(F.lit(0.0), (F.col("epochs") - whole) * F.col("words")).alias("left"))
    few = _few(m.sources)
    sources = keep(_ends(narrow, sources, seed, few), "ends")
    rows = rows.join(F.broadcast(sources) if few else sources, "__src").withColumn("mix_block", F.expr("pmod(__row, blocks)"))
    rows = rows.withColumn("order", _order(seed, "block", "mix_block")).withColumn("inner", _order(seed, "row", "__row"))
    at_end = (F.col("order") == F.col("end_order")) & (F.col("mix_block") == F.col("end_block"))
    before = (F.col("order") < F.col("end_order")) | ((F.col("order") == F.col("end_order")) & (F.col("mix_block") < F.col("end_block")))
    inside = at_end & ((F.col("inner") < F.col("end_inner")) | ((F.col("inner") == F.col("end_inner")) & (F.col("__row") <= F.col("end_row"))))
    times = F.when(F.col("mix_words") == 0, 1).otherwise(F.col("whole") + F.when(F.coalesce(before | inside, F.lit(False)), 1).otherwise(0)).cast("int")
    rows = rows.withColumn("mix_epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1))))
    return rows.select("given.*", "mix_words", "mix_weight", "mix_epoch", "mix_block")


def _order(seed: int, what: str, *columns: str):
    return F.xxhash64(F.lit(seed), F.lit(what), "__src", *columns)


def _ends(narrow: DataFrame, sources: DataFrame, seed: int, few: bool) -> DataFrame:
    """sources with the place at which the part of an epoch ends: the last paid block (end_order, end_block) is paid up to
    the document (end_inner, end_row)."""
    send = F.broadcast if few else lambda one_per_source: one_per_source
    rows = narrow.where("mix_words > 0").join(send(sources.where("left > 0").select("__src", "blocks", "left")), "__src").withColumn("block", F.expr("pmod(__row, blocks)")).withColumn("order", _order(seed, "block", "block"))
    rows = rows.withColumn("range", F.shiftright("order", 54) + RANGES // 2)

    def reached(df: DataFrame, by: list[str]) -> DataFrame:
        """Of each source, the first in order at which the sum of words exceeds what is left; before: the sum before it."""
        w = Window.partitionBy("__src").orderBy(*by)
        summed = df.withColumn("sum", F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        over = summed.where(F.col("sum") > F.col("left") + 1e-6).withColumn("n", F.row_number().over(w)).where("n = 1")
        return over.withColumn("left", F.col("left") - (F.col("sum") - F.col("words"))).drop("sum", "words", "n")

    first = reached(rows.groupBy("__src", "range", "left").agg(F.sum("mix_words").alias("words")), ["range"])
    inner = rows.drop("left").join(send(first), ["__src", "range"])
    second = reached(inner.groupBy("__src", "order", "block", "left").agg(F.sum("mix_words").alias("words")), ["order", "block"])
    inner = rows.drop("left", "range").join(send(second), ["__src", "order", "block"]).withColumn("inner", _order(seed, "row", "__row"))
    units = inner.groupBy("__src", "left", "inner", "__row").agg(F.sum("mix_words").alias("words"))
    w = Window.partitionBy("__src").orderBy("inner", "__row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    paid = units.withColumn("sum", F.sum("words").over(w)).where(F.col("sum") <= F.col("left") + 1e-6).groupBy("__src").agg(F.max(F.struct("inner", "__row")).alias("last"))
    ends = second.select("__src", F.col("order").alias("end_order"), F.col("block").alias("end_block")).join(paid, "__src", "left")
    return sources.drop("left").join(ends, "__src", "left").select("__src", "blocks", "mix_weight", "whole", "end_order", "end_block", F.col("last.inner").alias("end_inner"), F.col("last.__row").alias("end_row"))


def _few(sources: DataFrame, most: int = 50_000) -> bool:
    """Whether the table of sources is small enough to be sent to every task; it is joined by a shuffle otherwise."""
    return sources.limit(most + 1).count() <= most
