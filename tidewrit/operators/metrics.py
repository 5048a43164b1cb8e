"""Metrics of spans, tags and texts as aggregations. Every ratio of nothing to nothing is 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.lexicon import CRITICAL, PUNCTUATION, TYPES
from . import spans as S


def rate(hit: Column, all_: Column) -> Column:
    return F.coalesce(F.try_divide(hit.cast("double"), all_.cast("double")), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p, r = rate(tp, tp + fp), rate(tp, tp + fn)
    return p, r, rate(2 * p * r, p + r)


def _scored(df: DataFrame) -> DataFrame:
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return df.withColumns({"precision": p, "recall": r, "f1": f})


def span_matches(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """Full join of distinct spans on keys, with tp, fp, fn as 0 or 1."""
    g, p = gold.select(*keys).distinct().withColumn("__g", F.lit(1)), pred.select(*keys).distinct().withColumn("__p", F.lit(1))
    both = g.join(p, keys, "full_outer")
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")
    return both.select(*keys, one(F.col("__g").isNotNull() & F.col("__p").isNotNull()).alias("tp"), one(F.col("__g").isNull()).alias("fp"), one(F.col("__p").isNull()).alias("fn"))


def boundary_f1(gold: DataFrame, pred: DataFrame, id_col: str = "id") -> DataFrame:
    """Micro precision, recall and F1 of (start, end)."""
    return _scored(span_matches(gold, pred, [id_col, "start", "end"]).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn"))))


def type_f1(gold: DataFrame, pred: DataFrame, id_col: str = "id") -> DataFrame:
    """One row a type and one (type null) over all, in one pass of grouping sets."""
    m = span_matches(gold, pred, [id_col, "start", "end", "type"])
    return _scored(m.groupingSets([["type"], []], "type").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))))


def transition_error_rate(tags: DataFrame, id_col: str = "id") -> DataFrame:
    """Of rows (id, pos, tag): illegal steps over all steps; a span that stays open adds one to both."""
    w = Window.partitionBy(id_col).orderBy("pos")
    df = tags.withColumns({"before": F.coalesce(F.lag("tag").over(w), F.lit("O")), "after": F.lead("tag").over(w)})
    bad = (F.col("before").isin("O", "S", "E") & F.col("tag").isin("I", "E")) | (F.col("before").isin("B", "I") & F.col("tag").isin("O", "B", "S"))
    still_open = F.col("after").isNull() & F.col("tag").isin("B", "I")
    return df.agg((F.count_if(bad) + F.count_if(still_open)).alias("bad"), (F.count("*") + F.count_if(still_open)).alias("steps")).withColumn("rate", rate(F.col("bad"), F.col("steps")))


def exact_accuracy(records: DataFrame) -> DataFrame:
    """Of (type, gold, pred): share of equal forms by type, and over all (type null)."""
    hit = F.col("pred").eqNullSafe(F.col("gold"))
    return records.rollup("type").agg(F.count_if(hit).alias("hit"), F.count("*").alias("n")).withColumn("accuracy", rate(F.col("hit"), F.col("n")))


def critical_accuracy(records: DataFrame) -> DataFrame:
    return records.where(F.col("type").isin(CRITICAL)).agg(F.count_if(F.col("pred").eqNullSafe(F.col("gold"))).alias("hit"), F.count("*").alias("n")).withColumn("accuracy", rate(F.col("hit"), F.col("n")))


def false_normalization_rate(records: DataFrame) -> DataFrame:
    """Of records whose gold type is O or that must stay: the share that was changed."""
    keep = (F.col("gold_type") == "O") | F.coalesce(F.col("must_keep"), F.lit(False))
    return records.where(keep).agg(F.count_if(~F.col("pred").eqNullSafe(F.col("raw"))).alias("changed"), F.count("*").alias("n")).withColumn("rate", rate(F.col("changed"), F.col("n")))


def critical_utterance_exact(records: DataFrame, id_col: str = "id") -> DataFrame:
    """Share of utterances all of whose critical records are exact; one without critical records counts as exact."""
    ok = F.bool_and(~F.col("type").isin(CRITICAL) | F.col("pred").eqNullSafe(F.col("gold")))
    return records.groupBy(id_col).agg(ok.alias("ok")).agg(F.count_if("ok").alias("hit"), F.count("*").alias("n")).withColumn("accuracy", rate(F.col("hit"), F.col("n")))


def checkpoint_score(critical: Column, type_f1_: Column, boundary: Column, punctuation: Column, utterance: Column) -> Column:
    return 0.4 * critical + 0.3 * type_f1_ + 0.1 * boundary + 0.1 * punctuation + 0.1 * utterance


def label_f1(pairs: DataFrame, none: str = "O") -> DataFrame:
    """Of (gold, pred) labels, a row a position: counts and F1 for each label but ``none``."""
    sides = pairs.select(F.explode(F.array(F.struct(F.col("gold").alias("label"), F.when(F.col("gold") == F.col("pred"), "tp").otherwise("fn").alias("k")), F.struct(F.col("pred").alias("label"), F.when(F.col("gold") == F.col("pred"), "both").otherwise("fp").alias("k")))).alias("x")).select("x.*")
    counts = sides.where(F.col("label") != none).groupBy("label").agg(*(F.count_if(F.col("k") == k).alias(k) for k in ("tp", "fp", "fn")))
    return _scored(counts)


def macro_f1(pairs: DataFrame, none: str = "O") -> DataFrame:
    return label_f1(pairs, none).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"), F.count("*").alias("labels"))


#: Fixed value: what is stripped from the ends of a text before it is compared.
EDGE = " \t.,;:!?\"'()[]"


def canon(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"\s+", " "), F.lit(EDGE))


def token_f1(gold: Column, pred: Column) -> Column:
    """F1 of the multisets of tokens; 0 if either is empty. Native and narrow: counts are taken over one side's tokens."""
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    f1 = lambda g, p: rate(2 * F.aggregate(F.array_distinct(g), F.lit(0), lambda a, x: a + F.least(count(g, x), count(p, x))), F.size(g) + F.size(p))
    empty = (canon(gold) == "") | (canon(pred) == "") | gold.isNull() | pred.isNull()
    return F.when(empty, 0.0).otherwise(S.let(F.split(canon(gold), " "), F.split(canon(pred), " "), f1))


def by_topic(rows: DataFrame) -> DataFrame:
    """Of (topic, gold, pred): count, exact, mean token F1, best first."""
    exact = F.when(canon(F.col("gold")) == canon(F.col("pred")), 1).otherwise(0)
    return rows.withColumns({"__e": exact, "__f": token_f1(F.col("gold"), F.col("pred"))}).groupBy("topic").agg(F.count("*").alias("n"), F.sum("__e").alias("exact"), F.avg("__f").alias("token_f1")).orderBy(F.desc("token_f1"), "topic")


def confusion(pairs: DataFrame, top: int | None = 20) -> DataFrame:
    """(gold, pred, n) of unequal types, most frequent first."""
    out = pairs.where(F.col("gold") != F.col("pred")).groupBy("gold", "pred").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gold", "pred")
    return out.limit(top) if top else out


def confusion_matrix(pairs: DataFrame, types: list[str] | tuple[str, ...] = TYPES) -> DataFrame:
    """A row for each type as gold, a column for each type as pred, and a column and a row ``total``: counts of (gold, pred).
    Types outside the list, and nulls, count as ``other``, which has a row and a column too. All four levels of totals come
    from one aggregation; types that do not occur have zeros."""
    names = [*types, "other"]
    known = lambda c: F.when(F.col(c).isin(list(types)), F.col(c)).otherwise("other")
    counted = pairs.select(known("gold").alias("gold"), known("pred").alias("pred")).cube("gold", "pred").agg(F.count("*").alias("n"))
    counted = counted.select(F.coalesce("gold", F.lit("total")).alias("gold"), F.coalesce("pred", F.lit("total")).alias("pred"), "n")
    wide = counted.groupBy("gold").pivot("pred", [*names, "total"]).agg(F.first("n"))
    rows = pairs.sparkSession.createDataFrame([(i, t) for i, t in enumerate([*names, "total"])], "type_no int, gold string")
    return rows.join(F.broadcast(wide), "gold", "left").fillna(0).select("gold", "type_no", *(F.col(f"`{c}`") for c in [*names, "total"]))


def per_type_report(gold: DataFrame, pred: DataFrame, id_col: str = "id", k: int = 3, min_support: int = 1) -> DataFrame:
    """A row for each of the 46 types: gold, hit, boundary_only, missed, spurious, precision, recall, f1, status, confusions."""
    g = gold.select(id_col, "start", "end", F.col("type").alias("gold_type")).distinct()
    p = pred.select(id_col, "start", "end", F.col("type").alias("pred_type")).distinct()
    m = g.join(p, [id_col, "start", "end"], "full_outer")
    own = m.where("gold_type is not null").groupBy(F.col("gold_type").alias("type")).agg(F.count("*").alias("gold"), F.count_if(F.col("gold_type") == F.col("pred_type")).alias("hit"), F.count_if(F.col("pred_type").isNotNull() & (F.col("gold_type") != F.col("pred_type"))).alias("boundary_only"), F.count_if(F.col("pred_type").isNull()).alias("missed"))
    other = m.where("pred_type is not null and (gold_type is null or gold_type <> pred_type)").groupBy(F.col("pred_type").alias("type")).agg(F.count("*").alias("spurious"))
    rank = Window.partitionBy("gold_type").orderBy(F.desc("n"), "pred_type")
    mixed = m.where("gold_type <> pred_type").groupBy("gold_type", "pred_type").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k)
    mixed = mixed.groupBy(F.col("gold_type").alias("type")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "pred_type", "n"))), lambda x: F.concat(x["pred_type"], F.lit(":"), x["n"].cast("string"))), ", ").alias("confusions"))
    types = gold.sparkSession.createDataFrame([(i, t) for i, t in enumerate(TYPES)], "type_no int, type string")
    out = types.join(own, "type", "left").join(other, "type", "left").join(mixed, "type", "left").fillna(0, ["gold", "hit", "boundary_only", "missed", "spurious"]).fillna("", ["confusions"])
    pr, rc, f1 = prf(F.col("hit"), F.col("spurious"), F.col("gold") - F.col("hit"))
    status = F.when(F.col("gold") < min_support, "no data").when(F.col("f1") >= 0.8, "good").when(F.col("f1") >= 0.5, "usable").otherwise("weak")
    return out.withColumns({"precision": pr, "recall": rc, "f1": f1}).withColumn("status", status)


def examples(gold: DataFrame, pred: DataFrame, texts: DataFrame, id_col: str = "id", k: int = 2) -> DataFrame:
    """(type, right, wrong): the first k spans of each gold type that were found and that were not, as text; wrong ones with what
    stands for them. texts: (id, words), or a row a word, (id, pos, word), where utterances are too long for arrays. Spans are
    ranked before they meet, so a type moves k rows a task, and what is chosen goes to the texts, never the texts to it."""
    g = gold.select(id_col, "start", "end", F.col("type").alias("gold_type")).distinct()
    m = g.join(pred.select(id_col, "start", "end", F.col("type").alias("pred_type")).distinct(), [id_col, "start", "end"], "left")
    m = m.withColumn("ok", F.coalesce(F.col("gold_type") == F.col("pred_type"), F.lit(False)))
    rank = Window.partitionBy("gold_type", "ok").orderBy(id_col, "start", "end", "pred_type")
    some = F.broadcast(m.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k))
    if "words" in texts.columns:
        some = texts.join(some, id_col).withColumn("said", S.text_of(F.col("words"), F.col("start"), F.col("end")))
    else:
        held = texts.select(id_col, "pos", "word").join(some, id_col).where(F.col("pos").between(F.col("start"), F.col("end")))
        words = F.transform(F.array_sort(F.collect_set(F.struct("pos", "word"))), lambda x: x["word"])
        some = held.groupBy("gold_type", "ok", "r", "pred_type").agg(F.array_join(words, " ").alias("said"))
    text = F.replace(F.col("said"), F.lit("_"), F.lit(" "))
    some = some.withColumn("text", F.when(F.col("ok"), text).otherwise(F.concat(text, F.lit(" -> "), F.coalesce("pred_type", F.lit("nothing")))))
    listed = lambda ok: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("ok") == ok, F.struct("r", "text")))), lambda x: x["text"]), "; ")
    return some.groupBy(F.col("gold_type").alias("type")).agg(listed(True).alias("right"), listed(False).alias("wrong"))


def with_causes(report: DataFrame, trained: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """per_type_report() with n_train, cause, action and, against an earlier report (type, f1), f1_before and change.
    trained: (type, n_train)."""
    out = report.join(trained, "type", "left").withColumn("n_train", F.coalesce("n_train", F.lit(0).cast("long")))
    cause = F.when(F.col("gold") == 0, "").when(F.col("n_train") < 20, "little to learn from").when(F.col("boundary_only") >= F.col("missed"), "types mixed up").otherwise("boundaries missed")
    mixed = F.col("boundary_only") > F.col("missed")
    action = (
        F.when(F.col("gold") == 0, "evaluate it first").when(F.col("f1") >= 0.8, "none").when(F.col("n_train") < 200, "add sentences")
        .when(mixed, F.concat(F.lit("add sentences that tell it from "), F.coalesce(F.nullif(F.substring_index("confusions", ":", 1), F.lit("")), F.lit("its like")))).otherwise("add longer sentences with more spans")
    )
    out = out.withColumns({"cause": cause, "action": action})
    if baseline is None:
        return out
    return out.join(baseline.select("type", F.col("f1").alias("f1_before")), "type", "left").withColumn("change", F.round(F.col("f1") - F.col("f1_before"), 3))


def run_summary(rows: DataFrame) -> DataFrame:
    """One row over utterances (gold, pred: arrays of spans; gold_punct, pred_punct; gold_text, pred_text, source_text): F1 of
    boundaries and of types, accuracy and macro F1 of punctuation without O, and the share of equal texts, against the gold
    text and, where there is one, against the source's (but for full stops at the end). Every figure is a sum over rows."""
    ends = lambda spans: F.array_distinct(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    whole = lambda spans: F.array_distinct(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"))))
    sums = {}
    for name, of in (("b", ends), ("t", whole)):
        sums |= {f"{name}_tp": F.size(F.array_intersect(of("gold"), of("pred"))), f"{name}_n": F.size(of("gold")) + F.size(of("pred"))}
    pairs = F.arrays_zip(F.col("gold_punct").alias("g"), F.col("pred_punct").alias("p"))
    sums |= {"p_ok": F.size(F.filter(pairs, lambda x: x["g"] == x["p"])), "p_n": F.size(pairs)}
    labels = list(PUNCTUATION)
    for x in labels:
        sums |= {f"{x}_tp": _count(pairs, x, x), f"{x}_g": _count(pairs, x, None), f"{x}_p": _count(pairs, None, x)}
    end = lambda c: F.regexp_replace(c, r"\.+$", "")
    has_source = F.coalesce(F.col("source_text") != "", F.lit(False))
    sums |= {"exact": (F.col("gold_text") == F.col("pred_text")).cast("int"), "source": has_source.cast("int"), "source_ok": (has_source & (end(F.col("pred_text")) == end(F.col("source_text")))).cast("int")}
    one = rows.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in sums.items()))
    f1s = F.array(*(F.when(F.col(f"{x}_g") + F.col(f"{x}_p") > 0, rate(2 * F.col(f"{x}_tp"), F.col(f"{x}_g") + F.col(f"{x}_p"))) for x in labels))
    macro = F.filter(f1s, lambda f: f.isNotNull())
    return one.select(
        "n", rate(2 * F.col("b_tp"), F.col("b_n")).alias("boundary_f1"), rate(2 * F.col("t_tp"), F.col("t_n")).alias("type_f1"), rate(F.col("p_ok"), F.col("p_n")).alias("punct_accuracy"),
        rate(F.aggregate(macro, F.lit(0.0), lambda a, x: a + x), F.size(macro)).alias("punct_macro_f1"), rate(F.col("exact"), F.col("n")).alias("utterance_exact"), rate(F.col("source_ok"), F.col("source")).alias("source_exact"), F.col("source").alias("n_source"),
    )


def _count(pairs: Column, gold: str | None, pred: str | None) -> Column:
    def fits(x: Column) -> Column:
        return (F.lit(True) if gold is None else x["g"] == gold) & (F.lit(True) if pred is None else x["p"] == pred)

    return F.size(F.filter(pairs, fits))


def run_by_type(rows: DataFrame) -> DataFrame:
    """(type, hit, n) of gold spans."""
    spans = rows.select(F.explode("gold").alias("s"), "pred")
    return spans.groupBy(F.col("s.type").alias("type")).agg(F.count_if(F.array_contains("pred", F.col("s"))).alias("hit"), F.count("*").alias("n"))


def best_threshold(records: DataFrame, low: float = 0.2, high: float = 0.95, min_support: int = 3, default: float = 0.6) -> DataFrame:
    """Of (type, confidence, ok): the threshold for each type that maximises right minus wrong among what it lets pass.

    Candidates are the rounded confidences within the bounds, and the bounds; ties go to the higher. A running sum from
    the top replaces the comparison of all candidates with all records.
    """
    rows = records.select("type", F.round("confidence", 4).alias("c"), F.when(F.col("ok"), 1).otherwise(-1).alias("v"))
    support = rows.groupBy("type").agg(F.count("*").alias("support"))
    gains = rows.groupBy("type", "c").agg(F.sum("v").alias("v"))
    bounds = support.select("type", F.explode(F.array(F.lit(low), F.lit(high))).alias("c"), F.lit(0).cast("long").alias("v"))
    both = gains.unionByName(bounds).groupBy("type", "c").agg(F.sum("v").alias("v"))
    w = Window.partitionBy("type").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)
    summed = both.withColumn("gain", F.sum("v").over(w)).where((F.col("c") >= low) & (F.col("c") <= high))
    best = summed.groupBy("type").agg(F.max(F.struct("gain", "c")).alias("b"))
    return best.join(support, "type").select("type", "support", F.when(F.col("support") < min_support, F.lit(default)).otherwise(F.col("b.c")).alias("threshold"), F.col("b.gain").alias("gain"))


class Overlap(ValueError):
    """Records that must not be tuned on."""


def guarded_thresholds(records: DataFrame, final_test: DataFrame, sentence: str = "spoken", **options) -> DataFrame:
    """best_threshold() of records, unless one of their sentences is in the final test: then Overlap is raised before any
    gain is computed. Sentences are compared without case, marks and repeated blanks, by hash; the hashes of the final test go to a Bloom
    filter by Spark itself where that pays, and the join is exact."""
    plain = F.trim(F.regexp_replace(F.lower(F.regexp_replace(sentence, r"\p{P}", " ")), r"\s+", " "))
    name = lambda df: df.select(F.sha2(plain.cast("binary"), 256).alias("print")).where("print is not null")
    both = name(records).join(name(final_test).distinct(), "print", "left_semi").agg(F.count("*").alias("n"), F.count_distinct("print").alias("sentences")).first()
    if both["n"]:
        raise Overlap(f"{both['n']} records of {both['sentences']} sentences are in the final test: thresholds chosen on them fit its answers")
    return best_threshold(records, **options)
