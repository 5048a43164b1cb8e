"""Corpus dataflow: gates with reasons, de-duplication, leakage-safe splits, balance, and set operations by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import forms
from ..functions import lexicon as L
from . import selection, spans as S, stored

#: Tokens that show that a made sentence holds parts of its prompt; names of types are among them.
JUNK = ("`", "-", "*", ">", "|", "ok", "wait", "note", "line", "sentence", "spoken", "output", "example", "câu", "```", *sorted({p for t in L.TYPES for p in (t.lower(), *t.lower().split("_"))}))
SPLITS = ["train", "random_dev", "entity_holdout_dev", "template_holdout_dev"]


def reason(*gates: tuple[str, Column]) -> Column:
    """The name of the first gate whose condition holds; null if the row passes all."""
    return F.coalesce(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in gates))


def parted(df: DataFrame, why: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and the others with their reason."""
    df = df.withColumn("reason", why)
    return df.where("reason is null").drop("reason"), df.where("reason is not null")


def coverage(df: DataFrame, types: str = "types") -> DataFrame:
    """(type, n) of every type that the rows carry."""
    return df.select(F.explode(types).alias("type")).groupBy("type").agg(F.count("*").alias("n"))


def reason_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def utterance_reason(words: str = "words", spans: str = "spans", punct: str = "punct") -> Column:
    """Whether an utterance is well-formed; no spans at all is."""
    w, s, p = F.col(words), F.col(spans), F.col(punct)
    return reason(
        ("words and punctuation differ in length", F.size(w) != F.size(p)),
        ("digit in words", F.exists(w, lambda x: x.rlike(r"\p{Nd}"))),
        ("unknown punctuation", F.exists(p, lambda x: ~x.isin("O", *L.PUNCTUATION))),
        ("unknown type", F.exists(s, lambda x: ~x["type"].isin(L.TYPES))),
        ("span out of range", F.exists(s, lambda x: (x["start"] < 0) | (x["start"] > x["end"]) | (x["end"] >= F.size(w)))),
        ("spans overlap", F.size(S.without_overlaps(s)) != F.size(s)),
    )


def generated_reason(words: str = "words", spans: str = "spans", junk: tuple[str, ...] = JUNK) -> Column:
    """Quality of a made utterance: length, context around spans, junk tokens, and foreign letters outside addresses."""
    return S.let(F.col(words), F.col(spans), lambda w, s: _generated_reason(w, s, junk))


def _generated_reason(w: Column, s: Column, junk: tuple[str, ...]) -> Column:
    inside = lambda i: F.exists(s, lambda x: (x["start"] <= i) & (i <= x["end"]))
    address = lambda i: F.exists(s, lambda x: (x["type"] == "ELECTRONIC") & (x["start"] <= i) & (i <= x["end"]))
    places = F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i")))
    return reason(
        ("too short", F.size(w) < 5),
        ("too little context", F.size(F.filter(places, lambda x: ~inside(x["i"]))) < 2),
        ("junk", F.exists(places, lambda x: ~address(x["i"]) & x["w"].isin(*junk))),
        ("foreign letters", F.exists(places, lambda x: ~address(x["i"]) & ~x["w"].rlike(f"^[a-z{forms.VIETNAMESE}]+$"))),
    )


def boundary_reason(words: str = "words", spans: str = "spans") -> Column:
    """A number word beside a span and in none means that the span was cut short."""
    return S.let(F.col(words), F.col(spans), _boundary_reason)


def _boundary_reason(w: Column, s: Column) -> Column:
    numbers = sorted(L.NUMBER_WORDS)
    free = lambda i: ~F.exists(s, lambda x: (x["start"] <= i) & (i <= x["end"]))
    beside = lambda i: F.coalesce(F.get(w, i).isin(numbers), F.lit(False)) & free(i)
    return reason(("number word beside a span", F.exists(s, lambda x: ((x["start"] > 0) & beside(x["start"] - 1)) | beside(x["end"] + 1))))


def lost_boundaries(words: Column) -> Column:
    """Number of capitalised sentence beginnings that follow a word without an end mark."""
    return S.let(words, _lost_boundaries)


#: Words that begin sentences, and marks behind which a capital is no lost beginning.
STARTERS = "Chưa Trong Ông Bà Câu Ít Sau Trước Khi Nhưng Và Với Từ Để Trên Dưới Nay Hôm Vì Do Nếu Tuy Mặc Theo Đây Đó Cả Một Hai Ba Những Các Người Nhiều Cũng Thế Sự Việc Ngày Năm Tháng Hiện Đến Tại Về Bởi Song Rồi".split()
END_MARKS = ",.?!:;"


def _lost_boundaries(words: Column) -> Column:
    at = F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1)))
    closed = lambda w: F.coalesce(w.rlike(f"[{END_MARKS}]$"), F.lit(False))
    return F.size(F.filter(at, lambda i: F.coalesce(F.get(words, i).isin(STARTERS), F.lit(False)) & ~closed(F.get(words, i - 1))))


#: Fixed value: words of the code of web pages.
WEB_CODE = r"(?U)\b(?:function|var|window|setTimeout|addClass|removeClass|url|href|isLoading|pagethree|newslist|p\.|\.js)\b"


def is_fragment(text: Column) -> Column:
    """Cut within a number or a sentence, or code of a web page."""
    return text.rlike(r"^[0-9]{3}\b") | text.rlike(r"^\p{Ll}") | (F.regexp_count(text, F.lit(WEB_CODE)) >= 2)


def digit_free(text: Column) -> Column:
    return ~text.rlike(r"\p{Nd}")


def spoken_ok(text: Column, min_words: int = 3) -> Column:
    """A spoken form without digits and long enough."""
    return F.coalesce(digit_free(text) & (F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) >= min_words), F.lit(False))


def same_value(a: Column, b: Column) -> Column:
    """Two ways to write one value: equal letters, and equal numbers but for leading zeros and groups of three."""
    groups = lambda t: F.regexp_extract_all(t, F.lit("([0-9]+)"), 1)
    letters = lambda t: F.regexp_replace(F.lower(t), r"[^\p{L}]", "")
    plain = lambda g: F.transform(g, lambda x: F.regexp_replace(x, "^0+(?=[0-9])", ""))

    def grouped(more: Column, less: Column) -> Column:
        whole = F.forall(F.slice(more, F.lit(2), F.greatest(F.size(more), F.lit(1))), lambda g: F.length(g) == 3) & (F.length(F.get(more, F.lit(0))) <= 3)
        return (F.size(less) == 1) & whole & (F.array_join(more, "") == F.get(less, F.lit(0)))

    def compared(x: Column, y: Column) -> Column:
        g, h = groups(x), groups(y)
        values = F.when(F.size(g) == F.size(h), plain(g) == plain(h)).when(F.size(g) > F.size(h), grouped(g, h)).otherwise(grouped(h, g))
        return (x == y) | ((F.size(g) > 0) & (letters(x) == letters(y)) & values)

    return S.let(forms.no_edges(a), forms.no_edges(b), compared)


#: Shapes of written forms and the types to try, in order; a year of four digits comes first.
CANDIDATES = [
    (r"^[12][0-9]{3}$", ["DATE", "CARDINAL", "DIGIT_SEQ"]), (r"^-?\d{1,3}(\.\d{3})+$", ["CARDINAL"]), (r"^\d+,\d+%$", ["PERCENT"]), (r"^\d+%$", ["PERCENT"]), (r"^-?\d+,\d+$", ["DECIMAL"]), (r"^\d+/\d+$", ["DATE", "FRACTION"]), (r"^\d+/\d+/\d+$", ["DATE"]),
    (r"^\d+:\d+$", ["TIME", "RATIO"]), (r"^\d+°.*$", ["COORD", "HEADING", "BEARING"]), (r"^\d+\.\d+(\.\d+)+$", ["VERSION"]), (r"^0\d{8,10}$", ["TELEPHONE", "DIGIT_SEQ"]), (r"^\d{9}$", ["MMSI_ID", "DIGIT_SEQ"]), (r"^0\d+$", ["DIGIT_SEQ"]),
    (r"^\d+\s*[A-Za-zµ°²³/%]+$", ["MEASURE", "SPEED", "DISTANCE", "DEPTH", "DRAFT", "FREQUENCY"]), (r"(?iu)^thứ \d+$", ["ORDINAL"]), (r"(?iu)^Quý [IVX]+$", ["QUARTER"]), (r"^[A-ZĐ][a-zA-Z]*-\d+.*$", ["EQUIPMENT_ID"]), (r"^[A-ZĐ]{2,}$", ["ACRONYM"]), (r"^\d+$", ["CARDINAL", "DIGIT_SEQ"]),
]
OTHER_CANDIDATES = ["CARDINAL", "DIGIT_SEQ", "MEASURE", "DATE", "ACRONYM"]


def candidate_types(written: Column) -> Column:
    out = None
    for shape, types in CANDIDATES:
        value = F.array(*map(F.lit, types))
        out = F.when(written.rlike(shape), value) if out is None else out.when(written.rlike(shape), value)
    return out.otherwise(F.array(*map(F.lit, OTHER_CANDIDATES)))


def label_spans(df: DataFrame, norm, written: str = "written", spoken: str = "spoken") -> DataFrame:
    """df with label: the first candidate type whose normalizer makes the written form from the spoken one, else null."""
    kinds = candidate_types(F.col(written))
    found = df.withColumns({"__k": kinds, "__f": norm.columns(kinds, F.transform(kinds, lambda _: F.col(spoken)))})
    hits = F.filter(F.arrays_zip("__k", "__f"), lambda x: x["__f"]["valid"] & (x["__f"]["resolved"] == x["__k"]) & (x["__f"]["normalized"] == F.col(written)))
    return found.withColumn("label", F.get(hits, F.lit(0))["__k"]).drop("__k", "__f")


def first_by_key(df: DataFrame, key: Column, order: list) -> DataFrame:
    """The first row of each key. The rank is limited before the shuffle, so a key of any size moves one row a task."""
    w = Window.partitionBy("__key").orderBy(*order)
    return df.withColumn("__key", key).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__key", "__n")


def hash_id(text: Column) -> Column:
    return F.substring(F.sha1(text.cast("binary")), 1, 16)


def without_heldout(df: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    return df.join(held_out.select(key).distinct(), key, "left_anti").select(df.columns)


def todo(df: DataFrame, cache: DataFrame, id_col: str = "id", payload: str = "payload") -> DataFrame:
    """Rows whose (id, fingerprint of the payload) is in no cached answer."""
    df = df.withColumn("fingerprint", F.sha2(F.col(payload).cast("binary"), 256))
    return df.join(cache.select(id_col, "fingerprint").distinct(), [id_col, "fingerprint"], "left_anti").select(*df.columns)


def leak_key(values: Column, text: Column) -> Column:
    """The sorted values of a sentence; one without values is its own group."""
    return F.when(F.size(values) > 0, F.array_join(F.array_sort(values), "|")).otherwise(F.concat(F.lit("#"), hash_id(text)))


def build_splits(df: DataFrame, entity: str = "leak_key", template: str = "signature", seed: int = 13, entity_share: float = 0.12, template_share: float = 0.12, dev_share: float = 0.12) -> DataFrame:
    """df with split: entity groups never cross train, random_dev and entity_holdout_dev, and templates of
    template_holdout_dev never occur in train.

    Each hold-out gets its share of the groups exactly (at least one, and never over half of them), the first in a seeded
    order: entity groups of all rows, templates of the rows left, entity groups of what is left then. Where the share ends
    is found by sums (operators.selection), so the groups of any number are counted and no row is moved; the splits are
    filters on the hash of a row's own groups. A null group is one group."""
    entity_key, template_key = selection.text_key(F.col(entity)), selection.text_key(F.col(template))
    inside: dict[str, Column] = {}
    rest = df
    for name, key, share, most in (
        (SPLITS[2], entity_key, entity_share, lambda n: n - max(1, n // 2)),
        (SPLITS[3], template_key, template_share, lambda n: n - max(1, n // 2)),
        (SPLITS[1], entity_key, dev_share, lambda n: n - 1),
    ):
        h = selection.seeded(f"{seed}|{name}", key)
        groups = stored.keep(rest.select(F.lit(name).alias("group"), key.alias("key")).distinct().withColumns({"h": selection.seeded(f"{seed}|{name}", F.col("key")), "w": F.lit(1)}), "groups")
        n = groups.count()
        place = selection.places(groups, {name: min(max(1, int(n * share)), max(0, most(n)))})[name]
        inside[name] = selection.up_to(place, h, key)
        rest = rest.where(~inside[name])
    split = F.lit(SPLITS[0])
    for name in (SPLITS[1], SPLITS[3], SPLITS[2]):
        split = F.when(inside[name], name).otherwise(split)
    return df.withColumn("split", split)


def leakage(df: DataFrame, entity: str = "leak_key", template: str = "signature") -> DataFrame:
    """(kind, key): entity groups in several of train, random and entity splits; templates of the hold-out in train."""
    groups = df.where(F.col("split") != SPLITS[3]).groupBy(F.col(entity).alias("key")).agg(F.count_distinct("split").alias("n")).where("n > 1").select(F.lit("entity").alias("kind"), "key")
    held = df.where(F.col("split") == SPLITS[3]).select(F.col(template).alias("key")).distinct()
    return groups.unionByName(held.join(df.where(F.col("split") == SPLITS[0]).select(F.col(template).alias("key")), "key", "left_semi").select(F.lit("template").alias("kind"), "key"))


def rebalance(base: DataFrame, delta: DataFrame, caps: dict[str, int], key: str = "id", types: str = "types", seed: int = 13) -> DataFrame:
    """base and those rows of delta that are not in it and carry at least one type below its cap, when they are taken one by
    one in seeded order and what is taken counts.

    A row with a type that is below its cap is always taken. So up to where a type reaches its cap every row that carries
    it is taken, whatever its other types are, and that place follows from the number of rows with the type alone: it is
    found for all types at once by sums (operators.selection), and the rows are filtered where they stand. Rows of one key
    are taken or left together; types that a row repeats count as often. Null and empty types are always taken."""
    counts = base.select(F.explode(types).alias("t")).groupBy("t").agg(F.count("*").alias("n")).where(F.col("t").isin(list(caps))).collect()  # at most one row a type
    have = {r["t"]: r["n"] for r in counts}
    delta = delta.join(base.select(key).distinct(), key, "left_anti").select(delta.columns)
    name = selection.text_key(F.col(key))
    marks = delta.select(F.explode(types).alias("group"), name.alias("key")).where(F.col("group").isin(list(caps)))
    marks = stored.keep(marks.groupBy("group", "key").agg(F.count("*").alias("w")).withColumn("h", selection.seeded(str(seed), F.col("key"))), "types")
    places = selection.places(marks, {t: n - have.get(t, 0) for t, n in caps.items()})
    h = selection.seeded(str(seed), name)
    below = {t: selection.up_to(p, h, name) for t, p in places.items()}
    open_ = F.exists(types, lambda t: reduce(Column.__or__, ((t == x) & ok for x, ok in below.items()), ~F.coalesce(t.isin(list(caps)), F.lit(False))))
    taken = F.coalesce(F.size(types), F.lit(0)) <= 0
    return base.unionByName(delta.where(taken | F.coalesce(open_, F.lit(False))).select(base.columns))


def batches(df: DataFrame, n: int, order: list) -> DataFrame:
    """df with batch: consecutive groups of n rows in order, by a distributed rank (range partitions, then offsets)."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(spark.sparkContext.defaultParallelism, *order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id())
    ranged = ranged.withColumn("__i", F.col("__m") - F.shiftleft(F.col("__p").cast("long"), 33))
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a partition
    return ranged.join(F.broadcast(sizes.drop("c")), "__p").withColumn("batch", F.expr(f"(before + __i) div {n}")).drop("__p", "__m", "__i", "before")
