"""Spans and tags over arrays of words, as native expressions. Ends are inclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,type:string>"
PAIRS = "array<struct<start:int,end:int>>"
#: Tags that may follow each tag; a sequence begins with O, B or S and ends with O, E or S.
NEXT = {"O": "OBS", "B": "IE", "I": "IE", "E": "OBS", "S": "OBS"}


def let(*values_and_body) -> Column:
    """body(value, ...) with each value computed once. An expression used inside a lambda would be computed for every
    element, as projections are merged into it; a lambda's own variable never is."""
    *values, body = values_and_body

    def bind(bound: tuple, rest: list) -> Column:
        if not rest:
            return body(*bound)
        return F.get(F.transform(F.array(rest[0]), lambda v: bind((*bound, v), rest[1:])), F.lit(0))

    return bind((), values)


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once for each row. A generator of one row stands between them and what reads them:
    merged projections would compute them again in every expression, and Python functions take no nested lambdas."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def encode(spans: Column, n: Column) -> Column:
    """BIOES tags of n words. An empty sequence has none."""
    return let(spans, lambda s: _encode(s, n))


def _encode(spans: Column, n: Column) -> Column:
    def tag(i: Column) -> Column:
        inside = F.filter(spans, lambda s: (s["start"] <= i) & (i <= s["end"]))
        s = F.get(inside, F.lit(0))
        return F.when(s.isNull(), "O").when(s["start"] == s["end"], "S").when(i == s["start"], "B").when(i == s["end"], "E").otherwise("I")

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), tag)).otherwise(F.array().cast("array<string>"))


def decode(tags: Column) -> Column:
    """Spans of BIOES tags, tolerantly: I opens, B and S and O close what is open, E without a begin stands alone, and
    the end of the sequence closes."""
    span = lambda a, b: F.array(F.struct(a.cast("int").alias("start"), b.cast("int").alias("end")))
    none = F.array().cast(PAIRS)

    def step(acc: Column, x: Column) -> Column:
        i, t, begin = x["i"], x["t"], acc["begin"]
        is_open = begin >= 0
        closed = F.when(is_open & t.isin("O", "B", "S"), span(begin, i - 1)).otherwise(none)
        ended = F.when(t == "S", span(i, i)).when(t == "E", span(F.when(is_open, begin).otherwise(i), i)).otherwise(none)
        now = F.when(t == "B", i).when((t == "I") & ~is_open, i).when(t == "I", begin).otherwise(F.lit(-1))
        return F.struct(F.concat(acc["spans"], closed, ended).alias("spans"), now.cast("int").alias("begin"))

    numbered = F.transform(tags, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    start = F.struct(none.alias("spans"), F.lit(-1).alias("begin"))
    return F.aggregate(numbered, start, step, lambda a: F.concat(a["spans"], F.when(a["begin"] >= 0, span(a["begin"], F.size(tags) - 1)).otherwise(none)))


def illegal_steps(tags: Column) -> Column:
    """Number of illegal transitions, with the begin and an end that leaves a span open."""
    return let(tags, _illegal_steps)


def _illegal_steps(tags: Column) -> Column:
    allowed = F.create_map(*(F.lit(x) for k, v in NEXT.items() for x in (k, v)))
    pairs = F.filter(F.transform(tags, lambda t, i: F.struct(F.get(tags, i - 1).alias("a"), t.alias("b"))), lambda p: p["a"].isNotNull())
    wrong = F.size(F.filter(pairs, lambda p: ~F.contains(F.element_at(allowed, p["a"]), p["b"])))
    first, last = F.get(tags, F.lit(0)), F.try_element_at(tags, F.lit(-1))
    return wrong + F.when(first.isin("I", "E"), 1).otherwise(0) + F.when(last.isin("B", "I"), 1).otherwise(0)


def runs(labels: Column) -> Column:
    """Maximal runs of one label other than O, as (start, end, type)."""
    return let(labels, _runs)


def _runs(labels: Column) -> Column:
    before = lambda i: F.coalesce(F.get(labels, i - 1), F.lit("O"))
    after = lambda i: F.coalesce(F.get(labels, i + 1), F.lit("O"))
    at = F.transform(labels, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    starts = F.filter(at, lambda x: (x["t"] != "O") & (before(x["i"]) != x["t"]))
    ends = F.filter(at, lambda x: (x["t"] != "O") & (after(x["i"]) != x["t"]))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a["i"].cast("int").alias("start"), b["i"].cast("int").alias("end"), a["t"].alias("type")))


def bio_spans(tags: Column, strict: bool = True) -> Column:
    """Spans of B-TYPE and I-TYPE tags. Strict: null if an I does not go on with an open span of its type; else it extends
    whatever is open, or begins one."""
    return let(tags, lambda t: _bio_spans(t, strict))


def _bio_spans(tags: Column, strict: bool) -> Column:
    kind = lambda t: F.substring(t, 3, 1000)

    def goes_on(t: Column, before: Column) -> Column:
        """An I behind anything but O; strict: of the same type. A null tag is no O, and nothing goes on behind it."""
        return F.coalesce(t.startswith("I-") & (before != "O") & ((kind(t) == kind(before)) if strict else F.lit(True)), F.lit(False))

    # the places where nothing goes on, and the end: a span is from one to the next, without an accumulator copied at every step
    places = F.filter(F.sequence(F.lit(0), F.size(tags)), lambda i: ~goes_on(F.get(tags, i), F.get(tags, i - 1)))

    def found(places: Column) -> Column:
        one = lambda i, then: F.when(then.isNotNull() & F.coalesce(F.get(tags, i) != "O", F.lit(True)), F.struct(i.alias("start"), (then - 1).alias("end"), kind(F.get(tags, i)).alias("type")))
        spans = F.filter(F.zip_with(places, F.slice(places, F.lit(2), F.size(tags) + 1), one), lambda s: s.isNotNull())
        alone = F.exists(F.slice(places, F.lit(1), F.size(places) - 1), lambda i: F.get(tags, i).startswith("I-"))
        return F.when(~alone, spans) if strict else spans

    return F.when(tags.isNotNull(), let(places, found))


def text_of(words: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(words, start + 1, end - start + 1), " ")


def template_signature(words: Column, spans: Column) -> Column:
    """The words with <TYPE> for each span."""
    return let(spans, lambda s: _template_signature(words, s))


def _template_signature(words: Column, spans: Column) -> Column:
    def piece(w: Column, i: Column) -> Column:
        s = F.get(F.filter(spans, lambda s: (s["start"] <= i) & (i <= s["end"])), F.lit(0))
        return F.when(s.isNull(), w).when(i == s["start"], F.concat(F.lit("<"), s["type"], F.lit(">")))

    return F.trim(F.regexp_replace(F.array_join(F.filter(F.transform(words, piece), lambda x: x.isNotNull()), " "), r"\s+", " "))


def project(spans: Column, model: Column) -> Column:
    """Spans over raw tokens as spans over model words, each with raw_start and raw_end; conflict if a word is cut."""
    return let(model, lambda m: _project(spans, m))


def _project(spans: Column, model: Column) -> Column:
    def one(s: Column) -> Column:
        touched = F.filter(F.transform(model, lambda m, i: F.struct(i.alias("i"), m["raw_start"].alias("a"), m["raw_end"].alias("b"))), lambda m: (m["b"] >= s["start"]) & (m["a"] <= s["end"]))
        first, last = F.get(touched, F.lit(0)), F.try_element_at(touched, F.lit(-1))
        return F.struct(first["i"].cast("int").alias("start"), last["i"].cast("int").alias("end"), s["type"].alias("type"), ((first["a"] < s["start"]) | (last["b"] > s["end"])).alias("conflict"))

    return F.transform(spans, one)


def without_overlaps(spans: Column) -> Column:
    """In order of start, each span that begins behind the last one kept."""
    none = F.array().cast(f"array<{SPAN}>")

    def step(kept: Column, s: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        return F.when(last.isNull() | (s["start"] > last["end"]), F.concat(kept, F.array(F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["type"].alias("type"))))).otherwise(kept)

    return F.aggregate(F.array_sort(spans), none, step)


def peel_punctuation(tokens: Column) -> Column:
    """(word, label) of each token: marks at its end give the label (the leftmost that has one), marks at its edges go."""
    marks = F.create_map(*(F.lit(x) for x in (",", "COMMA", ";", "COMMA", ".", "PERIOD", "!", "PERIOD", "?", "QUESTION")))

    def one(t: Column) -> Column:
        tail = F.regexp_extract(t, r"([^\p{L}\p{N}]*)$", 1)
        mark = F.regexp_extract(tail, r"([,;.!?])", 1)
        return F.struct(F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "").alias("word"), F.when(mark == "", "O").otherwise(F.try_element_at(marks, mark)).alias("label"))

    return F.filter(F.transform(tokens, one), lambda x: x["word"] != "")
