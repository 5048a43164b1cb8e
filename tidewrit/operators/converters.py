"""Corpus converters: records of outside layouts to utterances, each with the first reason for which it is refused.

A converter is a narrow flow: every gate is a column, the order of the gates decides the reason, and refusing a span
refuses its sentence. All give the columns of SAMPLE; ``reason`` is null for utterances that are kept. corpus.parted()
or writers.split_sinks() divides them, corpus.reason_counts() counts reasons, corpus.first_by_key() keeps the first of
equal ids. Answers of a model are input tables (proposals), never calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import forms
from ..functions import lexicon as L
from . import corpus, diff, pipeline
from . import spans as S
from .normalize import Normalization

SAMPLE = ["id", "spoken", "written", "words", "punct", "spans", "types", "leak_key", "source", "written_source", "reason"]
SPANS = f"array<{S.SPAN}>"
PUNCT = ["O", *L.PUNCTUATION]

#: Labels of the old corpus with a type of their own, and those without one.
LABELS = {"NUM": "CARDINAL", "DATE": "DATE", "COORD": "COORD", "MEASURE": "MEASURE", "FOREIGN_NAME": "FOREIGN_NAME", "LEGAL_DOC": "LEGAL_DOC_ID", "DOC": "DOCUMENT_ID", "DATE_QUARTER": "QUARTER", "RANK": "RANK", "WEAPON_NAME": "EQUIPMENT_NAME", "EQUIP": "EQUIPMENT_ID"}
UNMAPPED = ["CASE", "TITLE", "UNIT"]
#: Zone names that a span may hold behind a time.
ZONE_TAILS = ["giờ địa phương", "giờ phối hợp quốc tế", "u tê xê", "u ti xi"]
#: Types whose written form has a digit, types that may differ in case alone, types whose case is their content.
WITH_DIGITS = ["CARDINAL", "ORDINAL", "DIGIT_SEQ", "DECIMAL", "FRACTION", "PERCENT", "RANGE", "RATIO", "MONEY", "MEASURE", "VERSION", "DATE", "TIME", "DURATION", "ETA", "ETD", "QUARTER", "COORD", "HEADING", "BEARING", "SPEED", "DISTANCE", "DEPTH", "DRAFT", "FREQUENCY", "CHANNEL", "MMSI_ID", "IMO_ID", "VESSEL_ID", "TELEPHONE", "VEHICLE_PLATE", "EQUIPMENT_ID", "LEGAL_DOC_ID", "DOCUMENT_ID"]
CASE_ONLY = ["PERSON_NAME", "LOCATION_NAME", "FOREIGN_NAME", "ORGANIZATION", "EQUIPMENT_NAME", "MARITIME_TERM", "RANK"]
CASE_BOUND = ["PERSON_NAME", "LOCATION_NAME", "FOREIGN_NAME", "EQUIPMENT_NAME", "MARITIME_TERM", "RANK", "ACRONYM"]
OUTSIDE = "ORGANIZATION"


# --- shared parts -----------------------------------------------------------------------------------------------------


def span(start: Column, end: Column, kind: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), kind.alias("type"))


def first_reason(spans: Column, of) -> Column:
    """The reason of the first span that has one."""
    return F.get(F.filter(F.transform(spans, of), lambda r: r.isNotNull()), F.lit(0))


def cut_short(words: Column, spans: Column, spare_spans: bool = True) -> Column:
    """A number word beside a span means that the span was cut short; with spare_spans unless it stands in another span."""

    def gate(words: Column, spans: Column) -> Column:
        def number(i: Column) -> Column:
            said = F.coalesce(F.get(words, i).isin(sorted(L.NUMBER_WORDS)), F.lit(False))
            return said & ~F.exists(spans, lambda o: (o["start"] <= i) & (i <= o["end"])) if spare_spans else said

        return first_reason(spans, lambda s: F.when((s["start"] > 0) & number(s["start"] - 1), F.concat(F.lit("cut on the left: "), s["type"])).when(number(s["end"] + 1), F.concat(F.lit("cut on the right: "), s["type"])))

    return S.let(words, spans, gate)


def unknown_type(spans: Column) -> Column:
    return first_reason(spans, lambda s: F.when(~s["type"].isin(L.TYPES), F.concat(F.lit("unknown type: "), s["type"])))


def has_digit(words: Column) -> Column:
    return F.array_join(words, " ").rlike(r"\p{Nd}")


def known_punct(punct: Column) -> Column:
    return F.transform(punct, lambda p: F.when(p.isin(PUNCT), p).otherwise("O"))


def types_of(spans: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["type"])))


def spoken_key(words: Column, spans: Column) -> Column:
    return S.let(words, lambda words: F.array_join(F.array_sort(F.transform(spans, lambda s: S.text_of(words, s["start"], s["end"]))), "|"))


def hashed(text: Column, n: int = 16) -> Column:
    return F.substring(F.sha1(text.cast("binary")), 1, n)


def not_emitted(outputs: Column, detail: bool = True) -> Column:
    def of(o: Column) -> Column:
        return F.when(~o["emitted"], F.concat(o["predicted_type"], F.lit(": "), F.coalesce(o["reason"], F.lit(""))) if detail else F.concat(F.lit("not normalized: "), o["predicted_type"]))

    return first_reason(outputs, of)


def _through_gold(spark: SparkSession, df: DataFrame, norm: Normalization | None, segment) -> DataFrame:
    """df with what the pipeline makes of its gold spans: written, outputs, skipped_reason. Rows that have a reason already are
    not read."""
    df = df.withColumn("__spans", F.col("spans")).withColumn("spans", F.when(F.col("early").isNull(), F.col("spans")))
    out = pipeline.write_gold(spark, df, norm, segment)
    return out.withColumn("spans", F.col("__spans")).drop("__spans", "span_texts")


def _sample(df: DataFrame, late: Column, **columns: Column) -> DataFrame:
    """The columns of SAMPLE: spoken, the id and the rest from columns; early, then late, then the checks of the schema."""
    df = df.withColumn("spoken", F.array_join("words", " "))
    schema = F.concat(F.lit("schema: "), corpus.utterance_reason())
    why = F.coalesce(F.col("early"), late, schema)
    base = {"id": hashed(F.col("spoken")), "types": types_of(F.col("spans")), "leak_key": F.array_join(F.array_sort(F.transform("outputs", lambda o: F.coalesce(o["normalized"], F.lit("")))), "|") if "outputs" in df.columns else F.lit(None)}
    return df.withColumns(base | columns).withColumn("reason", why).select(SAMPLE)


def _pipeline_reason(detail: bool = True) -> Column:
    return F.coalesce(F.when(F.col("early").isNull(), F.col("skipped_reason")), not_emitted(F.col("outputs"), detail))


# --- bundles -----------------------------------------------------------------------------------------------------------


def mark_letters(tokens: Column, marks: dict[str, str], first: bool = True) -> Column:
    """A text with a letter a token: w for words, another for each label of a mark. first: whether the first token may be one."""
    labels = list(dict.fromkeys(marks.values()))
    codes = F.create_map(*(F.lit(x) for k, v in marks.items() for x in (k, str(labels.index(v)))))
    code = lambda t: F.coalesce(F.try_element_at(codes, t), F.lit("w"))
    return F.array_join(F.transform(tokens, code if first else lambda t, i: F.when(i == 0, "w").otherwise(code(t))), "")


def labels_behind(letters: Column, marks: dict[str, str]) -> Column:
    """The label of each word of mark_letters(): that of the last of the marks behind it, in passes over the letters."""
    names = F.regexp_replace(F.regexp_replace(letters, "^[^w]+", ""), "w[^w]*([^w])", "$1")
    for letter, name in [("w", "O"), *((str(i), v) for i, v in enumerate(dict.fromkeys(marks.values())))]:
        names = F.replace(names, F.lit(letter), F.lit(name + " "))
    return F.when(F.contains(letters, F.lit("w")), F.split(F.rtrim(names), " ")).when(letters.isNotNull(), F.array().cast("array<string>"))


def stripped(tokens: Column, tags: Column) -> Column:
    """struct(words, punct, tags): tokens that are marks become the label of the word before them, the last of several; the
    leading ones go."""
    marks = {k: v for k, v in forms.MARKS.items() if k != ":"}
    pairs = F.arrays_zip(tokens.alias("t"), tags.alias("g"))

    def parts(words: Column) -> Column:
        lower = F.transform(words["t"], lambda t: F.lower(F.coalesce(t, F.lit(""))))
        return F.struct(lower.alias("words"), labels_behind(mark_letters(tokens, marks), marks).alias("punct"), F.transform(words["g"], lambda g: F.coalesce(g, F.lit("O"))).alias("tags"))

    return S.let(F.filter(pairs, lambda p: ~F.coalesce(p["t"].isin(list(marks)), F.lit(False))), parts)


def bundle_layout(df: DataFrame) -> DataFrame:
    """words, punct and spans (null where a record does not fit) of the three layouts of bundles: words with spans and labels;
    tokens as objects (their JSON, or their texts where a column objects tells that they are) with tags and
    punctuation_targets; tokens with marks among them, and tags."""
    tokens, tags = F.col("tokens"), F.col("bio_tags")
    final = (F.size("words") > 0) & F.col("punct").isNotNull() & F.col("spans").isNotNull() & tokens.isNull()
    fits = (F.size(tokens) > 0) & (F.size(tokens) == F.size(tags))
    told = "objects" in df.columns
    objects = F.col("objects") if told else F.get(tokens, F.lit(0)).startswith("{")
    own = F.transform("spans", lambda s: span(F.get(s, F.lit(0)), F.get(s, F.lit(1)), F.get(s, F.lit(2))))
    names = F.transform(tokens, lambda t: F.lower(F.coalesce(t if told else F.get_json_object(t, "$.text"), F.lit(""))))
    targets = F.when(F.size("punctuation_targets") == F.size(tokens), F.col("punctuation_targets")).otherwise(F.transform(tokens, lambda _: F.lit("O")))
    marked = stripped(tokens, tags)
    three = lambda w, p, s: F.struct(w.alias("words"), p.alias("punct"), s.cast(SPANS).alias("spans"))
    layout = (
        F.when(F.coalesce(final, F.lit(False)), F.when(F.size("words") == F.size("punct"), three(F.transform("words", F.lower), known_punct(F.col("punct")), own)))
        .when(F.coalesce(fits & objects, F.lit(False)), three(names, known_punct(targets), S.bio_spans(tags)))
        .when(F.coalesce(fits, F.lit(False)), S.let(marked, lambda m: three(m["words"], m["punct"], S.bio_spans(m["tags"]))))
    )
    return df.withColumn("__layout", layout).withColumns({k: F.col(f"__layout.{k}") for k in ("words", "punct", "spans")}).drop("__layout")


def with_zones_apart(words: Column, spans: Column) -> Column:
    """TIMEZONE spans that hold a time before the zone's name as a TIME span and a TIMEZONE span."""

    def apart(words: Column, spans: Column) -> Column:
        def one(s: Column) -> Column:
            text = S.text_of(words, s["start"], s["end"])
            out = F.when(s["type"] != "TIMEZONE", F.array(span(s["start"], s["end"], s["type"])))
            for tail in ZONE_TAILS:
                cut = s["end"] - len(tail.split())
                out = out.when(text.endswith(" " + tail), F.array(span(s["start"], cut, F.lit("TIME")), span(cut + 1, s["end"], F.lit("TIMEZONE"))))
            return out.otherwise(F.array(span(s["start"], s["end"], s["type"])))

        return F.flatten(F.transform(spans, one))

    return S.let(words, spans, apart)


def from_bundle(spark: SparkSession, records: DataFrame, norm: Normalization | None = None) -> DataFrame:
    """Bundles (sources.readers.read_any_bundle) by three gates: spans whole, every span normalized, the text rebuilt exactly.
    Sentences without spans are kept as negatives."""
    target = F.trim(F.coalesce(F.when(F.col("normalized_text") != "", F.col("normalized_text")), F.col("target"), F.lit("")))
    df = bundle_layout(records.withColumnRenamed("written", "target")).withColumn("written_source", target)
    df = df.withColumn("spans", with_zones_apart(F.col("words"), F.col("spans")))
    early = F.coalesce(
        F.when(F.col("words").isNull() | F.col("spans").isNull() | (F.col("written_source") == ""), "lengths differ or no target"), F.when(F.size("words") == 0, "nothing but marks"),
        F.when(has_digit(F.col("words")), "digit in words"), unknown_type(F.col("spans")), cut_short(F.col("words"), F.col("spans")),
    )
    df = _through_gold(spark, df.withColumn("early", early), norm, None)
    kind = F.coalesce(F.get(F.col("spans"), F.lit(0))["type"], F.lit("no span"))
    rebuilt = F.when(~F.col("written").eqNullSafe(forms.with_sentence_case(forms.aligned_target(F.col("written_source")))), F.concat(F.lit("rebuilt otherwise: "), kind))
    source = F.concat(F.substring_index(F.coalesce(F.when(F.col("source_type") != "", F.col("source_type")), F.lit("bundle")), "_", 1), F.lit(":"), F.coalesce(F.when(F.col("priority_group") != "", F.col("priority_group")), F.col("focus_family"), F.lit("")))
    name = F.concat(F.lit("bd"), hashed(F.array_join("words", " "), 14))
    return _sample(df, F.coalesce(_pipeline_reason(detail=False), rebuilt), id=name, source=source, types=F.transform("spans", lambda s: s["type"]))


def from_split_bundle(records: DataFrame) -> DataFrame:
    """BIO bundles with a declared split (sources.readers.read_bundle), read leniently; spans move with the words as marks
    go. The split is part of the source."""
    all_marks = "".join(str(i) for i in range(len(set(forms.MARKS.values()))))

    def moved(letters: Column, tags: Column) -> Column:
        """Each end by the words before it; null on a mark."""
        at = lambda i: F.when(F.substr(letters, i + 1, F.lit(1)) == "w", F.length(F.translate(F.substr(letters, F.lit(1), i), all_marks, "")))
        return F.transform(S.bio_spans(tags, strict=False), lambda s: span(at(s["start"]), at(s["end"]), s["type"]))

    # a first mark has no word before it and stays one
    df = S.settled(records.withColumnRenamed("id", "record"), __letters=mark_letters(F.col("tokens"), forms.MARKS, first=False))
    words = F.filter(F.col("tokens"), lambda t, i: (i == 0) | ~F.coalesce(t.isin(list(forms.MARKS)), F.lit(False)))
    df = df.withColumns({"words": F.transform(words, lambda t: F.lower(F.coalesce(t, F.lit("")))), "punct": labels_behind(F.col("__letters"), forms.MARKS)})
    df = df.withColumn("spans", F.array_sort(S.let(F.col("__letters"), F.col("bio_tags"), moved))).drop("__letters")
    bad = first_reason(F.col("spans"), lambda s: F.when(~s["type"].isin(L.TYPES), F.concat(F.lit("unknown type: "), s["type"])).when(s["start"].isNull() | s["end"].isNull(), "span over a mark"))
    early = F.coalesce(F.when(~(F.size("tokens") == F.size("bio_tags")) | F.col("tokens").isNull() | F.col("bio_tags").isNull(), "lengths differ"), bad)
    df = df.withColumns({"early": early, "written": F.col("normalized_text"), "written_source": F.col("normalized_text")})
    name = hashed(F.concat(F.col("record"), F.array_join("words", " ")))
    return _sample(df, F.lit(None).cast("string"), id=name, source=F.concat(F.lit("military_v2:"), F.col("split")), leak_key=spoken_key(F.col("words"), F.col("spans")))


def from_flat_corpus(records: DataFrame, norm: Normalization) -> DataFrame:
    """The old corpus of flat labels (tokens, itn_tags, punc_tags). Its spans are checked one after the other: label, number
    words beside it, grammar, and whether anything changes."""
    tags, words = F.col("itn_tags"), F.transform("tokens", F.lower)
    table = F.create_map(*(F.lit(x) for k, v in LABELS.items() for x in (k, v)))
    present = F.array_distinct(F.filter(tags, lambda t: t != "O"))
    df = records.withColumns({"words": words, "__runs": S.runs(tags), "punct": known_punct(F.col("punc_tags"))})
    df = df.withColumn("spans", F.transform("__runs", lambda s: span(s["start"], s["end"], F.try_element_at(table, s["type"]))))
    kinds, texts = F.transform("spans", lambda s: F.coalesce(s["type"], F.lit(""))), S.let(F.col("words"), lambda w: F.transform("spans", lambda s: S.text_of(w, s["start"], s["end"])))
    df = S.settled(df, __kinds=kinds, __texts=texts).withColumn("__parsed", norm.parsed(F.col("__kinds"), F.col("__texts"))).drop("__kinds")

    def gate(words: Column, spans: Column, labels: Column, texts: Column, parsed: Column) -> Column:
        number = lambda i: F.coalesce(F.get(words, i).isin(sorted(L.NUMBER_WORDS)), F.lit(False))

        def of(s: Column, i: Column) -> Column:
            named = lambda what: F.concat(F.lit(what), s["type"])
            return (
                F.when(s["type"].isNull(), F.concat(F.lit("label without a type: "), F.get(labels, i)["type"])).when((s["start"] > 0) & number(s["start"] - 1), named("cut on the left: ")).when(number(s["end"] + 1), named("cut on the right: "))
                .when(~F.get(parsed, i)["valid"], named("not normalized: ")).when(F.get(parsed, i)["normalized"] == F.get(texts, i), named("nothing changes: "))
            )

        return first_reason(spans, of)

    n = F.size("tokens")
    early = F.coalesce(
        F.when(F.coalesce((n == 0) | (n != F.size(tags)) | (n != F.size("punc_tags")), F.lit(True)), "lengths differ"), F.when(F.arrays_overlap(present, F.array(*map(F.lit, UNMAPPED))), "label without a type"),
        F.when(F.size(present) == 0, "no span"), F.when(has_digit(words), "digit in words"), S.let(F.col("words"), F.col("spans"), F.col("__runs"), F.col("__texts"), F.col("__parsed"), gate),
    )
    df = df.withColumns({"early": early, "written": F.lit(""), "written_source": F.lit("")})
    name = F.concat(F.lit("v1c"), hashed(F.array_join("words", " "), 13))
    return _sample(df, F.lit(None).cast("string"), id=name, source=F.lit("v1corpus"), leak_key=spoken_key(F.col("words"), F.col("spans")))


# --- pairs of written and spoken texts -----------------------------------------------------------------------------------


def from_variants(spark: SparkSession, variants: DataFrame, norm: Normalization, segment=None) -> DataFrame:
    """(text, variant, topic): spans are the stretches that differ and whose written form the grammar of a type that fits its
    shape makes from the spoken one."""
    a, b = forms.tokens(F.col("text")), forms.tokens(F.col("variant"))
    df = S.settled(variants, __ta=a, __tb=b)
    df = S.settled(df, __a=F.col("__ta.words"), __b=F.col("__tb.words"), punct=F.col("__tb.punct")).drop("__ta", "__tb")
    df = df.withColumn("__ops", diff.word_opcodes("__a", "__b"))
    df = S.settled(df, __r=diff.changed_regions(F.col("__a"), F.col("__b"), F.col("__ops"))).drop("__ops")
    df = S.settled(df, __r=F.col("__r"), __t=F.transform("__r", lambda r: forms.no_edges(r["written"])))
    tries = F.flatten(S.let(F.col("__t"), lambda t: F.transform("__r", lambda r, i: F.transform(F.when(F.get(t, i) == "", F.array().cast("array<string>")).otherwise(corpus.candidate_types(F.get(t, i))), lambda k: F.struct(i.alias("i"), k.alias("kind"), r["spoken"].alias("spoken"))))))
    df = S.settled(df, __tries=tries)
    df = df.withColumn("__out", norm.columns(F.transform("__tries", lambda x: x["kind"]), F.transform("__tries", lambda x: F.lower(x["spoken"]))))

    def labelled(targets: Column, tries: Column, out: Column) -> Column:
        hit = F.filter(F.zip_with(tries, out, lambda x, o: F.struct(x["i"].alias("i"), x["kind"].alias("kind"), (o["valid"] & (o["resolved"] == x["kind"]) & (o["normalized"] == F.get(targets, x["i"]))).alias("ok"))), lambda x: x["ok"])
        found = F.transform("__r", lambda r, i: span(r["start"], r["end"], F.get(F.filter(hit, lambda h: h["i"] == i), F.lit(0))["kind"]))
        return F.filter(found, lambda s: s["type"].isNotNull())

    df = df.withColumns({"spans": S.let(F.col("__t"), F.col("__tries"), F.col("__out"), labelled), "words": F.transform("__b", F.lower)})
    early = F.coalesce(F.when((F.size("__a") == 0) | (F.size("__b") == 0), "empty"), F.when(F.size("spans") == 0, "no label is confirmed"))
    df = _through_gold(spark, df.withColumn("early", early), norm, segment)
    return _sample(df, _pipeline_reason(), source=F.concat(F.lit("data_v1:"), F.coalesce("topic", F.lit("?"))), written_source=forms.squeeze(F.col("text")))


def variant_of(written: Column, variants: Column) -> Column:
    """struct(spoken, kind): the one spoken form of a chunk. Of several the least garbled, then the shortest."""
    used = F.filter(F.transform(variants, lambda v: forms.without_spurious_zero(forms.squeeze(v))), lambda v: (v != "") & (v != written))
    kind = F.when(F.size(used) == 0, "không_biến_thể").when(F.size(used) == 1, "một_biến_thể").otherwise("chọn_từ_nhiều")
    return F.struct(F.lower(F.when(F.size(used) == 0, written).otherwise(diff.pick_variant(written, used))).alias("spoken"), kind.alias("kind"))


def pairs_of(chunks: DataFrame, min_words: int = 6, max_words: int = 60, max_garbage: int = 0) -> DataFrame:
    """(text, issues, variants, topic) of articles as pairs id, written, spoken, topic, kind, reason: seven gates in order, then
    the first of equal written forms. Give an order by the columns file and chunk_no."""
    df = S.settled(chunks, written=forms.squeeze(F.coalesce("text", F.lit(""))))
    df = df.withColumn("__v", variant_of(F.col("written"), F.coalesce("variants", F.array().cast("array<string>"))))
    df = df.withColumns({"spoken": F.col("__v.spoken"), "kind": F.col("__v.kind"), "__g": diff.garbage_score(F.col("written"), F.col("__v.spoken"))})
    n = F.size(F.filter(F.split("written", " "), lambda w: w != ""))
    why = corpus.reason(
        ("length", ~n.between(min_words, max_words)), ("several sentences in one", F.array_contains(F.coalesce("issues", F.array().cast("array<string>")), "over_max_words_sentence_kept")),
        ("lost sentence boundary", corpus.lost_boundaries(F.split("written", " ")) > 0), ("fragment", corpus.is_fragment(F.col("written"))),
        ("digit in the spoken form", F.col("spoken").rlike(r"\p{Nd}")), ("spelled word", F.col("__g") > max_garbage),
    )
    df = df.withColumns({"reason": why, "__key": F.sha1(F.col("written").cast("binary"))})
    order = [c for c in ("file", "chunk_no") if c in chunks.columns]
    first = df.where("reason is null").groupBy("__key").agg(F.min(F.struct(*order)).alias("__first"))
    df = df.join(first, "__key", "left").withColumn("reason", F.coalesce("reason", F.when(F.struct(*order) != F.col("__first"), "repeated")))
    return df.select(F.substring("__key", 1, 16).alias("id"), "written", "spoken", "topic", "kind", "reason")


# --- proposals of a model ------------------------------------------------------------------------------------------------


def is_verified(kind: Column, out: Column, target: Column, values: bool = False) -> Column:
    """Whether a type is known and its own grammar and validator make the target (values: or the same value)."""
    same = corpus.same_value(out["normalized"], target) if values else out["normalized"] == target
    return F.coalesce(kind.isin(L.TYPES) & out["valid"] & (out["resolved"] == kind) & same, F.lit(False))


def spans_in_text(text: Column, proposals: Column) -> Column:
    """struct(words, punct, spans) of a written text in which each proposed written form stands for its spoken one. proposals:
    (begin, end, spoken, type, no), in the order of the text, ends exclusive; spans carry no."""
    none = F.array().cast("array<string>")
    spans = F.array().cast("array<struct<start:int,end:int,type:string,no:int>>")
    names = F.create_map(*(F.lit(x) for k, v in forms.MARKS.items() for x in (k, v)))

    def joined(acc: Column, t: Column) -> Column:
        """Plain text behind what is there: a mark that stands alone at its begin labels the last word."""
        lead = F.try_element_at(names, F.regexp_extract(F.trim(t), r"^([,.?!;:])", 1))
        n = F.size(acc["punct"])
        free = (n > 0) & lead.isNotNull() & F.trim(t).rlike(r"^[,.?!;:\"'()\[\]{}…]+(\s|$)")
        punct = F.when(free, F.concat(F.slice(acc["punct"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(lead))).otherwise(acc["punct"])
        more = forms.tokens(t, lower=True)
        return F.struct(F.concat(acc["words"], more["words"]).alias("words"), F.concat(punct, more["punct"]).alias("punct"), acc["spans"].alias("spans"), acc["at"].alias("at"))

    def step(acc: Column, p: Column) -> Column:
        plain = joined(acc, F.substr(text, acc["at"] + 1, p["begin"] - acc["at"]))
        said = F.filter(F.split(F.lower(p["spoken"]), r"\s+"), lambda w: w != "")
        n, m = F.size(plain["words"]), F.size(said)
        tail = F.coalesce(F.try_element_at(names, F.substr(text, p["end"] + 1, F.lit(1))), F.lit("O"))
        punct = F.concat(plain["punct"], F.array_repeat(F.lit("O"), m - 1), F.array(tail))
        new = F.array(F.struct(n.cast("int").alias("start"), (n + m - 1).cast("int").alias("end"), p["type"].alias("type"), p["no"].alias("no")))
        return F.struct(F.concat(plain["words"], said).alias("words"), punct.alias("punct"), F.concat(plain["spans"], new).alias("spans"), p["end"].alias("at"))

    start = F.struct(none.alias("words"), none.alias("punct"), spans.alias("spans"), F.lit(0).alias("at"))
    return F.aggregate(proposals, start, step, lambda acc: joined(acc, F.substr(text, acc["at"] + 1)))


def from_proposals(spark: SparkSession, chunks: DataFrame, norm: Normalization, segment=None) -> DataFrame:
    """(text, topic, proposals of (written, spoken, type)): proposed spans are placed in the written text; those whose spoken
    form does not make the written one are not kept."""
    clean = F.transform("proposals", lambda p, i: F.struct(F.trim(F.coalesce(p["written"], F.lit(""))).alias("written"), F.trim(F.coalesce(p["spoken"], F.lit(""))).alias("spoken"), F.upper(F.trim(F.coalesce(p["type"], F.lit("")))).alias("type"), i.cast("int").alias("no")))
    df = S.settled(chunks, text=forms.squeeze(F.col("text")), __p=F.filter(clean, lambda p: p["type"].isin(L.TYPES) & (p["written"] != "") & (p["spoken"] != "")))
    df = df.withColumn("__at", diff.placed_in_text(F.col("text"), F.transform("__p", lambda p: p["written"])))
    placed = F.zip_with(F.col("__p"), F.col("__at"), lambda p, a: F.when(a.isNotNull(), F.struct(a["begin"].alias("begin"), a["end"].alias("end"), p["spoken"].alias("spoken"), p["type"].alias("type"), p["no"].alias("no"), p["written"].alias("written"))))
    df = S.settled(df, __placed=F.array_sort(F.filter(placed, lambda p: p.isNotNull())))
    df = S.settled(df, __s=spans_in_text(F.col("text"), F.col("__placed")))
    df = S.settled(df, words=F.col("__s.words"), punct=F.col("__s.punct"), __spans=F.col("__s.spans")).drop("__s")
    texts = S.let(F.col("words"), lambda w: F.transform("__spans", lambda s: S.text_of(w, s["start"], s["end"])))
    df = S.settled(df, __texts=texts)
    df = df.withColumn("__out", norm.columns(F.transform("__spans", lambda s: s["type"]), F.col("__texts")))

    def verified(spans: Column, out: Column, placed: Column) -> Column:
        kept = F.transform(spans, lambda s, i: F.when(is_verified(s["type"], F.get(out, i), forms.no_edges(F.get(placed, i)["written"])), span(s["start"], s["end"], s["type"])))
        return F.filter(kept, lambda s: s.isNotNull())

    df = df.withColumn("spans", S.let(F.col("__spans"), F.col("__out"), F.col("__placed"), verified))
    early = F.coalesce(
        F.when(F.size("__p") == 0, "no span of a known type"), F.when(F.size("__spans") == 0, "no span stands in the text"), F.when(has_digit(F.col("words")), "digit in words"), F.when(F.size("spans") == 0, "no span is confirmed"),
    )
    df = _through_gold(spark, df.withColumn("early", early), norm, segment)
    return _sample(df, _pipeline_reason(), source=F.concat(F.lit("gemini:"), F.coalesce("topic", F.lit("?"))), written_source=F.col("text"))


def from_markup(spark: SparkSession, lines: DataFrame, norm: Normalization | None = None, segment=None, source: str = "seed") -> DataFrame:
    """(words, spans, punct) of marked-up lines (sources.readers.parse_markup): kept if every span is emitted."""
    early = F.when(F.col("words").isNull() | (F.size("words") == 0) | (F.size("spans") == 0), "no marked span")
    df = _through_gold(spark, lines.withColumn("early", early), norm, segment)
    return _sample(df, _pipeline_reason(), source=F.lit(source), written_source=F.lit(None).cast("string"))


def from_typed_regions(spark: SparkSession, pairs: DataFrame, types: DataFrame, norm: Normalization, segment=None, keep_refused: bool = False) -> DataFrame:
    """Pairs (id, written, spoken, topic) with a table of answers (written, spoken, type): each candidate region takes the type
    that was answered for it. A region that differs in words and has no confirmed type refuses its sentence; regions of
    organisations and those that differ in case alone are left out."""
    df = S.settled(pairs, __w=F.filter(F.split("written", r"\s+"), lambda w: w != ""), __s=F.filter(F.split("spoken", r"\s+"), lambda w: w != ""), __t=forms.tokens(F.col("spoken"), lower=True))
    df = df.withColumn("__ops", diff.word_opcodes("__w", "__s"))
    df = S.settled(df, __r=diff.candidate_regions(F.col("__w"), F.col("__s"), F.col("__ops")), words=F.col("__t.words"), punct=F.col("__t.punct")).drop("__ops")
    known = types.select(F.col("written").alias("__kw"), F.col("spoken").alias("__ks"), F.upper(F.trim("type")).alias("kind")).dropDuplicates(["__kw", "__ks"])
    # a row a region for the answers only, which carries its sentence: regions are found once, and all of a sentence's are read in one call
    df = df.drop("__w", "__s", "__t").withColumn("__row", F.monotonically_increasing_id())
    rows = df.select("*", F.posexplode_outer("__r").alias("__no", "__x")).withColumns({"__kw": forms.no_edges(F.col("__x.written")), "__ks": F.lower(F.trim("__x.spoken"))}).drop("__x")
    rows = rows.join(known, ["__kw", "__ks"], "left")
    carried = [c for c in df.columns if c != "__row"]
    answers = F.collect_list(F.when(F.col("__no").isNotNull(), F.struct("__no", F.coalesce("kind", F.lit("NONE")).alias("kind"))))
    df = rows.groupBy("__row").agg(F.array_sort(answers).alias("__kinds"), F.first(F.struct(*carried)).alias("__own")).select("__own.*", F.transform("__kinds", lambda x: x["kind"]).alias("__kinds"))
    df = S.settled(df, __texts=S.let(F.col("words"), lambda w: F.transform("__r", lambda r: S.text_of(w, r["start"], r["end"]))))
    df = df.withColumn("__out", norm.columns(F.col("__kinds"), F.col("__texts")))

    def answered(r: Column, kind: Column, out: Column, n: Column, no: Column) -> Column:
        differ = F.lower(forms.squeeze(r["written"])) != F.lower(forms.squeeze(r["spoken"]))
        bad = (
            F.when(kind == OUTSIDE, None).when(kind.isin("NONE", ""), F.when(differ, "NONE")).when(~kind.isin(L.TYPES), F.concat(F.lit("unknown type "), kind))
            .when(r["end"] >= n, "index").when(~is_verified(kind, out, r["written"], values=True), F.concat(F.lit("not confirmed "), kind))
        )
        return S.let(bad, lambda bad: F.struct(F.when(bad.isNull() & kind.isin(L.TYPES), span(r["start"], r["end"], kind)).alias("span"), F.when(bad.isNotNull(), F.struct(no.alias("no"), r["written"].alias("written"), r["spoken"].alias("spoken"), bad.alias("why"))).alias("refused")))

    found = S.let(F.col("__kinds"), F.col("__out"), F.size("words"), lambda kinds, out, n: F.transform("__r", lambda r, i: answered(r, F.get(kinds, i), F.get(out, i), n, i)))
    df = S.settled(df, __found=found).drop("__r", "__kinds", "__texts", "__out").withColumnRenamed("written", "written_source")
    part = lambda name: F.filter(F.transform("__found", lambda x: x[name]), lambda x: x.isNotNull())
    df = df.withColumns({"spans": S.without_overlaps(F.coalesce(F.array_sort(part("span")), F.array().cast(SPANS))), "refused": part("refused")}).drop("__found")
    early = F.when(F.lit(not keep_refused) & (F.size("refused") > 0), F.concat(F.lit("region without a type: "), F.get("refused", F.lit(0))["why"]))
    df = _through_gold(spark, df.withColumn("early", early).drop("spoken", "id"), norm, segment)
    return _sample(df, _pipeline_reason(), source=F.concat(F.lit("v1pair:"), F.coalesce("topic", F.lit("?"))))


def sane(noi: Column, viet: Column, kind: Column) -> Column:
    """Why a proposed span is wrong for its type, or null."""
    case_only = forms.folded(noi) == forms.folded(viet)
    upper = viet.rlike(r"\p{Lu}")
    return (
        F.when(forms.squeeze(noi) == forms.squeeze(viet), "both forms are the same").when(kind.isin(WITH_DIGITS) & ~viet.rlike(r"\p{Nd}"), "no digit in the written form")
        .when(case_only & ~kind.isin(CASE_ONLY), "differs in case alone").when((kind == "ACRONYM") & ~upper, "no capital in the written form")
    )


def first_case_only(noi: Column, viet: Column) -> Column:
    """The spoken form is the written one but for its first letter."""
    a, b = forms.squeeze(noi), forms.squeeze(viet)
    return (a != b) & (a != "") & (a == F.concat(F.lower(F.substring(b, 1, 1)), F.substr(b, F.lit(2))))


def from_alignments(spark: SparkSession, pairs: DataFrame, norm: Normalization, segment=None, keep_organisations: bool = False) -> DataFrame:
    """Pairs (id, written, spoken, topic, api of (noi, viet, kieu); null without an answer). Proposals are placed in the spoken
    words; put back, they must give the written text, and names must be made with their case."""
    df = S.settled(pairs.withColumnRenamed("written", "written_source"), __t=forms.tokens(F.col("spoken"), lower=True))
    df = S.settled(df, words=F.col("__t.words"), punct=F.col("__t.punct")).drop("__t")
    item = lambda p: F.struct(F.lower(F.trim(F.coalesce(p["noi"], F.lit("")))).alias("noi"), F.trim(F.coalesce(p["viet"], F.lit(""))).alias("viet"), F.upper(F.trim(F.coalesce(p["kieu"], F.lit("")))).alias("kind"))
    good = F.filter(F.transform("api", item), lambda p: (p["noi"] != "") & (p["viet"] != "") & (p["kind"] != "") & sane(p["noi"], p["viet"], p["kind"]).isNull())
    df = S.settled(df, __p=good)
    phrases = F.transform("__p", lambda p: F.array_join(F.filter(F.transform(F.split(p["noi"], r"\s+"), forms.no_edges), lambda w: w != ""), " "))
    soft = F.transform("__p", lambda p: (forms.folded(p["noi"]) == forms.folded(p["viet"])) & first_case_only(p["noi"], p["viet"]))
    starts = S.let(F.col("punct"), lambda punct: F.transform(punct, lambda _, i: (i == 0) | F.coalesce(F.get(punct, i - 1).isin("PERIOD", "QUESTION"), F.lit(False))))
    df = S.settled(df, __phrases=phrases, __soft=soft, __starts=starts)
    df = df.withColumn("__at", diff.find_runs("words", "__phrases", "__soft", "__starts")).drop("__phrases", "__soft", "__starts")
    strange = F.exists("__p", lambda p: ~p["kind"].isin([*L.TYPES, OUTSIDE]))
    placed = F.zip_with(F.col("__p"), F.col("__at"), lambda p, a: F.when(a.isNotNull() & ~a["free"], F.struct(a["start"].alias("start"), a["end"].alias("end"), p["kind"].alias("type"), p["viet"].alias("written"))))
    df = S.settled(df, __at=F.col("__at"), __placed=F.array_sort(F.filter(placed, lambda p: p.isNotNull())))
    marks = F.create_map(*(F.lit(x) for k, v in {"O": "", **L.PUNCTUATION}.items() for x in (k, v)))

    def rebuilt(words: Column, punct: Column, placed: Column) -> Column:
        marked = F.transform(words, lambda w, i: F.concat(w, F.coalesce(F.try_element_at(marks, F.get(punct, i)), F.lit(""))))
        with_marks = F.transform(placed, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.concat(p["written"], F.coalesce(F.try_element_at(marks, F.get(punct, p["end"])), F.lit(""))).alias("written")))
        return diff.reconstruct(marked, with_marks)

    df = df.withColumn("rebuilt", S.let(F.col("words"), F.col("punct"), F.col("__placed"), rebuilt))
    df = df.withColumn("spans", F.filter(F.transform("__placed", lambda p: span(p["start"], p["end"], p["type"])), lambda s: F.lit(keep_organisations) | (s["type"] != OUTSIDE)))
    texts = S.let(F.col("words"), lambda w: F.transform("__placed", lambda p: S.text_of(w, p["start"], p["end"])))
    df = S.settled(df, __texts=texts)
    df = df.withColumn("__out", norm.parsed(F.transform("__placed", lambda p: p["type"]), F.col("__texts")))
    made = F.zip_with(F.col("__placed"), F.col("__out"), lambda p, o: F.struct(p["type"].alias("type"), p["written"].alias("gold"), F.when(o["valid"], o["normalized"]).alias("made")))
    df = df.withColumn("__made", made)
    other_case = F.exists("__made", lambda m: m["type"].isin(CASE_BOUND) & (forms.without_marks(m["made"]) != forms.without_marks(m["gold"])))
    early = F.coalesce(
        F.when(F.col("api").isNull(), "no answer"), F.when(strange | F.exists("__at", lambda a: a.isNull()), "a span does not fit the spoken words"),
        F.when(forms.comparable(F.col("rebuilt")) != forms.comparable(F.col("written_source")), "put back, the spans give another text"),
        F.when(F.lit(not keep_organisations) & F.exists("__placed", lambda p: p["type"] == OUTSIDE), "an organisation, which has no type"), F.when(other_case, "a name is made with another case"),
    )
    gaps = F.filter(F.zip_with(F.col("__made"), F.col("__texts"), lambda m, t: F.struct(m["type"].alias("type"), t.alias("spoken"), m["gold"].alias("gold"), m["made"].alias("made"))), lambda g: (g["type"] != OUTSIDE) & (g["made"].isNull() | (forms.folded(g["made"]) != forms.folded(g["gold"]))))
    df = df.withColumns({"early": early, "gaps": gaps, "gold_key": F.array_join(F.array_sort(F.transform("__placed", lambda p: p["written"])), "|")})
    df = _through_gold(spark, df.drop("spoken", "id"), norm, segment)
    late = F.when(_pipeline_reason().isNotNull(), "the pipeline does not make it")
    return _sample(df, late, source=F.concat(F.lit("v1align:"), F.coalesce("topic", F.lit("?"))), leak_key=F.col("gold_key"))


def outside_taxonomy(pairs: DataFrame) -> DataFrame:
    """Every proposal of a type without a class (written, spoken, context, pair_id), whatever becomes of its sentence."""
    rows = pairs.select(F.col("id").alias("pair_id"), F.col("written").alias("context"), F.explode("api").alias("p"))
    return rows.where(F.upper(F.trim("p.kieu")) == OUTSIDE).select(F.trim("p.viet").alias("written"), F.lower(F.trim("p.noi")).alias("spoken"), "context", "pair_id")


def with_identity_spans(df: DataFrame, norm: Normalization) -> DataFrame:
    """df with same: the spans (text, type) that their grammar leaves as they are, supervision that says nothing."""
    texts = S.let(F.col("words"), lambda w: F.transform("spans", lambda s: F.replace(S.text_of(w, s["start"], s["end"]), F.lit("_"), F.lit(" "))))
    df = S.settled(df, __kinds=F.transform("spans", lambda s: s["type"]), __texts=texts)
    found = F.zip_with(F.arrays_zip("__kinds", "__texts"), norm.parsed(F.col("__kinds"), F.col("__texts")), lambda x, o: F.when(o["valid"] & (o["normalized"] == x["__texts"]), F.struct(x["__texts"].alias("text"), x["__kinds"].alias("type"))))
    return df.withColumn("same", F.filter(found, lambda x: x.isNotNull())).drop("__kinds", "__texts")


def without_identity_spans(df: DataFrame, norm: Normalization) -> DataFrame:
    """The sentences without such a span: one span drops its whole sentence."""
    return with_identity_spans(df, norm).where(F.size("same") == 0).drop("same")


def prepared(df: DataFrame, model: Column, subwords: Column, most_subwords: int = 256) -> DataFrame:
    """Utterances as training rows: BIOES tags of model words, and skipped_reason where a compound cuts a span or the sentence
    has too many subwords. model: (word, raw_start, raw_end); subwords: how many each model word has."""
    projected = S.project(F.col("spans"), model)
    df = df.withColumns({"model_spans": projected, "__n": F.size(model), "__sub": F.aggregate(subwords, F.lit(0), lambda a, x: a + x) + 2})
    why = F.when(F.exists("model_spans", lambda s: s["conflict"]), "a compound cuts a span").when(F.col("__sub") > most_subwords, "too long")
    return df.withColumns({"skipped_reason": why, "tags": S.encode(F.col("model_spans"), F.col("__n"))}).drop("__n", "__sub")
