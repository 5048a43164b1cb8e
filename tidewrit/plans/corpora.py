"""Queries of the corpus converters and gates, with their SQL. Records are made from the numeric tables, so that SQL knows
which gate each meets and what the kept ones become."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import forms
from ..operators import converters, corpus, metrics, pipeline, readings, segment, stored
from ..operators import spans as S
from ..operators.normalize import Normalization
from ..sources import readers
from ..streaming import streams
from . import verbalize as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


GROUPED = "replace(format('{:,}', CAST(o_orderkey AS BIGINT)), ',', '.')"
DAY = "strftime(o_orderdate, '%d/%m/%Y')"


def key() -> Column:
    return F.col("o_orderkey")


def strings(*values: str) -> Column:
    return F.array(*map(F.lit, values))


def grouped(n: Column) -> Column:
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit("."))


def day(c: str = "o_orderdate") -> Column:
    return F.date_format(c, "dd/MM/yyyy")


def said(c: Column) -> Column:
    return F.split(c, " ")


def tags(words: Column, kind: Column) -> Column:
    return F.transform(words, lambda _, i: F.concat(F.when(i == 0, "B-").otherwise("I-"), kind))


def orders(spark, sf_dir) -> DataFrame:
    df = pipeline.spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"))
    return S.settled(df, n=said(V.number(key())), d=said(V.date(F.col("o_orderdate"))), case=(key() % 6).cast("int"))


# --- bundles: an order's number and date; one record in six each is rebuilt otherwise, unknown, cut, with a digit, wrong ------


def bundle_records(spark, sf_dir) -> DataFrame:
    df = orders(spark, sf_dir)
    case = F.col("case")
    first = F.when(case == 4, "đơn4").otherwise("đơn")
    kind = F.when(case == 2, "NOTHING").otherwise("CARDINAL")
    more = F.when(case == 3, strings("ba")).otherwise(F.array().cast("array<string>"))
    target = F.concat(F.lit("đơn hàng "), grouped(key() + F.when(case == 1, 1).otherwise(0)), F.lit(", lập "), day(), F.lit("."))
    wrong = F.when(case == 5, strings("I-DATE")).otherwise(strings("O"))
    word_tags = F.concat(wrong, strings("O"), tags(F.col("n"), kind), strings("O"), tags(F.col("d"), F.lit("DATE")), F.transform(more, lambda _: F.lit("O")))
    words = F.concat(F.array(first, F.lit("Hàng")), F.col("n"), strings("lập"), F.col("d"), more)
    return S.settled(df, words=words, tags=word_tags, target=target, at=F.size("n") + 2)


def _insert(a: Column, at: Column, x: str) -> Column:
    return F.concat(F.slice(a, F.lit(1), at), strings(x), F.slice(a, at + 1, F.size(a)))


def _bundle(df: DataFrame, **columns: Column) -> DataFrame:
    none = F.lit(None)
    names = {"tokens": none.cast("array<string>"), "bio_tags": none.cast("array<string>"), "punctuation_targets": none.cast("array<string>"), "words": none.cast("array<string>"), "punct": none.cast("array<string>"), "spans": none.cast("array<array<string>>"), "normalized_text": F.col("target"), "written": none.cast("string"), "source_type": none.cast("string"), "priority_group": key().cast("string"), "focus_family": none.cast("string")}
    return df.select(*(c.alias(n) for n, c in (names | columns).items()))


def _kept(out: DataFrame, name: str = "o_orderkey") -> DataFrame:
    return out.select(F.substring_index("source", ":", -1).cast("long").alias(name), "reason", F.when(F.col("reason").isNull(), F.col("written")).alias("written"))


BUNDLE_SQL = f"SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'rebuilt otherwise: CARDINAL' WHEN 2 THEN 'unknown type: NOTHING' WHEN 3 THEN 'cut on the right: DATE' WHEN 4 THEN 'digit in words' %s END AS reason, CASE WHEN o_orderkey % 6 = 0 %s THEN 'Đơn hàng ' || {GROUPED} || ', lập ' || {DAY} || '.' END AS written FROM orders".replace("% 6", "%% 6").replace("'%d/%m/%Y'", "'%%d/%%m/%%Y'")
BROKEN = "ELSE 'lengths differ or no target'"


@query(BUNDLE_SQL % (BROKEN, ""))
def bundle_with_marks(spark, sf_dir):
    """Tokens with marks among them; the last case begins with I and is no BIO."""
    df = bundle_records(spark, sf_dir)
    tokens = F.concat(_insert(F.col("words"), F.col("at"), ","), strings("."))
    return _kept(converters.from_bundle(spark, _bundle(df, tokens=tokens, bio_tags=F.concat(_insert(F.col("tags"), F.col("at"), "O"), strings("O")))))


@query(BUNDLE_SQL % (BROKEN, ""))
def bundle_of_objects(spark, sf_dir):
    """Tokens as objects, with targets of punctuation."""
    df = bundle_records(spark, sf_dir)
    tokens = F.transform("words", lambda w: F.to_json(F.struct(w.alias("text"))))
    punct = F.transform("words", lambda _, i: F.when(i == F.col("at") - 1, "COMMA").when(i == F.size("words") - 1, "PERIOD").otherwise("O"))
    return _kept(converters.from_bundle(spark, _bundle(df, tokens=tokens, bio_tags=F.col("tags"), punctuation_targets=punct)))


@query(BUNDLE_SQL % (BROKEN, ""))
def bundle_files(spark, sf_dir):
    """Files of JSON lines, tokens as objects in some and as strings in others, read as variants, by batch and by stream."""
    df = bundle_records(spark, sf_dir)
    punct = F.transform("words", lambda _, i: F.when(i == F.col("at") - 1, "COMMA").when(i == F.size("words") - 1, "PERIOD").otherwise("O"))
    fields = {"bio_tags": F.col("tags"), "normalized_text": F.col("target"), "priority_group": key().cast("string")}
    objects = df.where("o_orderkey % 2 = 0").select(F.transform("words", lambda w, i: F.struct(w.alias("text"), i.alias("start"))).alias("tokens"), punct.alias("punctuation_targets"), *(c.alias(n) for n, c in fields.items()))
    tokens = F.concat(_insert(F.col("words"), F.col("at"), ","), strings("."))
    marked = fields | {"bio_tags": F.concat(_insert(F.col("tags"), F.col("at"), "O"), strings("O"))}
    plain = df.where("o_orderkey % 2 = 1").select(tokens.alias("tokens"), *(c.alias(n) for n, c in marked.items()))
    folder = stored.new_folder(spark, "bundles")
    objects.write.json(f"{folder}/in/kind=objects")
    plain.write.json(f"{folder}/in/kind=strings")
    streams.replay(readers.stream_variant_bundle(spark, f"{folder}/in/kind=strings"), f"{folder}/strings", f"{folder}/state")
    records = readers.read_variant_bundle(spark, f"{folder}/in/kind=objects")
    records = records.unionByName(spark.read.schema(records.schema).parquet(f"{folder}/strings"))
    return _kept(converters.from_bundle(spark, records))


@query(BUNDLE_SQL % ("ELSE NULL", "OR o_orderkey % 6 = 5"))
def bundle_of_spans(spark, sf_dir):
    """Words with spans and labels, where the last case is as good as the first."""
    df = bundle_records(spark, sf_dir)
    n = F.size("n")
    text = lambda *x: F.array(*(y.cast("string") for y in x))
    spans = F.array(text(F.lit(2), n + 1, F.when(F.col("case") == 2, "NOTHING").otherwise("CARDINAL")), text(n + 3, n + 2 + F.size("d"), F.lit("DATE")))
    punct = F.transform("words", lambda _, i: F.when(i == F.col("at") - 1, "COMMA").when(i == F.size("words") - 1, "PERIOD").otherwise("O"))
    return _kept(converters.from_bundle(spark, _bundle(df, words=F.col("words"), spans=spans, punct=punct)))


@query("SELECT CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'rebuilt otherwise: CARDINAL' WHEN 2 THEN 'unknown type: NOTHING' WHEN 3 THEN 'cut on the right: DATE' WHEN 4 THEN 'digit in words' ELSE 'lengths differ or no target' END AS reason, count(*) AS n FROM orders GROUP BY 1")
def bundle_reasons(spark, sf_dir):
    df = bundle_records(spark, sf_dir)
    tokens = F.concat(_insert(F.col("words"), F.col("at"), ","), strings("."))
    out = converters.from_bundle(spark, _bundle(df, tokens=tokens, bio_tags=F.concat(_insert(F.col("tags"), F.col("at"), "O"), strings("O"))))
    return corpus.reason_counts(out)


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CASE o_orderkey % 6 WHEN 2 THEN 'unknown type: NOTHING' WHEN 4 THEN 'schema: digit in words' WHEN 5 THEN 'span over a mark' END AS reason, CASE WHEN o_orderkey % 6 IN (0, 1, 3) THEN 2 END AS marks FROM orders")
def split_bundles(spark, sf_dir):
    """Lenient BIO; the last case tags a mark."""
    df = bundle_records(spark, sf_dir)
    over = F.when(F.col("case") == 5, "B-DATE").otherwise("O")
    tokens = F.concat(_insert(F.col("words"), F.col("at"), ";"), strings("!"))
    bio = F.concat(_insert(F.transform("tags", lambda t, i: F.when(i == 0, "O").otherwise(t)), F.col("at"), "O"), F.array(over))
    out = converters.from_split_bundle(df.select(key().cast("string").alias("id"), key().cast("string").alias("split"), tokens.alias("tokens"), bio.alias("bio_tags"), F.col("target").alias("normalized_text")))
    marks = F.size(F.filter("punct", lambda p: p != "O"))
    return out.select(F.substring_index("source", ":", -1).cast("long").alias("o_orderkey"), "reason", F.when(F.col("reason").isNull(), marks).alias("marks"))


@query("SELECT CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'label without a type' WHEN 2 THEN 'no span' WHEN 3 THEN 'digit in words' WHEN 4 THEN 'cut on the left: CARDINAL' WHEN 5 THEN 'not normalized: COORD' ELSE 'label without a type: ODD' END AS reason, count(*) AS n FROM events GROUP BY 1")
def flat_corpus_reasons(spark, sf_dir):
    """One gate for each remainder."""
    case = (F.col("event_id") % 7).cast("int")
    tokens = F.get(F.array(*(strings(*x.split()) for x in ("còn năm ngày", "ông an", "ông an", "còn 7", "còn ba năm", "ở kia", "bản abc"))), case)
    labels = F.get(F.array(*(strings(*x.split()) for x in ("O NUM O", "CASE O", "O O", "O NUM", "O O NUM", "O COORD", "O ODD"))), case)
    df = S.settled(table(spark, sf_dir, "events").select("event_id"), tokens=tokens, itn_tags=labels)
    df = df.withColumn("punc_tags", F.transform("tokens", lambda _: F.lit("O")))
    return corpus.reason_counts(converters.from_flat_corpus(df, Normalization(spark)))


# --- pairs -------------------------------------------------------------------------------------------------------------------

SENTENCE = f"'Đơn hàng lập ngày ' || {DAY} || ' có ' || (o_orderkey % 90 + 10) || '% hàng hỏng.'"


def sentence(share: Column | None = None) -> Column:
    return F.concat(F.lit("Đơn hàng lập ngày "), day(), F.lit(" có "), (key() % 90 + 10 if share is None else share).cast("string"), F.lit("% hàng hỏng."))


def spoken_sentence() -> Column:
    return F.concat_ws(" ", F.lit("đơn hàng lập"), V.date(F.col("o_orderdate")), F.lit("có"), V.number(key() % 90 + 10), F.lit("phần trăm hàng hỏng."))


@query(f"SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 'no label is confirmed' END AS reason, CASE WHEN o_orderkey % 4 <> 3 THEN {SENTENCE} END AS written FROM orders")
def labels_from_variants(spark, sf_dir):
    """Types found by shape and confirmed by the grammar; one in four has only differences that no grammar confirms."""
    df = table(spark, sf_dir, "orders").select(key().cast("string").alias("topic"), F.when(key() % 4 == 3, "Hàng tốt còn lại").otherwise(sentence()).alias("text"), F.when(key() % 4 == 3, "hàng xấu còn lại").otherwise(spoken_sentence()).alias("variant"))
    return _kept(converters.from_variants(spark, S.settled(df, text=F.col("text"), variant=F.col("variant")), Normalization(spark)))


PAIR_TEXT = "CASE o_orderkey % 8 WHEN 1 THEN 'Quá ngắn ' || o_orderkey WHEN 3 THEN 'Hàng về Trong kho số ' || o_orderkey || ' hôm nay.' WHEN 4 THEN '000 tấn hàng số ' || o_orderkey || ' đã về.' WHEN 5 THEN 'Hàng số ' || o_orderkey || ' đã về kho.' WHEN 6 THEN 'Đi qua kho số ' || o_orderkey || ' hôm nay.' ELSE 'Hàng số ' || o_orderkey || ' đã về kho chính.' END"


@query(f"WITH t AS (SELECT o_orderkey, {PAIR_TEXT} AS written, c.n AS chunk FROM orders, (VALUES (0), (1)) c(n) WHERE c.n = 0 OR o_orderkey % 8 = 0) SELECT substr(sha1(written), 1, 16) AS id, written, CASE WHEN o_orderkey % 8 IN (5) THEN 'không_biến_thể' WHEN o_orderkey % 8 = 7 THEN 'chọn_từ_nhiều' ELSE 'một_biến_thể' END AS kind, CASE o_orderkey % 8 WHEN 1 THEN 'length' WHEN 2 THEN 'several sentences in one' WHEN 3 THEN 'lost sentence boundary' WHEN 4 THEN 'fragment' WHEN 5 THEN 'digit in the spoken form' WHEN 6 THEN 'spelled word' ELSE CASE WHEN chunk = 1 THEN 'repeated' END END AS reason FROM t")
def pairs_of_articles(spark, sf_dir):
    """A gate for each remainder; one in eight occurs twice."""
    number, case = key().cast("string"), (key() % 8).cast("int")
    text = F.when(case == 1, F.concat(F.lit("Quá ngắn "), number)).when(case == 3, F.concat(F.lit("Hàng về Trong kho số "), number, F.lit(" hôm nay."))).when(case == 4, F.concat(F.lit("000 tấn hàng số "), number, F.lit(" đã về.")))
    text = text.when(case == 5, F.concat(F.lit("Hàng số "), number, F.lit(" đã về kho."))).when(case == 6, F.concat(F.lit("Đi qua kho số "), number, F.lit(" hôm nay."))).otherwise(F.concat(F.lit("Hàng số "), number, F.lit(" đã về kho chính.")))
    good = F.regexp_replace(F.col("text"), "[0-9]+", "một")
    variants = F.when(case == 5, F.array().cast("array<string>")).when(case == 6, F.array(F.replace(good, F.lit("qua"), F.lit("Q U A")))).when(case == 7, F.array(F.concat(good, F.lit(" thêm nữa")), good)).otherwise(F.array(good))
    df = S.settled(table(spark, sf_dir, "orders").select("o_orderkey"), text=text)
    df = df.select(number.alias("file"), F.explode(F.when(case == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("chunk_no"), "text", F.when(case == 2, strings("over_max_words_sentence_kept")).alias("issues"), variants.alias("variants"), F.lit("t").alias("topic"))
    return converters.pairs_of(df).select("id", "written", "kind", "reason")


def pairs(spark, sf_dir) -> DataFrame:
    df = pipeline.spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"))
    df = df.select(key().cast("string").alias("id"), key().cast("string").alias("topic"), sentence().alias("written"), spoken_sentence().alias("spoken"), "o_orderkey", "o_orderdate")
    return S.settled(df, written=F.col("written"), spoken=F.col("spoken"), date_said=F.regexp_replace(V.date(F.col("o_orderdate")), "^ngày ", ""), share_said=F.concat(V.number(key() % 90 + 10), F.lit(" phần trăm")))


@query(f"SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CASE WHEN o_orderkey % 90 + 10 >= 70 THEN 'region without a type: NONE' WHEN o_orderkey % 90 + 10 >= 50 THEN 'region without a type: not confirmed CARDINAL' END AS reason, CASE WHEN o_orderkey % 90 + 10 < 50 THEN {SENTENCE} END AS written FROM orders")
def labels_from_answers(spark, sf_dir):
    """Regions with the types that a table of answers has for them: it lacks some shares and is wrong about others."""
    df = pairs(spark, sf_dir)
    # of each date and share once, before it is said
    seen = pipeline.spread(table(spark, sf_dir, "orders").select("o_orderdate", (key() % 90 + 10).alias("share")))
    dates = seen.select("o_orderdate").distinct().select(day().alias("written"), F.regexp_replace(V.date(F.col("o_orderdate")), "^ngày ", "").alias("spoken"), F.lit("date").alias("type")).distinct()
    shares = seen.where("share < 70").select("share").distinct().select(F.concat(F.col("share").cast("string"), F.lit("%")).alias("written"), F.concat(V.number(F.col("share")), F.lit(" phần trăm")).alias("spoken"), F.when(F.col("share") >= 50, "CARDINAL").otherwise("PERCENT").alias("type"))
    return _kept(converters.from_typed_regions(spark, df.select("id", "written", "spoken", "topic"), dates.unionByName(shares), Normalization(spark)))


def proposals(df: DataFrame) -> Column:
    item = lambda w, s, t: F.struct(w.alias("viet"), s.alias("noi"), F.lit(t).alias("kieu"))
    return F.array(item(day(), F.col("date_said"), "date"), item(F.concat((key() % 90 + 10).cast("string"), F.lit("%")), F.col("share_said"), "PERCENT"))


@query(f"SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CASE o_orderkey % 6 WHEN 1 THEN 'no answer' WHEN 2 THEN 'a span does not fit the spoken words' WHEN 3 THEN 'put back, the spans give another text' WHEN 4 THEN 'an organisation, which has no type' END AS reason, CASE WHEN o_orderkey % 6 IN (0, 5) THEN {SENTENCE} END AS written FROM orders")
def labels_from_alignments(spark, sf_dir):
    """Proposals put back into the spoken words; the last case has one that changes the first letter alone, which goes."""
    df, case = pairs(spark, sf_dir), (key() % 6).cast("int")
    extra = lambda noi, viet, kieu: F.struct(F.lit(viet).alias("viet"), F.lit(noi).alias("noi"), F.lit(kieu).alias("kieu"))
    api = F.when(case == 2, F.array_append(proposals(df), extra("vắng mặt", "Vắng Mặt", "PERSON_NAME"))).when(case == 3, F.slice(proposals(df), F.lit(1), F.lit(1)))
    api = api.when(case == 4, F.array_append(proposals(df), extra("hàng hỏng", "Hàng Hỏng", "ORGANIZATION"))).when(case == 5, F.array_append(proposals(df), extra("đơn", "Đơn", "PERSON_NAME"))).when(case != 1, proposals(df))
    written = F.when(case == 4, F.replace("written", F.lit("hàng hỏng"), F.lit("Hàng Hỏng"))).otherwise(F.col("written"))
    return _kept(converters.from_alignments(spark, S.settled(df.select("id", written.alias("written"), "spoken", "topic", api.alias("api")), api=F.col("api")), Normalization(spark)))


@query(f"SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN 'no span of a known type' WHEN 2 THEN 'no span stands in the text' WHEN 3 THEN 'digit in words' END AS reason, CASE WHEN o_orderkey % 4 = 0 THEN {SENTENCE} END AS written FROM orders")
def labels_from_proposals(spark, sf_dir):
    """Proposed spans placed in the written text."""
    df, case = pairs(spark, sf_dir), (key() % 4).cast("int")
    item = lambda p: F.struct(p["viet"].alias("written"), p["noi"].alias("spoken"), p["kieu"].alias("type"))
    good = F.transform(proposals(df), item)
    other = lambda w, s, t: F.array(F.struct(F.lit(w).alias("written"), F.lit(s).alias("spoken"), F.lit(t).alias("type")))
    found = F.when(case == 1, other("hàng", "hàng", "SHIP")).when(case == 2, other("vắng", "vắng", "CARDINAL")).when(case == 3, F.slice(good, F.lit(1), F.lit(1))).otherwise(good)
    return _kept(converters.from_proposals(spark, df.select(F.col("written").alias("text"), "topic", found.alias("proposals")), Normalization(spark)))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE 'Tàu đi hướng ' || lpad(CAST(event_id % 360 AS VARCHAR), 3, '0') || '°.' END AS written, event_id % 3 = 2 AS refused FROM events")
def marked_up_lines(spark, sf_dir):
    """Lines of a reply, harvested, parsed and kept if every span is emitted."""
    heading = V.digits(F.lpad((F.col("event_id") % 360).cast("string"), 3, "0"))
    kind = F.when(F.col("event_id") % 3 == 2, "IMO_ID").otherwise("HEADING")
    reply = F.concat(F.lit("Here you are:\n1) tàu đi hướng [["), heading, F.lit("|"), kind, F.lit("]] .\nbye"))
    df = S.settled(table(spark, sf_dir, "events").select("event_id"), line=F.get(readers.harvest_lines(reply), F.lit(0)))
    df = S.settled(df, m=readers.parse_markup(F.col("line"))).select("event_id", "m.words", "m.spans", "m.punct")
    norm = Normalization(spark)
    out = pipeline.write_gold(spark, df, norm)
    emitted = F.forall("outputs", lambda o: o["emitted"])
    return out.select("event_id", F.when(emitted, F.col("written")).alias("written"), (~emitted).alias("refused"))


@query("SELECT event_id, event_id % 4 = 0 AS dropped FROM events")
def identity_spans(spark, sf_dir):
    """Sentences with a span that stays as it is."""
    plain = F.col("event_id") % 4 == 0
    words = F.when(plain, strings("gửi", "www.a.vn", "nhé")).otherwise(strings("còn", "hai", "mươi"))
    spans = F.when(plain, F.array(converters.span(F.lit(1), F.lit(1), F.lit("ELECTRONIC")))).otherwise(F.array(converters.span(F.lit(1), F.lit(2), F.lit("CARDINAL"))))
    df = S.settled(table(spark, sf_dir, "events").select("event_id"), words=words, spans=spans)
    return converters.with_identity_spans(df, Normalization(spark)).select("event_id", (F.size("same") > 0).alias("dropped"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Đi ' || (event_id % 9 + 1) || ' NM, về' WHEN 1 THEN NULL ELSE 'Về ngay' END AS written, event_id % 3 = 1 AS cut FROM events")
def gold_through_compounds(spark, sf_dir):
    """Compounds are joined, spans projected, labels moved to their ends; a compound that cuts a span skips its utterance."""
    case = (F.col("event_id") % 3).cast("int")
    digit = F.get(strings("một", "hai", "ba", "bốn", "năm", "sáu", "bảy", "tám", "chín"), (F.col("event_id") % 9).cast("int"))
    words = F.when(case == 0, F.concat(strings("đi"), F.array(digit), strings("hải", "lý", "về"))).when(case == 1, strings("còn", "ba", "mươi")).otherwise(strings("về", "ngay"))
    spans = F.when(case == 0, F.array(converters.span(F.lit(1), F.lit(3), F.lit("DISTANCE")))).when(case == 1, F.array(converters.span(F.lit(1), F.lit(1), F.lit("CARDINAL")))).otherwise(F.array().cast(converters.SPANS))
    punct = F.when(case == 0, strings("O", "O", "COMMA", "O", "O")).when(case == 1, strings("O", "O", "O")).otherwise(strings("O", "O"))
    df = S.settled(table(spark, sf_dir, "events").select("event_id"), words=words, spans=spans, punct=punct)
    out = pipeline.write_gold(spark, df, Normalization(spark), segment.segmenter(spark, {("hải", "lý"), ("ba", "mươi")}))
    return out.select("event_id", "written", (F.size("conflicts") > 0).alias("cut"))


# --- predicates and forms over real texts --------------------------------------------------------------------------------


@query("SELECT doc_id, regexp_matches(text, '^[0-9]{3}\\b') OR regexp_matches(text, '^\\p{Ll}') AS fragment FROM documents WHERE text IS NOT NULL")
def fragments(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", corpus.is_fragment(F.col("text")).alias("fragment"))


@query("SELECT doc_id, NOT regexp_matches(text, '\\p{Nd}') AND len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) >= 3 AS ok FROM documents WHERE text IS NOT NULL")
def spoken_forms(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", corpus.spoken_ok(F.col("text")).alias("ok"))


@query("SELECT conv_id, turn, regexp_matches(text, '^\\p{Lu}') AS capital, trim(regexp_replace(regexp_replace(regexp_replace(text, '[^\\pL\\pM\\pN_\\s/:.,+-]', ' ', 'g'), '[,.;:!?]+', ' ', 'g'), '\\s+', ' ', 'g')) AS form FROM conversations WHERE text IS NOT NULL")
def comparison_forms(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", forms.is_capitalized(t).alias("capital"), forms.without_marks(t).alias("form"))


@query("SELECT event_id, event_id % 4 IN (0, 1) AS same FROM events")
def equal_values(spark, sf_dir):
    """Leading zeros and groups of three make no other value; another number or another letter does."""
    n = F.col("event_id") % 9000 + 1000
    other = F.when(F.col("event_id") % 4 == 0, grouped(n)).when(F.col("event_id") % 4 == 1, F.concat(F.lit("00"), n.cast("string"))).when(F.col("event_id") % 4 == 2, (n + 1).cast("string")).otherwise(F.concat(n.cast("string"), F.lit("m")))
    return table(spark, sf_dir, "events").select("event_id", corpus.same_value(n.cast("string"), other).alias("same"))


@query("SELECT event_id, lpad(CAST(event_id % 90 AS VARCHAR), 2, '0') || '°' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || '.' || (event_id % 1000) || '′N, ' || lpad(CAST(event_id % 180 AS VARCHAR), 3, '0') || '°' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || '′E' AS target FROM events")
def aligned_targets(spark, sf_dir):
    """Positions of an outside notation in ours."""
    s = lambda m: (F.col("event_id") % m).cast("string")
    text = F.concat(s(90), F.lit("°"), s(60), F.lit(","), s(1000), F.lit("′N; "), s(180), F.lit("°"), s(60), F.lit("′E"))
    return table(spark, sf_dir, "events").select("event_id", forms.aligned_target(text).alias("target"))


# --- readings of catalogues ------------------------------------------------------------------------------------------------


@query("SELECT CASE p_partkey % 6 WHEN 0 THEN 'redundant' WHEN 1 THEN 'digit' WHEN 2 THEN 'reads as another form' WHEN 3 THEN 'no such form' WHEN 4 THEN 'sounds otherwise' ELSE NULL END AS reason, count(*) AS n FROM part GROUP BY 1")
def reading_gates(spark, sf_dir):
    """Proposed readings of names through the four gates."""
    case = (F.col("p_partkey") % 6).cast("int")
    said = F.get(strings("pa tri ốt", "pa 3 ốt", "oa sinh tơn", "gì đó", "con mèo đen", "pơ tri ốt tờ"), case)
    form = F.get(strings("Patriot", "Patriot", "Patriot", "Nowhere", "Patriot", "Patriot"), case)
    df = table(spark, sf_dir, "part").select(F.lit("foreign_names").alias("catalogue"), form.alias("canonical"), said.alias("reading"))
    return corpus.reason_counts(readings.gated(spark, df))


# --- evaluation of a run ---------------------------------------------------------------------------------------------------


def predictions(spark, sf_dir) -> DataFrame:
    """Gold and predicted spans, labels and texts of events."""
    e = F.col("event_id")
    df = table(spark, sf_dir, "events").select("event_id")
    gold = F.array(converters.span(F.lit(0), F.lit(1), F.lit("DATE")), converters.span(F.lit(3), F.lit(3), F.lit("TIME")))
    first = F.when(e % 5 == 0, converters.span(F.lit(0), F.lit(2), F.lit("DATE"))).when(e % 5 == 1, converters.span(F.lit(0), F.lit(1), F.lit("TIME"))).otherwise(converters.span(F.lit(0), F.lit(1), F.lit("DATE")))
    return df.select("event_id", gold.alias("gold"), F.array(first, converters.span(F.lit(3), F.lit(3), F.lit("TIME"))).alias("pred"), strings("O", "O", "COMMA", "PERIOD").alias("gold_punct"), F.when(e % 4 == 0, strings("O", "O", "O", "PERIOD")).otherwise(strings("O", "O", "COMMA", "PERIOD")).alias("pred_punct"), F.lit("x.").alias("gold_text"), F.when(e % 10 == 0, "y.").otherwise("x").alias("pred_text"), F.when(e % 2 == 0, "x").alias("source_text"))


RUN_SQL = "c AS (SELECT count(*) AS n, count(*) FILTER (event_id % 5 = 0) AS a, count(*) FILTER (event_id % 5 = 1) AS b, count(*) FILTER (event_id % 4 = 0) AS q, count(*) FILTER (event_id % 10 = 0) AS t, count(*) FILTER (event_id % 2 = 0) AS s, count(*) FILTER (event_id % 2 = 0 AND event_id % 10 <> 0) AS sx FROM events)"


@query(f"WITH {RUN_SQL} SELECT n, round((2 * n - a) / (2.0 * n), 9) AS boundary_f1, round((2 * n - a - b) / (2.0 * n), 9) AS type_f1, round((4 * n - q) / (4.0 * n), 9) AS punct_accuracy, round((2.0 * (n - q) / (2.0 * (n - q) + q) + 1) / 2, 9) AS punct_macro_f1, 0.0 AS utterance_exact, round(sx / s::DOUBLE, 9) AS source_exact, s AS n_source FROM c")
def run_summary(spark, sf_dir):
    out = metrics.run_summary(predictions(spark, sf_dir))
    return out.select("n", *(F.round(c, 9).alias(c) for c in ("boundary_f1", "type_f1", "punct_accuracy", "punct_macro_f1", "utterance_exact", "source_exact")), "n_source")


@query("SELECT 'DATE' AS type, count(*) FILTER (event_id % 5 NOT IN (0, 1)) AS hit, count(*) AS n FROM events UNION ALL SELECT 'TIME', count(*), count(*) FROM events")
def run_by_type(spark, sf_dir):
    return metrics.run_by_type(predictions(spark, sf_dir))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
