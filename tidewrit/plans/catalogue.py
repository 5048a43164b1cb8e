"""All queries of the spoken-to-written engine, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.validators import valid_column
from .. import sql as surface
from ..operators import corpus, diff, limiter, lookup, metrics, pipeline, segment, sequence, spans as S, stored, subwords, windows
from ..operators.normalize import Normalization
from ..sources import writers
from ..sources.answers import AnswerStore
from ..streaming import limits, streams
from . import verbalize as V


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- round trips: a spoken form made from numbers, read back, against the form that SQL makes of the numbers -------------

k = lambda c, m, a=0: (F.col(c) % m + a).cast("long")
t = lambda *x: F.concat_ws(" ", *(F.lit(y) if isinstance(y, str) else y for y in x))
pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
GROUPED = "replace(format('{:,}', CAST(%s AS BIGINT)), ',', '.')"

#: name: type, table, key columns, spoken form, SQL of the written form
ROUND_TRIPS: dict[str, tuple[str, str, list[str], Column, str]] = {}


def trip(name: str, kind: str, source: str, keys: list[str], spoken: Callable[[], Column], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = pipeline.spread(table(spark, sf_dir, source)).select(*keys, spoken().alias("spoken"))
        r = Normalization(spark).column(kind, F.col("spoken"))
        return df.withColumn("r", r).select(*keys, F.col("r.normalized").alias("written"), F.col("r.valid").alias("valid"))

    QUERIES[name] = run
    SQL[name] = f"SELECT {', '.join(keys)}, {sql} AS written, TRUE AS valid FROM {source}"


ROMAN_SQL = "CASE (o_orderkey % 4) WHEN 0 THEN 'I' WHEN 1 THEN 'II' WHEN 2 THEN 'III' ELSE 'IV' END"
trip("normalize_cardinal", "CARDINAL", "orders", ["o_orderkey"], lambda: V.number(F.col("o_orderkey")), GROUPED % "o_orderkey")
trip("normalize_negative", "CARDINAL", "orders", ["o_orderkey"], lambda: t("âm", V.number(k("o_orderkey", 100000, 1))), "'-' || " + GROUPED % "(o_orderkey % 100000 + 1)")
trip("normalize_ordinal", "ORDINAL", "part", ["p_partkey"], lambda: t("thứ", V.number(F.col("p_size"))), "'thứ ' || p_size")
trip("normalize_digit_seq", "DIGIT_SEQ", "customer", ["c_custkey"], lambda: V.digits(pad(F.col("c_custkey"), 8)), "lpad(CAST(c_custkey AS VARCHAR), 8, '0')")
trip("normalize_decimal", "DECIMAL", "lineitem", ["l_orderkey", "l_linenumber"], lambda: t(V.number(F.col("l_quantity").cast("long")), "phẩy", V.digits(pad(F.round(F.col("l_discount") * 100).cast("long"), 2))), GROUPED % "l_quantity" + " || ',' || lpad(CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR), 2, '0')")
trip("normalize_fraction", "FRACTION", "part", ["p_partkey"], lambda: t(V.number(F.col("p_size")), "phần", V.number(k("p_partkey", 90, 10))), "p_size || '/' || (p_partkey % 90 + 10)")
trip("normalize_percent", "PERCENT", "lineitem", ["l_orderkey", "l_linenumber"], lambda: t(V.number(F.round(F.col("l_tax") * 100).cast("long")), "phần trăm"), "CAST(round(l_tax * 100) AS BIGINT) || '%'")
trip("normalize_range", "RANGE", "part", ["p_partkey"], lambda: t("từ", V.number(F.col("p_size")), "đến", V.number(F.col("p_size") + 50)), "p_size || '-' || (p_size + 50)")
trip("normalize_ratio", "RATIO", "part", ["p_partkey"], lambda: t(V.number(F.col("p_size")), "trên", V.number(k("p_partkey", 100, 1))), "p_size || ':' || (p_partkey % 100 + 1)")
trip("normalize_money", "MONEY", "orders", ["o_orderkey"], lambda: t(V.number(F.floor("o_totalprice")), "đồng"), GROUPED % "floor(o_totalprice)" + " || ' đồng'")
trip("normalize_measure", "MEASURE", "lineitem", ["l_orderkey", "l_linenumber"], lambda: t(V.number(F.col("l_quantity").cast("long")), "mét khối một giờ"), "CAST(l_quantity AS BIGINT) || ' m³/h'")
trip("normalize_version", "VERSION", "part", ["p_partkey"], lambda: t("phiên bản", V.number(k("p_partkey", 20)), "chấm", V.number(F.col("p_size"))), "(p_partkey % 20) || '.' || p_size")
trip("normalize_date", "DATE", "orders", ["o_orderkey"], lambda: V.date(F.col("o_orderdate")), "strftime(o_orderdate, '%d/%m/%Y')")
trip("normalize_ship_date", "DATE", "lineitem", ["l_orderkey", "l_linenumber"], lambda: V.date(F.col("l_shipdate")), "strftime(l_shipdate, '%d/%m/%Y')")
trip("normalize_time", "TIME", "events", ["event_id"], lambda: V.time(F.col("ts")), "strftime(ts, '%H:%M:%S')")
trip("normalize_timezone", "TIMEZONE", "events", ["event_id"], lambda: t("u tê xê", F.when(F.col("event_id") % 2 == 0, "cộng").otherwise("trừ"), V.number(k("event_id", 15))), "'UTC' || CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END || (event_id % 15)")
trip("normalize_duration", "DURATION", "events", ["event_id"], lambda: t(V.number(k("event_id", 23, 1)), "giờ", V.number(k("event_id", 59, 1)), "phút"), "(event_id % 23 + 1) || ' giờ ' || (event_id % 59 + 1) || ' phút'")
trip("normalize_eta", "ETA", "events", ["event_id"], lambda: t("ê tê a", V.number(F.hour("ts")), "giờ", V.number(F.minute("ts"))), "'ETA ' || strftime(ts, '%H:%M')")
trip("normalize_etd", "ETD", "events", ["event_id"], lambda: t("thời gian dự kiến rời cảng", V.number(F.hour("ts")), "giờ", V.number(F.minute("ts"))), "'ETD ' || strftime(ts, '%H:%M')")
trip("normalize_quarter", "QUARTER", "orders", ["o_orderkey"], lambda: t("quý", V.number(k("o_orderkey", 4, 1))), f"'Quý ' || {ROMAN_SQL}")
trip("normalize_coordinate", "COORD", "events", ["event_id"], lambda: t(V.number(k("event_id", 90)), "độ", V.number(k("event_id", 60)), "phút bắc", V.number(k("event_id", 180)), "độ", V.number(k("event_id", 59)), "phút đông"), "lpad(CAST(event_id % 90 AS VARCHAR), 2, '0') || '°' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || '′N, ' || lpad(CAST(event_id % 180 AS VARCHAR), 3, '0') || '°' || lpad(CAST(event_id % 59 AS VARCHAR), 2, '0') || '′E'")
trip("normalize_heading", "HEADING", "events", ["event_id"], lambda: t("hướng", V.digits(pad(k("event_id", 360), 3))), "lpad(CAST(event_id % 360 AS VARCHAR), 3, '0') || '°'")
trip("normalize_bearing", "BEARING", "events", ["event_id"], lambda: t("phương vị", V.number(k("event_id", 360))), "lpad(CAST(event_id % 360 AS VARCHAR), 3, '0') || '°'")
trip("normalize_speed", "SPEED", "events", ["event_id"], lambda: t(V.number(k("event_id", 40, 1)), "hải lý một giờ"), "(event_id % 40 + 1) || ' kn'")
trip("normalize_distance", "DISTANCE", "events", ["event_id"], lambda: t(V.number(k("event_id", 900, 1)), "hải lý"), "(event_id % 900 + 1) || ' NM'")
trip("normalize_depth", "DEPTH", "events", ["event_id"], lambda: t(V.number(k("event_id", 300, 1)), "mét"), "(event_id % 300 + 1) || ' m'")
trip("normalize_draft", "DRAFT", "events", ["event_id"], lambda: t(V.number(k("event_id", 15, 1)), "phẩy", V.digits((F.col("event_id") % 10).cast("string")), "mét"), "(event_id % 15 + 1) || ',' || (event_id % 10) || ' m'")
trip("normalize_frequency", "FREQUENCY", "events", ["event_id"], lambda: t(V.digits(k("event_id", 900, 100).cast("string")), "phẩy", V.digits((F.col("event_id") % 10).cast("string")), "mê ga héc"), "(event_id % 900 + 100) || ',' || (event_id % 10) || ' MHz'")
trip("normalize_channel", "CHANNEL", "events", ["event_id"], lambda: t("kênh", V.number(k("event_id", 88, 1))), "'Kênh ' || (event_id % 88 + 1)")
trip("normalize_mmsi", "MMSI_ID", "customer", ["c_custkey"], lambda: V.digits(pad(F.col("c_custkey") + 200000000, 9)), "CAST(c_custkey + 200000000 AS VARCHAR)")
trip("normalize_imo", "IMO_ID", "customer", ["c_custkey"], lambda: t("i em ô", V.digits(pad(F.col("c_custkey") + 1000000, 7))), "'IMO ' || (c_custkey + 1000000)")
trip("normalize_telephone", "TELEPHONE", "customer", ["c_custkey"], lambda: V.digits(F.concat(F.lit("09"), pad(F.col("c_custkey"), 8))), "'09' || lpad(CAST(c_custkey AS VARCHAR), 8, '0')")
trip("normalize_telephone_abroad", "TELEPHONE", "customer", ["c_custkey"], lambda: t("cộng", V.digits(F.concat(F.lit("84"), pad(F.col("c_custkey") + 100000000, 9)))), "'+84 ' || substr(CAST(c_custkey + 100000000 AS VARCHAR), 1, 3) || ' ' || substr(CAST(c_custkey + 100000000 AS VARCHAR), 4, 3) || ' ' || substr(CAST(c_custkey + 100000000 AS VARCHAR), 7, 3)")
trip("fallback_sibling", "MMSI_ID", "customer", ["c_custkey"], lambda: V.digits(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("09"), pad(F.col("c_custkey"), 8))).otherwise(pad(F.col("c_custkey") + 1000000, 7))), "CASE WHEN c_custkey % 2 = 0 THEN '09' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') ELSE CAST(c_custkey + 1000000 AS VARCHAR) END")
trip("normalize_callsign", "CALLSIGN", "customer", ["c_custkey"], lambda: t("hô hiệu", V.digits((F.col("c_custkey") % 10).cast("string")), "vê hát", V.digits(pad(F.col("c_custkey"), 5))), "(c_custkey % 10) || 'VH' || lpad(CAST(c_custkey AS VARCHAR), 5, '0')")
trip("normalize_vessel_id", "VESSEL_ID", "supplier", ["s_suppkey"], lambda: t("bê đê", V.digits(pad(F.col("s_suppkey"), 5)), "tê ét"), "'BD' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') || 'TS'")
trip("normalize_port_code", "PORT_CODE", "supplier", ["s_suppkey"], lambda: F.when(F.col("s_suppkey") % 2 == 0, "vê en hát pê hát").otherwise("ét giê ét i en"), "CASE WHEN s_suppkey % 2 = 0 THEN 'VNHPH' ELSE 'SGSIN' END")
trip("normalize_document_id", "DOCUMENT_ID", "orders", ["o_orderkey"], lambda: t("số", V.number(k("o_orderkey", 900, 1)), "năm", V.number(F.year("o_orderdate"))), "'Số ' || (o_orderkey % 900 + 1) || '/' || year(o_orderdate)")
trip("normalize_legal_doc", "LEGAL_DOC_ID", "orders", ["o_orderkey"], lambda: t("số", V.number(k("o_orderkey", 900, 1)), "xẹt", V.number(F.year("o_orderdate")), "nờ đê cê pê"), "'Số ' || (o_orderkey % 900 + 1) || '/' || year(o_orderdate) || '/NĐ-CP'")
trip("normalize_ip_address", "ELECTRONIC", "events", ["event_id"], lambda: t(V.number(k("event_id", 256)), "chấm", V.number(k("event_id", 255)), "chấm", V.number(k("event_id", 254)), "chấm", V.number(k("event_id", 253))), "(event_id % 256) || '.' || (event_id % 255) || '.' || (event_id % 254) || '.' || (event_id % 253)")
trip("normalize_vehicle_plate", "VEHICLE_PLATE", "customer", ["c_custkey"], lambda: t(V.digits(k("c_custkey", 80, 11).cast("string")), "a gạch ngang", V.digits(pad(F.col("c_custkey") % 1000, 3)), "chấm", V.digits(pad(F.col("c_custkey") % 100, 2))), "(c_custkey % 80 + 11) || 'A-' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || '.' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0')")
trip("normalize_address", "ADDRESS", "customer", ["c_custkey"], lambda: t("số", V.number(F.col("c_custkey")), "trần phú phường", V.number(k("c_custkey", 20, 1))), "'Số ' || c_custkey || ' Trần Phú phường ' || (c_custkey % 20 + 1)")
trip("normalize_equipment", "EQUIPMENT_ID", "part", ["p_partkey"], lambda: t(F.when(F.col("p_partkey") % 2 == 0, "ét u gạch ngang").otherwise("míc"), V.number(k("p_partkey", 90, 10))), "CASE WHEN p_partkey % 2 = 0 THEN 'Su-' ELSE 'MiG-' END || (p_partkey % 90 + 10)")
trip("normalize_acronym", "ACRONYM", "supplier", ["s_suppkey"], lambda: F.when(F.col("s_suppkey") % 2 == 0, "u bê en đê").otherwise("vê hát ép"), "CASE WHEN s_suppkey % 2 = 0 THEN 'UBND' ELSE 'VHF' END")
trip("normalize_maritime_term", "MARITIME_TERM", "supplier", ["s_suppkey"], lambda: F.when(F.col("s_suppkey") % 2 == 0, "mê đây").otherwise("đét xờ lâu a hét"), "CASE WHEN s_suppkey % 2 = 0 THEN 'MAYDAY' ELSE 'dead slow ahead' END")
trip("normalize_foreign_name", "FOREIGN_NAME", "supplier", ["s_suppkey"], lambda: F.when(F.col("s_suppkey") % 2 == 0, "pát ri ốt").otherwise("oa sinh tơn"), "CASE WHEN s_suppkey % 2 = 0 THEN 'Patriot' ELSE 'Washington' END")
trip("normalize_equipment_name", "EQUIPMENT_NAME", "supplier", ["s_suppkey"], lambda: F.when(F.col("s_suppkey") % 2 == 0, "pa tri ốt").otherwise("đờ rôn"), "CASE WHEN s_suppkey % 2 = 0 THEN 'Patriot' ELSE 'Drone' END")
trip("normalize_person", "PERSON_NAME", "nation", ["n_nationkey"], lambda: F.lower(F.replace("n_name", F.lit("_"), F.lit(" "))), "list_aggregate(list_transform(string_split(lower(replace(n_name, '_', ' ')), ' '), lambda x: upper(x[1:1]) || x[2:]), 'string_agg', ' ')")
trip("normalize_location", "LOCATION_NAME", "region", ["r_regionkey"], lambda: F.lower("r_name"), "list_aggregate(list_transform(string_split(lower(r_name), ' '), lambda x: upper(x[1:1]) || x[2:]), 'string_agg', ' ')")
trip("normalize_rank", "RANK", "supplier", ["s_suppkey"], lambda: F.when(F.col("s_suppkey") % 2 == 0, "chief officer").otherwise("đại tá"), "CASE WHEN s_suppkey % 2 = 0 THEN 'Chief Officer' ELSE 'Đại tá' END")


# --- the utterance pipeline -----------------------------------------------------------------------------------------


def spoken_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances of an order's number and date with gold spans."""
    df = S.settled(pipeline.spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")), n=F.split(V.number(F.col("o_orderkey")), " "), d=F.split(V.date(F.col("o_orderdate")), " "))
    words = F.concat(F.array(F.lit("đơn"), F.lit("hàng")), F.col("n"), F.array(F.lit("lập")), F.col("d"))
    spans = F.array(F.struct(F.lit(2).alias("start"), (F.size("n") + 1).alias("end"), F.lit("CARDINAL").alias("type")), F.struct((F.size("n") + 3).alias("start"), (F.size("n") + F.size("d") + 2).alias("end"), F.lit("DATE").alias("type")))
    df = df.select("o_orderkey", words.alias("words"), spans.alias("gold"))
    last = F.transform("words", lambda w, i: F.when(i == F.size("words") - 1, "PERIOD").otherwise("O"))
    return df.withColumns({"spans": pipeline.with_gold_confidence(F.col("gold")), "punct": last})


@query(f"SELECT o_orderkey, 'Đơn hàng ' || {GROUPED % 'o_orderkey'} || ' lập ' || strftime(o_orderdate, '%d/%m/%Y') || '.' AS written, CAST(2 AS BIGINT) AS n_emitted FROM orders")
def flagship_spoken_orders(spark, sf_dir):
    """Spans, normalisation, gate and rendering end to end."""
    out = pipeline.write(spark, spoken_orders(spark, sf_dir))
    return out.select("o_orderkey", "written", F.size(F.filter("outputs", lambda o: o["emitted"])).cast("long").alias("n_emitted"))


@query(f"SELECT o_orderkey, s.n AS span_no, CASE s.n WHEN 0 THEN 'CARDINAL' ELSE 'DATE' END AS resolved_type, CASE s.n WHEN 0 THEN {GROUPED % 'o_orderkey'} ELSE strftime(o_orderdate, '%d/%m/%Y') END AS normalized, (o_orderkey % 10) / 10.0 >= 0.6 AS emitted FROM orders, (VALUES (0), (1)) s(n)")
def trace_spoken_orders(spark, sf_dir):
    """The trace under confidences that vary, so that the gate stops some spans."""
    df = spoken_orders(spark, sf_dir)
    low = F.transform("spans", lambda s: s.withField("boundary_conf", (F.col("o_orderkey") % 10) / 10))
    out = pipeline.trace(pipeline.write(spark, df.withColumn("spans", low)), "o_orderkey")
    return out.select("o_orderkey", F.col("span_no").cast("int").alias("span_no"), "resolved_type", "normalized", "emitted")


@query(SQL["trace_spoken_orders"])
def trace_in_sql(spark, sf_dir):
    """The same rows from a query in SQL alone, over a view of the utterances."""
    surface.register(spark)
    spoken_orders(spark, sf_dir).createOrReplaceTempView("spoken_orders")
    return spark.sql("""
        SELECT o_orderkey, t.span_no, t.resolved_type, t.normalized, t.emitted
        FROM (SELECT o_orderkey, words, transform(spans, s -> named_struct('start', s.start, 'end', s.end, 'type', s.type, 'boundary_conf', double(o_orderkey % 10) / 10, 'type_conf', s.type_conf)) AS spans FROM spoken_orders),
             LATERAL trace_spans(words, spans) t
    """)


@query("SELECT CASE n WHEN 0 THEN 'CARDINAL' ELSE 'DATE' END AS type, count(*) AS spans, count(*) AS emitted, CAST(0 AS BIGINT) AS below_threshold, CAST(0 AS BIGINT) AS invalid FROM orders, (VALUES (0), (1)) s(n) GROUP BY 1")
def emission_in_sql(spark, sf_dir):
    """By type, from a view over a view."""
    spoken_orders(spark, sf_dir).createOrReplaceTempView("spoken_orders")
    surface.views(spark, "spoken_orders", "o_orderkey")
    return spark.sql("SELECT type, spans, emitted, below_threshold, invalid FROM spoken_orders_emission")


@query(r"SELECT conv_id, turn, CAST(unnest(range(len(p))) AS INT) AS n, unnest(p) AS sentence FROM (SELECT conv_id, turn, list_filter(string_split_regex(regexp_replace(trim(text, chr(32) || chr(9) || chr(10)), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS p FROM conversations WHERE text IS NOT NULL)")
def sentences_in_sql(spark, sf_dir):
    surface.register(spark)
    table(spark, sf_dir, "conversations").createOrReplaceTempView("turns")
    return spark.sql("SELECT conv_id, turn, s.n, s.sentence FROM turns, LATERAL text_sentences(text) s")


# --- spans over tokenised text: a word of six or more characters begins a span that goes on while words have six -----

LONG_SQL = "WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM conversations WHERE text IS NOT NULL), e AS (SELECT conv_id, turn, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM w), f AS (SELECT *, CASE WHEN length(word) >= 6 THEN 1 ELSE 0 END AS l, coalesce(lag(CASE WHEN length(word) >= 6 THEN 1 ELSE 0 END) OVER p, 0) AS b, coalesce(lead(CASE WHEN length(word) >= 6 THEN 1 ELSE 0 END) OVER p, 0) AS a FROM e WINDOW p AS (PARTITION BY conv_id, turn ORDER BY pos))"
TAG_SQL = "CASE WHEN l = 0 THEN 'O' WHEN b = 0 AND a = 0 THEN 'S' WHEN b = 0 THEN 'B' WHEN a = 0 THEN 'E' ELSE 'I' END"


def turns(spark, sf_dir) -> DataFrame:
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    df = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", words.alias("words"))
    labels = F.transform("words", lambda w: F.when(F.length(w) >= 6, "LONG").otherwise("O"))
    return df.withColumn("spans", S.runs(labels)).withColumn("tags", S.encode(F.col("spans"), F.size("words")))


@query(f"{LONG_SQL} SELECT conv_id, turn, pos::INT AS pos, {TAG_SQL} AS tag FROM f")
def encode_bioes(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", F.posexplode("tags").alias("pos", "tag"))


@query(f"{LONG_SQL}, g AS (SELECT *, pos - row_number() OVER (PARTITION BY conv_id, turn, l ORDER BY pos) AS island FROM f) SELECT conv_id, turn, min(pos)::INT AS start, max(pos)::INT AS \"end\" FROM g WHERE l = 1 GROUP BY conv_id, turn, island")
def decode_bioes(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", F.explode(S.decode(F.col("tags"))).alias("s")).select("conv_id", "turn", "s.start", "s.end")


@query(f"{LONG_SQL} SELECT conv_id, turn, string_agg(CASE WHEN l = 0 THEN word ELSE '<LONG>' END, ' ' ORDER BY pos) AS signature FROM f WHERE l = 0 OR b = 0 GROUP BY conv_id, turn")
def template_signatures(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", S.template_signature(F.col("words"), F.col("spans")).alias("signature")).where("signature <> ''")


@query("WITH e AS (SELECT event_id, user_id, CASE (event_id * 7 + user_id) % 5 WHEN 0 THEN 'O' WHEN 1 THEN 'B' WHEN 2 THEN 'I' WHEN 3 THEN 'E' ELSE 'S' END AS tag FROM events), p AS (SELECT tag, coalesce(lag(tag) OVER w, 'O') AS b, lead(tag) OVER w AS a FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT CAST(sum(CASE WHEN (b IN ('O', 'S', 'E') AND tag IN ('I', 'E')) OR (b IN ('B', 'I') AND tag IN ('O', 'B', 'S')) THEN 1 ELSE 0 END) + sum(CASE WHEN a IS NULL AND tag IN ('B', 'I') THEN 1 ELSE 0 END) AS BIGINT) AS bad, CAST(count(*) + sum(CASE WHEN a IS NULL AND tag IN ('B', 'I') THEN 1 ELSE 0 END) AS BIGINT) AS steps FROM p")
def illegal_transitions(spark, sf_dir):
    tag = F.get(F.array(*map(F.lit, "OBIES")), ((F.col("event_id") * 7 + F.col("user_id")) % 5).cast("int"))
    tags = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("pos"), tag.alias("tag"))
    return metrics.transition_error_rate(tags).select("bad", "steps")


@query("WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM conversations WHERE text IS NOT NULL), e AS (SELECT conv_id, turn, unnest(ws) AS word FROM w), p AS (SELECT conv_id, turn, regexp_extract(word, '([^\\pL\\pN]*)$') AS tail, regexp_replace(word, '^[^\\pL\\pN]+|[^\\pL\\pN]+$', '', 'g') AS core FROM e) SELECT conv_id, turn, count(*) AS words, count(*) FILTER (regexp_extract(tail, '[,;.!?]') IN (',', ';')) AS commas, count(*) FILTER (regexp_extract(tail, '[,;.!?]') IN ('.', '!')) AS periods FROM p WHERE core <> '' GROUP BY conv_id, turn")
def punctuation_labels(spark, sf_dir):
    df = turns(spark, sf_dir).withColumn("p", S.peel_punctuation(F.col("words")))
    count = lambda x: F.size(F.filter("p", lambda y: y["label"] == x)).cast("long")
    return df.where(F.size("p") > 0).select("conv_id", "turn", F.size("p").cast("long").alias("words"), count("COMMA").alias("commas"), count("PERIOD").alias("periods"))


@query("SELECT event_id, CAST((event_id % 97) // 3 AS INT) AS start, CAST((event_id % 97 + event_id % 5) // 3 AS INT) AS \"end\", 'T' || (event_id % 3) AS type, event_id % 97 % 3 <> 0 OR (event_id % 97 + event_id % 5) % 3 <> 2 AS conflict FROM events")
def project_spans(spark, sf_dir):
    """Raw spans through model words of three raw tokens each; most of them are cut by one."""
    s = F.struct((F.col("event_id") % 97).cast("int").alias("start"), (F.col("event_id") % 97 + F.col("event_id") % 5).cast("int").alias("end"), F.concat(F.lit("T"), (F.col("event_id") % 3).cast("string")).alias("type"))
    model = F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: F.struct((i * 3).alias("raw_start"), (i * 3 + 2).alias("raw_end")))
    return table(spark, sf_dir, "events").select("event_id", F.explode(S.project(F.array(s), model)).alias("x")).select("event_id", "x.*")


# --- validators and electronic subtypes ---------------------------------------------------------------------------

COORD_VALUE = "lpad(CAST(event_id % 100 AS VARCHAR), 2, '0') || '°' || lpad(CAST(event_id % 70 AS VARCHAR), 2, '0') || '′N'"


@query(f"SELECT event_id, event_id % 100 <= 90 AND event_id % 70 < 60 AS coord_ok, event_id % 400 < 360 AS heading_ok, length(CAST(event_id AS VARCHAR)) = 3 AS port_ok FROM events")
def validators(spark, sf_dir):
    coord = F.concat(pad(k("event_id", 100), 2), F.lit("°"), pad(k("event_id", 70), 2), F.lit("′N"))
    heading = F.concat(pad(k("event_id", 400), 3), F.lit("°"))
    mmsi_like = F.concat(F.lit("100000"), F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", valid_column(F.lit("COORD"), coord).alias("coord_ok"), valid_column(F.lit("HEADING"), heading).alias("heading_ok"), valid_column(F.lit("MMSI_ID"), mmsi_like).alias("port_ok"))


@query("SELECT page_id, CASE WHEN regexp_full_match(regexp_replace(url, '[?#].*$', ''), '(https?://)?(www\\.)?[A-Za-z0-9.-]+\\.[A-Za-z]{2,}(/\\S*)?') THEN regexp_replace(url, '[?#].*$', '') END AS written FROM pages")
def electronic_urls(spark, sf_dir):
    """Web addresses that are already written pass as they are."""
    url = F.regexp_replace("url", r"[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", Normalization(spark).column("ELECTRONIC", url)["normalized"].alias("written"))


# --- catalogue lookup ---------------------------------------------------------------------------------------------


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Patriot' WHEN 1 THEN 'Patriot' WHEN 2 THEN 'Tomahawk' ELSE NULL END AS canonical, CASE s_suppkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'folded' WHEN 2 THEN 'exact' ELSE 'none' END AS tier FROM supplier")
def catalogue_lookup(spark, sf_dir):
    text = F.get(F.array(*map(F.lit, ["pa tri ốt", "pa tri ót", "tô ma hốc", "cờ lô ri ban đờ"])), (F.col("s_suppkey") % 4).cast("int"))
    df = table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("said"))
    return lookup.lookup(df, lookup.table(spark), "foreign_names", F.col("said")).select("s_suppkey", "canonical", "tier")


@query()
def catalogue_lookup_fuzzy(spark, sf_dir):
    text = F.get(F.array(*map(F.lit, ["oa sinh tân", "bai tri ốt", "tô ma hấc a", "hi mát"])), (F.col("s_suppkey") % 4).cast("int"))
    df = table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("said"))
    return lookup.lookup(df, lookup.table(spark), "foreign_names", F.col("said")).select("s_suppkey", "said", "canonical", "tier", F.round("score", 4).alias("score"))


# --- sequence model and windows -------------------------------------------------------------------------------------


@query()
def crf_best_tags(spark, sf_dir):
    """Emissions from the embeddings: rows of five."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.transform(F.slice("embedding", i * 5 + 1, F.lit(5)), lambda x: x.cast("double") * 10))
    df = table(spark, sf_dir, "embeddings").select("vec_id", sequence.best_tags(rows).alias("r"))
    spans = S.decode(F.col("r.tags"))
    least = F.transform(spans, lambda s: F.round(sequence.boundary_confidence(F.col("r.confidence"), s["start"], s["end"]), 4))
    return df.select("vec_id", F.array_join("r.tags", "").alias("tags"), F.size(spans).alias("n_spans"), F.coalesce(F.array_min(least), F.lit(1.0)).alias("least_confidence"))


@query("""
WITH m AS (SELECT vec_id, list_transform([1, 2, 3, 4], lambda k: list_avg(list_transform(range(0, len(embedding) // 4), lambda i: CAST(embedding[i * 4 + k] AS DOUBLE)))) AS m FROM embeddings),
t AS (SELECT vec_id, m, list_max(m) AS top FROM m)
SELECT vec_id, CAST(list_position(m, top) - 1 AS INT) AS type, round(1 / list_sum(list_transform(m, lambda x: exp(x - top))), 6) AS probability FROM t
""")
def type_confidences(spark, sf_dir):
    """Embeddings as logits of four types, a row of four a word, all words being one span."""
    rows = F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 4).cast("int") - 1), lambda i: F.transform(F.slice("embedding", i * 4 + 1, F.lit(4)), lambda x: x.cast("double")))
    df = table(spark, sf_dir, "embeddings").select("vec_id", sequence.type_confidence(rows, F.lit(0), F.floor(F.size("embedding") / 4).cast("int") - 1, 4).alias("c"))
    return df.select("vec_id", "c.type", F.round("c.probability", 6).alias("probability"))


@query("SELECT user_id, round(0.4 * avg(CASE WHEN value > 10 THEN 1 ELSE 0 END) + 0.3 * avg(CASE WHEN value > 20 THEN 1 ELSE 0 END) + 0.1 * avg(CASE WHEN value > 30 THEN 1 ELSE 0 END) + 0.1 * avg(CASE WHEN value > 40 THEN 1 ELSE 0 END) + 0.1 * avg(CASE WHEN value > 50 THEN 1 ELSE 0 END), 6) AS score FROM events GROUP BY user_id")
def checkpoint_scores(spark, sf_dir):
    """The score of a checkpoint from five shares of a user's events."""
    shares = [F.avg((F.col("value") > n).cast("int")) for n in (10, 20, 30, 40, 50)]
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(metrics.checkpoint_score(*shares), 6).alias("score"))


STEPS = ", ".join(f"('{a}', '{b}', {sequence.TAGS.index(b)})" for a, follow in S.NEXT.items() for b in follow)
PATH_SQL = f"""
WITH RECURSIVE e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 10) AS x, CAST(len(embedding) // 5 AS INT) AS n FROM embeddings
), steps(a, b, place) AS (VALUES {STEPS}), w AS (
  SELECT vec_id, 1 AS t, tag, x[place + 1] AS score, tag AS path FROM e, (VALUES ('O', 0), ('B', 1), ('S', 4)) s(tag, place) WHERE n > 0
  UNION ALL
  SELECT vec_id, t, tag, best.score, best.path FROM (
    SELECT w.vec_id, w.t + 1 AS t, s.b AS tag, max({{'score': w.score + e.x[w.t * 5 + s.place + 1], 'path': w.path || s.b}}) AS best
    FROM w JOIN e ON w.vec_id = e.vec_id AND w.t < e.n JOIN steps s ON s.a = w.tag GROUP BY w.vec_id, w.t, s.b)
)
SELECT vec_id, arg_max(path, score) AS tags FROM (SELECT w.vec_id, path, score FROM w JOIN e ON w.vec_id = e.vec_id AND w.t = e.n WHERE tag IN ('O', 'E', 'S')) GROUP BY vec_id
"""


@query(PATH_SQL)
def crf_best_paths(spark, sf_dir):
    """Emissions from whole embeddings: rows of five; SQL walks all legal paths, the best to each tag at a time."""
    rows = F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 5).cast("int") - 1), lambda i: F.transform(F.slice("embedding", i * 5 + 1, F.lit(5)), lambda x: x.cast("double") * 10))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(sequence.best_tags(rows)["tags"], "").alias("tags"))


@query("WITH RECURSIVE w AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda x: greatest(CAST(ceil(length(x) / 4.0) AS INT), 1)) AS c FROM conversations WHERE text IS NOT NULL), t AS (SELECT conv_id, turn, CAST(len(c) AS INT) AS n, list_transform(range(0, len(c) + 1), lambda i: CASE WHEN i = 0 THEN 0 ELSE CAST(list_sum(c[1:i]) AS INT) END) AS s FROM w), p AS (SELECT conv_id, turn, n, s, 0 AS no, 0 AS a, CAST(greatest(1, len(list_filter(s, lambda x: x <= 224)) - 1) AS INT) AS b FROM t WHERE n > 0 UNION ALL SELECT conv_id, turn, n, s, no + 1, a2, CAST(greatest(a2 + 1, len(list_filter(s, lambda x: x <= s[a2 + 1] + 224)) - 1) AS INT) FROM (SELECT *, CAST(greatest(a + 1, len(list_filter(s[1:b], lambda x: x <= s[b + 1] - 40)) - 1) AS INT) AS a2 FROM p WHERE b < n)) SELECT conv_id, turn, no AS window_no, a AS word_start, b AS word_end, CAST(s[b + 1] - s[a + 1] AS INT) AS subwords FROM p")
def window_plans(spark, sf_dir):
    counts = F.transform(F.split("text", " "), lambda w: F.greatest(F.ceil(F.length(w) / 4).cast("int"), F.lit(1)))
    df = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", windows.plan_windows(counts).alias("w"))
    return df.select("conv_id", "turn", F.posexplode("w").alias("window_no", "x")).select("conv_id", "turn", "window_no", "x.word_start", "x.word_end", "x.subwords")


@query("WITH w AS (SELECT o.n AS window_no, o.n * 60 AS s, o.n * 60 + 100 AS e FROM range(2000) o(n)), p AS (SELECT ev.event_id AS word, window_no, row_number() OVER (PARTITION BY ev.event_id ORDER BY abs(ev.event_id - (s + e - 1) / 2.0), window_no) AS r FROM events ev JOIN w ON ev.event_id >= s AND ev.event_id < e) SELECT word, CAST(window_no AS BIGINT) AS window_no FROM p WHERE r = 1")
def stitch_windows(spark, sf_dir):
    """Events as words under windows of 100 that step by 60."""
    last = F.floor(F.col("event_id") / 60)
    df = table(spark, sf_dir, "events").select(F.lit(0).alias("id"), F.col("event_id").alias("word"), F.explode(F.sequence(F.greatest(F.ceil((F.col("event_id") - 99) / 60), F.lit(0)), last)).alias("window_no"))
    df = df.withColumns({"word_start": F.col("window_no") * 60, "word_end": F.col("window_no") * 60 + 100})
    return windows.stitch(df).select("word", "window_no")


# --- metrics over predictions made by arithmetic -----------------------------------------------------------------

TYPES_SQL = "CASE {} % 3 WHEN 0 THEN 'DATE' WHEN 1 THEN 'TIME' ELSE 'COORD' END"


def _three(c: Column) -> Column:
    return F.get(F.array(*map(F.lit, ["DATE", "TIME", "COORD"])), (c % 3).cast("int"))


def span_sets(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    gold = e.select(F.col("user_id").alias("id"), F.col("event_id").alias("start"), (F.col("event_id") + 2).alias("end"), _three(F.col("event_id")).alias("type"))
    pred = e.where("event_id % 10 <> 0").select(F.col("user_id").alias("id"), F.col("event_id").alias("start"), (F.col("event_id") + F.when(F.col("event_id") % 7 == 0, 3).otherwise(2)).alias("end"), _three(F.col("event_id") + F.when(F.col("event_id") % 11 == 0, 1).otherwise(0)).alias("type"))
    return gold, pred


GP = f"gold AS (SELECT user_id AS id, event_id AS s, event_id + 2 AS e, {TYPES_SQL.format('event_id')} AS type FROM events), pred AS (SELECT user_id AS id, event_id AS s, event_id + CASE WHEN event_id % 7 = 0 THEN 3 ELSE 2 END AS e, {TYPES_SQL.format('(event_id + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END)')} AS type FROM events WHERE event_id % 10 <> 0)"


@query(f"WITH {GP}, c AS (SELECT (SELECT count(*) FROM gold JOIN pred USING (id, s, e)) AS tp, (SELECT count(*) FROM gold) AS g, (SELECT count(*) FROM pred) AS p) SELECT tp, p - tp AS fp, g - tp AS fn, round(2.0 * tp / (p + g), 9) AS f1 FROM c")
def boundary_f1(spark, sf_dir):
    return metrics.boundary_f1(*span_sets(spark, sf_dir)).select("tp", "fp", "fn", F.round("f1", 9).alias("f1"))


@query(f"WITH {GP}, t AS (SELECT type, count(*) AS tp FROM gold JOIN pred USING (id, s, e, type) GROUP BY type), g AS (SELECT type, count(*) AS g FROM gold GROUP BY type), p AS (SELECT type, count(*) AS p FROM pred GROUP BY type), a AS (SELECT type, coalesce(tp, 0) AS tp, g, p FROM g JOIN p USING (type) LEFT JOIN t USING (type)), b AS (SELECT * FROM a UNION ALL SELECT NULL, sum(tp)::BIGINT, sum(g)::BIGINT, sum(p)::BIGINT FROM a) SELECT type, tp, p - tp AS fp, g - tp AS fn, round(2.0 * tp / (p + g), 9) AS f1 FROM b")
def type_f1(spark, sf_dir):
    return metrics.type_f1(*span_sets(spark, sf_dir)).select("type", "tp", "fp", "fn", F.round("f1", 9).alias("f1"))


REPORT_SQL = "m AS (SELECT gold.type AS g, pred.type AS p FROM gold FULL JOIN pred USING (id, s, e)), own AS (SELECT g AS type, count(*) AS gold, count(*) FILTER (g = p) AS hit, count(*) FILTER (p IS NOT NULL AND g <> p) AS boundary_only, count(*) FILTER (p IS NULL) AS missed FROM m WHERE g IS NOT NULL GROUP BY g), sp AS (SELECT p AS type, count(*) AS spurious FROM m WHERE p IS NOT NULL AND g IS DISTINCT FROM p GROUP BY p), mx AS (SELECT type, string_agg(x, ', ' ORDER BY n DESC, p) AS confusions FROM (SELECT g AS type, p, count(*) AS n, p || ':' || count(*) AS x, row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, p) AS r FROM m WHERE g <> p GROUP BY g, p) WHERE r <= 3 GROUP BY type), r AS (SELECT own.*, coalesce(spurious, 0) AS spurious, coalesce(confusions, '') AS confusions FROM own LEFT JOIN sp USING (type) LEFT JOIN mx USING (type))"


@query(f"WITH {GP}, {REPORT_SQL} SELECT type, gold, hit, boundary_only, missed, spurious, round(hit / (hit + spurious)::DOUBLE, 9) AS precision, round(hit / gold::DOUBLE, 9) AS recall, round(2.0 * hit / (gold + hit + spurious), 9) AS f1, CASE WHEN 2.0 * hit / (gold + hit + spurious) >= 0.8 THEN 'good' WHEN 2.0 * hit / (gold + hit + spurious) >= 0.5 THEN 'usable' ELSE 'weak' END AS status, confusions FROM r")
def per_type_report(spark, sf_dir):
    """The types that occur; the report itself has a row for each of the 46."""
    out = metrics.per_type_report(*span_sets(spark, sf_dir), min_support=1).where("gold > 0").drop("type_no")
    return out.select("type", "gold", "hit", "boundary_only", "missed", "spurious", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")), "status", "confusions")


@query(f"WITH {GP}, {REPORT_SQL} SELECT type, CASE WHEN type = 'COORD' THEN 'little to learn from' WHEN boundary_only >= missed THEN 'types mixed up' ELSE 'boundaries missed' END AS cause, CASE WHEN 2.0 * hit / (gold + hit + spurious) >= 0.8 THEN 'none' WHEN type = 'COORD' THEN 'add sentences' WHEN boundary_only > missed THEN 'add sentences that tell it from ' || split_part(confusions, ':', 1) ELSE 'add longer sentences with more spans' END AS action, round(round(2.0 * hit / (gold + hit + spurious), 9) - 0.5, 3) AS change FROM r")
def report_causes(spark, sf_dir):
    """Causes, actions and the change against an earlier report."""
    gold, pred = span_sets(spark, sf_dir)
    trained = spark.createDataFrame([("DATE", 1000), ("TIME", 500), ("COORD", 5)], "type string, n_train long")
    before = gold.select("type").distinct().withColumn("f1", F.lit(0.5))
    return metrics.with_causes(metrics.per_type_report(gold, pred, min_support=1).where("gold > 0"), trained, before).select("type", "cause", "action", "change")


@query(f"WITH {GP}, m AS (SELECT gold.id, gold.s, gold.e, gold.type AS g, pred.type AS p FROM gold LEFT JOIN pred USING (id, s, e)), k AS (SELECT *, coalesce(g = p, FALSE) AS ok, row_number() OVER (PARTITION BY g, coalesce(g = p, FALSE) ORDER BY id, s, e) AS r FROM m) SELECT g AS type, coalesce(string_agg(CASE WHEN ok THEN 'w' || s END, '; ' ORDER BY r), '') AS \"right\", coalesce(string_agg(CASE WHEN NOT ok THEN 'w' || s || ' -> ' || coalesce(p, 'nothing') END, '; ' ORDER BY r), '') AS wrong FROM k WHERE r <= 2 GROUP BY g")
def report_examples(spark, sf_dir):
    """The first two spans of each type that were found, and that were not."""
    gold, pred = span_sets(spark, sf_dir)
    pos = F.explode(F.sequence("start", "end"))
    texts = gold.select("id", pos.alias("pos")).select("id", "pos", F.concat(F.lit("w"), F.col("pos").cast("string")).alias("word"))
    out = metrics.examples(gold, pred, texts)
    first = lambda c: F.regexp_replace(c, r"(w[0-9]+)(?: w[0-9]+)*", "$1")  # noqa: E731  a span's first word stands for it
    return out.select("type", first(F.col("right")).alias("right"), first(F.col("wrong")).alias("wrong"))


RECORDS_SQL = f"r AS (SELECT doc_id AS id, {TYPES_SQL.format('doc_id')} AS type, CAST(doc_id AS VARCHAR) AS gold, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE CAST(doc_id AS VARCHAR) END AS pred FROM labels)"


def records(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "labels").select((F.col("doc_id") % 50).alias("id"), _three(F.col("doc_id")).alias("type"), d.alias("gold"), F.when(F.col("doc_id") % 5 == 0, "x").otherwise(d).alias("pred"), d.alias("raw"), F.when(F.col("toxic") == 1, "O").otherwise("DATE").alias("gold_type"), F.lit(None).cast("boolean").alias("must_keep"))


@query(f"WITH {RECORDS_SQL} SELECT type, count(*) FILTER (gold = pred) AS hit, count(*) AS n, round(count(*) FILTER (gold = pred) / count(*), 9) AS accuracy FROM r GROUP BY ROLLUP (type)")
def exact_accuracy(spark, sf_dir):
    return metrics.exact_accuracy(records(spark, sf_dir)).select("type", "hit", "n", F.round("accuracy", 9).alias("accuracy"))


@query(f"WITH {RECORDS_SQL} SELECT count(*) FILTER (gold = pred) AS hit, count(*) AS n, round(count(*) FILTER (gold = pred) / count(*), 9) AS accuracy FROM r WHERE type = 'COORD'")
def critical_accuracy(spark, sf_dir):
    return metrics.critical_accuracy(records(spark, sf_dir)).select("hit", "n", F.round("accuracy", 9).alias("accuracy"))


@query("SELECT count(*) FILTER (doc_id % 5 = 0) AS changed, count(*) AS n, round(count(*) FILTER (doc_id % 5 = 0) / count(*), 9) AS rate FROM labels WHERE toxic = 1")
def false_normalization(spark, sf_dir):
    return metrics.false_normalization_rate(records(spark, sf_dir)).select("changed", "n", F.round("rate", 9).alias("rate"))


@query("WITH u AS (SELECT doc_id % 50 AS id, bool_and(doc_id % 3 <> 2 OR doc_id % 5 <> 0) AS ok FROM labels GROUP BY 1) SELECT count(*) FILTER (ok) AS hit, count(*) AS n FROM u")
def critical_utterances(spark, sf_dir):
    return metrics.critical_utterance_exact(records(spark, sf_dir)).select("hit", "n")


PUNCT_SQL = "p AS (SELECT CASE doc_id % 4 WHEN 0 THEN 'O' WHEN 1 THEN 'COMMA' WHEN 2 THEN 'PERIOD' ELSE 'QUESTION' END AS gold, CASE (doc_id + CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END) % 4 WHEN 0 THEN 'O' WHEN 1 THEN 'COMMA' WHEN 2 THEN 'PERIOD' ELSE 'QUESTION' END AS pred FROM documents)"


@query(f"WITH {PUNCT_SQL}, l AS (SELECT unnest(['COMMA', 'PERIOD', 'QUESTION']) AS label), c AS (SELECT label, count(*) FILTER (gold = label AND pred = label) AS tp, count(*) FILTER (gold <> label AND pred = label) AS fp, count(*) FILTER (gold = label AND pred <> label) AS fn FROM p, l GROUP BY label) SELECT label, tp, fp, fn, round(2.0 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c")
def punctuation_f1(spark, sf_dir):
    lab = lambda c: F.get(F.array(*map(F.lit, ["O", "COMMA", "PERIOD", "QUESTION"])), (c % 4).cast("int"))
    d = F.col("doc_id")
    pairs = table(spark, sf_dir, "documents").select(lab(d).alias("gold"), lab(d + F.when(d % 6 == 0, 1).otherwise(0)).alias("pred"))
    return metrics.label_f1(pairs).select("label", "tp", "fp", "fn", F.round("f1", 9).alias("f1"))


@query("WITH b AS (SELECT a.item_id, trim(trim(regexp_replace(a.text, '\\s+', ' ', 'g')), ' .,;:!?\"''()[]') AS g, trim(trim(regexp_replace(b.text, '\\s+', ' ', 'g')), ' .,;:!?\"''()[]') AS p FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1), t AS (SELECT item_id, 'g' AS side, unnest(string_split(g, ' ')) AS w FROM b UNION ALL SELECT item_id, 'p', unnest(string_split(p, ' ')) FROM b), c AS (SELECT item_id, w, count(*) FILTER (side = 'g') AS cg, count(*) FILTER (side = 'p') AS cp FROM t GROUP BY item_id, w) SELECT item_id, round(2.0 * sum(least(cg, cp)) / sum(cg + cp), 9) AS f1 FROM c GROUP BY item_id")
def token_f1(spark, sf_dir):
    """Each benchmark item against the next."""
    b = table(spark, sf_dir, "benchmark")
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("next"))
    return b.join(other, "item_id").select("item_id", F.round(metrics.token_f1(F.col("text"), F.col("next")), 9).alias("f1"))


@query(f"WITH {GP}, m AS (SELECT gold.type AS gold, pred.type AS pred FROM gold JOIN pred USING (id, s, e)) SELECT gold, pred, count(*) AS n FROM m WHERE gold <> pred GROUP BY ALL ORDER BY n DESC, gold, pred LIMIT 20")
def confusion_pairs(spark, sf_dir):
    gold, pred = span_sets(spark, sf_dir)
    m = gold.withColumnRenamed("type", "gold").join(pred.withColumnRenamed("type", "pred"), ["id", "start", "end"]).select("gold", "pred")
    return metrics.confusion(m)


MATRIX_TYPES = ["click", "error", "purchase", "signup"]
MATRIX_SQL = """
WITH p AS (SELECT CASE WHEN event_type IN ('click', 'error', 'purchase', 'signup') THEN event_type ELSE 'other' END AS gold,
                  CASE WHEN before IN ('click', 'error', 'purchase', 'signup') THEN before ELSE 'other' END AS pred
           FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)),
n AS (SELECT coalesce(gold, 'total') AS gold, coalesce(pred, 'total') AS pred, count(*) AS n FROM p GROUP BY CUBE (gold, pred))
SELECT gold, "click", "error", purchase, signup, "other", total FROM (PIVOT n ON pred IN ('click', 'error', 'purchase', 'signup', 'other', 'total') USING sum(n)::BIGINT GROUP BY gold)
"""


@query(MATRIX_SQL)
def confusion_matrix(spark, sf_dir):
    """Types of a user's events against those of the events before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = table(spark, sf_dir, "events").select(F.col("event_type").alias("gold"), F.lag("event_type").over(w).alias("pred"))
    return metrics.confusion_matrix(pairs, MATRIX_TYPES).drop("type_no")


SWEEP = "r AS (SELECT event_type AS type, round((event_id % 100) / 100.0, 4) AS c, CASE WHEN (event_id * 7) % 100 < event_id % 100 + 20 THEN 1 ELSE -1 END AS v FROM events)"


@query(f"WITH {SWEEP}, cand AS (SELECT DISTINCT type, c FROM r WHERE c BETWEEN 0.2 AND 0.95 UNION SELECT DISTINCT type, unnest([0.2, 0.95]) FROM r), g AS (SELECT cand.type, cand.c, coalesce(sum(r.v), 0) AS gain FROM cand LEFT JOIN r ON r.type = cand.type AND r.c >= cand.c GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY gain DESC, c DESC) AS n FROM g) SELECT type, CAST(c AS DOUBLE) AS threshold, CAST(gain AS BIGINT) AS gain FROM b WHERE n = 1")
def best_thresholds(spark, sf_dir):
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("type"), ((e % 100) / 100).alias("confidence"), ((e * 7) % 100 < e % 100 + 20).alias("ok"))
    return metrics.best_threshold(rows).select("type", "threshold", "gain")


# --- corpus operators ------------------------------------------------------------------------------------------------


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN text IS NULL THEN 'no text' WHEN length(text) < 200 THEN 'short' WHEN regexp_matches(text, '[0-9]') THEN 'digits' WHEN lang <> 'en' THEN 'other language' ELSE 'kept' END AS reason FROM documents) GROUP BY reason")
def gate_reasons(spark, sf_dir):
    x = F.col("text")
    why = corpus.reason(("no text", x.isNull()), ("short", F.length(x) < 200), ("digits", x.rlike("[0-9]")), ("other language", F.col("lang") != "en"))
    return corpus.reason_counts(table(spark, sf_dir, "documents").select(F.coalesce(why, F.lit("kept")).alias("reason")))


@query("SELECT doc_id, hash_id FROM (SELECT doc_id, substr(sha1(text), 1, 16) AS hash_id, row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) AS n FROM documents WHERE text IS NOT NULL) WHERE n = 1")
def dedup_first(spark, sf_dir):
    df = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", corpus.hash_id(F.col("text")).alias("hash_id"))
    return corpus.first_by_key(df, F.col("hash_id"), ["doc_id"])


@query("SELECT DISTINCT d.doc_id FROM documents d WHERE d.lang IS NOT NULL AND d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)")
def without_heldout(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("lang is not null and doc_id is not null").select("doc_id").distinct()
    return corpus.without_heldout(docs, table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")


@query("SELECT l.doc_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.doc_id % 3 <> 0)")
def cache_todo(spark, sf_dir):
    payload = F.concat(F.lit("ask "), F.col("doc_id").cast("string"))
    cache = table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), F.sha2(payload.cast("binary"), 256).alias("fingerprint"))
    asked = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), payload.alias("payload"))
    return corpus.todo(asked, cache).select(F.col("id").alias("doc_id"))


def sentences_of(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "documents").where("text is not null")
    return df.select("doc_id", F.concat(F.col("source"), F.lit("|"), F.col("lang")).alias("leak_key"), F.substring_index("text", ".", 1).alias("signature"))


#: The order of a key: 60 bits of md5.
ORDER_SQL = "CAST('0x' || substr(md5('%s|' || %s), 1, 15) AS BIGINT)"
NULL_SQL = "coalesce(%s, chr(0) || 'null')"
#: The shares of build_splits over a table d(id, e, t) of groups.
SPLITS_SQL = f"""e AS (
  SELECT e FROM (SELECT e, row_number() OVER (ORDER BY {ORDER_SQL % ('13|entity_holdout_dev', 'e')}, e) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT e FROM d))
  WHERE r <= least(greatest(1, CAST(floor(n * CAST(0.12 AS DOUBLE)) AS BIGINT)), greatest(0, n - greatest(1, n // 2)))
), left1 AS (SELECT * FROM d WHERE e NOT IN (SELECT e FROM e)), t AS (
  SELECT t FROM (SELECT t, row_number() OVER (ORDER BY {ORDER_SQL % ('13|template_holdout_dev', 't')}, t) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT t FROM left1))
  WHERE r <= least(greatest(1, CAST(floor(n * CAST(0.12 AS DOUBLE)) AS BIGINT)), greatest(0, n - greatest(1, n // 2)))
), left2 AS (SELECT * FROM left1 WHERE t NOT IN (SELECT t FROM t)), v AS (
  SELECT e FROM (SELECT e, row_number() OVER (ORDER BY {ORDER_SQL % ('13|random_dev', 'e')}, e) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT e FROM left2))
  WHERE r <= least(greatest(1, CAST(floor(n * CAST(0.12 AS DOUBLE)) AS BIGINT)), greatest(0, n - 1))
), made AS (
  SELECT *, CASE WHEN e IN (SELECT e FROM e) THEN 'entity_holdout_dev' WHEN t IN (SELECT t FROM t) THEN 'template_holdout_dev' WHEN e IN (SELECT e FROM v) THEN 'random_dev' ELSE 'train' END AS split FROM d
)"""


@query(f"WITH d AS (SELECT doc_id, {NULL_SQL % "source || '|' || lang"} AS e, {NULL_SQL % "split_part(text, '.', 1)"} AS t FROM documents WHERE text IS NOT NULL), {SPLITS_SQL} SELECT doc_id, split FROM made")
def leakage_safe_splits(spark, sf_dir):
    return corpus.build_splits(sentences_of(spark, sf_dir)).select("doc_id", "split")


LEAKS_SQL = "d AS (SELECT doc_id, source || '|' || lang AS leak_key, split_part(text, '.', 1) AS signature, CASE doc_id % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'random_dev' WHEN 2 THEN 'entity_holdout_dev' ELSE 'template_holdout_dev' END AS split FROM documents WHERE text IS NOT NULL)"


@query(f"WITH {LEAKS_SQL} SELECT 'entity' AS kind, leak_key AS \"key\" FROM d WHERE split <> 'template_holdout_dev' GROUP BY leak_key HAVING count(DISTINCT split) > 1 UNION ALL SELECT DISTINCT 'template', signature FROM d WHERE split = 'template_holdout_dev' AND signature IN (SELECT signature FROM d WHERE split = 'train')")
def split_leakage(spark, sf_dir):
    """Leaks of a division that pays no heed to groups."""
    split = F.get(F.array(*map(F.lit, corpus.SPLITS)), (F.col("doc_id") % 4).cast("int"))
    return corpus.leakage(sentences_of(spark, sf_dir).withColumn("split", split))


@query("SELECT CAST(0 AS BIGINT) AS n_leaks")
def splits_without_leakage(spark, sf_dir):
    """No group of the splits that are made crosses where it may not."""
    return corpus.leakage(corpus.build_splits(sentences_of(spark, sf_dir))).agg(F.count("*").alias("n_leaks"))


@query(f"WITH d AS (SELECT l_orderkey, l_linenumber, {NULL_SQL % "CAST(l_partkey AS VARCHAR)"} AS e, l_returnflag || '/' || l_linestatus || '/' || CAST(l_quantity AS INT) AS t FROM lineitem), {SPLITS_SQL} SELECT split, count(*) AS n_rows, count(DISTINCT e) AS n_entities, count(DISTINCT t) AS n_templates FROM made GROUP BY split")
def split_shares(spark, sf_dir):
    """Rows and groups of each split of the lineitems, parts being entities: the hold-outs have their shares of the groups."""
    template = F.concat_ws("/", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("int"))
    made = corpus.build_splits(table(spark, sf_dir, "lineitem").select("l_partkey", template.alias("t")), "l_partkey", "t")
    return made.groupBy("split").agg(F.count("*").alias("n_rows"), F.count_distinct("l_partkey").alias("n_entities"), F.count_distinct("t").alias("n_templates"))


REBALANCED_SQL = f"""
WITH d AS (SELECT doc_id AS id, lang, {ORDER_SQL % ('13', 'CAST(doc_id AS VARCHAR)')} AS h FROM documents WHERE doc_id IS NOT NULL),
taken AS (SELECT id, lang, count(*) OVER (PARTITION BY lang ORDER BY h, CAST(id AS VARCHAR)) AS n FROM d WHERE id % 4 <> 0),
had AS (SELECT lang, count(*) AS n FROM d WHERE id % 4 = 0 GROUP BY lang)
SELECT id, lang FROM d WHERE id % 4 = 0
UNION ALL SELECT id, t.lang FROM taken t LEFT JOIN had ON t.lang = had.lang WHERE t.lang IS NULL OR t.lang NOT IN ('fr', 'de') OR t.n + coalesce(had.n, 0) <= 100
"""
TYPE_CAPS = {"HOUSEHOLD": 200, "BUILDING": 120, "n0": 300, "n1": 250, "n2": 10_000, "rich": 700}
SEVERAL_SQL = f"""
WITH RECURSIVE source AS (
  SELECT c_custkey AS id, list_concat([c_mktsegment, 'n' || c_nationkey % 4], CASE WHEN c_acctbal > 4000 THEN ['rich'] ELSE [] END) AS types, {ORDER_SQL % ('13', 'CAST(c_custkey AS VARCHAR)')} AS h FROM customer
), rest AS (
  SELECT id, types, row_number() OVER (ORDER BY h, CAST(id AS VARCHAR)) AS n FROM source WHERE id % 3 <> 0
), caps(type, most) AS (
  VALUES {", ".join(f"('{c}', {n})" for c, n in TYPE_CAPS.items())}
), walk AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, FALSE AS taken,
         (SELECT map(list(type), list(most - (SELECT count(*) FROM source WHERE id % 3 = 0 AND list_contains(types, type)))) FROM caps) AS room
  UNION ALL
  SELECT n, id, taken, map_from_entries(list_transform(map_entries(room), lambda e: {{'key': e.key, 'value': e.value - CASE WHEN taken AND list_contains(types, e.key) THEN 1 ELSE 0 END}})) FROM (
    SELECT r.n, r.id, r.types, w.room, len(list_filter(r.types, lambda x: coalesce(w.room[x] > 0, TRUE))) > 0 AS taken FROM walk w JOIN rest r ON r.n = w.n + 1)
)
SELECT id FROM source WHERE id % 3 = 0 UNION ALL SELECT id FROM walk WHERE taken
"""


@query(SEVERAL_SQL)
def rebalanced_types(spark, sf_dir):
    """Customers of several types each; SQL takes them one by one."""
    types = F.array_compact(F.array("c_mktsegment", F.concat(F.lit("n"), F.col("c_nationkey") % 4), F.when(F.col("c_acctbal") > 4000, "rich")))
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), types.alias("types"))
    return corpus.rebalance(d.where("id % 3 = 0"), d, TYPE_CAPS).select("id")


@query(REBALANCED_SQL)
def rebalanced(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("doc_id is not null").select(F.col("doc_id").alias("id"), F.array("lang").alias("types"))
    return corpus.rebalance(d.where("id % 4 = 0"), d, {"fr": 100, "de": 100}).select("id", F.get("types", F.lit(0)).alias("lang"))


@query("SELECT event_id, CAST((row_number() OVER (ORDER BY ts, event_id) - 1) // 500 AS BIGINT) AS batch FROM events")
def batches(spark, sf_dir):
    return corpus.batches(table(spark, sf_dir, "events").select("event_id", "ts"), 500, ["ts", "event_id"]).select("event_id", "batch")


@query("SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 6) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW)")
def rate_window(spark, sf_dir):
    """Events of a user in the 60 seconds before each."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-60_000_000, 0)
    df = table(spark, sf_dir, "events").withColumn("us", micros)
    return df.select("event_id", F.count("*").over(w).alias("n"), F.round(F.sum("value").over(w), 6).alias("total"))


LIMITS = limiter.Limits(calls=3, tokens=150, daily=3, window=86_400_000_000)
LIMITER_SQL = """
WITH RECURSIVE asked AS (
  SELECT event_id, user_id, epoch_us(ts) AS us, CAST(floor(value) AS BIGINT) AS tok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events
), walk AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS moment, CAST(NULL AS VARCHAR) AS refused,
         CAST([] AS STRUCT(t BIGINT, k BIGINT)[]) AS ring, CAST(-1 AS BIGINT) AS day, CAST(0 AS BIGINT) AS used, CAST(-1 AS BIGINT) AS latest FROM asked
  UNION ALL
  SELECT user_id, n, event_id, moment, refused, CASE WHEN moment IS NULL THEN ring ELSE list_append(list_filter(ring, lambda x: moment - x.t <= 86400000000), {'t': moment, 'k': tok}) END,
         CASE WHEN moment IS NULL THEN day ELSE moment // 86400000000 END, CASE WHEN moment IS NULL THEN used WHEN moment // 86400000000 = day THEN used + 1 ELSE 1 END, coalesce(moment, latest)
  FROM (
    SELECT *, CASE WHEN refused IS NULL THEN list_filter(list_sort(list_prepend(early, list_filter(list_transform(ring, lambda x: x.t + 86400000001), lambda c: c > early))),
        lambda c: len(list_filter(ring, lambda x: c - x.t <= 86400000000)) < 3 AND coalesce(list_sum(list_transform(list_filter(ring, lambda x: c - x.t <= 86400000000), lambda x: x.k)), 0) + tok <= 150)[1] END AS moment
    FROM (
      SELECT a.user_id, a.n, a.event_id, a.tok, w.ring, w.day, w.used, w.latest, greatest(a.us, w.latest) AS early,
             CASE WHEN a.tok > 150 THEN 'tokens' WHEN greatest(a.us, w.latest) // 86400000000 = w.day AND w.used >= 3 THEN 'day' END AS refused
      FROM walk w JOIN asked a ON a.user_id = w.user_id AND a.n = w.n + 1))
)
SELECT event_id, coalesce(moment, -1) AS admitted_us, coalesce(refused, '') AS refused FROM walk WHERE n > 0
"""


def answer(us: Column) -> list[Column]:
    return [F.coalesce(us, F.lit(-1)).alias("admitted_us"), F.coalesce("refused", F.lit("")).alias("refused")]


@query(LIMITER_SQL)
def limiter_admissions(spark, sf_dir):
    """When the events of a user are admitted: three a day and window, and their values together."""
    asked = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.floor("value").alias("tokens"))
    return limiter.admissions(asked, "user_id", "ts", "tokens", "event_id", LIMITS).select("event_id", *answer(F.unix_micros("admitted_at")))


@query(LIMITER_SQL.rstrip() + " AND event_id IN (SELECT event_id FROM events WHERE epoch_us(ts) // 1000 < (SELECT max(epoch_us(ts)) // 1000 - 3600000 FROM events))")
def stream_limiter(spark, sf_dir):
    """The same over a stream, up to its last watermark."""
    events = _events(spark, sf_dir).withColumn("tokens", F.floor("value"))
    out = _replayed(spark, limits.admissions(events, "user_id", "ts", "tokens", "event_id", LIMITS, "1 hour"))
    return out.select(F.col("request").cast("long").alias("event_id"), *answer(F.col("admitted_us")))


@query("""
WITH d AS (SELECT doc_id, lang, text, source, CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END AS now FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN lang = 'en' AND doc_id % 2 = 0 AND doc_id % 10 <> 0 THEN 'old' ELSE 'none' END AS version,
       CASE WHEN doc_id % 3 = 0 THEN length(now) WHEN lang = 'en' AND doc_id % 2 = 0 AND doc_id % 10 <> 0 THEN -length(text) ELSE 0 END AS answer
FROM d
""")
def answer_store(spark, sf_dir):
    """Answers of two versions: those of the old are taken over where the language is en and the text has not changed since,
    a batch is run twice, a run is killed before its commit, and all is compacted."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null and text is not null").select("doc_id", "lang", "text")
    now = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    store = AnswerStore(spark, stored.new_folder(spark, "answers"), "int", ("text",), "doc_id", "long")
    first = docs.where("doc_id % 2 = 0").withColumn("answer", -F.length("text"))
    store.commit(first, "old", "batch-1")
    store.commit(first.withColumn("answer", F.lit(7)), "old", "batch-1")  # a retry
    later = now.where("doc_id % 3 = 0").withColumn("answer", F.length("text"))
    store.commit(later.where("doc_id % 2 = 0").withColumn("answer", F.lit(8)), "new", "batch-2")
    store.commit(later, "new", "batch-3")
    later.withColumn("answer", F.lit(9)).write.parquet(f"{store.path}/data/killed")
    store.migrate(now, F.coalesce(F.col("lang") == "en", F.lit(False)), "old", "new")
    store.compact()
    store.vacuum()
    done = store.answered(now, "new").select("doc_id", F.when(F.col("answer") < 0, "old").otherwise("new").alias("version"), "answer")
    return done.unionByName(store.todo(now, "new").select("doc_id", F.lit("none").alias("version"), F.lit(0).alias("answer")))


@query("SELECT coalesce(outcome, 'kept') AS outcome, count(*) AS n, count(*) OVER () AS n_outcomes, (SELECT count(*) FROM documents) AS n_observed FROM (SELECT CASE WHEN text IS NULL THEN 'no text' WHEN length(text) > 5000 THEN 'long' WHEN lang = 'de' THEN 'language' END AS outcome FROM documents) GROUP BY 1")
def side_outputs(spark, sf_dir):
    """Rows kept and refused in one pass, counted on the way and in what was written."""
    folder = stored.new_folder(spark, "outcomes")
    why = corpus.reason(("no text", F.col("text").isNull()), ("long", F.length("text") > 5000), ("language", F.col("lang") == "de"))
    seen = writers.write_outcomes(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), why, folder)
    kept, refused = writers.read_outcomes(spark, folder, "doc_id long, lang string, text string")
    counts = kept.agg(F.count("*").alias("n")).select(F.lit("kept").alias("outcome"), "n").where("n > 0").unionByName(refused.groupBy(F.col("reason").alias("outcome")).agg(F.count("*").alias("n")))
    return counts.withColumns({"n_outcomes": F.count("*").over(Window.partitionBy(F.lit(1))), "n_observed": F.lit(seen["rows"])})


@query("SELECT event_type AS type, count(*) AS n FROM events GROUP BY 1")
def type_coverage_whole(spark, sf_dir):
    """Every type and how often it occurs."""
    return corpus.coverage(table(spark, sf_dir, "events").select(F.array("event_type").alias("types")), "types")


@query("SELECT type, n FROM (SELECT event_type AS type, count(*) AS n FROM events GROUP BY 1) ORDER BY n DESC, type LIMIT 3")
def type_coverage(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(F.explode(F.array("event_type")).alias("type"))
    return df.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type").limit(3)


@query("SELECT DISTINCT item_id FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM benchmark WHERE item_id % 2 = 0) UNION SELECT item_id FROM benchmark WHERE item_id % 4 = 0")
def set_operations(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id")
    return b.exceptAll(b.where("item_id % 2 = 0")).distinct().unionByName(b.where("item_id % 4 = 0")).distinct()


@query("SELECT o_orderkey, 'DATE' AS label FROM orders")
def candidate_labels(spark, sf_dir):
    """Types found from the written form alone, checked by their normalizers."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("written"), V.date(F.col("o_orderdate")).alias("spoken"))
    return corpus.label_spans(df, Normalization(spark)).select("o_orderkey", "label")


@query("WITH w AS (SELECT conv_id, turn, string_split_regex(lower(text), '\\s+') AS ws FROM conversations WHERE text IS NOT NULL), p AS (SELECT conv_id, turn, len(ws) AS n, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) AS pairs FROM w) SELECT conv_id, turn, CAST(n - len(list_filter(pairs, lambda x: x IN ('of the', 'in the', 'and the', 'de la', 'mit der'))) AS INT) AS n_words, TRUE AS reversible FROM p")
def compound_words(spark, sf_dir):
    words = F.split(F.lower("text"), r"\s+")
    vocabulary = ["of_the", "in_the", "and_the", "de_la", "mit_der</w>"]
    seg = segment.segmenter(spark, segment.lexicon(vocabulary))
    df = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", words.alias("tokens"))
    df = df.withColumn("model", seg("tokens"))
    return df.select("conv_id", "turn", F.size("model").alias("n_words"), segment.reversible(F.col("tokens"), F.col("model")).alias("reversible"))


#: Merges of the query's vocabulary, in the order of their ranks.
MERGES = [("t", "h"), ("th", "e</w>"), ("e", "r"), ("o", "n"), ("e", "n"), ("i", "on"), ("t", "ion"), ("er", "</w>"), ("d", "e</w>"), ("c", "h</w>"), ("a", "n"), ("l", "l"), ("ti", "on"), ("o", "u"), ("e", "e")]
MERGED_SQL = "replace(%s, ' {0}  {1} ', ' {0}{1} ')"
SUBWORDS_SQL = f"""
WITH w AS (
  SELECT conv_id, turn, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS word FROM conversations WHERE text IS NOT NULL
), spaced AS (
  SELECT conv_id, turn, word, list_aggregate(list_transform(string_split(word[:-2], ''), lambda c: ' ' || c || ' '), 'string_agg', '') || ' ' || word[-1:] || '</w> ' AS s FROM w WHERE length(word) > 1
  UNION ALL SELECT conv_id, turn, word, ' ' || word || '</w> ' FROM w WHERE length(word) = 1
), merged AS (
  SELECT conv_id, turn, word, (length(@) - length(replace(@, '  ', ''))) // 2 + 1 AS n FROM spaced
)
SELECT conv_id, turn, count(*) AS n_words, CAST(sum(n) + 2 AS BIGINT) AS n_subwords, round(sum(CAST(length(word) AS DOUBLE) / n), 6) AS letters FROM merged GROUP BY conv_id, turn
""".replace("@", reduce(lambda s, m: MERGED_SQL.format(*m) % s, MERGES, "s"))


@query(SUBWORDS_SQL)
def subword_vectors(spark, sf_dir):
    """Words to subwords, a vector a subword (the letters in it), and the mean of each word's again, through windows."""
    symbols = sorted({*(a + b for a, b in MERGES), "<s>", "</s>", "<unk>"})
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    encode = subwords.encoder(spark, subwords.Subwords({t: i for i, t in enumerate(symbols)}, MERGES, begin_mark="<s>", end_mark="</s>"))
    df = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", words.alias("words"))
    df = S.settled(df.withColumn("e", encode("words")), conv_id=F.col("conv_id"), turn=F.col("turn"), words=F.col("words"), e=F.col("e"), counts=subwords.counts(F.col("e")))
    # the letters of a word, dealt out evenly to its subwords; a subword's place is found from its word's
    letters = F.flatten(F.concat(F.array(F.array(F.array(F.lit(0.0)))), F.zip_with("words", "counts", lambda w, n: F.array_repeat(F.array(F.length(w).cast("double") / n), n)), F.array(F.array(F.array(F.lit(0.0))))))
    df = df.withColumn("pooled", subwords.word_vectors(F.col("e"), letters, 1)).withColumn("windows", windows.plan_windows(F.col("counts")))
    parts = df.select("conv_id", "turn", F.size("words").alias("n_words"), F.size("e.ids").alias("n_subwords"), "pooled", F.posexplode("windows").alias("window_no", "w"))
    pieces = parts.select(F.struct("conv_id", "turn").alias("id"), "n_words", "n_subwords", "window_no", "w.word_start", "w.word_end", F.posexplode(F.slice("pooled", F.col("w.word_start") + 1, F.col("w.word_end") - F.col("w.word_start"))).alias("at", "value"))
    whole = windows.stitch(pieces.withColumn("word", F.col("word_start") + F.col("at")))
    return whole.groupBy("id.conv_id", "id.turn").agg(F.count("*").alias("n_words"), F.first("n_subwords").cast("long").alias("n_subwords"), F.round(F.sum(F.get("value", F.lit(0))), 6).alias("letters"))


@query()
def diff_regions(spark, sf_dir):
    """Each user turn against the next turn."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.lower("text").alias("spoken"))
    r = c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.posexplode(diff.diff_regions("text", "spoken")).alias("n", "r"))
    return r.select("conv_id", "turn", "n", "r.start", "r.end", "r.written")


# --- streaming --------------------------------------------------------------------------------------------------------


def _events(spark, sf_dir) -> DataFrame:
    """The table as a stream: a folder of files, or the one file among others in its folder."""
    path, schema = f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema
    alone = table(spark, sf_dir, "events").inputFiles()[0].endswith("/events.parquet")
    reader = spark.readStream.schema(schema).format("parquet")
    return reader.option("pathGlobFilter", "events.parquet").load(sf_dir) if alone else reader.load(path)


def _replayed(spark, stream: DataFrame) -> DataFrame:
    folder = stored.new_folder(spark, "stream")
    streams.replay(stream, f"{folder}/out", f"{folder}/state")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("SELECT event_id, lpad(CAST(event_id % 360 AS VARCHAR), 3, '0') || '°' AS written FROM events")
def stream_normalize(spark, sf_dir):
    """Normalisation over a stream of all events, against the batch form."""
    spoken = _events(spark, sf_dir).select("event_id", F.lit("HEADING").alias("type"), V.digits(pad(k("event_id", 360), 3)).alias("text"))
    return _replayed(spark, streams.normalize_stream(spoken, Normalization(spark)).select("event_id", F.col("result.normalized").alias("written")))


@query("SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2 HAVING date_trunc('day', any_value(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM events)")
def stream_rates(spark, sf_dir):
    """Events of each type by day, those days that the watermark has closed."""
    source = _events(spark, sf_dir).select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    return _replayed(spark, streams.rate(source, "event_type", "ts", "1 day")).select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 6).alias("total"))


@query("SELECT DISTINCT event_type, user_id % 10 AS bucket, CAST(1 AS BIGINT) AS n_kept, TRUE AS is_one_of_them FROM events")
def stream_first_seen(spark, sf_dir):
    """Of each key, which holds hundreds of events, the stream lets exactly one through."""
    source = _events(spark, sf_dir).withColumn("bucket", F.col("user_id") % 10)
    seen = _replayed(spark, streams.first_seen(source.select("event_type", "bucket", "event_id", F.col("ts").cast("timestamp").alias("ts")), ["event_type", "bucket"], "ts", "400 days").select("event_type", "bucket", "event_id"))
    own = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("t"), (F.col("user_id") % 10).alias("b"))
    one = seen.join(own, "event_id", "left").withColumn("ok", (F.col("t") == F.col("event_type")) & (F.col("b") == F.col("bucket")))
    return one.groupBy("event_type", "bucket").agg(F.count("*").alias("n_kept"), F.coalesce(F.bool_and("ok"), F.lit(False)).alias("is_one_of_them"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
