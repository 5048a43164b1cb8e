"""Readers: every input is read by Spark's own sources, so any file system will do, and broken records stay as rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import spans as S
from ..operators.stored import keep
from . import schemas


def read_jsonl(spark: SparkSession, path: str, schema: str = schemas.UTTERANCE) -> DataFrame:
    """One record a line; a broken line has nulls and its text in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def read_articles(spark: SparkSession, root: str) -> DataFrame:
    """Nested documents below a folder, one a file, as one row a chunk: file, topic, chunk_no, text, issues, variants."""
    docs = spark.read.schema(f"{schemas.ARTICLE}, _corrupt_record string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
    rows = docs.select(F.input_file_name().alias("file"), F.col("article.topic").alias("topic"), F.posexplode_outer("chunks").alias("chunk_no", "c"), "_corrupt_record")
    variants = F.transform(F.coalesce("c.all_text_results", F.array().cast("array<struct<type:string,text:string>>")), lambda x: x["text"])
    return rows.select("file", "topic", "chunk_no", F.col("c.text").alias("text"), F.col("c.validation_issues").alias("issues"), variants.alias("variants"), F.col("_corrupt_record").isNotNull().alias("broken"))


def read_text_tree(spark: SparkSession, root: str) -> DataFrame:
    """topic (the folder), idx (the number in brackets in the file's name, or null) and text of all text files."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root, wholetext=True).select("value", F.url_decode(F.col("_metadata.file_path")).alias("path"))
    idx = F.regexp_extract("path", r"\(([0-9]+)\)[^/]*$", 1).try_cast("int")
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]*$", 1).alias("topic"), idx.alias("idx"), F.col("value").alias("text"))


def sentences(df: DataFrame, text: str = "text", min_words: int = 3) -> DataFrame:
    """df with one row a sentence: n (its place) and sentence, without speaker prefixes and quotes."""
    parts = df.select("*", F.posexplode(F.split(F.col(text), r"(?<=[.!?])\s+")).alias("n", "sentence"))
    clean = F.trim(F.regexp_replace(F.regexp_replace("sentence", r"^\s*(?:[\p{Lu}][\p{L} ]{0,30}:|[-–])\s+", ""), "[\"“”]", ""))
    return parts.withColumn("sentence", clean).where(F.size(F.split("sentence", r"\s+")) >= min_words)


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """BIO bundles whose arrays may be JSON strings: id, split, tokens, bio_tags, normalized_text."""
    df = read_jsonl(spark, path, schemas.BIO_BUNDLE)
    arr = lambda c: F.coalesce(F.col(c), F.from_json(f"{c}_json", "array<string>"))
    return df.select("id", "split", arr("tokens").alias("tokens"), arr("bio_tags").alias("bio_tags"), "normalized_text")


def read_any_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Bundles of any of their layouts, for operators.converters.from_bundle(). Tokens that are objects come as their JSON."""
    return read_jsonl(spark, path, schemas.ANY_BUNDLE)


def variant_bundle(lines: DataFrame, line: str = "value") -> DataFrame:
    """Bundles of any of their layouts from lines of JSON, batch or stream, for operators.converters.from_bundle(). A record is a
    variant, whose parts are read where they are: tokens may be strings or objects, spans lists of numbers and names. A line
    that is no JSON has nulls. objects tells whether tokens are objects; tokens are then their texts."""
    df = lines.select(F.try_parse_json(line).alias("v"))
    get = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    text = lambda t, own: F.coalesce(F.try_variant_get(t, "$.text", "string"), own)
    tokens = get("tokens", "array<variant>")
    columns = {c: get(c, "string") for c in ("id", "normalized_text", "written", "source_type", "priority_group", "focus_family")}
    columns |= {c: get(c, "array<string>") for c in ("bio_tags", "punctuation_targets", "words", "punct")}
    columns |= {
        "spans": get("spans", "array<array<string>>"),
        "objects": F.coalesce(F.schema_of_variant(F.get(tokens, F.lit(0))).startswith("OBJECT"), F.lit(False)),
        "tokens": F.transform(tokens, lambda t: F.when(F.schema_of_variant(t).startswith("OBJECT"), text(t, F.lit(""))).otherwise(F.try_variant_get(t, "$", "string"))),
    }
    return df.select(*(c.alias(n) for n, c in columns.items()))


def read_variant_bundle(spark: SparkSession, path: str) -> DataFrame:
    return variant_bundle(spark.read.text(path))


def stream_variant_bundle(spark: SparkSession, path: str) -> DataFrame:
    return variant_bundle(spark.readStream.text(path))


def read_token_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Bundles of token objects with punctuation targets: id, words, punct, spans (null if the tags are no BIO), written."""
    df = read_jsonl(spark, path, schemas.TOKEN_BUNDLE)
    words = F.transform("tokens", lambda t: t["text"])
    return df.select("id", words.alias("words"), F.col("punctuation_targets").alias("punct"), S.bio_spans(F.col("bio_tags")).alias("spans"), F.col("normalized_text").alias("written"), F.col("source_type").alias("source"))


def read_old_corpus(spark: SparkSession, path: str, mapping: dict[str, str]) -> DataFrame:
    """Flat labels as spans of the new types; unmapped lists labels without one."""
    df = read_jsonl(spark, path, schemas.OLD_CORPUS)
    table = F.create_map(*(F.lit(x) for k, v in mapping.items() for x in (k, v)))
    mapped = F.transform(S.runs(F.col("itn_tags")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.try_element_at(table, s["type"]).alias("type")))
    unmapped = F.array_except(F.array_distinct("itn_tags"), F.array(*map(F.lit, ["O", *mapping])))
    return df.select(F.col("tokens").alias("words"), mapped.alias("spans"), F.col("punc_tags").alias("punct"), unmapped.alias("unmapped"))


def clean_line(text: Column) -> Column:
    """Lower case, without markup and leading numbering."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>|[*_`#]+", " "), r"^\s*(?:[0-9]+[.)]|[-•])\s+", ""), r"\s+", " ")))


def _plain_path(path: Column) -> Column:
    return F.regexp_replace(F.url_decode(path), "^file:/+", "/")


def read_inputs(spark: SparkSession, paths: list[str], min_words: int = 1) -> DataFrame:
    """First column of CSV files (without their first row) and lines of text files: file, line, the first of equal lines, without
    digits, in their order. paths are files or folders of them. All are one scan of lines, whatever their number; a line
    is a row, and a quoted first column ends on it."""
    path = F.col("_metadata.file_path")
    raw = spark.read.text(paths).select(_plain_path(path).alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value"))
    raw = keep(raw.withColumn("row", F.monotonically_increasing_id()), "lines")
    is_csv = F.lower("path").endswith(".csv")
    heads = raw.where(is_csv & (F.col("block") == 0) & (F.col("value") != "")).groupBy("path").agg(F.min("row").alias("row"))
    rows = raw.join(heads, ["path", "row"], "left_anti")
    quoted = F.replace(F.regexp_extract("value", '^\ufeff?"((?:[^"]|"")*)"', 1), F.lit('""'), F.lit('"'))
    first = F.when(F.col("value").rlike('^\ufeff?"'), quoted).otherwise(F.regexp_extract("value", "^\ufeff?([^,]*)", 1))
    df = rows.withColumn("line", clean_line(F.when(is_csv, first).otherwise(F.regexp_replace("value", "^\ufeff", ""))))
    # a row's path is one that was given, or in a folder that was
    given = {re.sub("^file:/+", "/", p).rstrip("/"): (i, p) for i, p in reversed(list(enumerate(paths)))}
    nos = F.create_map(*(F.lit(x) for k, (i, _) in given.items() for x in (k, i)))
    no = F.coalesce(F.try_element_at(nos, F.col("path")), F.try_element_at(nos, F.regexp_replace("path", "/[^/]*$", "")), F.lit(len(paths)))
    df = df.withColumn("__o", F.struct(no.alias("file_no"), "path", "block", "row"))
    df = df.where((F.size(F.split("line", " ")) >= min_words) & (F.col("line") != "") & ~F.col("line").rlike(r"\p{Nd}"))
    # of equal lines the first stays: by the order of the paths, then of the lines in a file
    found = df.groupBy("line").agg(F.min("__o").alias("o"))
    return found.select(F.coalesce(F.get(F.array(*map(F.lit, paths)), F.col("o.file_no")), F.col("o.path")).alias("file"), "line", "o").orderBy("o").drop("o")


def read_style_seeds(spark: SparkSession, path: str, n: int, low: int = 40, high: int = 220) -> DataFrame:
    """At most n texts of a CSV whose length is within bounds, in the order of their hashes."""
    df = spark.read.option("header", True).csv(path).select("text").where(F.length("text").between(low, high))
    return df.orderBy(F.xxhash64("text"), "text").limit(n)


def read_catalogue(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(catalogue, canonical, spoken, ord) of a catalogue file, for operators.lookup."""
    df = spark.read.schema(schemas.CATALOGUE).option("multiLine", True).json(path)
    e = df.select(F.posexplode(F.coalesce("entries", "models")).alias("i", "e")).select("i", "e.canonical", F.posexplode(F.array_append("e.spoken", F.col("e.canonical"))).alias("j", "spoken"))
    return e.select(F.lit(name).alias("catalogue"), "canonical", "spoken", (F.col("i").cast("long") * (1 << 20) + F.col("j")).alias("ord"))


#: Fixed value: what stands before a line that a model has numbered or named.
LEAD_JUNK = r"(?iu)^(?:[\s*\-•>`]|\d+[.)]|line\s*\d+\s*:|spoken\s*:|câu\s*\d+\s*:)+"
_MARK = r"\[\[[^\[\]|]+\|[A-Z_]+\]\]"


def harvest_lines(text: Column) -> Column:
    """The lines of a reply that hold marked spans, without what a model says around them."""
    clean = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim(x), LEAD_JUNK, "")), "^`+|`+$", "")))
    count = lambda x, mark: (F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit("")))) / 2
    return F.filter(clean, lambda x: x.rlike(_MARK) & (count(x, "[[") == count(x, "]]")))


def parse_markup(line: Column) -> Column:
    """struct(words, spans, punct) of a line with [[text|TYPE]], in lower case. A mark behind a word or alone labels the word
    before it; null without a span, or if a mark begins the line."""
    marks = F.create_map(*(F.lit(x) for x in (",", "COMMA", ".", "PERIOD", "?", "QUESTION")))
    parts = F.regexp_extract_all(line, F.lit(rf"({_MARK}|[^\s\[]+|\[)"), 1)
    none = F.array().cast("array<string>")

    def one(p: Column) -> Column:
        kind = F.regexp_extract(p, r"^\[\[[^|]*\|([A-Z_]+)\]\]$", 1)
        inner = F.filter(F.split(F.lower(F.regexp_extract(p, r"^\[\[([^|]*)\|", 1)), r"\s+"), lambda w: w != "")
        tail = F.try_element_at(marks, F.regexp_extract(F.regexp_extract(p, r"([,.?]*)$", 1), r"^(.)", 1))
        word = F.regexp_replace(F.regexp_replace(F.lower(p), r"[,.?]+$", ""), r"^[\"'()]+|[\"'()]+$", "")
        plain = F.when(word == "", none).otherwise(F.array(word))
        return F.struct(F.when(kind != "", inner).otherwise(plain).alias("w"), F.when(kind != "", kind).alias("t"), F.when(kind == "", tail).alias("m"))

    def step(acc: Column, p: Column) -> Column:
        n, m = F.size(acc["words"]), F.size(p["w"])
        span = F.array(F.struct(n.alias("start"), (n + m - 1).alias("end"), p["t"].alias("type")))
        moved = F.concat(F.slice(acc["punct"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(p["m"]))
        more = F.concat(acc["punct"], F.array_repeat(F.lit("O"), F.greatest(m - 1, F.lit(0))), F.when(m > 0, F.array(F.coalesce(p["m"], F.lit("O")))).otherwise(none))
        punct = F.when((m == 0) & (n > 0) & p["m"].isNotNull(), moved).otherwise(more)
        bad = acc["bad"] | ((m == 0) & ((n == 0) & p["m"].isNotNull() | p["t"].isNotNull()))
        return F.struct(F.concat(acc["words"], p["w"]).alias("words"), F.when(p["t"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], span)).alias("spans"), punct.alias("punct"), bad.alias("bad"))

    start = F.struct(none.alias("words"), F.array().cast(schemas.SPANS).alias("spans"), none.alias("punct"), F.lit(False).alias("bad"))
    out = F.aggregate(F.transform(parts, one), start, step)
    return S.let(out, lambda o: F.when(~o["bad"] & (F.size(o["spans"]) > 0), F.struct(o["words"].alias("words"), o["spans"].alias("spans"), o["punct"].alias("punct"))))


def parse_reply(reply: Column, n: Column) -> Column:
    """(no, spoken) of the lines "<no>|<spoken>" of a reply about n numbered lines."""
    one = lambda x: F.struct(F.regexp_extract(x, r"^\s*(\d+)\s*[|.)：:]\s*(.+)$", 1).try_cast("int").alias("no"), F.regexp_replace(F.trim(F.regexp_extract(x, r"^\s*(\d+)\s*[|.)：:]\s*(.+)$", 2)), "^\"+|\"+$", "").alias("spoken"))
    return F.filter(F.transform(F.split(F.coalesce(reply, F.lit("")), "\n"), lambda x: one(F.trim(x))), lambda x: x["no"].between(1, n))
