"""The operators' queries, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, jaccard, langid, licenses, lines, mixing, repair, search, shards, tokencounts, toxicity, urls
from .scratch import Scratch


def bounded_batches(spark: SparkSession) -> None:
    """Batches of texts for Python workers are of about 4 MB, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every vector whose vec_id is divisible by 100."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, keep=Scratch(spark, "op1").keep)


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per token sequence at its slot."""
    scratch = Scratch(spark, "op2")
    return shards.materialise(table(spark, sf_dir, "documents"), f"{scratch.root}/shards", keep=scratch.keep)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    return urls.judge(pages, rules, keep=Scratch(spark, "op3").keep).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM parts
), keys AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fits AS (
  SELECT page_id, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule_host) + length(rule_path) DESC, length(rule_host) DESC) AS n, host, path
  FROM (SELECT DISTINCT page_id, host, path FROM keys) k JOIN rules
    ON (host = rule_host OR host LIKE '%.' || rule_host) AND starts_with(path, rule_path)
)
SELECT k.page_id, k.host, k.path, f.rule, coalesce(f.rule_verdict, 'allow') AS verdict
FROM keys k LEFT JOIN fits f ON f.n = 1 AND k.page_id IS NOT DISTINCT FROM f.page_id AND k.host = f.host AND k.path = f.path
"""


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    docs = table(spark, sf_dir, "documents")
    held_out = toxicity.held_out()
    return langid.identify(docs, langid.learn(docs.where(~held_out))).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), Scratch(spark, "op5").keep))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that documents hold."""
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=Scratch(spark, "op6").keep)
    return found.drop("h1", "h2")


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each time that the mixture reads a document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), columns=["doc_id", "source"], keep=Scratch(spark, "op7").keep)
    return mixed.select("doc_id", "source", "mix_words", "mix_weight", "mix_epoch", "mix_block")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses whose texts stand in documents."""
    return licenses.scan(table(spark, sf_dir, "documents"), keep=Scratch(spark, "op8").keep)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_copies, n_links for every document."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op9"))


#: Every pair of texts with a common shingle, exactly; texts of equal words are one class.
OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS line, doc_id, list_filter(string_split_regex(lower(text), '[\x00-\x20]+'), lambda x: x <> '') AS w FROM documents
), classes AS (
  SELECT row_number() OVER () AS class, w, least, copies FROM (SELECT w, min(doc_id) AS least, count(DISTINCT doc_id) + count_if(doc_id IS NULL) AS copies FROM d WHERE len(w) > 0 GROUP BY w)
), shingles AS (
  SELECT class, unnest(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM classes
), sizes AS (SELECT class, count(*) AS n FROM shingles GROUP BY class),
pairs AS (
  SELECT a.class AS a, b.class AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.class <> b.class GROUP BY a.class, b.class
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.class = a JOIN sizes y ON y.class = b WHERE common >= 0.8 * (x.n + y.n - common) - 1e-9
), reach(a, b) AS (
  SELECT class, class FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), grouped AS (SELECT r.a AS class, min(c.least) AS class_id FROM reach r JOIN classes c ON r.b = c.class GROUP BY r.a),
linked AS (SELECT a AS class, sum(c.copies) AS n FROM links JOIN classes c ON c.class = b GROUP BY a)
SELECT d.doc_id, CASE WHEN len(d.w) > 0 THEN g.class_id ELSE d.doc_id END AS class_id, coalesce(c.copies, 1)::BIGINT AS n_copies, CASE WHEN len(d.w) > 0 THEN coalesce(l.n, 0) + c.copies - 1 ELSE 0 END::BIGINT AS n_links
FROM d LEFT JOIN classes c ON d.w = c.w LEFT JOIN grouped g ON g.class = c.class LEFT JOIN linked l ON l.class = c.class
"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines to drop and the places of those that stay for them."""
    return lines.repeated_lines(table(spark, sf_dir, "documents"), Scratch(spark, "op10"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and the longest prefix of 512 tokens of every document, from the table of prefixes."""
    table_ = Scratch(spark, "op11").keep(tokencounts.prefix_table(table(spark, sf_dir, "documents")), "prefixes")
    asked = table_.select("doc_id", "n_bytes", "n_chars", tokencounts.tokens_of(F.col("prefix"), F.col("n_chars")).alias("n_tokens"), tokencounts.longest_within(F.col("prefix"), F.lit(512)).alias("chars_within_limit"))
    return asked.select("doc_id", "n_bytes", "n_tokens", (F.col("chars_within_limit") < F.col("n_chars")).alias("over_limit"), "chars_within_limit")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every damaged conversation."""
    return repair.audit(repair.damaged(table(spark, sf_dir, "conversations")), Scratch(spark, "op12"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score of the 10 best documents of every benchmark item."""
    return search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10, keep=Scratch(spark, "op13").keep)


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS terms FROM documents
), totals AS (
  SELECT count(*) AS n_docs, sum(len(terms)) AS n_terms FROM docs WHERE len(terms) > 0
), item_terms AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark
), postings AS (
  SELECT row_id, doc_id, len(terms) AS n, term, count(*) AS tf
  FROM (SELECT row_id, doc_id, terms, unnest(terms) AS term FROM docs) SEMI JOIN item_terms USING (term) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY term
), impacts AS (
  SELECT row_id, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + CAST((90 * n * n_docs) // n_terms AS BIGINT)))) AS impact FROM postings JOIN weights USING (term), totals
), scores AS (
  SELECT item_id, row_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM impacts JOIN item_terms USING (term) GROUP BY ALL HAVING sum(impact) > 0
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores QUALIFY rank <= 10
"""

OP12_SQL = r"""
WITH RECURSIVE source AS (
  SELECT row_number() OVER () AS line, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), crc AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(key, ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
                            lambda c, bits: xor(xor(c, bits) >> 1, 3988292384 * (xor(c, bits) & 1))), 4294967295) % 20 AS kind FROM source
), damage AS (
  SELECT line, conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, line, copy) AS pos,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, line, copy) > 1 AS again,
         lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, line, copy) AS before FROM damage
), judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM placed
), summary AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate,
         count_if(fault = 'truncated') AS truncated, count_if(before IS NOT NULL AND before || substr(role, 1, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n
  FROM judged GROUP BY conv_id
), inserts(q, to_q, letters, roles, price) AS (
  VALUES (0, 0, '', '', 0), (1, 1, '', '', 0), (2, 2, '', '', 0), (3, 3, '', '', 0), (0, 2, 'I', 'u', 5), (0, 3, 'II', 'ua', 10),
         (1, 2, 'I', 'u', 5), (1, 3, 'II', 'ua', 10), (2, 3, 'I', 'a', 5), (3, 2, 'I', 'u', 5)
), moves(q, initial, to_q, letter, price) AS (
  VALUES (0, '', 0, 'D', 2), (1, '', 1, 'D', 2), (2, '', 2, 'D', 2), (3, '', 3, 'D', 2), (0, 's', 1, 'K', 0), (0, 'u', 2, 'K', 0), (1, 'u', 2, 'K', 0),
         (2, 'a', 3, 'K', 0), (3, 'u', 2, 'K', 0), (0, 'u', 2, 'R', 1), (1, 'u', 2, 'R', 1), (2, 'a', 3, 'R', 1), (3, 'u', 2, 'R', 1)
), steps AS (
  SELECT i.q, m.initial, m.to_q, i.letters || m.letter AS letters, i.roles, m.letter, i.price + m.price AS price FROM inserts i JOIN moves m ON i.to_q = m.q
), added(roles, body) AS (
  VALUES ('', ''), ('u', chr(10) || 'user:'), ('a', chr(10) || 'assistant:'), ('ua', chr(10) || 'user:' || chr(10) || 'assistant:')
), search AS (
  SELECT conv_id, 0 AS pos, 0 AS q, 0 AS cost, '' AS audit, '' AS body FROM summary
  UNION ALL
  SELECT conv_id, pos, q, best.cost, best.audit, best.body FROM (
    SELECT s.conv_id, j.pos AS pos, t.to_q AS q,
           min({'cost': s.cost + t.price + CASE WHEN t.letter <> 'D' AND j.fault = 'truncated' THEN 5 ELSE 0 END, 'audit': s.audit || t.letters,
                 'body': s.body || a.body || CASE t.letter WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || j.role || ':' || j.text
                         ELSE chr(10) || CASE t.initial WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || j.text END}) AS best
    FROM search s JOIN judged j ON s.conv_id IS NOT DISTINCT FROM j.conv_id AND j.pos = s.pos + 1
    JOIN steps t ON t.q = s.q AND (t.letter = 'D' OR j.fault NOT IN ('blank', 'duplicate') AND (t.letter = 'R' OR t.initial = substr(j.role, 1, 1)))
    JOIN added a ON a.roles = t.roles GROUP BY s.conv_id, j.pos, t.to_q)
), ends AS (
  SELECT s.conv_id, min({'cost': s.cost + i.price, 'audit': s.audit || i.letters, 'body': s.body || a.body}) AS best
  FROM search s JOIN summary n ON s.conv_id IS NOT DISTINCT FROM n.conv_id AND s.pos = n.n JOIN inserts i ON i.q = s.q AND i.to_q IN (0, 3) JOIN added a ON a.roles = i.roles
  GROUP BY s.conv_id
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(e.best.cost, 0)::BIGINT AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(substr(e.best.body, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN summary s ON c.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN ends e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_nearest_neighbours, op2_training_order, op3_url_filter, op4_language, op5_toxicity, op6_decontamination, op7_mixture, op8_licenses, op9_ngram_jaccard, op10_line_dedup, op11_token_counts, op12_conversation_repair, op13_lexical_search, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": OP3_SQL, "op9_ngram_jaccard": OP9_SQL, "op12_conversation_repair": OP12_SQL, "op13_lexical_search": OP13_SQL}
