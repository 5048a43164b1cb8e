"""Answers that survive retries, outcomes in one pass, SQL, jobs on files, matrices and the guard of the final test."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from goldens import UTTERANCES
from pyspark.sql import functions as F

from tidewrit import jobs, sql
from tidewrit.operators import corpus, metrics, pipeline
from tidewrit.sources import writers
from tidewrit.sources.answers import AnswerStore, fingerprint
from tidewrit.sources.files import Folder


def rows_of(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- answers -------------------------------------------------------------------------------------------------------------


def store_at(spark, path, payload=("text",)):
    return AnswerStore(spark, f"file://{path}/store", "string", payload)


def held(store):
    return sorted((r["id"] or "", r["version"], r["answer"]) for r in store.latest().collect())


ASKED = "id string, text string, answer string"


def test_a_retried_batch_and_a_killed_run_leave_one_answer(spark, tmp_path):
    s = store_at(spark, tmp_path)
    assert held(s) == [] and s.todo(rows_of(spark, [("a", "x", "")], ASKED), "1").count() == 1
    batch = rows_of(spark, [("a", "x", "A"), ("b", None, "B"), ("c", "", "C"), (None, "n", "N")], ASKED)
    assert s.commit(batch, "1", "first") and not s.commit(batch.withColumn("answer", F.lit("other")), "1", "first")
    batch.withColumn("answer", F.lit("killed")).write.parquet(f"{s.path}/data/killed")  # written, never committed
    assert held(s) == [("", "1", "N"), ("a", "1", "A"), ("b", "1", "B"), ("c", "1", "C")]
    assert sorted(s.vacuum()) == ["killed"]
    asked = rows_of(spark, [("a", "x", ""), ("b", "", ""), ("c", None, ""), ("d", "x", ""), (None, "n", "")], ASKED).drop("answer")
    assert sorted(r["id"] or "-" for r in s.todo(asked, "1").collect()) == ["-", "b", "c", "d"]  # null is not empty
    assert s.todo(asked, "2").count() == 5


def test_later_commits_hold_and_compaction_changes_nothing(spark, tmp_path):
    s = store_at(spark, tmp_path)
    for n, text in enumerate(["x", "x", "y"]):
        s.commit(rows_of(spark, [("a", text, f"A{n}"), (f"b{n}", "t", "B")], ASKED), "1", f"try-{n}")
    before = held(s)
    assert before == [("a", "1", "A1"), ("a", "1", "A2"), ("b0", "1", "B"), ("b1", "1", "B"), ("b2", "1", "B")]
    reader = s.latest()
    s.compact()
    assert held(s) == before and len(s.manifests()) == 1
    assert sorted(r["answer"] for r in reader.collect()) == ["A1", "A2", "B", "B", "B"]  # began before, and its files are there
    assert len(s.vacuum()) == 3 and held(s) == before
    assert not s.commit(rows_of(spark, [("a", "x", "again")], ASKED), "1", "try-0")  # done, although it was replaced
    s.commit(rows_of(spark, [("a", "x", "A9")], ASKED), "1", "try-9")
    assert ("a", "1", "A9") in held(s)


def test_migration_takes_only_what_is_asked_no_differently(spark, tmp_path):
    s = store_at(spark, tmp_path)
    s.commit(rows_of(spark, [(i, f"text {i}", f"old {i}") for i in "abcd"], ASKED), "1", "first")
    s.commit(rows_of(spark, [("d", "text d", "new d")], ASKED), "2", "second")
    asked = rows_of(spark, [("a", "text a", ""), ("b", "text b, edited", ""), ("c", "text c", ""), ("d", "text d", ""), ("e", "text e", "")], ASKED).drop("answer")
    assert s.migrate(asked, F.col("id") != "c", "1", "2") and not s.migrate(asked, F.col("id") != "c", "1", "2")
    assert sorted((r["id"], r["answer"]) for r in s.answered(asked, "2").collect()) == [("a", "old a"), ("d", "new d")]
    assert sorted(r["id"] for r in s.todo(asked, "2").collect()) == ["b", "c", "e"]
    s.compact(["2"])
    assert {v for _, v, _ in held(s)} == {"2"}


def test_a_stream_of_answers_is_committed_by_batch(spark, tmp_path):
    s = store_at(spark, tmp_path)
    for n in range(3):
        rows_of(spark, [(f"{n}-{i}", "t", "A") for i in range(4)], ASKED).coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
    stream = lambda: spark.readStream.schema(ASKED).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    s.upsert(stream(), "1", f"file://{tmp_path}/state").awaitTermination()
    assert len(held(s)) == 12 and [m["attempt"] for m in s.manifests()] == ["stream-0", "stream-1", "stream-2"]
    s.upsert(stream(), "1", f"file://{tmp_path}/lost-state").awaitTermination()  # a lost checkpoint runs all again
    assert len(s.manifests()) == 3 and s.rows().count() == 12


def test_files_appear_once(spark, tmp_path):
    f = Folder(spark, f"file://{tmp_path}/f")
    assert f.names() == [] and f.create("a", "één") and not f.create("a", "two") and f.read("a") == "één" and f.names() == ["a"]
    one = spark.range(1).select(fingerprint("1", F.lit("a"), F.lit("b")).alias("x"), fingerprint("1", F.lit("a\x1fb")).alias("y"), fingerprint("2", F.lit("a"), F.lit("b")).alias("z")).first()
    assert len({*one}) == 3


# --- outcomes ------------------------------------------------------------------------------------------------------------


def test_outcomes_are_written_in_one_pass(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def once(text):
        read.add(1)
        return text

    df = rows_of(spark, [(i, [None, "a", "bb", "kept"][i % 4]) for i in range(40)], "id long, text string").withColumn("text", once.asNondeterministic()("text"))
    why = corpus.reason(("no text", F.col("text").isNull()), ("short", F.length("text") < 2))
    seen = writers.write_outcomes(df, why, f"file://{tmp_path}/o", longest=F.max(F.length("text")))
    assert seen == {"rows": 40, "kept": 20, "rejected": 20, "longest": 4} and read.value == 40
    kept, refused = writers.read_outcomes(spark, f"file://{tmp_path}/o", "id long, text string")
    assert kept.count() == 20 and {(r["reason"], r["n"]) for r in refused.groupBy("reason").agg(F.count("*").alias("n")).collect()} == {("no text", 10), ("short", 10)}
    assert "PartitionFilters: [isnotnull(outcome" in kept._jdf.queryExecution().executedPlan().toString()
    empty = writers.write_outcomes(df.limit(0), why, f"file://{tmp_path}/e")
    assert (empty["rows"], empty["kept"], empty["rejected"]) == (0, 0, 0)


# --- SQL -----------------------------------------------------------------------------------------------------------------


def locate(words, text):
    t = text.split()
    i = next(i for i in range(len(words)) if words[i : i + len(t)] == t)
    return i, i + len(t) - 1


@pytest.fixture(scope="module")
def utterances(spark):
    rows = []
    for n, (spoken, spans, _) in enumerate(UTTERANCES):
        w = spoken.split()
        rows.append((str(n), w, [(*locate(w, s), k, [1.0, 0.61257, 0.3][(n + j) % 3], 0.95) for j, (s, k) in enumerate(spans)], ["O"] * (len(w) - 1) + ["PERIOD"]))
    return rows_of(spark, rows, jobs.TAGGED)


def test_the_trace_in_sql_is_that_of_the_pipeline(spark, utterances):
    norm = sql.register(spark)
    utterances.createOrReplaceTempView("said")
    got = spark.sql("SELECT id, t.* FROM said, LATERAL trace_spans(words, spans) t").collect()
    want = pipeline.trace(pipeline.write(spark, utterances, norm)).select("id", *got[0].asDict().keys() - {"id"}).collect()
    key = lambda r: (r["id"], r["span_no"])
    assert len(got) == len(want) > 30
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert g.asDict() == {k: w[k] for k in g.asDict()}
    assert sql.views(spark, "said") == ["said_written", "said_trace", "said_emission"]
    by = {r["type"]: r for r in spark.table("said_emission").collect()}
    assert sum(r["spans"] for r in by.values()) == len(want) and sum(r["emitted"] for r in by.values()) == sum(r["emitted"] for r in want)
    assert sum(r["below_threshold"] + r["invalid"] + r["emitted"] for r in by.values()) == len(want)
    one = spark.sql("SELECT normalize_span('CARDINAL', 'hai mươi') AS a, valid_span('HEADING', '090°') AS b, valid_span('HEADING', '400°') AS c, valid_span(NULL, 'x') AS d, deaccent('Đường phố') AS e, deaccent(NULL) AS f").first()
    assert (one["a"]["normalized"], one["b"], one["c"], one["d"], one["f"]) == ("20", True, False, None, None) and "đ" not in one["e"].lower()
    tags = spark.sql("SELECT * FROM tag_spans(array('B', 'E', 'I', 'I', 'O', 'S', 'E', 'B', 'B', NULL))").collect()
    assert [(r["first"], r["last"]) for r in tags] == [(0, 1), (2, 3), (5, 5), (6, 6), (7, 7), (8, 8)]
    assert [r["sentence"] for r in spark.sql("SELECT * FROM text_sentences(' One. Two?  Three ')").collect()] == ["One.", "Two?", "Three"]
    assert spark.sql("SELECT * FROM trace_spans(CAST(NULL AS ARRAY<STRING>), CAST(NULL AS ARRAY<STRUCT<start: INT, end: INT, type: STRING, boundary_conf: DOUBLE, type_conf: DOUBLE>>))").count() == 0


# --- jobs ----------------------------------------------------------------------------------------------------------------


def run(spark, capsys, *argv):
    code = jobs.main([str(a) for a in argv], spark)
    out = capsys.readouterr()
    return code, json.loads(out.out.splitlines()[-1]) if code == 0 else out.err


def test_write_job(spark, tmp_path, capsys, utterances):
    utterances.write.json(f"{tmp_path}/in.jsonl")
    code, seen = run(spark, capsys, "write", "--input", f"file://{tmp_path}/in.jsonl", "--out", f"file://{tmp_path}/out.csv", "--threshold", 0.0)
    assert code == 0 and seen["rows"] == len(UTTERANCES) and seen["skipped"] == 0
    got = {r["id"]: r["written"] for r in spark.read.option("header", True).csv(f"{tmp_path}/out.csv").withColumnRenamed("﻿id", "id").collect()}
    assert got == {str(n): want for n, (_, _, want) in enumerate(UTTERANCES)}


def test_convert_job_keeps_and_refuses(spark, tmp_path, capsys):
    good = {"id": "1", "words": ["đi", "hai", "mươi", "hải", "lý"], "punct": ["O", "O", "O", "O", "PERIOD"], "spans": [["1", "2", "CARDINAL"]], "normalized_text": "Đi 20 hải lý."}
    rows = [good, {**good, "spans": [["1", "1", "CARDINAL"]]}, {**good, "punct": ["O"]}, {**good, "spans": [["1", "2", "NOTHING"]]}]
    Path(tmp_path, "in.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    code, seen = run(spark, capsys, "convert", "--layout", "bundle", "--input", f"file://{tmp_path}/in.jsonl", "--out", f"file://{tmp_path}/out")
    assert code == 0 and (seen["rows"], seen["kept"], seen["rejected"]) == (4, 1, 3) and seen["reasons"]["unknown type: NOTHING"] == 1
    assert spark.read.parquet(f"{tmp_path}/out").where("outcome = 'kept'").first()["written"] == "Đi 20 hải lý."


def test_splits_rebalance_evaluate_and_check_jobs(spark, tmp_path, capsys):
    rows = [{"id": str(i), "spoken": f"a b{i} c", "written": "x", "words": ["a", f"b{i}", "c"], "spans": [{"start": 1, "end": 1, "type": "CARDINAL"}], "punct": ["O"] * 3, "leak_key": f"k{i % 40}", "source": "s", "types": [["x"], ["x", "y"], []][i % 3]} for i in range(120)]
    Path(tmp_path, "u.jsonl").write_text("\n".join(map(json.dumps, rows)), encoding="utf-8")
    code, seen = run(spark, capsys, "splits", "--input", f"file://{tmp_path}/u.jsonl", "--out", f"file://{tmp_path}/s.jsonl")
    assert code == 0 and seen["rows"] == 120 and seen["splits"]["entity_holdout_dev"] == 12 and corpus.leakage(spark.read.json(f"{tmp_path}/s.jsonl").withColumn("signature", F.col("id"))).count() == 0
    code, seen = run(spark, capsys, "check", "--input", f"file://{tmp_path}/u.jsonl")
    assert code == 0 and seen["rows"] == 120
    Path(tmp_path, "base.jsonl").write_text("\n".join(map(json.dumps, rows[:30])), encoding="utf-8")
    code, seen = run(spark, capsys, "rebalance", "--base", f"file://{tmp_path}/base.jsonl", "--full", f"file://{tmp_path}/u.jsonl", "--out", f"file://{tmp_path}/r", "--cap", "x=25", "--cap", "y=10")
    assert code == 0 and seen == {"job": "rebalance", "rows": 30 + 30 + 5, "base": 30, "full": 120}
    run_rows = [{"gold": [{"start": 0, "end": 0, "type": "DATE"}], "pred": [{"start": 0, "end": 0, "type": "TIME"}], "gold_punct": ["O"], "pred_punct": ["O"], "gold_text": "a", "pred_text": "a"}]
    Path(tmp_path, "e.jsonl").write_text("\n".join(map(json.dumps, run_rows)), encoding="utf-8")
    code, seen = run(spark, capsys, "evaluate", "--input", f"file://{tmp_path}/e.jsonl", "--types", f"file://{tmp_path}/t")
    assert code == 0 and (seen["boundary_f1"], seen["type_f1"], seen["utterance_exact"]) == (1.0, 0.0, 1.0) and spark.read.parquet(f"{tmp_path}/t").first()["hit"] == 0
    Path(tmp_path, "none.jsonl").write_text("", encoding="utf-8")
    assert run(spark, capsys, "check", "--input", f"file://{tmp_path}/none.jsonl")[0] == 1
    assert jobs.main(["splits"], spark) == 2 and jobs.main(["nothing"], spark) == 2


def test_tune_job_refuses_the_final_test(spark, tmp_path, capsys):
    seen = [{"spoken": f"câu {i}", "type": "DATE", "confidence": 0.5 + i / 100, "ok": i % 3 > 0} for i in range(30)]
    Path(tmp_path, "o.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in seen), encoding="utf-8")
    for name, text in (("clean", "câu khác"), ("leak", "  Câu 7. ")):
        Path(tmp_path, f"{name}.jsonl").write_text(json.dumps({"spoken": text}, ensure_ascii=False), encoding="utf-8")
    args = ("tune", "--input", f"file://{tmp_path}/o.jsonl", "--out", f"file://{tmp_path}/t.json")
    code, err = run(spark, capsys, *args, "--final-test", f"file://{tmp_path}/leak.jsonl")
    assert code == 1 and "final test" in err and not Path(tmp_path, "t.json").exists()
    code, done = run(spark, capsys, *args, "--final-test", f"file://{tmp_path}/clean.jsonl")
    assert code == 0 and done == {"job": "tune", "types": 1, "records": 30} and spark.read.json(f"{tmp_path}/t.json").first()["support"] == 30


def test_the_command_itself(tmp_path):
    done = subprocess.run([sys.executable, "-m", "tidewrit", "--help"], capture_output=True, text=True, cwd=Path(__file__).resolve().parent.parent, timeout=120)
    assert done.returncode == 0 and "rebalance" in done.stdout


# --- matrix --------------------------------------------------------------------------------------------------------------


def test_matrix_of_all_types(spark):
    pairs = rows_of(spark, [("DATE", "TIME"), ("DATE", "DATE"), ("DATE", None), (None, "DATE"), ("odd", "DATE")], "gold string, pred string")
    m = {r["gold"]: r for r in metrics.confusion_matrix(pairs).collect()}
    assert len(m) == 48 and len(m["DATE"]) == 50
    assert (m["DATE"]["TIME"], m["DATE"]["DATE"], m["DATE"]["other"], m["DATE"]["total"], m["other"]["DATE"], m["total"]["DATE"], m["total"]["total"], m["RANK"]["total"]) == (1, 1, 1, 3, 2, 3, 5, 0)
    assert {r["total"] for r in metrics.confusion_matrix(pairs.limit(0)).collect()} == {0}
