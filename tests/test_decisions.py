"""Decisions that depend on all rows before them: admissions, shares of splits, caps of types."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewrit.operators import corpus, limiter, selection
from tidewrit.operators.limiter import DAY, Limits
from tidewrit.streaming import limits, streams


def admitted_by_loops(requests, lim):
    """Tries every microsecond at which something can change; requests in order: (time, tokens)."""
    taken, out = [], []
    for time, tokens in requests:
        if time is None:
            out.append((None, "time"))
            continue
        if tokens > lim.tokens:
            out.append((None, "tokens"))
            continue
        early = max([time, *(t for t, _ in taken)])
        if sum(t // DAY == early // DAY for t, _ in taken) >= lim.daily:
            out.append((None, "day"))
            continue

        def fits(at):
            inside = [n for t, n in taken if at - t <= lim.window]
            return len(inside) < lim.calls and sum(inside) + tokens <= lim.tokens

        moments = sorted({early, *(t + lim.window + 1 for t, _ in taken if t + lim.window + 1 > early)})
        at = next((m for m in moments if fits(m)), None) if lim.wait else early if fits(early) else None
        out.append((at, None if at is not None else "window"))
        if at is not None:
            taken.append((at, tokens))
    return out


@pytest.mark.parametrize("lim", [Limits(3, 40, 9, 50_000_000), Limits(2, 25, 10_000, 3_000_000, wait=False), Limits(1, 100, 3, 40_000_000_000)])
def test_admissions_against_loops(spark, lim):
    rng = random.Random(4)
    start = 1_700_000_000_000_000
    rows = [(i, rng.choice(["a", "b", None]), None if i % 97 == 0 else start + rng.randrange(0, 3_000) * 1_000_000, rng.choice([1, 5, 10, 20, 45, None])) for i in range(400)]
    df = spark.createDataFrame([(i, k, None if us is None else dt.datetime.fromtimestamp(us / 1e6, dt.timezone.utc), n, "x") for i, k, us, n in rows], "id long, who string, at timestamp, tokens long, refused_before string").repartition(3)
    got = {r["id"]: (r["us"], r["refused"]) for r in limiter.admissions(df, "who", "at", "tokens", "id", lim).select("id", F.unix_micros("admitted_at").alias("us"), "refused").collect()}
    for who in ("a", "b", None):
        mine = sorted((r for r in rows if r[1] == who), key=lambda r: (r[2] is None, r[2] or 0, r[0]))
        assert [got[r[0]] for r in mine] == admitted_by_loops([(r[2], r[3] or 0) for r in mine], lim)
    assert limiter.admissions(df.limit(0), "who", "at", "tokens", "id", lim).count() == 0


def test_actual_tokens_stand_in_the_window():
    ring, lim = limiter.Ring(), Limits(10, 100, 100, 60)
    assert [ring.ask(lim, 0, 80, 10), ring.ask(lim, 1, 80), ring.ask(lim, 2, 20), ring.ask(lim, 3, 5)] == [(0, None), (1, None), (61, None), (62, None)]


def test_stream_admits_as_the_batch_form(spark, tmp_path):
    rng = random.Random(6)
    lim = Limits(2, 30, 20, 30_000_000)
    rows = [(i, f"k{i % 3}", dt.datetime(2024, 1, 1, 0, 0, 0, rng.randrange(1_000_000)) + dt.timedelta(seconds=rng.randrange(600)), rng.choice([1, 10, 25, 40])) for i in range(150)]
    schema = "id long, who string, at timestamp, tokens long"
    for n in range(3):  # several files, each a batch with requests of all times
        spark.createDataFrame(rows[n * 50 : n * 50 + 50], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    spark.createDataFrame([(999, "z", dt.datetime(2024, 1, 2), 1)], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"file://{tmp_path}/in")
    streams.replay(limits.admissions(stream, "who", "at", "tokens", "id", lim, "20 minutes"), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    got = {int(r["request"]): (r["admitted_us"], r["refused"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    want = limiter.admissions(spark.createDataFrame(rows, schema), "who", "at", "tokens", "id", lim)
    assert got == {r["id"]: (r["us"], r["refused"]) for r in want.select("id", F.unix_micros("admitted_at").alias("us"), "refused").collect()}


def test_places_in_a_seeded_order(spark):
    rng = random.Random(1)
    keys = [f"k{i}" for i in range(300)] + [""]
    df = spark.createDataFrame([(g, k, rng.randint(0, 4)) for g in "xy" for k in keys for _ in range(2)], "group string, key string, w long").withColumn("h", selection.seeded("7", F.col("key")))
    same = df.withColumn("h", F.col("h") % 5)  # many keys of one hash
    for table in (df, same):
        rows = sorted((r["group"], r["h"], r["key"], r["w"]) for r in table.collect())
        for n in (-1, 0, 1, 77, 500, 10_000):
            for g, place in selection.places(table, {"x": n, "y": n + 3}).items():
                need, total, want = n if g == "x" else n + 3, 0, None
                for _, h, k, w in (r for r in rows if r[0] == g):
                    total += w
                    if want is None and total >= need:
                        want = (h, k)
                assert place == (selection.NOWHERE if need <= 0 else selection.END if want is None else want)


@pytest.mark.parametrize("n_groups", [0, 1, 2, 9, 200])
def test_shares_of_splits(spark, n_groups):
    rng = random.Random(n_groups)
    rows = [(i, None if g == 3 else f"e{g}", f"t{rng.randrange(n_groups * 3)}") for i, g in enumerate(g for g in range(n_groups) for _ in range(1000 if g == 1 else rng.randint(1, 4)))]
    df = spark.createDataFrame(rows, "id long, leak_key string, signature string")
    got = corpus.build_splits(df).collect()
    assert len(got) == len(rows) and corpus.leakage(corpus.build_splits(df)).count() == 0
    groups = lambda s: {r["leak_key"] for r in got if r["split"] == s}
    held = min(max(1, int(n_groups * 0.12)), max(0, n_groups - max(1, n_groups // 2))) if n_groups else 0
    assert len(groups("entity_holdout_dev")) == held
    left = [r for r in got if r["split"] != "entity_holdout_dev"]
    n_templates = len({r["signature"] for r in left})
    assert len({r["signature"] for r in left if r["split"] == "template_holdout_dev"}) == (min(max(1, int(n_templates * 0.12)), max(0, n_templates - max(1, n_templates // 2))) if n_templates else 0)
    rest = {r["leak_key"] for r in left if r["split"] != "template_holdout_dev"}
    assert len(groups("random_dev")) == (min(max(1, int(len(rest) * 0.12)), len(rest) - 1) if rest else 0)


def test_rebalance_takes_what_one_after_the_other_would(spark):
    rng = random.Random(3)
    kinds = ["a", "b", "c", "d"]
    base = [(i, rng.choices(kinds, k=rng.randint(0, 3))) for i in range(60)]
    more = [(i, rng.choice([None, [], *([rng.choices(kinds, k=rng.randint(1, 4))] * 6)])) for i in range(40, 500)]
    schema, caps = "id long, types array<string>", {"a": 90, "b": 30, "c": 150, "e": 5}
    plain = spark.createDataFrame(base, schema)
    delta = spark.createDataFrame(more, schema)
    order = [r["id"] for r in delta.where("id >= 60").orderBy(selection.seeded("13", F.col("id").cast("string")), F.col("id").cast("string")).collect()]
    for c in (caps, {"a": 0}, {"d": 10_000}, {}):
        have = {k: sum(t.count(k) for _, t in base) for k in kinds}
        want, types = [i for i, _ in base], dict(more)
        for i in order:
            own = types[i] or []
            if own and all(t in c and have.get(t, 0) >= c[t] for t in own):
                continue
            want.append(i)
            for t in own:
                have[t] = have.get(t, 0) + 1
        out = corpus.rebalance(plain, delta, c)
        assert sorted(r["id"] for r in out.collect()) == sorted(want), c
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Pandas" not in plan
