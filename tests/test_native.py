"""Expressions of normalisers against their Python forms."""

import random

import pytest
from pyspark.sql import functions as F

from tidewrit.functions import catalogues, lexicon as L
from tidewrit.functions.native import NATIVE
from tidewrit.functions.normalizers import Engine
from tidewrit.operators.normalize import Normalization, attempt

NUMBERS = [*L.DIGITS, "mười", "mươi", "mười", "mươi", "12", "007", "trăm", "x'y", "lẻ"]
NAMES = ["nguyễn", "VĂN", "a_b", "_", "đại", "tá", "Chief", "officer", "captain", "ß", "é", "  ", " ", "1a", "o'neil"]


@pytest.mark.parametrize("kind", sorted(NATIVE))
def test_expression_equals_python(spark, kind):
    rng = random.Random(kind)
    pool = NUMBERS if kind == "DIGIT_SEQ" else NAMES
    digits = [*L.DIGITS, "mười", "mươi"]
    texts = ["", " ", None, *(" ".join(rng.choice(pool if n % 3 else digits if kind == "DIGIT_SEQ" else sorted(L.ENGLISH_RANKS)) for _ in range(rng.randint(1, 7))) for n in range(3000))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    out = df.select("id", Normalization(spark).column(kind, F.col("text")).alias("r"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    engine = Engine(catalogues.defaults())
    for r in out.collect():
        assert tuple(r["r"]) == attempt(engine, kind, texts[r["id"]] or ""), repr(texts[r["id"]])
