"""Larger tables and keys: what is shown, read or placed does not depend on how large a key is."""

from pyspark.sql import functions as F

from tidewrit.functions import catalogues, forms
from tidewrit.functions.normalizers import Engine
from tidewrit.operators import converters, metrics
from tidewrit.operators import spans as S
from tidewrit.operators.normalize import Normalization
from tidewrit.plans import corpora


def test_examples_of_words_in_rows(spark):
    """A text of a hundred million words, of which only the words of spans are there."""
    far = 10**8
    gold = spark.createDataFrame([(1, far, far + 1, "DATE"), (1, far + 5, far + 5, "DATE"), (2, 0, 0, "TIME")], "id long, start long, end long, type string")
    pred = spark.createDataFrame([(1, far, far + 1, "DATE"), (2, 0, 0, "DATE")], "id long, start long, end long, type string")
    words = spark.createDataFrame([(1, far + 1, "b_c"), (1, far, "a"), (1, far + 5, "d"), (1, far + 5, "d"), (2, 0, "e"), (3, 0, "f")], "id long, pos long, word string")
    arrays = spark.createDataFrame([(2, ["e"])], "id long, words array<string>")
    assert {tuple(r) for r in metrics.examples(gold, pred, words).collect()} == {("DATE", "a b c", "d -> nothing"), ("TIME", "", "e -> DATE")}
    assert [tuple(r) for r in metrics.examples(gold, pred, arrays).collect()] == [("TIME", "", "e -> DATE")]


def test_dotted_addresses_with_twos_before_dots():
    """hai chấm is a colon too, and 170::90:186 is an address, but so said is 172.2.92.186."""
    engine = Engine(catalogues.defaults())
    said = {
        "một trăm bảy mươi hai chấm hai chấm chín mươi hai chấm một trăm tám mươi sáu": "172.2.92.186", "bảy mươi hai chấm ba mươi hai chấm hai chấm hai trăm ba mươi lăm": "72.32.2.235",
        "hai chấm hai chấm hai chấm hai": "2.2.2.2", "hai không không một hai chấm không hai chấm hai chấm một": "2001:0::1",
    }
    assert {k: engine.normalize("ELECTRONIC", k)[0] for k in said} == said


def test_records_of_one_small_file_reach_all_cores(spark):
    """Orders come in one part, and reading them costs far more than moving them."""
    for made in (corpora.orders, corpora.pairs):
        assert made(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_tags_and_marks_without_accumulators(spark):
    """Spans and words are found by places: nothing is copied at every step, so a long text costs no square of its length."""
    n = 20_000
    long = spark.range(1).select(F.array_repeat(F.lit("a"), n).alias("tokens"), F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when(i % 2 == 0, "I-DATE").otherwise("B-DATE")).alias("tags"))
    out = long.select(S.bio_spans(F.col("tags")).alias("s"), converters.stripped(F.col("tokens"), F.col("tags")).alias("m"))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "aggregate(" not in plan
    assert out.select(F.size("s"), F.size("m.words"), F.size("m.punct")).first() == (n // 2, n, n)
    odd = [(None, None, True), ([], [], True), (["B-A", "I-A", "O", "B-B", "I-A"], None, True), (["I-A", "I-B", "O", "X", "I-C", None, "I-A"], [(0, 1, "A"), (3, 4, ""), (5, 5, None), (6, 6, "A")], False), (["B-A", None], None, True), (["B-A", "B-A", "I-A"], [(0, 0, "A"), (1, 2, "A")], True)]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(odd)], "i int, t array<string>").select("i", S.bio_spans(F.col("t")).alias("strict"), S.bio_spans(F.col("t"), strict=False).alias("lenient"))
    for r in df.orderBy("i").collect():
        got = r["strict"] if odd[r["i"]][2] else r["lenient"]
        assert (got and [tuple(s) for s in got]) == odd[r["i"]][1], r
    marks = {k: v for k, v in forms.MARKS.items() if k != ":"}
    df = spark.createDataFrame([([",", "A", ".", "?", ":", "b", "!"],), ([".", ","],), ([],)], "t array<string>").select(converters.labels_behind(converters.mark_letters(F.col("t"), marks), marks).alias("p"))
    assert [r["p"] for r in df.collect()] == [["QUESTION", "O", "PERIOD"], [], []]


def test_null_tokens_of_split_bundles_keep_their_places(spark):
    rows = spark.createDataFrame([("a", "train", ["còn", None, "ba", "."], ["O", "O", "B-CARDINAL", "O"], "x")], "id string, split string, tokens array<string>, bio_tags array<string>, normalized_text string")
    got = converters.from_split_bundle(rows).first()
    assert (got["words"], got["punct"], got["spans"]) == (["còn", "", "ba"], ["O", "O", "PERIOD"], [(2, 2, "CARDINAL")])


def test_pairs_with_one_id_keep_their_own_regions(spark):
    """Regions of pairs that share an id, or have none, are not mixed."""
    said = {"có 12 tấn": "có mười hai tấn", "còn lại 7 tấn": "còn lại bảy tấn", "hết": "hết"}
    pairs = spark.createDataFrame([("1" if i < 2 else None, w, s, "t") for i, (w, s) in enumerate(said.items())], "id string, written string, spoken string, topic string")
    types = spark.createDataFrame([("12", "mười hai", "CARDINAL"), ("7", "bảy", "CARDINAL")], "written string, spoken string, type string")
    out = converters.from_typed_regions(spark, pairs, types, Normalization(spark)).select("spoken", "written", "reason", F.size("spans").alias("n")).collect()
    assert {tuple(r) for r in out} == {("có mười hai tấn", "Có 12 tấn", None, 1), ("còn lại bảy tấn", "Còn lại 7 tấn", None, 1), ("hết", "Hết", None, 0)}
