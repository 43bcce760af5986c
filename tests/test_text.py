from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.functions.scan import matches
from pagemill.functions.vectors import hash_embedding, unit
from pagemill.operators.retrieval import context_text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_cleaners(spark):
    assert one(spark, "“Plain” — ‘text’ –- here", lambda t: T.clean(t)) == "\"Plain\" - 'text' -- here"
    assert one(spark, "Hello\tworld   with   many    spaces.", T.single_spaces) == "Hello world with many spaces."
    assert one(spark, "Line 1\n\n\n\n\nLine 2", T.double_newlines) == "Line 1\n\nLine 2"
    assert one(spark, "Hello\x00\x08World\nWith\tTabs", T.without_controls) == "HelloWorld\nWith\tTabs"
    assert one(spark, "Page 1 of 5\n- 3 -\n[Page 12]\nPage 4", lambda t: T.clean(t)) == ""
    assert one(spark, ' \t “Welcome!”\n\n\n\nPage 1 of 1\n\nThis is\t\ta  clean  testcase.\x07 ', lambda t: T.clean(t)) == '"Welcome!"\n\nThis is a clean testcase.'
    assert one(spark, "ﬁne ①", T.compatible) == "fine 1"
    assert one(spark, None, lambda t: T.clean(t)) is None


def test_sentences_and_tokens(spark):
    assert one(spark, "One. Two!  Three?\nFour", T.sentences) == ["One.", "Two!", "Three?", "Four"]
    assert one(spark, "ab", T.token_estimate) == 1
    assert one(spark, "The cat is on it", T.query_tokens) == ["cat", "it"]
    assert one(spark, "the a", T.query_tokens) == ["the", "a"]


def test_matches_have_offsets(spark):
    found = one(spark, "é ab12 cd3 x9", lambda t: matches(t, r"([a-z]+)(\d+)", 2))
    assert [tuple(m) for m in found] == [(2, "ab12", "ab", "12"), (7, "cd3", "cd", "3"), (11, "x9", "x", "9")]
    assert one(spark, "none", lambda t: matches(t, r"\d", 0)) == []


def test_vectors(spark):
    row = spark.range(1).select(unit(F.array(F.lit(3.0), F.lit(4.0))).alias("a"), unit(F.array(F.lit(0.0), F.lit(0.0))).alias("b"), hash_embedding(F.lit("x"), 48).alias("c")).first()
    assert row.a == [0.6, 0.8] and row.b == [0.0, 0.0]
    assert len(row.c) == 48 and abs(sum(x * x for x in row.c) - 1) < 1e-12 and row.c[:10] == row.c[32:42]


def test_two_places_round_by_the_exact_value(spark):
    values = [0.595, 0.125, 0.375, 0.585, 0.5949, 1.0, 0.0, None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").select("i", T.two_places(F.col("x")).alias("t")).orderBy("i").collect()
    assert [r.t for r in rows] == [None if v is None else f"{v:.2f}" for v in values]
    packed = spark.createDataFrame([(1, 1, 7, 1, "text", 0.595, 1, 31)], "query_id long, rank int, doc_id long, page int, text string, score double, position int, tokens_so_far int")
    names = spark.createDataFrame([(7, "Doc 7")], "doc_id long, name string")
    assert context_text(packed, names).first().context == "=== SOURCE DOCUMENT: Doc 7 ===\n[Page 1 | Relevance: 0.59]:\ntext\n---"
