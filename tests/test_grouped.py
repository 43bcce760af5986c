"""Matches of several patterns in one pass, and pairs made where a label's occurrences meet."""

from itertools import combinations

from pyspark.sql import functions as F

from pagemill.functions import patterns as P
from pagemill.functions.scan import Rule, every_match, java, matches, snippet
from pagemill.functions.text import strip
from pagemill.operators import audit

SCHEMA = "doc_id long, page int, chunk_index int, text string"
TEXTS = ["The rate is 5 s. A size\x1cof 6 GB; the RATE was 7\tdays", "é the rate is 5 s; size of 6 GB.", "a\x01b is 7 GB", "ſize of Kits is 9 GB", "", None, "\nrate is 1\n", "no number", "due  is 5,000  USD. The cap\x0b is 3 GBP x"]


def test_every_match(spark):
    """The same rows from Arrow batches and from Java's patterns, whatever letters a text has; snippets too."""
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    patterns = [P.NUMERIC, P.MONEY, P.POSITIVE]
    found = every_match(frame, ["i"], [Rule(java(p), P.NO_LABEL if p != P.POSITIVE else None, "is" if k == 1 else "") for k, p in enumerate(patterns)], 2, (4, 3))
    rows = sorted(tuple(r) for r in found.withColumn("around", F.translate("around", "\n", " ")).collect())
    expected = []
    for k, p in enumerate(patterns):
        one = frame.select("i", "text", F.posexplode(matches(F.col("text"), java(p), 2, None, False)).alias("n", "m"))
        expected += one.select("i", F.lit(k), "n", "m.match", strip(F.col("m.g1")), strip(F.col("m.g2")), "m.start", snippet(F.col("text"), F.col("m.start"), F.length("m.match"), 4, 3)).collect()
    assert rows == sorted(map(tuple, expected)) and len(rows) > 6
    assert "ArrowEvalPython" not in (plan := found._jdf.queryExecution().toString()) and plan.count("MapInArrow") >= 1


def test_strip(spark):
    texts = ["a", " a", "a ", "\x85a b\xa0", "", " \n", "\x1ca", "é ", None, "a\r\n"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r[0] == r[1] for r in frame.select(strip(F.col("t")), F.regexp_replace("t", r"(?U)^\s+|\s+$", "")).collect())


def test_a_label_meets_once(spark):
    """Pairs are made where a label's occurrences meet: one shuffle, no join, also for groups of many batches."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rows = [(1, i % 7, i, f"The rate is {i % 13}. The cap is {i}.") for i in range(600)] + [(2, i, i, f"The rate is {i}.") for i in range(3)]
        found = audit.numeric_conflicts(spark.createDataFrame(rows, SCHEMA), snippets=False)
        got = [(r.doc_id, r.label, r.value_a, r.page_a, r.value_b, r.page_b) for r in found.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    occ = [(1, "The rate", f"{i % 13}.", i % 7) for i in range(600)], [(1, "The cap", str(i), i % 7) for i in range(600)], [(2, "The rate", str(i), i) for i in range(3)]
    want = [(*a, *b[2:]) for own in occ for a, b in combinations(dict.fromkeys(own), 2) if a[2] != b[2] and a[3] != b[3]]
    assert sorted(got) == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan and "Window" not in plan


def test_summaries_are_not_shuffled(spark):
    """Only duties meet by summary; scores need no summary at all."""
    chunks = spark.createDataFrame([(1, 1, 0, "The rate is 5."), (1, 2, 1, "The rate is 6.")], SCHEMA)
    plan = audit.contradictions(chunks).groupBy("severity").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan and plan.count("Window [") == 1 and "Join" not in plan


def test_wide_summaries_are_merged_in_their_label(spark):
    """Summaries alike in their first characters, cut within the first value, within the second, or not at all."""
    long = "1" * 60
    rows = [(1, p, p, f"The rate is {long}{p}. The size is {'2' * 25}{p}. The other is {p}.") for p in range(1, 6)]
    chunks = spark.createDataFrame([*rows, (1, 9, 9, f"The rate is {long}1. The size is {'2' * 25}. The long label that goes on and on is {'3' * 31}1"), (1, 10, 10, f"The long label that goes on and on is {'3' * 31}2")], SCHEMA)
    whole = audit.merged(audit.as_findings(audit.conflict_pairs(audit.occurrences(chunks))))
    assert sorted(map(tuple, audit.contradictions(chunks).collect())) == sorted(map(tuple, whole.collect()))


def test_semantic_findings_give_way_to_detected_ones(spark):
    chunks = spark.createDataFrame([(1, 1, 0, "The rate is 5."), (1, 2, 1, "The rate is 6."), (2, 1, 0, "none")], SCHEMA)
    said = " numerical CONFLICT for 'The rate': '5' (page 1) vs '6' (page 2)"
    rows = [(1, 1, said, 3), (1, 2, "differs", 0), (1, 3, "Differs ", 4), (2, 1, said, 5), (2, 2, " ", 1)]
    semantic = spark.createDataFrame([(d, o, "logical", "low", 0.5, e, p) for d, o, e, p in rows], "doc_id long, ord int, type string, severity string, confidence double, explanation string, page_a int")
    found = audit.contradictions(chunks, semantic)
    assert sorted((r.doc_id, r.type, r.explanation.strip(), r.page) for r in found.collect()) == [(1, "logical", "differs", 1), (1, "numerical", "", 1), (2, "logical", said.strip(), 5)]
    plan = audit.contradictions(chunks, semantic.where("explanation like '%iffers%'"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2 and plan.count("Window [") == 1 and "Join" not in plan  # as without semantic ones


def test_access_scope_of_workspaces_with_documents(spark):
    """Readers are found for workspaces with documents only, and meet a large one's documents in groups."""
    from pagemill.operators import workspace

    documents = spark.range(9000).select(F.col("id").alias("document_id"), F.when(F.col("id") < 8990, 1).otherwise(F.col("id") % 3 + 2).cast("long").alias("workspace_id"))
    spaces = spark.createDataFrame([(1, 7, 10), (2, 7, None), (3, 8, 11), (4, 7, 11), (5, 9, 10)], "workspace_id long, owner_id long, organization_id long")
    members = spark.createDataFrame([(7, 10, "admin"), (8, 10, "member"), (8, 11, "member")], "user_id long, organization_id long, role string")
    found = workspace.access_scope(documents, spaces, members)
    n = {r[0]: r[1] for r in documents.groupBy("workspace_id").count().collect()}
    want = {(1, 7, "admin"): n[1], (1, 8, "member"): n[1], (2, 7, "admin"): n[2], (3, 8, "member"): n[3], (4, 7, None): n[4], (4, 8, "member"): n[4]}
    assert {(r[0], r[1], r[2]): r[3] for r in found.groupBy("workspace_id", "user_id", "role").count().collect()} == want
    assert found.distinct().count() == found.count()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.count("pmod") >= 1
