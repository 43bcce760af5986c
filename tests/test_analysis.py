"""Ingestion and analysis as single operators, metadata, payloads, and late rows of a stream."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from pagemill.operators import analysis, pairs
from pagemill.sources import files
from pagemill.streaming import streams

CHUNKS = "doc_id long, page int, chunk_index int, text string"
FACTS = "doc_id long, ord int, subject string, predicate string, value string, page int, confidence double, evidence string"
ENTITIES = "doc_id long, ord int, text string, type string, confidence double, page int, snippet string, related string"


def test_analyze_corpus(spark):
    text = spark.createDataFrame([(1, 1, 0, "The retention period is 30%. See Section 9.9."), (1, 2, 1, "The retention period is 45%. TODO")], CHUNKS)
    ids = spark.createDataFrame([(1,), (2,), (2,)], "doc_id long")
    out = {r["doc_id"]: r for r in analysis.analyze_corpus(ids, text, spark.createDataFrame([], FACTS), spark.createDataFrame([], ENTITIES)).collect()}
    assert set(out) == {1, 2}
    assert (out[2]["score"], out[2]["confidence"], out[2]["n_chunks"]) == (100.0, 1.0, 0)
    assert all(out[2][c] == [] for c in ("contradictions", "references", "requirements", "entity_conflicts", "ambiguities", "deductions"))
    assert [c["type"] for c in out[1]["contradictions"]] == ["numerical"]
    assert [r["status"] for r in out[1]["references"]] == ["BROKEN_REFERENCE"]
    assert out[1]["score"] < 100 and len(out[1]["deductions"]) == 3
    assert out[1]["evidence"].startswith("Trust score computed from 2 chunks across 6 dimensions. Breakdown — Contradictions: 88%") and out[1]["breakdown"]["contradiction_health"] == 88
    assert out[1]["summary"]["major_contradictions"] == [out[1]["contradictions"][0]["summary"]] and out[1]["review"]["risk_items"] == ["Broken internal reference: Section 9.9 -> Section 9.9 (Page 1)"]
    assert (out[2]["evidence"], out[2]["breakdown"], out[2]["facts"], out[2]["entities"]) == ("", {}, [], [])
    assert out[2]["summary"]["executive_summary"] == "Document is processing." and out[2]["review"]["open_questions"] == []


def test_analysis_meets_once(spark):
    """Lists, scores and reports of a document meet in one shuffle, not in a join each; rows without document join nothing."""
    text = spark.createDataFrame([(1, 1, 0, "The retention period is 30%."), (None, 1, 0, "See Section 9.9.")], CHUNKS)
    ids = spark.createDataFrame([(1,), (None,)], "doc_id long")
    out = analysis.analyze_corpus(ids, text, spark.createDataFrame([], FACTS), spark.createDataFrame([], ENTITIES))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 1 and plan.count("Window ") == 0
    rows = {r["doc_id"]: r for r in out.collect()}
    assert set(rows) == {1, None} and rows[None]["references"] == [] and rows[None]["summary"]["executive_summary"] == "Document is processing."


def test_explained_and_ids(spark):
    row = [(7, "date", "Due date", "May 1, 2024", 1, "May 2, 2024", 3, "a", "b")]
    given = spark.createDataFrame(row, "doc_id long, type string, label string, value_a string, page_a int, value_b string, page_b int, snippet_a string, snippet_b string")
    out = analysis.with_finding_ids(analysis.explained(given), ["doc_id", "label", "value_a", "value_b"], "finding").first()
    assert out["explanation"] == "The document assigns conflicting date values to 'Due date'. Page 1 states 'May 1, 2024' while page 3 states 'May 2, 2024'. One of these must be incorrect."
    assert [(s["text"], s["page"]) for s in out["statements"]] == [("a", 1), ("b", 3)]
    assert out["finding_id"] == analysis.with_finding_ids(given, ["doc_id", "label", "value_a", "value_b"], "finding").first()["finding_id"]


def test_ingest_again_replaces(spark):
    path = f"{tempfile.mkdtemp(prefix='spark-')}/chunks"
    each = analysis.ingest_into(path)
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    each(docs((1, "One sentence here."), (2, "Another one."), (3, None)), 0)
    each(docs((1, "Wholly new text."), (4, "")), 1)
    each(docs((1, "Wholly new text.")), 1)
    assert sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(path).collect()) == [(1, "Wholly new text."), (2, "Another one.")]
    each(docs((1, None), (2, "")), 2)
    assert spark.read.schema("doc_id long").parquet(path).count() == 0


def test_metadata_and_payloads(spark):
    given = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": None}), (None, None)], "x map<string,string>, y map<string,string>")
    assert [r[0] for r in given.select(analysis.merged_metadata(F.col("x"), F.col("y"))).collect()] == [{"a": "1", "b": "3"}, {}]
    payloads = spark.createDataFrame([('{"confidence": "high", "text": ""}',), ('{"confidence": 0.5, "text": "x"}',), ("no json",), (None,)], "payload string")
    out = analysis.with_defaults(payloads, "confidence double, text string", {"confidence": 1.0, "text": "entity"}).collect()
    assert [(r["confidence"], r["text"]) for r in out] == [(1.0, "entity"), (0.5, "x"), (1.0, "entity"), (1.0, "entity")]


def test_listed_payloads(spark):
    """Fields that are missing, null, empty, mistyped or nested; elements that are no objects; payloads without a list."""
    rows = ['{"f": [{"t": "a", "c": 0.5, "p": 2}, {"t": "", "c": "high", "p": null}, {"c": "0.25", "p": "7"}, 3, {"t": {"x": [1]}, "c": [1], "p": 2.9}]}', '{"f": {"t": "a"}}', '{"g": []}', '{"f": []}', "broken", None]
    given = spark.createDataFrame(list(enumerate(rows)), "k int, payload string")
    out = [tuple(r) for r in analysis.listed_with_defaults(given, "$.f", "t string, c double, p int", {"t": "none", "c": 1.0, "p": 1}).drop("payload").orderBy("k", "place").collect()]
    assert out[:4] == [(0, 0, "a", 0.5, 2), (0, 1, "none", 1.0, 1), (0, 2, "none", 0.25, 7), (0, 3, "none", 1.0, 1)]
    assert out[4][:4] == (0, 4, '{"x":[1]}', 1.0) and len(out) == 5
    texts = spark.createDataFrame([('{"a": 1, "b": null, "c": [1, "x"], "d": {"e": true}, "f": "t", "g": 1.5, "h": false}',), ("[1]",), ("no",), (None,)], "t string")
    assert [r[0] for r in texts.select(files.sanitised_json(F.col("t"))).collect()] == [{"a": "1", "c": '[1,"x"]', "d": '{"e":true}', "f": "t", "g": "1.5", "h": "false"}, {}, {}, {}]


def test_lost_buckets_are_reported(spark):
    """What was written is read back: a bucket that is lost, cut or changed is told with the rows expected and found."""
    import os
    import shutil

    base = tempfile.mkdtemp(prefix="spark-")
    path, failures = f"{base}/chunks", f"{base}/failures"
    rows = spark.createDataFrame([(i, f"text {i}", None if i % 3 else i) for i in range(200)], "doc_id long, text string, page int")
    files.replace_in(spark, rows, rows.select("doc_id"), path, failures=failures)
    again = rows.where("doc_id < 50")
    files.replace_in(spark, again, again.select("doc_id"), path, failures=failures)
    assert spark.read.schema("doc_bucket long").parquet(failures).count() == 0 and files.read_back(rows, path).count() == 0
    buckets = sorted(int(d.split("=")[1]) for d in os.listdir(path) if d.startswith("doc_bucket="))
    shutil.rmtree(f"{path}/doc_bucket={buckets[0]}")
    own = {b: rows.where(f"pmod(xxhash64(doc_id), 64) = {b}") for b in buckets[:3]}
    own[buckets[1]].limit(1).coalesce(1).write.mode("overwrite").parquet(f"{path}/doc_bucket={buckets[1]}")
    own[buckets[2]].withColumn("text", F.upper("text")).coalesce(1).write.mode("overwrite").parquet(f"{path}/doc_bucket={buckets[2]}")
    told = {r["doc_bucket"]: (r["expected"], r["found"]) for r in files.read_back(rows, path).collect()}
    assert told == {buckets[0]: (own[buckets[0]].count(), 0), buckets[1]: (own[buckets[1]].count(), 1), buckets[2]: (own[buckets[2]].count(),) * 2} or own[buckets[1]].count() == 1


def test_contexts_and_segments(spark):
    text = spark.createDataFrame([(1, 1, 1, "b" * 20), (1, 1, 0, "a")], CHUNKS)
    assert analysis.context_head(text).first()["context"] == "[Segment 1]\na\n\n---\n\n[Segment 2]\n" + "b" * 20
    assert analysis.context_head(text, most_chars=12).first()["context"] == "[Segment 1]\n\n\n[...truncated for entity analysis...]"
    hits = spark.createDataFrame([(1, 2, 9, 3, "y"), (1, 1, 8, 2, "x")], "query_id long, rank int, doc_id long, page int, text string")
    assert analysis.merged_context(hits).first()["context"] == "[Source: Doc ID 8, Page 2] x\n\n[Source: Doc ID 9, Page 3] y"
    segments = spark.createDataFrame([(1, 0, 4, 0), (1, 0, 5, 1)], "doc_id long, batch int, page int, chunk_index int")
    facts = spark.createDataFrame([(1, 0, 5), (1, 0, 6)], "doc_id long, batch int, page int")
    assert sorted((r["page"], r["chunk_index"]) for r in analysis.source_segments(facts, segments).collect()) == [(5, 1), (6, 0)]


def test_nested_findings_need_two_statements(spark):
    reply = '{"contradictions": [{"conflictingStatements": [{"text": "a", "page": 1}]}, {"conflictingStatements": [{"text": "a", "page": 1}, {"text": "b", "page": 2}]}]}'
    out = pairs.nested_findings(spark.createDataFrame([(1, 1, reply), (1, 2, "none")], "doc_id long, reply_id int, reply string")).collect()
    assert [(r["finding"], r["summary"], r["confidence"]) for r in out] == [(1, "Contradiction detected", 0.8)]


def test_late_rows_and_state_across_batches(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    schema = "ts timestamp_ntz, event_type string, value double"
    for rows in ([(day(1), "a", 1.0)], [(day(1, 1), "a", 2.0)], [(day(10), "a", 4.0)], [(day(11), "a", 32.0)], [(day(1, 2), "a", 8.0)], [(day(20), "a", 16.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    counted = streams.window_counts(streams.file_stream(spark, path, spark.read.parquet(path)), "1 day")
    out = streams.drained(counted).select(F.dayofmonth("window_start").alias("day"), "n", "total").collect()
    assert sorted(tuple(r) for r in out) == [(1, 2, 3.0), (10, 1, 4.0), (11, 1, 32.0)]


def test_delete_leaves_rows_without_value(spark):
    rows = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")
    assert [r["doc_id"] for r in files.delete(rows, {"text": "x"}).collect()] == [2]


def test_replace_in_leaves_other_files(spark):
    """New documents are only added, and of old ones only their files are written anew; a run that broke off leaves nothing twice."""
    import glob
    import os
    import shutil

    path = "file://" + tempfile.mkdtemp(prefix="spark-") + "/a table"
    root = path.removeprefix("file://")
    rows = lambda ids, text: spark.createDataFrame([(f"{i}-{k}", i, text) for i in ids for k in (0, 1)], "chunk_id string, doc_id long, text string")
    put = lambda chunks, ids: files.replace_in(spark, chunks, spark.createDataFrame([(i,) for i in ids], "doc_id long"), path, buckets=4)
    held = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/*/*.parquet")}
    read = lambda: sorted(tuple(r) for r in spark.read.parquet(path).select("chunk_id", "text").collect())
    put(rows(range(40), "a"), range(40))
    first = held()
    put(rows(range(40, 80), "b"), range(40, 80))
    second = held()
    assert first.items() < second.items()
    want = {(f"{i}-{k}", "a" if i < 40 else "b") for i in range(80) for k in (0, 1)}
    assert read() == sorted(want)
    copies = tempfile.mkdtemp(prefix="spark-")
    for n, f in enumerate(first):
        shutil.copy(f, f"{copies}/{n}")
    put(rows([7, 8], "c").where("doc_id = 8"), [7, 8])  # the one has no chunks any more
    assert {f: t for f, t in second.items() if f not in first}.items() < held().items()
    want = {(c, "c" if c[:2] == "8-" else t) for c, t in want if c[:2] != "7-"}
    assert read() == sorted(want)
    for n, f in enumerate(first):  # as if the run had broken off before old files went
        shutil.copy(f"{copies}/{n}", f)
    put(rows([7, 8], "c").where("doc_id = 8"), [7, 8])
    assert {r for r in read() if r[1] != "a"} == {r for r in want if r[1] != "a"} and len(set(read())) == len(read())
