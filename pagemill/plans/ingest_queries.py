"""Queries of ingestion and analysis as single operators, of streams over several batches, and of small tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagemill.functions.vectors import hash_embedding
from pagemill.operators import analysis, audit, chunking, pairs, retrieval, workspace
from pagemill.plans import audit_queries as own_audit, core_queries as core
from pagemill.plans.corpora import ENTITIES, FACTS, chunks, derived, duck_sql
from pagemill.session import materialise, table, workspace as fresh_path
from pagemill.sources import files
from pagemill.streaming import streams


def in_files(spark: SparkSession, rows: DataFrame, order: str, files: int = 4) -> DataFrame:
    """A stream of ``rows`` written as some files in ``order``, a file a micro-batch."""
    path = fresh_path(spark, "stream-input")
    rows.repartitionByRange(files, order).write.parquet(path)
    return streams.file_stream(spark, path, rows)


def ingest_corpus(spark, sf_dir):
    """Documents as a stream of files into a chunk table; then some of them come once more, which changes nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = fresh_path(spark, "ingested-chunks")
    each = analysis.ingest_into(path, embed=lambda text: hash_embedding(text, core.DIM))
    for arriving in (docs, docs.where("doc_id % 10 = 0")):
        streams.ingest(in_files(spark, arriving, "doc_id"), each, fresh_path(spark, "ingest-checkpoint")).awaitTermination()
    made = spark.read.parquet(path)
    return made.select("doc_id", "chunk_index", "page", "token_count", "first_sentence", "n_sentences", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def analysed(spark, sf_dir):
    """All orders as documents, and a document without chunks for each customer."""
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("doc_id"))
    ids = ids.unionByName(table(spark, sf_dir, "customer").select((-F.col("c_custkey")).cast("long").alias("doc_id")))
    text = materialise(chunks(spark, sf_dir), "audited-chunks")
    return materialise(analysis.analyze_corpus(ids, text, derived(spark, sf_dir, FACTS), derived(spark, sf_dir, ENTITIES)), "analysis")


LISTS = ["facts", "entities", "contradictions", "references", "requirements", "entity_conflicts", "ambiguities", "deductions"]


def analyze_corpus(spark, sf_dir):
    return analysed(spark, sf_dir).select("doc_id", "score", "confidence", F.col("n_chunks").cast("long").alias("n_chunks"), *(F.size(c).cast("long").alias(c) for c in LISTS), F.get("contradictions", F.lit(0))["summary"].alias("first_summary"), "evidence", F.round(F.col("breakdown")["contradiction_health"], 2).alias("health"), F.col("summary.executive_summary").alias("said"), F.size("review.risk_items").cast("long").alias("risks"), F.array_join(F.transform("facts", lambda f: f["id"]), ",").alias("fact_ids"))


#: expectations of an analysed document; the same text in both engines
RULES = {
    "score in range": "score >= 0 and score <= 100",
    "no deduction, full score": "deductions > 0 or score = 100",
    "conflicts lower the score": "contradictions = 0 or score < 100",
    "sure only with chunks": "n_chunks = 0 or confidence < 1",
    "few ambiguities": "ambiguities <= 2",
}


def corpus_expectations(spark, sf_dir):
    found = analyze_corpus(spark, sf_dir)
    pack = found.select("doc_id", F.when(F.col("n_chunks") <= 1, "easy").when(F.col("n_chunks") <= 3, "medium").when(F.col("n_chunks") <= 5, "hard").otherwise("nightmare").alias("pack"))
    return workspace.quality_report(analysis.expectations(found, RULES).join(pack, "doc_id"))


def explained_conflicts(spark, sf_dir):
    found = analysis.explained(audit.date_conflicts(chunks(spark, sf_dir)))
    found = analysis.with_finding_ids(found, ["doc_id", "type", "label", "value_a", "page_a", "value_b", "page_b"], "finding")
    return found.select("doc_id", "finding_id", "explanation", F.col("statements")[0]["page"].alias("first_page"), F.col("statements")[1]["page"].alias("second_page"))


def document_chunks(spark, sf_dir):
    return chunking.chunk_documents(chunking.clean_pages(core.pages(spark, sf_dir)))


def chunk_scan(spark, sf_dir):
    return analysis.chunk_scan(chunks(spark, sf_dir), [1, 2, 3, 5, 7]).select("doc_id", "chunk_index", "page", F.sha2("text", 256).alias("text_sha256"))


def context_head(spark, sf_dir):
    return analysis.context_head(document_chunks(spark, sf_dir)).select("doc_id", F.length("context").alias("n_chars"), F.sha2("context", 256).alias("context_sha256"))


def merged_context(spark, sf_dir):
    return analysis.merged_context(retrieval.retrieve(*core.corpus(spark, sf_dir))).select("query_id", F.length("context").alias("n_chars"), F.sha2("context", 256).alias("context_sha256"))


def session_retrieval(spark, sf_dir):
    """Every other query belongs to a session over the documents with its remainder by 5."""
    asked, own = core.corpus(spark, sf_dir)
    sessions = asked.where("query_id % 2 = 0").select("query_id", (F.col("query_id") % 5).alias("r"))
    scope = own.select("doc_id").distinct().withColumn("r", F.col("doc_id") % 5).join(sessions, "r").select("query_id", "doc_id")
    return retrieval.dense_search(asked, own, scope=scope).select("query_id", "rank", "chunk_id", F.round("similarity", 6).alias("similarity"))


def source_segments(spark, sf_dir):
    text = chunks(spark, sf_dir).withColumn("batch", F.expr("chunk_index div 3"))
    facts = text.select("doc_id", "batch", F.col("chunk_index").alias("fact"), F.when(F.col("page") % 3 == 0, F.lit(99)).otherwise(F.col("page")).alias("page"))
    return analysis.source_segments(facts, text.select("doc_id", "batch", "page", "chunk_index")).select("doc_id", "fact", "page", "chunk_index")


def run_telemetry(spark, sf_dir):
    said = derived(spark, sf_dir, FACTS).select("doc_id", F.concat_ws(" ", "predicate", "value").alias("summary"))
    calls = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("long").alias("doc_id"), (F.col("o_custkey") % 100 / 8).alias("seconds"))
    return analysis.run_telemetry(chunks(spark, sf_dir).select("doc_id"), said, calls)


def payload_defaults(spark, sf_dir):
    """Payloads of orders: a score that is often no number, an empty label, broken JSON."""
    body = F.format_string('{"score": "%s", "label": "%s", "page": %s}', F.when(F.col("o_custkey") % 3 == 0, "n/a").otherwise(F.col("o_custkey").cast("string")), F.when(F.col("o_custkey") % 5 == 0, "").otherwise(F.col("o_orderstatus")), F.when(F.col("o_orderkey") % 4 == 0, "null").otherwise((F.col("o_orderkey") % 9).cast("string")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "broken").otherwise(body).alias("payload"))
    return analysis.with_defaults(rows, "score double, label string, page int", {"score": 1.0, "label": "ENTITY", "page": 1}).drop("payload")


#: a list of findings with missing, null, empty, mistyped and nested fields, and elements that are no objects
LISTED = """CASE WHEN o_orderkey % 11 = 0 THEN '{{"findings": "none"}}' WHEN o_orderkey % 13 = 0 THEN 'broken' ELSE concat('{{"findings": [{{"label": "', CASE WHEN o_custkey % 3 = 0 THEN '' ELSE o_orderstatus END, '", "score": ', CASE o_custkey % 5 WHEN 0 THEN '"high"' WHEN 1 THEN 'null' WHEN 2 THEN '"0.25"' WHEN 3 THEN '[1]' ELSE '0.5' END, ', "page": ', cast(o_orderkey % 9 AS {STRING}),
    '}}, 7, {{"label": [1, "x"], "page": true}}]}}') END"""


def listed_payloads(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(LISTED.format(STRING="string")).alias("payload"))
    return analysis.listed_with_defaults(rows, "$.findings", "label string, score double, page int", {"label": "ENTITY", "score": 1.0, "page": 1}).drop("payload")


def json_metadata(spark, sf_dir):
    """Metadata of parts given as JSON objects."""
    body = F.format_string('{"size": %d, "brand": "%s", "gone": null, "price": %s, "tags": ["a", %d], "nested": {"x": %d}, "odd": %s}', "p_size", "p_brand", (F.col("p_size") / 4).cast("string"), "p_size", "p_size", F.when(F.col("p_size") % 2 == 0, "true").otherwise("false"))
    made = table(spark, sf_dir, "part").select("p_partkey", files.sanitised_json(F.when(F.col("p_partkey") % 7 == 0, "[1]").otherwise(body)).alias("m"))
    return made.select("p_partkey", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("metadata"))


def verified_ingest(spark, sf_dir):
    """The buckets of an ingested table that hold what was written, after a bucket is lost and a document is written again."""
    path, failures = fresh_path(spark, "verified-chunks"), fresh_path(spark, "failed-buckets")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), "text")
    files.replace_in(spark, docs, docs.select("doc_id").distinct(), path, failures=failures)
    files.replace_in(spark, docs.where("doc_id % 10 = 0"), docs.where("doc_id % 10 = 0").select("doc_id").distinct(), path, failures=failures)
    written = docs.withColumn("text", F.when(F.col("doc_id") % 97 == 0, F.concat("text", F.lit("lost"))).otherwise(F.col("text")))
    bad = files.read_back(written, path).select("doc_bucket", F.lit(True).alias("differs"))
    own = docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("doc_bucket"))
    told = spark.read.schema("doc_bucket long").parquet(failures).select("doc_bucket", F.lit(True).alias("failed")).distinct()
    rows = own.join(bad, "doc_bucket", "left").join(told, "doc_bucket", "left")
    # of a document whose text was changed, the bucket differs; no write failed
    return rows.where("doc_id % 97 = 0").select("doc_id", F.coalesce("differs", F.lit(False)).alias("differs"), F.coalesce("failed", F.lit(False)).alias("failed"))


def document_metadata(spark, sf_dir):
    """Metadata of parts, merged with changes that win, without nulls."""
    base = F.create_map(F.lit("brand"), "p_brand", F.lit("size"), F.col("p_size").cast("string"), F.lit("type"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")))
    new = F.when(F.col("p_partkey") % 3 == 0, F.create_map(F.lit("size"), F.lit("changed"), F.lit("state"), F.lit("COMPLETED")))
    merged = table(spark, sf_dir, "part").select("p_partkey", analysis.merged_metadata(base, new).alias("m"))
    return merged.select("p_partkey", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("metadata"))


def user_organisations(spark, sf_dir):
    _, members, _, _ = core.tenants(spark, sf_dir)
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("organization_id"), F.col("n_name").alias("organization"))
    return workspace.organisations_of(members, names)


def activity_log(spark, sf_dir):
    log = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("workspace_id"), F.col("event_type").alias("action"), "ts", "event_id")
    return workspace.audit_report(log)[0].select("workspace_id", "action", "event_id")


NESTED = """SELECT l_orderkey AS doc_id, l_linenumber AS reply_id, concat('```json {{"contradictions": [{{"summary": "Item ', cast(l_partkey % 50 AS {STRING}), '", "confidence": 0.5, "conflictingStatements": [{{"text": "a", "page": 1}}, {{"text": "b", "page": ', cast(l_linenumber AS {STRING}), '}}]}}, {{"conflictingStatements": [{{"text": "alone", "page": 2}}]}}]}} ```') AS reply
FROM lineitem"""


def nested_findings(spark, sf_dir):
    found = pairs.nested_findings(derived(spark, sf_dir, NESTED))
    return found.select("doc_id", "reply_id", "finding", "type", "summary", "confidence", F.element_at("statements", 2)["page"].alias("second_page"))


def events(spark, sf_dir):
    return in_files(spark, table(spark, sf_dir, "events"), "ts")


def stream_sliding_counts(spark, sf_dir):
    counted = streams.drained(streams.window_counts(events(spark, sf_dir), "1 day", "6 hours"), "complete")
    return counted.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def stream_sessions(spark, sf_dir):
    found = streams.drained(streams.session_counts(events(spark, sf_dir), "12 hours", "3650 days"), "complete")
    return found.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")), "n")


def stream_findings(spark, sf_dir):
    said = events(spark, sf_dir).select(F.col("user_id").alias("doc_id"), F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.concat(F.lit(" "), "event_type")).alias("summary"), "ts")
    return streams.drained(streams.distinct_findings(said, "3650 days")).select("doc_id", "summary_key")


def stream_status(spark, sf_dir):
    changes = events(spark, sf_dir).select(F.col("user_id").alias("document_id"), F.col("event_id").cast("string").alias("status"), F.struct("ts", "event_id").alias("ts"))
    return streams.drained(streams.latest_by_key(changes), "complete").select("document_id", "status")


QUERIES = {
    "ingest_corpus": ingest_corpus,
    "analyze_corpus": analyze_corpus,
    "corpus_expectations": corpus_expectations,
    "explained_conflicts": explained_conflicts,
    "chunk_scan": chunk_scan,
    "context_head": context_head,
    "merged_context": merged_context,
    "session_retrieval": session_retrieval,
    "source_segments": source_segments,
    "run_telemetry": run_telemetry,
    "payload_defaults": payload_defaults,
    "listed_payloads": listed_payloads,
    "json_metadata": json_metadata,
    "verified_ingest": verified_ingest,
    "document_metadata": document_metadata,
    "user_organisations": user_organisations,
    "activity_log": activity_log,
    "nested_findings": nested_findings,
    "stream_sliding_counts": stream_sliding_counts,
    "stream_sessions": stream_sessions,
    "stream_findings": stream_findings,
    "stream_status": stream_status,
}

_COUNTED = {"facts": "dx", "entities": "merged_ents", "contradictions": "merged", "references": "refs", "requirements": "matrix", "entity_conflicts": "entity_conflicts", "ambiguities": "vague", "deductions": "lost"}
_COUNTS = " ".join(f'LEFT JOIN (SELECT doc_id, count(*) AS "{k}" FROM {v} GROUP BY doc_id) USING (doc_id)' for k, v in _COUNTED.items())
_ANALYSED = f"""{own_audit.EVERYTHING}, {own_audit.SCORES}, {core._DEDUPED.removeprefix(core._F + ", ")}, ids AS (SELECT DISTINCT o_orderkey::BIGINT AS doc_id FROM orders UNION SELECT -c_custkey::BIGINT FROM customer),
    analysed AS (SELECT doc_id, coalesce(score, 100.0) AS score, coalesce(confidence, 1.0) AS confidence, coalesce(n_chunks, 0)::BIGINT AS n_chunks, {", ".join(f'coalesce("{k}", 0)::BIGINT AS "{k}"' for k in _COUNTED)} FROM ids LEFT JOIN (SELECT doc_id, score, confidence, n_chunks FROM trust) USING (doc_id) {_COUNTS})"""
_SECTION = "string_agg(concat('[Segment ', chunk_index + 1, ']', chr(10), text), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY chunk_index)"
_CORPUS = f"WITH {own_audit.CORPUS}"
ORACLE_SQL = {
    "ingest_corpus": core.ORACLE_SQL["chunk_documents"],
    "corpus_expectations": f"""{_ANALYSED}, checks AS ({" UNION ALL ".join(f"SELECT n_chunks, {rule} AS passed FROM analysed" for rule in RULES.values())})
        SELECT CASE WHEN n_chunks <= 1 THEN 'easy' WHEN n_chunks <= 3 THEN 'medium' WHEN n_chunks <= 5 THEN 'hard' ELSE 'nightmare' END AS pack, count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, CASE WHEN bool_and(passed) THEN 'PASS' ELSE 'FAIL' END AS status FROM checks GROUP BY 1""",
    "chunk_scan": f"{_CORPUS} SELECT doc_id, chunk_index, page, sha256(text) AS text_sha256 FROM corpus WHERE doc_id IN (1, 2, 3, 5, 7)",
    "context_head": f"{core._CHUNKS}, whole AS (SELECT doc_id, {_SECTION} AS w FROM ck WHERE chunk_index < 30 GROUP BY doc_id), cut AS (SELECT doc_id, CASE WHEN length(w) > 15000 THEN concat(substr(w, 1, 15000), chr(10), chr(10), '[...truncated for entity analysis...]') ELSE w END AS c FROM whole) SELECT doc_id, length(c) AS n_chars, sha256(c) AS context_sha256 FROM cut",
    "merged_context": f"{core._RETRIEVE}, mc AS (SELECT query_id, string_agg(concat('[Source: Doc ID ', doc_id, ', Page ', page, '] ', text), concat(chr(10), chr(10)) ORDER BY fr) AS c FROM hits GROUP BY query_id) SELECT query_id, length(c) AS n_chars, sha256(c) AS context_sha256 FROM mc",
    "session_retrieval": f"{core._SEARCH} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank, chunk_id, round(similarity, 6) AS similarity FROM dense WHERE query_id % 2 <> 0 OR doc_id % 5 = query_id % 5 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) <= 30",
    "source_segments": f"{_CORPUS}, s AS (SELECT *, chunk_index // 3 AS batch FROM corpus), f AS (SELECT doc_id, batch, chunk_index AS fact, CASE WHEN page % 3 = 0 THEN 99 ELSE page END AS page FROM s) SELECT doc_id, fact, page, coalesce((SELECT min(chunk_index) FROM s WHERE s.doc_id = f.doc_id AND s.batch = f.batch AND s.page = f.page), (SELECT min(chunk_index) FROM s WHERE s.doc_id = f.doc_id AND s.batch = f.batch)) AS chunk_index FROM f",
    "run_telemetry": f"{_CORPUS}, facts AS ({duck_sql(FACTS)}), a AS (SELECT doc_id, count(*) AS retrieved FROM corpus GROUP BY 1), b AS (SELECT doc_id, count(DISTINCT lower(trim(concat_ws(' ', predicate, value)))) AS contradictions FROM facts GROUP BY 1), c AS (SELECT o_orderkey::BIGINT AS doc_id, round(sum(o_custkey % 100 / 8.0::DOUBLE), 3) AS latency FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) SELECT doc_id, coalesce(retrieved, 0) AS retrieved, coalesce(contradictions, 0) AS contradictions, coalesce(latency, 0.0) AS latency FROM a FULL JOIN b USING (doc_id) FULL JOIN c USING (doc_id)",
    "payload_defaults": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 OR o_custkey % 3 = 0 THEN 1.0 ELSE o_custkey::DOUBLE END AS score, CASE WHEN o_orderkey % 7 = 0 OR o_custkey % 5 = 0 THEN 'ENTITY' ELSE o_orderstatus END AS label, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 4 = 0 THEN 1 ELSE (o_orderkey % 9)::INT END AS page FROM orders",
    "listed_payloads": """SELECT o_orderkey, unnest([0, 1, 2])::INT AS place, unnest([CASE WHEN o_custkey % 3 = 0 THEN 'ENTITY' ELSE o_orderstatus END, 'ENTITY', '[1,"x"]']) AS label, unnest([CASE o_custkey % 5 WHEN 2 THEN 0.25 WHEN 4 THEN 0.5 ELSE 1.0 END, 1.0, 1.0])::DOUBLE AS score, unnest([(o_orderkey % 9)::INT, 1, 1]) AS page FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0""",
    "json_metadata": """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat('brand=', p_brand, ';nested={"x":', p_size, '};odd=', p_size % 2 = 0, ';price=', regexp_replace((p_size / 4.0)::DECIMAL(9, 2)::VARCHAR, '[.]?0+$', ''), ';size=', p_size, ';tags=["a",', p_size, ']') END AS metadata FROM part""",
    "verified_ingest": "SELECT doc_id, true AS differs, false AS failed FROM documents WHERE doc_id % 97 = 0",
    "document_metadata": "SELECT p_partkey, concat('brand=', p_brand, CASE WHEN p_partkey % 3 = 0 THEN ';size=changed;state=COMPLETED' ELSE concat(';size=', p_size) END, CASE WHEN p_size % 2 = 0 THEN concat(';type=', p_type) ELSE '' END) AS metadata FROM part",
    "user_organisations": f"WITH {core._TENANTS} SELECT user_id, organization_id, n_name AS organization, role FROM members JOIN nation ON n_nationkey = organization_id",
    "activity_log": "SELECT user_id % 20 AS workspace_id, event_type AS action, event_id FROM events",
    "nested_findings": "SELECT l_orderkey AS doc_id, l_linenumber AS reply_id, 0 AS finding, 'statement' AS type, concat('Item ', l_partkey % 50) AS summary, 0.5::DOUBLE AS confidence, l_linenumber AS second_page FROM lineitem",
    "explained_conflicts": f"WITH {own_audit.CORPUS}, {own_audit.DATE} SELECT doc_id, concat('finding-', substr(sha256(concat_ws('|', doc_id, type, label, value_a, page_a, value_b, page_b)), 1, 12)) AS finding_id, concat('The document assigns conflicting date values to ''', label, '''. Page ', page_a, ' states ''', value_a, ''' while page ', page_b, ' states ''', value_b, '''. One of these must be incorrect.') AS explanation, page_a AS first_page, page_b AS second_page FROM date_c",
    "stream_sliding_counts": "SELECT time_bucket(INTERVAL 6 HOURS, ts) - INTERVAL 6 HOURS * k AS window_start, event_type, count(*) AS n FROM events, range(4) r(k) GROUP BY ALL",
    "stream_sessions": "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 12 HOURS THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 12 HOURS AS session_end, count(*) AS n FROM s GROUP BY user_id, s",
    "stream_findings": "SELECT DISTINCT user_id AS doc_id, lower(trim(event_type)) AS summary_key FROM events",
    "stream_status": "SELECT user_id AS document_id, arg_max(event_id, row(ts, event_id))::VARCHAR AS status FROM events GROUP BY user_id",
}
_RISKS = "SELECT t.doc_id, greatest(1, least(8, count(*) FILTER (kind = 0)) + least(8, count(*) FILTER (kind = 1))) AS risks FROM trust t LEFT JOIN (SELECT doc_id, 0 AS kind FROM refs WHERE status = 'BROKEN_REFERENCE' UNION ALL SELECT doc_id, 1 FROM entity_conflicts) USING (doc_id) GROUP BY t.doc_id"
ORACLE_SQL["analyze_corpus"] = f"""{_ANALYSED} SELECT a.*, f.summary AS first_summary, coalesce(t.evidence, '') AS evidence, t.contradiction_health AS health, CASE WHEN t.doc_id IS NULL THEN 'Document is processing.' ELSE concat('Executive summary of document ', t.doc_id, '. The document has a trust score of ', {core._NUMBER("t.score")}, '% based on automated intelligence checks.') END AS said, coalesce(risks, 0)::BIGINT AS risks, coalesce(fact_ids, '') AS fact_ids
    FROM analysed a LEFT JOIN (SELECT doc_id, summary FROM merged QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY source, ca, ia, cb, ib, summary) = 1) f USING (doc_id) LEFT JOIN trust t USING (doc_id) LEFT JOIN ({_RISKS}) USING (doc_id)
    LEFT JOIN (SELECT doc_id, string_agg(concat('fact-', substr(sha256(concat_ws('|', doc_id, subject, predicate, value)), 1, 12)), ',' ORDER BY ord) AS fact_ids FROM dx GROUP BY doc_id) USING (doc_id)"""
