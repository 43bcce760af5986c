"""Queries of ingestion, retrieval, pairs, entities, reports and workspaces, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagemill.functions.patterns import QUOTES, PLAIN_QUOTES, STOPWORDS
from pagemill.functions.text import clean, token_estimate
from pagemill.functions.vectors import hash_embedding
from pagemill.operators import chunking, entities, pairs, reports, retrieval, workspace
from pagemill.plans import audit_queries as audit
from pagemill.plans.corpora import ENTITIES, FACTS, REPLIES, chunks, derived, duck_sql
from pagemill.session import materialise, table
from pagemill.sources import files
from pagemill.streaming import streams

DIM = 64


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.pages_of(table(spark, sf_dir, "documents"))


def clean_pages(spark, sf_dir):
    return chunking.clean_pages(pages(spark, sf_dir)).select("doc_id", "page", "text")


def chunk_documents(spark, sf_dir):
    made = chunking.chunk_documents(chunking.clean_pages(pages(spark, sf_dir)))
    return made.select("doc_id", "chunk_index", "page", "token_count", "first_sentence", "n_sentences", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def chunk_long_documents(spark, sf_dir):
    made = chunking.chunk_long_documents(chunking.clean_pages(pages(spark, sf_dir)))
    return made.select("doc_id", "chunk_index", "page", "token_count", "first_sentence", "n_sentences", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def chunk_statistics(spark, sf_dir):
    return chunking.chunk_statistics(chunking.chunk_documents(chunking.clean_pages(pages(spark, sf_dir))))


def readable_documents(spark, sf_dir):
    return chunking.readable(pages(spark, sf_dir))


def document_files(spark, sf_dir):
    name = F.concat(F.lit("file"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 4 == 0, ".md").when(F.col("doc_id") % 4 == 1, ".TXT").when(F.col("doc_id") % 4 == 2, ".pdf").otherwise(".bin"))
    docs = table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), "text")
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return docs.select("doc_id", "name", files.resolve_format(F.col("name"), F.lit(None).cast("string")).alias("format"), files.markdown_title(files.decoded(content), F.col("name")).alias("title"), F.length(content).cast("long").alias("bytes"), F.sha2(content, 256).alias("sha256"))


def hash_embeddings(spark, sf_dir):
    vector = hash_embedding(F.coalesce("text", F.lit("")), DIM)
    return table(spark, sf_dir, "documents").select("doc_id", F.transform(F.slice(vector, 1, 8), lambda x: F.round(x, 9)).alias("head"), F.round(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x), 9).alias("norm"))


def corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, chunks): the benchmark texts, and the chunk table of the documents with vectors, written once."""
    made = chunking.chunk_documents(chunking.clean_pages(pages(spark, sf_dir)))
    own = materialise(made.select("chunk_id", "doc_id", "page", "text", hash_embedding(F.col("text"), DIM).alias("vector")), "chunk-table")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", hash_embedding(F.col("text"), DIM).alias("vector"))
    return asked, own


def dense_search(spark, sf_dir):
    return retrieval.dense_search(*corpus(spark, sf_dir)).select("query_id", "rank", "chunk_id", F.round("similarity", 6).alias("similarity"))


def hybrid_search(spark, sf_dir):
    asked, own = corpus(spark, sf_dir)
    found = retrieval.hybrid_scores(asked, retrieval.dense_search(asked, own))
    return found.select("query_id", "chunk_id", *(F.round(c, 6).alias(c) for c in ("similarity", "bm25", "keyword", "hybrid")))


def retrieve(spark, sf_dir):
    return retrieval.retrieve(*corpus(spark, sf_dir)).select("query_id", "rank", "chunk_id", "score")


def packed(spark, sf_dir):
    return retrieval.pack_context(retrieval.retrieve(*corpus(spark, sf_dir)))


def pack_context(spark, sf_dir):
    return packed(spark, sf_dir).select("query_id", "rank", "chunk_id", "tokens_so_far", "position")


def citations(spark, sf_dir):
    names = table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select("doc_id", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("name"))
    return retrieval.cite(packed(spark, sf_dir), names).drop("score")


def contexts(spark, sf_dir):
    names = table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select("doc_id", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("name"))
    return retrieval.context_text(packed(spark, sf_dir), names).select("query_id", "tokens", F.length("context").alias("n_chars"), F.sha2("context", 256).alias("context_sha256"))


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("doc_id"), F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"))


def replies(spark, sf_dir):
    return pairs.parse_replies(derived(spark, sf_dir, REPLIES))


def merged(spark, sf_dir):
    return entities.merge_entities(derived(spark, sf_dir, ENTITIES))


def quotes(spark, sf_dir):
    text = chunks(spark, sf_dir)
    quote = F.when(F.col("chunk_index") % 2 == 0, F.upper(F.substring("text", 20, 40))).otherwise("nothing of the kind")
    return pairs.resolve_quotes(text.select("doc_id", F.col("chunk_index").alias("quote_id"), quote.alias("quote"), F.lit(99).alias("page")), text)


def prompts(spark, sf_dir):
    text = chunking.chunk_documents(chunking.clean_pages(pages(spark, sf_dir)))
    made = pairs.prompt_batches(text.select("doc_id", F.col("chunk_index").alias("ord"), "page", "text"))
    return made.select("doc_id", "batch", "n_segments", "chars", F.sha2("prompt", 256).alias("prompt_sha256"))


def source_prompts(spark, sf_dir):
    """Prompts over one long text a source: the chunks of all its documents in order, under the least of their ids."""
    text = materialise(chunking.chunk_documents(chunking.clean_pages(pages(spark, sf_dir))).select("doc_id", "chunk_index", "page", "text"), "segments")
    sources = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    heads = sources.groupBy("source").agg(F.min("doc_id").alias("head"))
    joined = text.join(sources, "doc_id").join(heads, "source")
    segments = joined.select(F.col("head").alias("doc_id"), (F.col("doc_id") * 1_000_000 + F.col("chunk_index")).alias("ord"), "page", "text")
    made = pairs.prompt_batches_long(segments, block_items=64)
    return made.select("doc_id", "batch", "n_segments", "chars", F.sha2("prompt", 256).alias("prompt_sha256"))


def summaries(spark, sf_dir):
    f = audit.findings(spark, sf_dir, reread=True)
    return reports.executive_summary(f["trust"], entities.dedupe_facts(derived(spark, sf_dir, FACTS)), f["contradictions"], f["references"], f["requirements"], f["entity_conflicts"], f["ambiguities"])


def reviews(spark, sf_dir):
    f = audit.findings(spark, sf_dir, reread=("references", "entity_conflicts", "ambiguities"))
    return reports.review_report(f["trust"], f["references"], f["entity_conflicts"], f["ambiguities"])


def tenants(spark, sf_dir):
    """Users are customers, organisations nations, workspaces suppliers (every other one without organisation), documents parts."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.concat("c_name", F.lit("@example.org")).alias("email"))
    members = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("organization_id"), F.when(F.col("c_mktsegment") == "BUILDING", "admin").otherwise("member").alias("role"))
    spaces = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("workspace_id"), (F.col("s_suppkey") * 3 % 100 + 1).alias("owner_id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey")).alias("organization_id"))
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("document_id"), (F.col("p_partkey") % 50 + 1).alias("workspace_id"), (F.col("p_partkey") % 100 + 1).alias("user_id"), F.when(F.col("p_size") % 3 == 0, "COMPLETED").otherwise("FAILED").alias("status"), (F.col("p_size") * 100_000).cast("long").alias("bytes"))
    return users, members, spaces, docs


_TENANTS = """users AS (SELECT c_custkey AS user_id, c_name AS name, concat(c_name, '@example.org') AS email FROM customer),
    members AS (SELECT c_custkey AS user_id, c_nationkey AS organization_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'admin' ELSE 'member' END AS role FROM customer),
    spaces AS (SELECT s_suppkey AS workspace_id, s_suppkey * 3 % 100 + 1 AS owner_id, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS organization_id FROM supplier),
    docs AS (SELECT p_partkey AS document_id, p_partkey % 50 + 1 AS workspace_id, p_partkey % 100 + 1 AS user_id, CASE WHEN p_size % 3 = 0 THEN 'COMPLETED' ELSE 'FAILED' END AS status, p_size::BIGINT * 100000 AS bytes FROM part)"""


def organisation_members(spark, sf_dir):
    users, members, _, _ = tenants(spark, sf_dir)
    return workspace.members(members, users)


def access_scope(spark, sf_dir):
    _, members, spaces, docs = tenants(spark, sf_dir)
    return workspace.access_scope(docs, spaces, members)


def library_overview(spark, sf_dir):
    return workspace.library_overview(tenants(spark, sf_dir)[3])


def notifications(spark, sf_dir):
    users, _, _, docs = tenants(spark, sf_dir)
    return workspace.notifications(docs, users)


def audit_counts(spark, sf_dir):
    log = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("workspace_id"), F.col("event_type").alias("action"), "ts")
    return workspace.audit_report(log)[1]


def recent_messages(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session_id")
    return workspace.recent_messages(said).select("session_id", "turn", "role", "position")


def chat_history(spark, sf_dir):
    """What a model gets before each session's last message."""
    said = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session_id")
    asked = said.groupBy("session_id").agg(F.max("turn").alias("turn"))
    return workspace.recent_messages(said, current=asked).select("session_id", "turn", "role", "position", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def repeated_questions(spark, sf_dir):
    said = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.lit("user").alias("role"), F.col("event_type").alias("text"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), "event_id")
    return workspace.repeated_questions(said).groupBy("session_id").agg(F.count_if("reused").alias("reused"), F.count(F.lit(1)).alias("asked"))


def rate_limit(spark, sf_dir):
    asked = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", "event_id")
    return workspace.rate_limit(asked, 3, 86_400).select("event_id", "key", "before", "admitted", "remaining", "reset")


def statuses(spark, sf_dir):
    names = [*workspace.PROGRESS, "FAILED"]
    status = F.element_at(F.array(*(F.lit(n) for n in names)), (F.col("event_id") % len(names) + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), status.alias("status"), "ts", "event_id")


def latest_status(spark, sf_dir):
    return workspace.latest_status(statuses(spark, sf_dir))


def stage_seconds(spark, sf_dir):
    stages = workspace.stage_seconds(statuses(spark, sf_dir))
    return stages.groupBy("status").agg(F.count("seconds").alias("n"), F.sum("seconds").alias("seconds"))


def usage_totals(spark, sf_dir):
    log = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("role").alias("model"), token_estimate(F.coalesce("text", F.lit(""))).cast("long").alias("prompt_tokens"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("completion_tokens"))
    return workspace.usage_totals(log)


def quality_report(spark, sf_dir):
    trust = audit.findings(spark, sf_dir)["trust"]
    checks = trust.select(F.concat(F.lit("pack "), (F.col("doc_id") % 10).cast("string")).alias("pack"), (F.col("score") >= 20).alias("passed"))
    return workspace.quality_report(checks)


def duplicate_documents(spark, sf_dir):
    return files.duplicate_files(table(spark, sf_dir, "documents"))


def upserted(spark, sf_dir):
    """Line items as chunks: the dear ones come again with another text, then one document's are deleted."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("text"))
    new = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("doc_id"), F.lit("new").alias("text"))
    return files.delete(files.upsert(rows, new), {"doc_id": [1, 2, 3], "text": "new"}).groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.sum("chunk_id").alias("ids"))


def first_page(spark, sf_dir):
    return workspace.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 20, 100)


def event_stream(spark, sf_dir):
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def stream_window_counts(spark, sf_dir):
    counted = streams.window_counts(event_stream(spark, sf_dir), "1 day")
    return streams.drained(counted, "complete").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {
    "clean_pages": clean_pages,
    "chunk_documents": chunk_documents,
    "chunk_long_documents": chunk_long_documents,
    "chunk_statistics": chunk_statistics,
    "readable_documents": readable_documents,
    "document_files": document_files,
    "hash_embeddings": hash_embeddings,
    "dense_search": dense_search,
    "hybrid_search": hybrid_search,
    "retrieve": retrieve,
    "pack_context": pack_context,
    "citations": citations,
    "context_text": contexts,
    "chunk_pair_candidates": lambda s, d: pairs.chunk_pair_candidates(vectors(s, d)),
    "fact_pair_candidates": lambda s, d: pairs.fact_pair_candidates(vectors(s, d)),
    "fact_pair_heuristic": lambda s, d: pairs.fact_pair_heuristic(derived(s, d, FACTS)),
    "parse_replies": lambda s, d: replies(s, d).select("doc_id", "reply_id", "ok", "parsed.type", "parsed.summary", "parsed.confidence", F.col("parsed.contradiction_strength").alias("strength"), "parsed.is_contradiction"),
    "score_contradictions": lambda s, d: pairs.score_contradictions(replies(s, d)),
    "score_semantic_conflicts": lambda s, d: pairs.score_semantic_conflicts(replies(s, d)),
    "resolve_quotes": quotes,
    "prompt_batches": prompts,
    "source_prompts": source_prompts,
    "dedupe_facts": lambda s, d: entities.dedupe_facts(derived(s, d, FACTS)),
    "shape_facts": lambda s, d: entities.shape_facts(entities.dedupe_facts(derived(s, d, FACTS))),
    "merge_entities": lambda s, d: merged(s, d).select("doc_id", "type", "entity", "confidence", "frequency", "related", F.array_join(F.transform("mentions", lambda m: F.concat_ws(":", m["page"].cast("string"), m["snippet"])), ";").alias("mentions")),
    "entity_graph": lambda s, d: entities.entity_graph(merged(s, d)),
    "top_entities": lambda s, d: entities.top_entities(merged(s, d)),
    "top_graph": lambda s, d: entities.top_graph(merged(s, d)),
    "entity_conflicts": lambda s, d: entities.entity_conflicts(derived(s, d, FACTS), merged(s, d)).drop("ord"),
    "executive_summary": summaries,
    "review_report": reviews,
    "organisation_members": organisation_members,
    "access_scope": access_scope,
    "library_overview": library_overview,
    "notifications": notifications,
    "audit_counts": audit_counts,
    "recent_messages": recent_messages,
    "chat_history": chat_history,
    "repeated_questions": repeated_questions,
    "rate_limit": rate_limit,
    "latest_status": latest_status,
    "stage_seconds": stage_seconds,
    "usage_totals": usage_totals,
    "quality_report": quality_report,
    "duplicate_documents": duplicate_documents,
    "upserted_chunks": upserted,
    "first_page": first_page,
    "stream_window_counts": stream_window_counts,
}

_BYTES = "list_transform(range(0, 32), lambda i: ('0x' || substr(sha256(text), (2 * i + 1)::INT, 2))::INT / 127.5::DOUBLE - 1.0::DOUBLE)"
_EMBED = f"list_transform(range(0, {DIM}), lambda k: b[(k * 3 % 32 + 1)::INT])"


def _embedded(name: str, select: str) -> str:
    raw = f"SELECT *, {_EMBED} AS raw FROM (SELECT *, {_BYTES} AS b FROM ({select}))"
    return f"{name} AS (SELECT * EXCLUDE (b, raw), list_transform(raw, lambda x: x / sqrt(list_dot_product(raw, raw))) AS vector FROM ({raw}))"


_STOPS = ", ".join(f"'{w}'" for w in STOPWORDS)
_TOKENS = r"list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')"
_CLEAN = (
    "WITH pg AS (SELECT doc_id, text FROM documents), cl AS (SELECT doc_id, 1 AS page, "
    + audit.strip(
        "regexp_replace(regexp_replace(translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(text, '{q}', '{p}'), '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x9F\\p{{Cf}}\\p{{Co}}]', '', 'g'), '(?im)^\\s*page\\s+\\d+\\s+of\\s+\\d+\\s*$', '', 'g'), '(?im)^\\s*-\\s*\\d+\\s*-\\s*$', '', 'g'), '(?im)^\\s*\\[\\s*page\\s+\\d+\\s*\\]\\s*$', '', 'g'), '(?im)^\\s*page\\s+\\d+\\s*$', '', 'g'), chr(9), ' '), ' {{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')".format(
            q=QUOTES, p=PLAIN_QUOTES.replace("'", "''")
        )
    )
    + " AS text FROM pg)"
)
_CHUNKS = rf"""WITH RECURSIVE {_CLEAN.removeprefix("WITH ")},
    se AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {audit.strip("s")}), lambda s: s <> '') AS s FROM cl WHERE text IS NOT NULL),
    tk AS (SELECT doc_id, s, list_transform(s, lambda x: greatest(1, length(x) // 4)) AS t FROM se WHERE len(s) > 0),
    ps AS (SELECT doc_id, s, len(s) AS n, list_prepend(0, list_transform(range(1, len(t) + 1), lambda i: list_sum(t[1:i])::INT)) AS p FROM tk),
    orbit AS (SELECT doc_id, 0 AS idx, 0::BIGINT AS i, greatest(1, len(list_filter(p, lambda x: x <= 500)) - 1)::BIGINT AS j FROM ps
      UNION ALL
      SELECT doc_id, idx + 1, nx, greatest(nx + 1, len(list_filter(p, lambda x: x - p[nx + 1] <= 500)) - 1)::BIGINT FROM (
        SELECT o.doc_id, o.idx, p, greatest(o.i + 1, CASE WHEN c < o.j THEN c WHEN o.j - 1 > o.i THEN o.j - 1 ELSE o.j END)::BIGINT AS nx FROM (
          SELECT o.*, ps.p, ps.n, greatest(o.i + 1, len(list_filter(ps.p, lambda x: ps.p[o.j + 1] - x > 50))) AS c FROM orbit o JOIN ps USING (doc_id) WHERE o.j < ps.n) o)),
    ck AS (SELECT doc_id, idx AS chunk_index, 1 AS page, (p[j + 1] - p[i + 1])::INT AS token_count, i::INT AS first_sentence, (j - i)::INT AS n_sentences, array_to_string(s[i + 1:j], chr(10) || chr(10)) AS text FROM orbit JOIN ps USING (doc_id))"""
_SEARCH = f"""{_CHUNKS}, {_embedded("asked", "SELECT item_id AS query_id, text FROM benchmark")}, {_embedded("own", "SELECT concat(doc_id, '-chk-', chunk_index) AS chunk_id, doc_id, page, text FROM ck")},
    dense AS (SELECT query_id, chunk_id, doc_id, page, o.text, list_dot_product(a.vector, o.vector) AS cosine, round(greatest(0.0, least(1.0, list_dot_product(a.vector, o.vector))), 9) AS similarity, a.text AS asked FROM asked a, own o),
    cand AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM dense QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) <= 30)"""
# RE2's word boundaries are ASCII: words with other letters, which hold no token, are taken out first
_WORDS = lambda t: rf"regexp_extract_all(regexp_replace(lower({t}), '[a-z0-9_]*[^\x00-\x7F][a-z0-9_\p{{L}}\p{{N}}\p{{M}}]*', chr(1), 'g'), '\b[a-zA-Z0-9_''-]{{2,}}\b')"
_HYBRID = f"""{_SEARCH},
    words AS (SELECT query_id, chunk_id, {_WORDS("text")} AS ws FROM cand), terms AS (SELECT DISTINCT query_id, unnest({_WORDS("text")}) AS term FROM asked),
    stats AS (SELECT query_id, count(*) AS n, avg(len(ws)) AS mean FROM words GROUP BY query_id),
    tf AS (SELECT query_id, chunk_id, term, count(*) AS tf FROM (SELECT query_id, chunk_id, unnest(ws) AS term FROM words) JOIN terms USING (query_id, term) GROUP BY ALL),
    df AS (SELECT query_id, term, count(*) AS df FROM tf GROUP BY ALL),
    bm AS (SELECT query_id, chunk_id, round(sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(ws) / greatest(mean, 1.0::DOUBLE)))), 9) AS bm25 FROM tf JOIN df USING (query_id, term) JOIN stats USING (query_id) JOIN words USING (query_id, chunk_id) GROUP BY ALL),
    scored AS (SELECT c.*, coalesce(bm25, 0.0::DOUBLE) AS bm25, max(coalesce(bm25, 0.0::DOUBLE)) OVER (PARTITION BY c.query_id) AS best FROM cand c LEFT JOIN bm USING (query_id, chunk_id)),
    hyb AS (SELECT *, CASE WHEN best > 0 THEN bm25 / best ELSE 0.0 END AS keyword, round(0.7::DOUBLE * similarity + 0.3::DOUBLE * CASE WHEN best > 0 THEN bm25 / best ELSE 0.0 END, 9) AS hybrid FROM scored)"""
_RETRIEVE = f"""{_HYBRID},
    q1 AS (SELECT query_id, list_distinct({_TOKENS}) AS every FROM asked), q2 AS (SELECT *, list_filter(every, lambda w: length(w) > 1 AND w NOT IN ({_STOPS})) AS chosen FROM q1),
    q3 AS (SELECT query_id, CASE WHEN len(chosen) > 0 THEN chosen ELSE every END AS wanted FROM q2),
    rer AS (SELECT h.*, row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, rank) AS hr, CASE WHEN len(wanted) > 0 THEN len(list_intersect(wanted, {_TOKENS})) / len(wanted)::DOUBLE ELSE 0.0 END AS ov FROM hyb h JOIN q3 USING (query_id)),
    sco AS (SELECT *, round_even(round(CASE WHEN cosine > 0 THEN 0.3::DOUBLE * ov + 0.7::DOUBLE * (cosine + 1) / 2 ELSE ov END, 9), 4) AS score FROM rer),
    hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hr) AS fr FROM sco WHERE score >= 0.05 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hr) <= 5)"""
_PACK = rf"""{_RETRIEVE},
    uniq AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, lower({audit.strip("text")}) ORDER BY fr) = 1),
    spent AS (SELECT *, sum(greatest(1, length(text) // 4) + 30) OVER (PARTITION BY query_id ORDER BY fr) AS tokens_so_far FROM uniq),
    fit AS (SELECT *, min(fr) OVER (PARTITION BY query_id, doc_id) AS lead FROM spent WHERE tokens_so_far <= 4000),
    packed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lead, page, fr) AS position FROM fit)"""
_NAMES = "names AS (SELECT doc_id, concat('Doc ', doc_id) AS name FROM documents WHERE doc_id % 3 <> 0)"
_VECTORS = "vecs AS (SELECT label::BIGINT AS doc_id, vec_id AS ord, list_transform(embedding, lambda x: x::DOUBLE) AS v0 FROM embeddings), vs AS (SELECT doc_id, ord, list_transform(v0, lambda x: x / sqrt(list_dot_product(v0, v0))) AS v FROM vecs)"


def _pairs_sql(low: float, high: float, around: float, keep: str) -> str:
    return f"""{_VECTORS}, pr AS (SELECT a.doc_id, a.ord AS a, b.ord AS b, round(list_dot_product(a.v, b.v), 6) AS similarity FROM vs a JOIN vs b ON a.doc_id = b.doc_id AND a.ord < b.ord),
        inb AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM pr WHERE similarity BETWEEN {low} AND {high}),
        rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(abs(similarity - {around}), 6), a, b) AS rank FROM inb), kept AS (SELECT doc_id, rank, a, b, similarity FROM rk WHERE rank <= {keep})"""


_REPLIES = rf"""WITH rep AS ({duck_sql(REPLIES)}), js AS (SELECT *, nullif(regexp_extract(reply, '(?s)(\{{.*\}})', 1), '') AS j FROM rep),
    parsed AS (SELECT doc_id, reply_id, similarity, json_extract_string(j, '$.type') AS type, json_extract_string(j, '$.summary') AS summary, json_extract_string(j, '$.confidence')::DOUBLE AS confidence, json_extract_string(j, '$.contradiction_strength')::DOUBLE AS strength, json_extract_string(j, '$.is_contradiction')::BOOLEAN AS is_contradiction, j IS NOT NULL AS ok FROM js)"""
_BAND = lambda a, b, c: f"CASE WHEN score >= {a} THEN 'critical' WHEN score >= {b} THEN 'high' WHEN score >= {c} THEN 'medium' ELSE 'low' END AS severity"
_F = f"WITH {audit.FACT_ROWS}, {audit.CLEAN_FACTS}"
_E = f"WITH {audit.ENTITY_ROWS}, {audit.ENTITY_MERGE}, m AS (SELECT *, len(mentions) AS frequency FROM merged_ents)"
_DEDUPED = f"{_F}, dd AS (SELECT doc_id, arg_max(row(ord, s, p, v, page, fact_type), row(confidence, -ord)) AS best, max(confidence) AS confidence, list(evidence ORDER BY ord) AS evidence, list(chunk_index ORDER BY ord) AS chunks FROM clean GROUP BY doc_id, lower(s), lower(p), lower(v)), dx AS (SELECT doc_id, best[1] AS ord, best[2] AS subject, best[3] AS predicate, best[4] AS value, best[5] AS page, best[6] AS fact_type, confidence, evidence, chunks FROM dd)"
_GRAPH = f"{_E}, edges AS (SELECT DISTINCT e.doc_id, least(e.a, e.b) AS src, greatest(e.a, e.b) AS dst FROM (SELECT doc_id, lower(entity) AS a, lower(trim(unnest(related))) AS b FROM m) e WHERE e.b <> '' AND e.a <> e.b), top AS (SELECT doc_id, rank, entity, type, frequency FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY frequency DESC, ord) AS rank FROM m) WHERE rank <= 12)"
_STATUS = "st AS (SELECT user_id AS document_id, (['" + "', '".join([*workspace.PROGRESS, "FAILED"]) + f"'])[(event_id % {len(workspace.PROGRESS) + 1} + 1)::INT] AS status, ts, event_id FROM events)"

_NUMBER = lambda x: f"CASE WHEN abs({x} * 10 - round({x} * 10)) < 1e-9 THEN printf('%.1f', {x}) ELSE printf('%.2f', {x}) END"
def _prompts_sql(segments: str) -> str:
    full = "r.chars + s.n > 12000 OR r.held >= 25"
    return f"""{_CHUNKS}, sg AS MATERIALIZED (SELECT *, length(text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM ({segments})),
        ba AS (SELECT doc_id, k, 0 AS batch, 1 AS held, n AS chars FROM sg WHERE k = 1
          UNION ALL SELECT s.doc_id, s.k, CASE WHEN {full} THEN r.batch + 1 ELSE r.batch END, CASE WHEN {full} THEN 1 ELSE r.held + 1 END, CASE WHEN {full} THEN s.n ELSE r.chars + s.n END FROM ba r JOIN sg s ON s.doc_id = r.doc_id AND s.k = r.k + 1)
        SELECT doc_id, batch, count(*)::INT AS n_segments, sum(n)::INT AS chars, sha256(string_agg(concat('[Segment - Page ', page, ' / Chunk ', ord, ']', chr(10), text), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY k)) AS prompt_sha256 FROM ba JOIN sg USING (doc_id, k) GROUP BY doc_id, batch"""


ORACLE_SQL = {
    "clean_pages": f"{_CLEAN} SELECT * FROM cl",
    "chunk_documents": f"{_CHUNKS} SELECT doc_id, chunk_index, page, token_count, first_sentence, n_sentences, length(text) AS n_chars, sha256(text) AS text_sha256 FROM ck",
    "chunk_long_documents": f"{_CHUNKS} SELECT doc_id, chunk_index, page, token_count, first_sentence, n_sentences, length(text) AS n_chars, sha256(text) AS text_sha256 FROM ck",
    "chunk_statistics": f"{_CHUNKS} SELECT doc_id, count(*) AS n_chunks, sum(token_count) // count(*) AS mean_tokens, sum(token_count) AS total_tokens FROM ck GROUP BY doc_id",
    "readable_documents": r"SELECT doc_id, coalesce(bool_or(length(regexp_replace(text, '\s+', '', 'g')) > 0), false) AS readable FROM documents WHERE text IS NOT NULL GROUP BY doc_id",
    "document_files": r"""WITH d AS (SELECT doc_id, concat('file', doc_id, CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.TXT' WHEN 2 THEN '.pdf' ELSE '.bin' END) AS name, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, name, CASE doc_id % 4 WHEN 0 THEN 'md' WHEN 1 THEN 'txt' WHEN 2 THEN 'pdf' END AS format, coalesce(nullif(trim(regexp_extract(t, '(?m)^#\s+(.+)$', 1)), ''), regexp_replace(name, '\.[^.]*$', '')) AS title, strlen(t) AS bytes, sha256(t) AS sha256 FROM d""",
    "hash_embeddings": f"WITH {_embedded('e', 'SELECT doc_id, coalesce(text, chr(32)[:0]) AS text FROM documents')} SELECT doc_id, list_transform(vector[1:8], lambda x: round(x, 9)) AS head, round(list_dot_product(vector, vector), 9) AS norm FROM e",
    "dense_search": f"{_SEARCH} SELECT query_id, rank, chunk_id, round(similarity, 6) AS similarity FROM cand",
    "hybrid_search": f"{_HYBRID} SELECT query_id, chunk_id, round(similarity, 6) AS similarity, round(bm25, 6) AS bm25, round(keyword, 6) AS keyword, round(hybrid, 6) AS hybrid FROM hyb",
    "retrieve": f"{_RETRIEVE} SELECT query_id, fr AS rank, chunk_id, score FROM hits",
    "pack_context": f"{_PACK} SELECT query_id, fr AS rank, chunk_id, tokens_so_far, position FROM packed",
    "citations": f"{_PACK}, {_NAMES}, sn AS (SELECT *, {audit.strip('text')} AS x FROM packed) SELECT query_id, fr AS rank, sn.doc_id, page, coalesce(name, 'Source Document') AS document_name, CASE WHEN length(x) > 200 THEN concat(substr(x, 1, 197), '...') ELSE x END AS snippet FROM sn LEFT JOIN names USING (doc_id)",
    "context_text": f"{_PACK}, {_NAMES}, pt AS (SELECT query_id, position, tokens_so_far, concat(CASE WHEN position = min(position) OVER (PARTITION BY query_id, p.doc_id) THEN concat(CASE WHEN position > 1 THEN chr(10) ELSE '' END, '=== SOURCE DOCUMENT: ', coalesce(name, 'Unknown Source'), ' ===', chr(10)) ELSE '' END, printf('[Page %d | Relevance: %.2f]:', page, score), chr(10), text, chr(10), '---') AS part FROM packed p LEFT JOIN names USING (doc_id)) SELECT query_id, max(tokens_so_far) AS tokens, sum(length(part)) + count(*) - 1 AS n_chars, sha256(string_agg(part, chr(10) ORDER BY position)) AS context_sha256 FROM pt GROUP BY query_id",
    "chunk_pair_candidates": f"WITH {_pairs_sql(0.45, 0.95, 0.70, 'greatest(8, least(15, n))')} SELECT * FROM kept UNION ALL SELECT doc_id, 1, min(ord), min(ord), 1.0 FROM vs GROUP BY doc_id HAVING count(*) = 1",
    "fact_pair_candidates": f"WITH {_pairs_sql(0.20, 0.85, 0.55, '40')} SELECT * FROM kept",
    "fact_pair_heuristic": f"WITH {audit.FACT_ROWS}, o AS (SELECT doc_id, ord, lower({audit.strip('subject')}) AS s, lower({audit.strip('value')}) AS v FROM facts) SELECT x.doc_id, row_number() OVER (PARTITION BY x.doc_id ORDER BY x.ord, y.ord) AS rank, x.ord AS a, y.ord AS b, 0.55::DOUBLE AS similarity FROM o x JOIN o y ON x.doc_id = y.doc_id AND x.s = y.s AND x.ord < y.ord AND x.v <> y.v QUALIFY rank <= 40",
    "parse_replies": f"{_REPLIES} SELECT doc_id, reply_id, ok, type, summary, confidence, strength, is_contradiction FROM parsed",
    "score_contradictions": f"{_REPLIES}, sc AS (SELECT doc_id, reply_id, coalesce(summary, 'Contradiction detected') AS summary, round(0.4::DOUBLE * coalesce(confidence, 0.8) + 0.4::DOUBLE * coalesce(strength, 0.8) + 0.2::DOUBLE * coalesce(similarity, 0.5), 6) AS score FROM parsed WHERE ok) SELECT *, {_BAND(0.85, 0.65, 0.45)} FROM sc",
    "score_semantic_conflicts": f"{_REPLIES}, sc AS (SELECT doc_id, reply_id, summary, round(0.5::DOUBLE * coalesce(confidence, 0.75) + 0.3::DOUBLE * (1 - coalesce(similarity, 0.5)) + 0.2::DOUBLE * coalesce(confidence, 0.75), 6) AS score FROM parsed WHERE ok AND is_contradiction) SELECT *, {_BAND(0.80, 0.60, 0.40)} FROM sc",
    "resolve_quotes": f"WITH {audit.CORPUS}, qs AS (SELECT doc_id, chunk_index AS quote_id, CASE WHEN chunk_index % 2 = 0 THEN upper(substr(text, 20, 40)) ELSE 'nothing of the kind' END AS quote FROM corpus), hit AS (SELECT q.doc_id, q.quote_id, arg_min(c.page, c.chunk_index) AS page, arg_min(c.text, c.chunk_index) AS text FROM qs q JOIN corpus c ON q.doc_id = c.doc_id AND contains(lower(c.text), lower(trim(q.quote))) GROUP BY ALL) SELECT q.doc_id, q.quote_id, coalesce(h.page, 99) AS page, substr(coalesce(h.text, quote), 1, 400) AS snippet, CASE WHEN h.page IS NULL THEN 0.5 ELSE 1.0 END::DOUBLE AS score FROM qs q LEFT JOIN hit h ON q.doc_id = h.doc_id AND q.quote_id = h.quote_id",
    "prompt_batches": _prompts_sql("SELECT doc_id, chunk_index AS ord, page, text FROM ck"),
    "source_prompts": _prompts_sql("SELECT head AS doc_id, c.doc_id * 1000000 + chunk_index AS ord, page, c.text FROM ck c JOIN (SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(source, '')) AS head FROM documents) h ON c.doc_id = h.doc_id"),
    "dedupe_facts": f"{_DEDUPED} SELECT * FROM dx",
    "shape_facts": f"{_DEDUPED} SELECT doc_id, concat('fact-', substr(sha256(concat_ws('|', doc_id, subject, predicate, value)), 1, 12)) AS id, coalesce(nullif(fact_type, ''), 'definitional') AS type, subject, predicate, value, confidence, page, concat('chunk-', chunks[1]) AS chunk_id, evidence[1] AS evidence FROM dx",
    "merge_entities": f"{_E} SELECT doc_id, type, entity, confidence, frequency, coalesce(related, []) AS related, list_aggregate(list_transform(mentions, lambda x: concat(x.page, ':', x.snippet)), 'string_agg', ';') AS mentions FROM m",
    "entity_graph": f"{_GRAPH} SELECT * FROM edges",
    "top_entities": f"{_GRAPH} SELECT * FROM top",
    "top_graph": f"{_GRAPH}, tr AS (SELECT doc_id, lower(entity) AS name, min(rank) AS r FROM top GROUP BY ALL) SELECT e.doc_id, CASE WHEN x.r < y.r THEN e.src ELSE e.dst END AS source, CASE WHEN x.r < y.r THEN e.dst ELSE e.src END AS target FROM edges e JOIN tr x ON e.doc_id = x.doc_id AND e.src = x.name JOIN tr y ON e.doc_id = y.doc_id AND e.dst = y.name",
    "entity_conflicts": f"WITH {audit.FACT_ROWS}, {audit.ENTITY_ROWS}, {audit.CLEAN_FACTS}, {audit.FACT_CONFLICTS}, {audit.ENTITY_CONFLICTS} SELECT doc_id, entity, value_a, value_b, pages, confidence, severity FROM entity_conflicts",
    "organisation_members": f"WITH {_TENANTS} SELECT organization_id, user_id, name, email, role FROM members JOIN users USING (user_id)",
    "access_scope": f"WITH {_TENANTS}, vis AS (SELECT owner_id AS user_id, workspace_id FROM spaces UNION SELECT m.user_id, s.workspace_id FROM spaces s JOIN members m USING (organization_id)) SELECT v.user_id, d.document_id, v.workspace_id, CASE WHEN s.organization_id IS NULL THEN CASE WHEN s.owner_id = v.user_id THEN 'admin' END ELSE m.role END AS role FROM vis v JOIN spaces s USING (workspace_id) LEFT JOIN members m ON m.user_id = v.user_id AND m.organization_id = s.organization_id JOIN docs d ON d.workspace_id = v.workspace_id",
    "library_overview": f"WITH {_TENANTS} SELECT user_id, count(*) AS documents, count(*) FILTER (status = 'COMPLETED') AS completed, round_even(sum(bytes) / 1048576.0::DOUBLE, 2) AS megabytes FROM docs GROUP BY user_id",
    "notifications": f"WITH {_TENANTS} SELECT document_id, user_id, email FROM docs JOIN users USING (user_id) WHERE status = 'COMPLETED'",
    "audit_counts": "SELECT user_id % 20 AS workspace_id, event_type AS action, count(*) AS n, max(ts) AS last_ts FROM events GROUP BY ALL",
    "recent_messages": "WITH k AS (SELECT * FROM conversations WHERE role IN ('user', 'assistant', 'system') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5) SELECT conv_id AS session_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM k",
    "chat_history": "WITH m AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS latest FROM conversations), k AS (SELECT * FROM m WHERE turn <> latest AND role IN ('user', 'assistant', 'system') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5) SELECT conv_id AS session_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, sha256(coalesce(text, '')) AS text_sha256 FROM k",
    "repeated_questions": "WITH l AS (SELECT user_id, floor(epoch(ts)) - lag(floor(epoch(ts))) OVER (PARTITION BY user_id, event_type ORDER BY floor(epoch(ts))) AS gap FROM events) SELECT user_id AS session_id, count(*) FILTER (gap <= 1800) AS reused, count(*) AS asked FROM l GROUP BY ALL",
    "rate_limit": "WITH n AS (SELECT event_id, user_id AS key, epoch_us(ts) AS t, count(*) OVER w AS before, min(epoch_us(ts)) OVER w AS oldest FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND 1 PRECEDING)) SELECT event_id, key, before, before < 3 AS admitted, greatest(0, 3 - before - 1)::INT AS remaining, CASE WHEN before < 3 THEN 86400 ELSE greatest(1, floor(86400 - (t - oldest) / 1e6::DOUBLE)::INT) END AS reset FROM n",
    "latest_status": f"WITH {_STATUS}, p AS (SELECT document_id, status, date_trunc('microsecond', ts) AS ts, CASE status " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in workspace.PROGRESS.items()) + " END AS step FROM st) SELECT document_id, arg_max(status, ts) AS status, arg_max(step, ts) FILTER (step IS NOT NULL) AS progress, floor(epoch(max(ts)))::BIGINT - floor(epoch(min(ts)))::BIGINT AS seconds FROM p GROUP BY document_id",
    "stage_seconds": f"WITH {_STATUS}, l AS (SELECT status, floor(epoch(lead(ts) OVER (PARTITION BY document_id ORDER BY ts)))::BIGINT - floor(epoch(ts))::BIGINT AS s FROM st) SELECT status, count(s) AS n, sum(s)::BIGINT AS seconds FROM l GROUP BY status",
    "usage_totals": "WITH u AS (SELECT conv_id AS session_id, role AS model, greatest(1, length(coalesce(text, '')) // 4) AS p, length(coalesce(text, '')) AS c FROM conversations) SELECT session_id, model, sum(p) AS prompt_tokens, sum(c) AS completion_tokens, sum(p + c) AS total_tokens FROM u GROUP BY ALL",
    "quality_report": f"{audit.EVERYTHING}, {audit.SCORES}, ch AS (SELECT concat('pack ', doc_id % 10) AS pack, score >= 20 AS passed FROM trust) SELECT pack, count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, CASE WHEN bool_and(passed) THEN 'PASS' ELSE 'FAIL' END AS status FROM ch GROUP BY pack",
    "duplicate_documents": "SELECT sha256(coalesce(text, '')) AS sha256, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "upserted_chunks": "WITH r AS (SELECT o_orderkey AS chunk_id, o_custkey AS doc_id, CASE WHEN o_totalprice > 300000 THEN 'new' ELSE o_orderstatus END AS text FROM orders) SELECT text, count(*) AS n, sum(chunk_id) AS ids FROM r WHERE NOT (doc_id IN (1, 2, 3) AND text = 'new') GROUP BY text",
    "first_page": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 20",
    "stream_window_counts": "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "executive_summary": f"""{audit.EVERYTHING}, {audit.SCORES}, {_DEDUPED.removeprefix(_F + ", ")},
        h1 AS (SELECT doc_id, list(x ORDER BY n) AS v FROM (SELECT doc_id, concat_ws(' ', subject, predicate, value) AS x, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM dx) WHERE n <= 15 GROUP BY doc_id),
        h2 AS (SELECT doc_id, list(x ORDER BY n) AS v FROM (SELECT doc_id, summary AS x, row_number() OVER (PARTITION BY doc_id ORDER BY source, ca, ia, cb, ib, summary) AS n FROM merged) WHERE n <= 8 GROUP BY doc_id),
        h3 AS (SELECT doc_id, list(x ORDER BY n) AS v FROM (SELECT doc_id, concat('Broken reference: ', reference, ' -> ', target) AS x, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, rule, i) AS n FROM refs WHERE status = 'BROKEN_REFERENCE') WHERE n <= 8 GROUP BY doc_id),
        h4 AS (SELECT doc_id, least(10, count(*)) AS v FROM matrix GROUP BY doc_id),
        h5 AS (SELECT doc_id, list(x ORDER BY n) AS v FROM (SELECT doc_id, concat(entity, ': ''', value_a, ''' vs ''', value_b, '''') AS x, row_number() OVER (PARTITION BY doc_id ORDER BY source, oa, ob) AS n FROM entity_conflicts) WHERE n <= 8 GROUP BY doc_id),
        h6 AS (SELECT doc_id, list(x ORDER BY n) AS v FROM (SELECT doc_id, concat('Ambiguity: ''', phrase, ''' (', category, ')') AS x, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, rule, i) AS n FROM vague) WHERE n <= 8 GROUP BY doc_id)
        SELECT t.doc_id, concat('Executive summary of document ', t.doc_id, '. The document has a trust score of ', {_NUMBER("t.score")}, '% based on automated intelligence checks.') AS executive_summary,
          coalesce(list_transform(h1.v, lambda f: concat('Fact: ', f)), ['No major facts extracted.']) AS key_findings, list_concat(coalesce(h3.v, []), coalesce(h6.v, [])) AS critical_risks,
          coalesce(h2.v, ['No major contradictions found.']) AS major_contradictions, coalesce(h5.v, ['No major entity conflicts found.']) AS important_entities,
          concat('Document contains ', coalesce(h4.v, 0), ' identified requirement tracking items.') AS requirements_overview,
          concat('Evaluated trust score is ', {_NUMBER("t.score")}, '%: Contradiction health score is ', {_NUMBER("t.contradiction_health")}, '%. Reference integrity score is ', {_NUMBER("t.reference_integrity")}, '%.') AS trust_assessment,
          ['Verify and repair identified broken references.', 'Clarify identified ambiguous terminology.'] AS recommended_actions
        FROM trust t LEFT JOIN h1 USING (doc_id) LEFT JOIN h2 USING (doc_id) LEFT JOIN h3 USING (doc_id) LEFT JOIN h4 USING (doc_id) LEFT JOIN h5 USING (doc_id) LEFT JOIN h6 USING (doc_id)""",
    "review_report": f"""{audit.EVERYTHING}, {audit.SCORES},
        h3 AS (SELECT doc_id, list(x ORDER BY n) AS v FROM (SELECT doc_id, concat(reference, ' -> ', target, ' (Page ', page, ')') AS x, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, rule, i) AS n FROM refs WHERE status = 'BROKEN_REFERENCE') WHERE n <= 8 GROUP BY doc_id),
        h5 AS (SELECT doc_id, list(x ORDER BY n) AS v FROM (SELECT doc_id, concat(entity, ': ''', value_a, ''' vs ''', value_b, '''') AS x, row_number() OVER (PARTITION BY doc_id ORDER BY source, oa, ob) AS n FROM entity_conflicts) WHERE n <= 8 GROUP BY doc_id),
        h6 AS (SELECT doc_id, list(x ORDER BY n) AS v FROM (SELECT doc_id, concat('''', phrase, ''' (', category, ') on Page ', page) AS x, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, rule, i) AS n FROM vague) WHERE n <= 8 GROUP BY doc_id),
        al AS (SELECT t.doc_id, coalesce(h3.v, []) AS b, coalesce(h5.v, []) AS c, coalesce(h6.v, []) AS a FROM trust t LEFT JOIN h3 USING (doc_id) LEFT JOIN h5 USING (doc_id) LEFT JOIN h6 USING (doc_id))
        SELECT doc_id, ['Verify that all sections mentioned in references exist.'] AS reviewer_checklist,
          CASE WHEN len(c) + len(a) > 0 THEN list_concat(list_transform(c, lambda x: concat('What is the correct value for entity: ', x, '?')), list_transform(a, lambda x: concat('Can we replace the ambiguous phrase ', x, ' with a concrete description?'))) ELSE ['Are there any outstanding project questions?'] END AS open_questions,
          ['Confirm that all requirement trace targets are satisfied.'] AS compliance_concerns,
          CASE WHEN len(c) + len(b) > 0 THEN list_concat(list_transform(c, lambda x: concat('Entity data clash: ', x)), list_transform(b, lambda x: concat('Broken internal reference: ', x))) ELSE ['No high-priority risks detected.'] END AS risk_items,
          CASE WHEN len(c) + len(b) > 0 THEN list_concat(list_transform(c, lambda x: concat('Resolve conflict: ', x, '.')), list_transform(b, lambda x: concat('Check broken reference: ', x))) ELSE ['Verify text contents.'] END AS verification_tasks FROM al""",
}
