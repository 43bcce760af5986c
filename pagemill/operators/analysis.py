"""Ingestion and analysis of whole corpora as single operators, and the small tables around them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagemill.functions import patterns as P
from pagemill.functions.text import strip
from pagemill.functions.vectors import hash_embedding
from pagemill.operators import audit, chunking, entities, reports
from pagemill.session import materialise
from pagemill.sources import files


def ingest_corpus(docs: DataFrame, size: int = 500, overlap: int = 50, embed: Callable[[Column], Column] = hash_embedding) -> DataFrame:
    """The chunk table of ``docs`` (doc_id, text): pages, cleaned, cut into chunks, with ``vector`` from ``embed``.

    A null or blank text gives no chunks; of a document that comes twice, all pages are taken.
    """
    chunks = chunking.chunk_documents(chunking.clean_pages(chunking.pages_of(docs)), size, overlap)
    return chunks.withColumn("vector", embed(F.col("text")))


def ingest_into(path: str, failures: str | None = None, **options) -> Callable[[DataFrame, int], None]:
    """What a stream of documents does with each micro-batch: their chunks replace those of the same documents in ``path``.

    With ``failures``, each batch is read back, and buckets that lack what was written are appended to the table there.

    A batch that runs again after a failure writes the same rows, as only the partitions of its documents are replaced.
    """

    def each(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        chunks = ingest_corpus(batch.dropDuplicates(["doc_id"]), **options)
        files.replace_in(spark, chunks, batch.select("doc_id").distinct(), path, failures=failures)

    return each


def chunk_scan(chunks: DataFrame, documents: list) -> DataFrame:
    """The chunks of some documents in the order of the text."""
    return chunks.where(F.col("doc_id").isin(documents)).orderBy("doc_id", "chunk_index")


def context_head(chunks: DataFrame, most_chunks: int = 30, most_chars: int = 15_000) -> DataFrame:
    """doc_id, context: the first chunks of each document as numbered segments, cut at ``most_chars`` with a note."""
    part = F.format_string("[Segment %d]\n%s", F.col("chunk_index") + 1, "text")
    rows = chunks.where(F.col("chunk_index") < most_chunks).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", part.alias("part")))).alias("parts"))
    whole = F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n---\n\n")
    cut = F.concat(F.substring(whole, 1, most_chars), F.lit("\n\n[...truncated for entity analysis...]"))
    return rows.select("doc_id", F.when(F.length(whole) > most_chars, cut).otherwise(whole).alias("context"))


def merged_context(hits: DataFrame) -> DataFrame:
    """query_id, context: the hits of each query in rank order, each with its document and page."""
    part = F.format_string("[Source: Doc ID %s, Page %d] %s", F.col("doc_id").cast("string"), "page", "text")
    rows = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))).alias("parts"))
    return rows.select("query_id", F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n").alias("context"))


def source_segments(facts: DataFrame, segments: DataFrame) -> DataFrame:
    """``facts`` (doc_id, batch, page, ...) with ``chunk_index``: the first segment of their batch on that page, else its first."""
    exact = segments.groupBy("doc_id", "batch", "page").agg(F.min("chunk_index").alias("own"))
    first = segments.groupBy("doc_id", "batch").agg(F.min("chunk_index").alias("first"))
    joined = facts.join(exact, ["doc_id", "batch", "page"], "left").join(first, ["doc_id", "batch"], "left")
    return joined.withColumn("chunk_index", F.coalesce("own", "first")).drop("own", "first")


def run_telemetry(hits: DataFrame, findings: DataFrame, calls: DataFrame) -> DataFrame:
    """By document: chunks retrieved, distinct contradictions, and seconds of model calls (doc_id, seconds)."""
    got = hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("retrieved"))
    said = findings.groupBy("doc_id").agg(F.count_distinct(F.lower(strip(F.col("summary")))).alias("contradictions"))
    took = calls.groupBy("doc_id").agg(F.round(F.sum("seconds"), 3).alias("latency"))
    joined = got.join(said, "doc_id", "full").join(took, "doc_id", "full")
    return joined.select("doc_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("retrieved", "contradictions")), F.coalesce("latency", F.lit(0.0)).alias("latency"))


def with_defaults(payloads: DataFrame, schema: str, defaults: dict[str, object], column: str = "payload") -> DataFrame:
    """``payloads`` with the fields of ``schema`` (all strings in the JSON text) read leniently.

    A field that is missing, empty or no value of its type gets its default; so does every field of a broken payload.
    """
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    raw = F.from_json(column, ", ".join(f"{name} string" for name, _ in fields))
    read = payloads.withColumn("_raw", raw)
    value = lambda name, kind: F.nullif(F.col(f"_raw.{name}"), F.lit("")).try_cast(kind)
    return read.select(*payloads.columns, *(F.coalesce(value(name, kind), F.lit(defaults[name]).cast(kind)).alias(name) for name, kind in fields))


def listed_with_defaults(payloads: DataFrame, path: str, schema: str, defaults: dict[str, object], column: str = "payload") -> DataFrame:
    """A row for each element of the list at ``path`` in a JSON payload, its fields read leniently.

    A field that is missing, null, an empty text or no value of its type gets its default; an element that is no object gets
    all of them. Nested values of text fields come as JSON. A payload that is broken or has no such list gives no row. The
    columns of ``payloads``, ``place`` (from 0), then the fields of ``schema``.
    """
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    elements = F.try_variant_get(F.try_parse_json(column), path, "array<variant>")
    rows = payloads.select("*", F.posexplode(elements).alias("place", "_element"))

    def value(name: str, kind: str) -> Column:
        raw = F.try_variant_get("_element", f"$.{name}", "variant")
        nested = F.schema_of_variant(raw).rlike("^(OBJECT|ARRAY)")
        text = F.nullif(F.when(nested, F.to_json(raw)).otherwise(F.try_variant_get("_element", f"$.{name}", "string")), F.lit(""))
        read = text if kind == "string" else F.when(~nested, text).try_cast(kind)
        return F.coalesce(read, F.lit(defaults[name]).cast(kind)).alias(name)

    return rows.select(*payloads.columns, "place", *(value(name, kind) for name, kind in fields))


def merged_metadata(base: Column, new: Column) -> Column:
    """Two maps as one: where both have a key, ``new`` wins; null maps count as empty, null values go."""
    none = F.create_map().cast("map<string,string>")
    base, new = F.coalesce(base, none), F.coalesce(new, none)
    return files.sanitised(F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(new, k)), new))


def with_finding_ids(findings: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """``findings`` with ``finding_id``, which depends on ``keys`` alone: the same in every run."""
    text = F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    return findings.withColumn("finding_id", F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(text, 256), 1, 12)))


def explained(conflicts: DataFrame) -> DataFrame:
    """Conflicts of labelled values with the sentence that explains them, and both statements as ``statements``."""
    said = F.format_string("The document assigns conflicting %s values to '%s'. Page %d states '%s' while page %d states '%s'. One of these must be incorrect.", "type", "label", "page_a", "value_a", "page_b", "value_b")
    side = lambda x: F.struct(F.col(f"snippet_{x}").alias("text"), F.col(f"page_{x}").alias("page"))
    return conflicts.withColumns({"explanation": said, "statements": F.array(side("a"), side("b"))})


#: what an analysed document without chunks says. Fixed values
PROCESSING = "Document is processing."


def analyze_corpus(documents: DataFrame, chunks: DataFrame, facts: DataFrame, found: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """A nested row for each of ``documents`` (doc_id): trust score with breakdown and evidence, deductions, the lists of all
    facts, entities and findings, ``summary`` and ``review``.

    ``facts``, ``found`` (entities) and ``semantic`` (conflicts of facts, :func:`pagemill.operators.pairs.semantic_conflicts`)
    are what models replied. A document without chunks has score 100, confidence 1, no breakdown and empty lists. Lists are in
    the order of detection; a document's findings bound them. Findings are written once, as lists, deductions and scores read
    them; they are dropped with the folder that holds them, as the result reads them too.
    """
    conflicts, refs = materialise(audit.contradictions(chunks, semantic), "conflicts"), materialise(audit.references(chunks), "references")
    requirements, vague = materialise(audit.requirement_matrix(chunks), "requirements"), materialise(audit.ambiguities(chunks), "ambiguities")
    named = materialise(entities.merge_entities(found), "entities")
    clashes = materialise(entities.entity_conflicts(facts, named), "entity-conflicts")
    lost = materialise(audit.deductions(chunks, conflicts, refs, requirements, clashes, vague), "deductions")
    lists = {
        "facts": (entities.shape_facts(entities.dedupe_facts(facts), keep=("ord",)), ["ord"]),
        "entities": (named, ["ord"]),
        "contradictions": (conflicts, ["ord"]),
        "references": (refs, ["ord"]),
        "requirements": (requirements, ["requirement_id"]),
        "entity_conflicts": (clashes, ["ord"]),
        "ambiguities": (vague, ["ord"]),
        "deductions": (lost, ["component", "page", "evidence"]),
    }
    parts = {name: (frame, [*first, *(c for c in frame.columns if c not in ("doc_id", *first))]) for name, (frame, first) in lists.items()}
    trust = audit.trust_scores(chunks, lost)
    parts["trust"] = (trust, [c for c in trust.columns if c != "doc_id"])
    # all that a document has meets once, each thing in a column of its own
    every = documents.select("doc_id", F.lit(True).alias("asked"))
    for name, (frame, columns) in parts.items():
        every = every.unionByName(frame.where("doc_id is not null").select("doc_id", F.struct(*columns).alias(name)), allowMissingColumns=True)
    gathered = every.repartition("doc_id").groupBy("doc_id").agg(F.max("asked").alias("asked"), F.any_value("trust", True).alias("trust"), *(F.array_sort(F.collect_list(name)).alias(name) for name in lists)).where("asked")
    gathered = gathered.withColumn("doc_id", F.col("doc_id").cast(documents.schema["doc_id"].dataType))

    def reported(rows: DataFrame, texts: dict, of: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
        """``rows`` with a report made of their own lists; an empty one where there is no score."""
        base = rows.select("doc_id", "trust.*", *reports.heads_of_lists(texts), F.struct(*rows.columns).alias("_row"))
        fields = [f for f in of(base).schema.fields if f.name != "doc_id"]
        made = of(base, "_row").select("_row.*", F.struct(*(f.name for f in fields)).alias(name))
        empty = [F.array().cast("array<string>") if f.dataType.simpleString().startswith("array") else F.lit(PROCESSING if f.name == "executive_summary" else "") for f in fields]
        return made.withColumn(name, F.when(F.col("trust").isNotNull(), F.col(name)).otherwise(F.struct(*(e.alias(f.name) for e, f in zip(empty, fields, strict=True)))))

    rows = reported(reported(gathered, reports.SUMMARISED, reports.summary_of, "summary"), reports.REVIEWED, reports.review_of, "review")
    breakdown = F.create_map(*(x for _, k, _ in P.COMPONENTS for x in (F.lit(k), F.col(f"trust.{k}"))))
    none = F.create_map().cast("map<string,double>")
    return rows.select(
        "doc_id",
        F.coalesce("trust.score", F.lit(100.0)).alias("score"),
        F.coalesce("trust.confidence", F.lit(1.0)).alias("confidence"),
        F.coalesce("trust.n_chunks", F.lit(0)).alias("n_chunks"),
        F.when(F.col("trust").isNotNull(), breakdown).otherwise(none).alias("breakdown"),
        F.coalesce("trust.evidence", F.lit("")).alias("evidence"),
        *lists,
        "summary",
        "review",
    )


def expectations(analysis: DataFrame, rules: dict[str, str]) -> DataFrame:
    """doc_id, assertion, passed: SQL conditions by name over the rows of :func:`analyze_corpus`; unknown counts as failed."""
    checks = F.array(*(F.struct(F.lit(name).alias("assertion"), F.coalesce(F.expr(rule), F.lit(False)).alias("passed")) for name, rule in rules.items()))
    return analysis.select("doc_id", F.explode(checks).alias("c")).select("doc_id", "c.*")
