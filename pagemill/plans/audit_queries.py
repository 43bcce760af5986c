"""Queries of the audit on the derived specification corpus, with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagemill.functions import patterns as P
from pagemill.operators import audit, entities
from pagemill.plans.corpora import CHUNKS, ENTITIES, FACTS, chunks, derived, duck_sql
from pagemill.session import materialise

CORPUS = f"corpus AS ({duck_sql(CHUNKS)})"
CONFLICT_COLUMNS = ["doc_id", "type", "severity", "confidence", "label", "value_a", "page_a", "value_b", "page_b", "summary"]
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def quoted(pattern: str, flags: str = "i") -> str:
    return "'" + f"(?{flags}){pattern}".replace("'", "''") + "'"


def strip(x: str) -> str:
    return STRIP.format(x)


def occurrences(name: str, pattern: str, groups: int, flags: str = "i") -> str:
    """A CTE: a row for each match in the corpus, with its place i and groups g0, g1..."""
    arrays = ", ".join(f"regexp_extract_all(text, {quoted(pattern, flags)}, {g}) AS a{g}" for g in range(groups + 1))
    fields = ", ".join(f"a{g}[i] AS g{g}" for g in range(groups + 1))
    return f"{name} AS (SELECT doc_id, page, chunk_index, i, text, {fields} FROM (SELECT *, unnest(generate_series(1, len(a0))) AS i FROM (SELECT *, {arrays} FROM corpus)))"


def conflict_ctes(kind: str, pattern: str, confidence: float, least: int, generic: bool) -> str:
    more = " AND lower(label) NOT IN (" + ", ".join(f"'{g}'" for g in P.GENERIC_LABELS) + ")" if generic else ""
    value = lambda v: rf"regexp_replace(lower({v}), '[\s,]+', '', 'g')"
    return f"""{occurrences(kind + "_m", pattern, 2)},
        {kind}_l AS (SELECT *, {strip("g1")} AS label, {strip("g2")} AS value FROM {kind}_m),
        {kind}_o AS (SELECT *, lower(label) AS k FROM {kind}_l WHERE length(label) >= {least}{more}),
        {kind}_f AS MATERIALIZED (SELECT *, {value("value")} AS same FROM {kind}_o QUALIFY row_number() OVER (PARTITION BY doc_id, k, lower(value), page ORDER BY chunk_index, i) = 1),
        {kind}_c AS (SELECT a.doc_id, '{kind}' AS type, 'high' AS severity, {confidence}::DOUBLE AS confidence, a.label, a.value AS value_a, a.page AS page_a, b.value AS value_b, b.page AS page_b,
          concat('{kind.capitalize()} conflict for ''', a.label, ''': ''', a.value, ''' (page ', a.page, ') vs ''', b.value, ''' (page ', b.page, ')') AS summary, a.chunk_index AS ca, a.i AS ia, b.chunk_index AS cb, b.i AS ib
          FROM {kind}_f a JOIN {kind}_f b ON a.doc_id = b.doc_id AND a.k = b.k AND (a.chunk_index, a.i) < (b.chunk_index, b.i) AND a.page <> b.page AND a.same <> b.same)"""


NUMERIC = conflict_ctes("numerical", P.NUMERIC, 0.92, 3, True)
DATE = conflict_ctes("date", P.DATE, 0.90, 4, False)
MONEY = conflict_ctes("monetary", P.MONEY, 0.95, 3, False)
DUTY = lambda name: f"{name}_d AS (SELECT *, lower(g1) AS verb, substr(lower({strip('g2')}), 1, 30) AS object, {strip('g0')} AS statement FROM {name}_m)"
POLARITY = f"""{occurrences("pos_m", P.POSITIVE, 2)}, {occurrences("neg_m", P.NEGATIVE, 2)}, {DUTY("pos")}, {DUTY("neg")},
        pos_f AS (SELECT * FROM pos_d QUALIFY row_number() OVER (PARTITION BY doc_id, verb, object ORDER BY chunk_index, i) = 1),
        requirement_c AS (SELECT a.doc_id, 'requirement' AS type, 'critical' AS severity, 0.93::DOUBLE AS confidence, concat(a.verb, ' ', a.object) AS label, a.statement AS value_a, a.page AS page_a, b.statement AS value_b, b.page AS page_b,
          concat('Requirement polarity conflict: ''', substr(a.statement, 1, 60), ''' vs ''', substr(b.statement, 1, 60), '''') AS summary, a.chunk_index AS ca, a.i AS ia, b.chunk_index AS cb, b.i AS ib
          FROM pos_f a JOIN neg_d b ON a.doc_id = b.doc_id AND a.verb = b.verb AND a.object = b.object AND a.page <> b.page)"""
KINDS = ["numerical", "date", "monetary", "requirement"]
MERGED = (
    f"{NUMERIC}, {DATE}, {MONEY}, {POLARITY}, every AS ("
    + " UNION ALL ".join(f"SELECT *, {i} AS source FROM {k}_c" for i, k in enumerate(KINDS))
    + f"), merged AS (SELECT * FROM (SELECT *, substr(lower({strip('summary')}), 1, 120) AS sk FROM every) WHERE sk <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, sk ORDER BY source, ca, ia, cb, ib, summary) = 1)"
)
RULES = " UNION ALL ".join(
    "SELECT doc_id, page, chunk_index, i, {r} AS rule, g0 AS phrase, '{c}' AS category, '{s}' AS severity, '{a}' AS recommendation FROM vague_{r}".format(r=r, c=c, s=s, a=a.replace("'", "''")) for r, (_, c, s, a) in enumerate(P.AMBIGUITY_RULES)
)
VAGUE = (
    ", ".join(occurrences(f"vague_{r}", rf"\b{phrase}\b", 0) for r, (phrase, *_) in enumerate(P.AMBIGUITY_RULES))
    + f""", vague_a AS ({RULES}), vague_f AS (SELECT * FROM vague_a QUALIFY row_number() OVER (PARTITION BY doc_id, lower(phrase), page ORDER BY chunk_index, rule, i) = 1),
        vague AS (SELECT * FROM vague_f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, rule, i) <= {P.MOST_AMBIGUITIES})"""
)
REFERENCE = (
    ", ".join(occurrences(f"def_{i}", p, 1, flags) for i, (_, flags, p) in enumerate(P.DEFINITIONS))
    + ", "
    + ", ".join(occurrences(f"ref_{i}", p, 1) for i, p in enumerate(P.REFERENCES.values()))
    + ", defined AS ("
    + " UNION ".join(f"SELECT doc_id, '{kind}' AS kind, upper({strip('g1')}) AS value FROM def_{i}" for i, (kind, _, _) in enumerate(P.DEFINITIONS))
    + "), used AS ("
    + " UNION ALL ".join(f"SELECT doc_id, page, chunk_index, i, {r} AS rule, '{kind}' AS kind, g0 AS reference, upper({strip('g1')}) AS value FROM ref_{r}" for r, kind in enumerate(P.REFERENCES))
    + """), used_f AS (SELECT * FROM used QUALIFY row_number() OVER (PARTITION BY doc_id, lower(reference), kind, lower(value), page ORDER BY chunk_index, rule, i) = 1),
        refs AS (SELECT u.doc_id, u.reference, concat(upper(u.kind[1]), u.kind[2:], ' ', u.value) AS target, u.page, CASE WHEN d.doc_id IS NULL THEN 'BROKEN_REFERENCE' ELSE 'VALID' END AS status, chunk_index, rule, i FROM used_f u LEFT JOIN defined d ON u.doc_id = d.doc_id AND u.kind = d.kind AND u.value = d.value)"""
)
MATRIX = rf"""req_a AS (SELECT *, regexp_extract_all(text, {quoted(P.REQUIREMENT)}, 0) AS m, regexp_extract_all(text, {quoted(P.REQUIREMENT)}, 1) AS v, regexp_split_to_array(text, {quoted(P.REQUIREMENT)}) AS p FROM corpus),
        req_b AS (SELECT *, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS off FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM req_a)),
        req_c AS (SELECT doc_id, page, chunk_index, i, concat(CASE WHEN contains(m[i], 'Functional') THEN 'Functional Requirement' WHEN contains(m[i], 'Requirement') THEN 'Requirement' ELSE 'REQ' END, ' ', v[i]) AS requirement_id,
          regexp_matches(substr(text, (off + length(m[i]) + 1)::BIGINT, 5), '^\s*[:\-]') OR off = 0 OR substr(text, off::BIGINT, 1) = chr(10) AS defines,
          {strip("replace(substr(text, (greatest(off - 60, 0) + 1)::BIGINT, (off + length(m[i]) + 100 - greatest(off - 60, 0))::BIGINT), chr(10), ' ')")} AS around FROM req_b),
        req_g AS (SELECT doc_id, requirement_id, coalesce(list_sort(list(DISTINCT page) FILTER (defines)), []) AS definition_pages, coalesce(list_sort(list(DISTINCT page) FILTER (NOT defines)), []) AS mentioned, arg_min(around, row(NOT defines, chunk_index, i)) AS d FROM req_c GROUP BY ALL),
        req_h AS (SELECT *, list_filter(mentioned, lambda x: NOT list_contains(definition_pages, x)) AS reference_pages FROM req_g),
        matrix AS (SELECT doc_id, requirement_id, CASE WHEN len(definition_pages) = 0 THEN CASE WHEN len(reference_pages) > 0 THEN 'MISSING' ELSE 'REFERENCED' END WHEN len(reference_pages) > 0 THEN 'DEFINED' ELSE 'ORPHANED' END AS status,
          definition_pages, reference_pages, CASE WHEN length(d) > 200 THEN concat(substr(d, 1, 200), '...') ELSE d END AS description FROM req_h)"""
FACT_ROWS = f"facts AS ({duck_sql(FACTS)})"
ENTITY_ROWS = f"ents AS ({duck_sql(ENTITIES)})"
SAME = lambda v: f"replace(replace(lower({v}), ',', ''), '$', '')"
CLEAN_FACTS = f"clean AS (SELECT *, {strip('subject')} AS s, {strip('predicate')} AS p, {strip('value')} AS v FROM facts WHERE {strip('subject')} <> '' AND {strip('predicate')} <> '' AND {strip('value')} <> '')"
FACT_CONFLICTS = f"""firsts AS (SELECT * FROM clean QUALIFY row_number() OVER (PARTITION BY doc_id, lower(s), lower(p), lower(v) ORDER BY ord) = 1),
        fact_pairs AS (SELECT a.doc_id, a.s AS entity, a.v AS value_a, b.v AS value_b, list_sort(list_distinct([a.page, b.page])) AS pages, least(a.confidence, b.confidence) AS confidence, a.ord AS oa, b.ord AS ob, 0 AS source
          FROM firsts a JOIN firsts b ON a.doc_id = b.doc_id AND lower(a.s) = lower(b.s) AND lower(a.p) = lower(b.p) AND a.ord < b.ord AND {SAME("a.v")} <> {SAME("b.v")}),
        fact_conflicts AS (SELECT *, CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.65 THEN 'medium' ELSE 'low' END AS severity FROM fact_pairs)"""
ENTITY_MERGE = """mention_rows AS (SELECT doc_id, lower(trim(text)) AS k, type, page, snippet, min(ord) AS o, min(row(ord, text)) AS named, max(confidence) AS confidence, list(DISTINCT related) FILTER (lower(trim(related)) <> lower(trim(text))) AS related FROM ents GROUP BY ALL),
        merged_ents AS (SELECT doc_id, type, min(named)[2] AS entity, min(o) AS ord, max(confidence) AS confidence, list({'page': page, 'snippet': snippet} ORDER BY page, o) AS mentions, list_sort(list_distinct(flatten(list(related)))) AS related FROM mention_rows GROUP BY doc_id, k, type)"""
_MENTION = lambda t, p: f"SELECT doc_id, entity, ord, mi, mp, unnest(generate_series(1, len(vs))) AS j, vs FROM (SELECT doc_id, entity, ord, mi, mentions[mi].page AS mp, regexp_extract_all(mentions[mi].snippet, {quoted(p)}) AS vs FROM (SELECT *, unnest(generate_series(1, len(mentions))) AS mi FROM merged_ents WHERE type = '{t}' AND len(mentions) >= 2))"
ENTITY_CONFLICTS = f"""{ENTITY_MERGE}, seen AS ({_MENTION("MONEY", P.SNIPPET_MONEY)} UNION ALL {_MENTION("DATE", P.SNIPPET_DATE)}),
        vals AS (SELECT doc_id, entity, ord, vs[j] AS val, min(row(mi, j)) AS seen_at, list(mp) AS ps FROM seen GROUP BY doc_id, entity, ord, vs[j]),
        mention_conflicts AS (SELECT doc_id, entity, list(val ORDER BY seen_at) AS vl, list_sort(list_distinct(flatten(list(ps)))) AS pages, ord FROM vals GROUP BY doc_id, entity, ord HAVING count(*) >= 2),
        all_conflicts AS (SELECT doc_id, entity, value_a, value_b, pages, confidence, severity, 0 AS source, oa, ob FROM fact_conflicts UNION ALL SELECT doc_id, entity, vl[1], vl[2], pages, 0.8::DOUBLE, 'medium', 1, ord, 0 FROM mention_conflicts),
        entity_conflicts AS (SELECT * FROM all_conflicts QUALIFY row_number() OVER (PARTITION BY doc_id, lower(entity), least(lower(value_a), lower(value_b)), greatest(lower(value_a), lower(value_b)) ORDER BY source, oa, ob) = 1)"""
_POINTS = lambda points, other: "CASE lower(severity) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in points.items()) + f" ELSE {points[other]} END"
_NAMES = [c for c, _, _ in P.COMPONENTS]
LOST = f"""{occurrences("todo_m", P.PLACEHOLDER, 0)}, todo AS (SELECT * FROM todo_m QUALIFY row_number() OVER (PARTITION BY doc_id, lower(g0), page ORDER BY chunk_index, i) = 1),
        lost AS (SELECT doc_id, '{_NAMES[0]}' AS component, ({_POINTS(P.CONFLICT_POINTS, "medium")})::DOUBLE AS points, concat('Semantic conflict (', severity, '): ''', summary, '''') AS evidence, 1 AS page, concat('contr-', substr(sha256(concat_ws('|', doc_id, sk)), 1, 12)) AS finding_id FROM merged
          UNION ALL SELECT doc_id, '{_NAMES[1]}', {P.REFERENCE_POINTS}, concat('Broken reference: ''', reference, ''' → target ''', target, ''' not found'), page, concat('ref-', reference, '-', page) FROM refs WHERE status = 'BROKEN_REFERENCE'
          UNION ALL SELECT doc_id, '{_NAMES[2]}', {P.REQUIREMENT_POINTS["MISSING"]}, concat('Requirement ''', requirement_id, ''' referenced but never defined'), coalesce(reference_pages[1], 1), concat('req-missing-', requirement_id) FROM matrix WHERE status = 'MISSING'
          UNION ALL SELECT doc_id, '{_NAMES[2]}', {P.REQUIREMENT_POINTS["ORPHANED"]}, concat('Requirement ''', requirement_id, ''' defined but never referenced (orphaned)'), coalesce(definition_pages[1], 1), concat('req-orphaned-', requirement_id) FROM matrix WHERE status = 'ORPHANED'
          UNION ALL SELECT doc_id, '{_NAMES[3]}', {_POINTS(P.ENTITY_POINTS, "medium")}, concat('Conflicting values for entity ''', entity, ''': ''', value_a, ''' vs ''', value_b, ''''), coalesce(pages[1], 1), concat('ent-conflict-', entity) FROM entity_conflicts
          UNION ALL SELECT doc_id, '{_NAMES[4]}', {_POINTS(P.AMBIGUITY_POINTS, "low")}, concat('Ambiguous term ''', phrase, ''' (', category, ') — ', recommendation), page, concat('amb-', phrase, '-', page) FROM vague
          UNION ALL SELECT doc_id, '{_NAMES[5]}', {P.PLACEHOLDER_POINTS}, concat('Unresolved placeholder: ''', g0, ''' on page ', page), page, concat('comp-', g0, '-', page) FROM todo)"""
EVERYTHING = f"WITH {CORPUS}, {FACT_ROWS}, {ENTITY_ROWS}, {MERGED}, {REFERENCE}, {MATRIX}, {CLEAN_FACTS}, {FACT_CONFLICTS}, {ENTITY_CONFLICTS}, {VAGUE}, {LOST}"
_SUMS = ", ".join(f"greatest(0.0, 100.0 - coalesce(sum(points) FILTER (component = '{c}'), 0.0)) AS {k}" for c, k, _ in P.COMPONENTS)
SCORES = f"""scored AS (SELECT s.doc_id, any_value(n_chunks) AS n_chunks, count(component) AS n_deductions, {_SUMS} FROM (SELECT doc_id, count(*) AS n_chunks FROM corpus GROUP BY doc_id) s LEFT JOIN lost l ON s.doc_id = l.doc_id GROUP BY s.doc_id),
        trust AS (SELECT doc_id, greatest(0.0, least(100.0, round_even({" + ".join(f"{w} * {k}" for _, k, w in P.COMPONENTS)}, 2))) AS score,
          least(0.98, round_even(0.70::DOUBLE + 0.20::DOUBLE * least(1.0::DOUBLE, greatest(1, n_chunks) / 20.0::DOUBLE) + 0.10::DOUBLE * ({" + ".join(f"({k} < 100)::INT" for _, k, _ in P.COMPONENTS)}) / 6.0::DOUBLE, 3)) AS confidence, {", ".join(k for _, k, _ in P.COMPONENTS)}, n_deductions, n_chunks,
          printf('Trust score computed from %d chunks across 6 dimensions. Breakdown — Contradictions: %d%%, References: %d%%, Requirements: %d%%, Entities: %d%%, Ambiguity: %d%%, Completeness: %d%%. Total deductions: %d.', n_chunks, {", ".join(f"round_even({k}, 0)::INT" for _, k, _ in P.COMPONENTS)}, n_deductions) AS evidence FROM scored)"""


def findings(spark: SparkSession, sf_dir: str, reread: bool | tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """All findings over the specification corpus; the chunk table is written once for the detectors that share it.

    ``reread``: the findings that are written once too, as something reads them beside the deductions; true for all.
    """
    text = materialise(chunks(spark, sf_dir), "audited-chunks")
    facts, ents = derived(spark, sf_dir, FACTS), derived(spark, sf_dir, ENTITIES)
    found = {
        "chunks": text,
        "contradictions": audit.contradictions(text),
        "references": audit.references(text),
        "requirements": audit.requirement_matrix(text),
        "entity_conflicts": entities.entity_conflicts(facts, entities.merge_entities(ents)),
        "ambiguities": audit.ambiguities(text),
    }
    found |= {k: materialise(found[k], k.replace("_", "-")) for k in ([k for k in found if k != "chunks"] if reread is True else reread or ())}
    found["deductions"] = audit.deductions(text, *(found[k] for k in ("contradictions", "references", "requirements", "entity_conflicts", "ambiguities")))
    found["trust"] = audit.trust_scores(text, found["deductions"])
    return found


def conflicts_of(detector):
    return lambda spark, sf_dir: detector(chunks(spark, sf_dir)).select(*CONFLICT_COLUMNS)


def trust_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir)["trust"]


def trust_deductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir)["deductions"]


def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by kind and severity with subtotals, for the whole corpus."""
    found = findings(spark, sf_dir)
    rows = found["contradictions"].select(F.lit("contradiction").alias("kind"), "severity")
    rows = rows.unionByName(found["ambiguities"].select(F.lit("ambiguity").alias("kind"), "severity")).unionByName(found["entity_conflicts"].select(F.lit("entity").alias("kind"), "severity"))
    return rows.rollup("kind", "severity").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "placeholders": lambda s, d: audit.placeholders(chunks(s, d)),
    "date_conflicts": conflicts_of(partial(audit.date_conflicts, snippets=False)),
    "money_conflicts": conflicts_of(partial(audit.money_conflicts, snippets=False)),
    "numeric_conflicts": conflicts_of(partial(audit.numeric_conflicts, snippets=False)),
    "polarity_conflicts": conflicts_of(audit.polarity_conflicts),
    "merged_contradictions": lambda s, d: audit.contradictions(chunks(s, d)).select("doc_id", "type", "severity", "confidence", "summary", "finding_id"),
    "ambiguities": lambda s, d: audit.ambiguities(chunks(s, d)).drop("ord"),
    "references": lambda s, d: audit.references(chunks(s, d)).drop("ord"),
    "requirement_matrix": lambda s, d: audit.requirement_matrix(chunks(s, d)),
    "trust_score": trust_score,
    "trust_deductions": trust_deductions,
    "severity_counts": severity_counts,
}
_C = ", ".join(CONFLICT_COLUMNS)
ORACLE_SQL = {
    "numeric_conflicts": f"WITH {CORPUS}, {NUMERIC} SELECT {_C} FROM numerical_c",
    "date_conflicts": f"WITH {CORPUS}, {DATE} SELECT {_C} FROM date_c",
    "money_conflicts": f"WITH {CORPUS}, {MONEY} SELECT {_C} FROM monetary_c",
    "polarity_conflicts": f"WITH {CORPUS}, {POLARITY} SELECT {_C} FROM requirement_c",
    "merged_contradictions": f"WITH {CORPUS}, {MERGED} SELECT doc_id, type, severity, confidence, summary, concat('contr-', substr(sha256(concat_ws('|', doc_id, sk)), 1, 12)) AS finding_id FROM merged",
    "ambiguities": f"WITH {CORPUS}, {VAGUE} SELECT doc_id, page, phrase, category, severity, recommendation FROM vague",
    "references": f"WITH {CORPUS}, {REFERENCE} SELECT doc_id, reference, target, page, status FROM refs",
    "requirement_matrix": f"WITH {CORPUS}, {MATRIX} SELECT * FROM matrix",
    "placeholders": f"WITH {CORPUS}, {occurrences('todo_m', P.PLACEHOLDER, 0)} SELECT doc_id, page, g0 AS placeholder FROM todo_m QUALIFY row_number() OVER (PARTITION BY doc_id, lower(g0), page ORDER BY chunk_index, i) = 1",
    "trust_score": f"{EVERYTHING}, {SCORES} SELECT * FROM trust",
    "trust_deductions": f"{EVERYTHING} SELECT * FROM lost",
    "severity_counts": f"{EVERYTHING}, rows AS (SELECT 'contradiction' AS kind, severity FROM merged UNION ALL SELECT 'ambiguity', severity FROM vague UNION ALL SELECT 'entity', severity FROM entity_conflicts) SELECT kind, severity, count(*) AS n FROM rows GROUP BY ROLLUP (kind, severity)",
}
