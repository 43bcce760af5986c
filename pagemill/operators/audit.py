"""Audit of chunk tables (doc_id, page, chunk_index, text): conflicts, ambiguities, references, requirements.

All documents at once: detectors are narrow scans, and what is compared meets on (doc_id, label).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagemill.functions import patterns as P
from pagemill.functions.scan import Rule, every_match, java
from pagemill.functions.text import normal_value, strip, truncated
from pagemill.operators.grouped import pairs_in_groups
from pagemill.session import materialise

WHERE = ["doc_id", "page", "chunk_index"]


def scan(chunks: DataFrame, pattern: str, groups: int, around: tuple[int, int] | None, skip: str | None = None) -> DataFrame:
    """A row for each match: doc_id, page, chunk_index, match_index, match, g1...; with ``around`` start and around too."""
    return every_match(chunks, WHERE, [Rule(java(pattern), skip)], groups, around).drop("rule")


def one_line(text: str) -> Column:
    return F.replace(F.col(text), F.lit("\n"), F.lit(" "))


def first_rows(frame: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in ``order``."""
    return frame.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def label_conflicts(chunks: DataFrame, kind: str, pattern: str, confidence: float, least_label: int, generic: bool, snippets: bool = True) -> DataFrame:
    """Pairs of different values of one label on different pages of a document, in the order of the text.

    Of equal (label, value, page) only the first takes part, which keeps pairs few and leaves merged findings the same. A label's
    occurrences meet in one shuffle, without the ``snippets`` (snippet_a, snippet_b) if these aren't asked for.
    """
    occ = scan(chunks, pattern, 2, (60, 80) if snippets else None, P.NO_LABEL).withColumnsRenamed({"g1": "label", "g2": "value"})
    occ = occ.withColumn("key", F.lower("label")).where(F.length("label") >= least_label)
    if generic:
        occ = occ.where(~F.col("key").isin(P.GENERIC_LABELS))
    extra = {"snippet": one_line("around")} if snippets else {}
    occ = occ.select("doc_id", F.lit(kind).alias("kind"), "key", "label", "value", F.lit("").alias("side"), *WHERE[1:], "match_index", *(c.alias(k) for k, c in extra.items()))
    pairs = pairs_in_groups(compared(occ.repartition("doc_id", "kind", "key")), extra=list(extra))
    at = lambda x: F.struct(F.col(f"chunk_{x}").alias("chunk_index"), F.col(f"match_{x}").alias("match_index")).alias(f"ord_{x}")
    return pairs.select("doc_id", F.lit(kind).alias("type"), F.lit("high").alias("severity"), F.lit(confidence).alias("confidence"), "label", "value_a", "page_a", "value_b", "page_b", *(f"{c}_{x}" for c in extra for x in "ab"), valued_summary().alias("summary"), at("a"), at("b"))


def numeric_conflicts(chunks: DataFrame, snippets: bool = True) -> DataFrame:
    return label_conflicts(chunks, "numerical", P.NUMERIC, 0.92, 3, True, snippets)


def date_conflicts(chunks: DataFrame, snippets: bool = True) -> DataFrame:
    return label_conflicts(chunks, "date", P.DATE, 0.90, 4, False, snippets)


def money_conflicts(chunks: DataFrame, snippets: bool = True) -> DataFrame:
    return label_conflicts(chunks, "monetary", P.MONEY, 0.95, 3, False, snippets)


def polarity_conflicts(chunks: DataFrame) -> DataFrame:
    """A duty stated and denied on different pages. The first statement of (verb, object) stands for it.

    "shall not use X" also states verb "not": kept, since results depend on it.
    """

    def duties(pattern: str) -> DataFrame:
        found = scan(chunks, pattern, 2, (20, 60)).withColumns({"verb": F.lower("g1"), "object": F.substring(F.lower("g2"), 1, 30)})
        return found.select("doc_id", "verb", "object", "page", strip(F.col("match")).alias("statement"), one_line("around").alias("snippet"), F.struct("chunk_index", "match_index").alias("ord"))

    stated = first_rows(duties(P.POSITIVE), ["doc_id", "verb", "object"], ["ord"])
    stated = stated.select("doc_id", "verb", "object", *(F.col(c).alias(f"{c}_a") for c in ("page", "statement", "snippet", "ord")))
    denied = duties(P.NEGATIVE).select("doc_id", "verb", "object", *(F.col(c).alias(f"{c}_b") for c in ("page", "statement", "snippet", "ord")))
    pairs = stated.join(denied, ["doc_id", "verb", "object"]).where("page_a <> page_b")
    summary = F.concat(F.lit("Requirement polarity conflict: '"), F.substring("statement_a", 1, 60), F.lit("' vs '"), F.substring("statement_b", 1, 60), F.lit("'"))
    return pairs.select("doc_id", F.lit("requirement").alias("type"), F.lit("critical").alias("severity"), F.lit(0.93).alias("confidence"), F.concat_ws(" ", "verb", "object").alias("label"), F.col("statement_a").alias("value_a"), "page_a", F.col("statement_b").alias("value_b"), "page_b", "snippet_a", "snippet_b", summary.alias("summary"), "ord_a", "ord_b")


#: kind, confidence, severity, least length of a label, whether generic labels go, pattern. Fixed values
LABELLED = [("numerical", 0.92, "high", 3, True, P.NUMERIC), ("date", 0.90, "high", 4, False, P.DATE), ("monetary", 0.95, "high", 3, False, P.MONEY)]
DUTIES = ("requirement", 0.93, "critical")
KINDS = [kind for kind, *_ in LABELLED] + [DUTIES[0]]
#: characters of a summary by which findings are merged. Fixed value
SUMMARY_KEY = 120


def occurrences(chunks: DataFrame, kinds: list[str] = KINDS) -> DataFrame:
    """Labelled values of some kinds, and duties stated and denied, in one pass over the chunks.

    doc_id, kind, key (what conflicting ones share), label, value, page, chunk_index, match_index, side (``stated`` or
    ``denied`` for duties, else empty), and of :func:`compared` spelled and same.
    """
    every = [(kind, "", Rule(java(pattern), P.NO_LABEL)) for kind, *_, pattern in LABELLED] + [(DUTIES[0], side, Rule(java(p))) for side, p in (("stated", P.POSITIVE), ("denied", P.NEGATIVE))]
    every = [rule for rule in every if rule[0] in kinds]
    named = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(side).alias("side")) for kind, side, _ in every))
    rows = every_match(chunks, WHERE, [rule for *_, rule in every], 2).withColumn("r", F.get(named, F.col("rule"))).select(*WHERE, "match_index", "match", "g1", "g2", "r.*")
    duty = F.col("side") != ""
    rows = rows.withColumns({"label": F.when(duty, F.concat_ws(" ", F.lower("g1"), F.substring(F.lower("g2"), 1, 30))).otherwise(F.col("g1")), "value": F.when(duty, strip(F.col("match"))).otherwise(F.col("g2"))})
    short = reduce(lambda w, k: w.when(F.col("kind") == k[0], F.length("label") < k[3]), LABELLED, F.when(duty, F.lit(False)))
    generic = F.col("kind").isin([kind for kind, *_, drop, _ in LABELLED if drop]) & F.lower("label").isin(P.GENERIC_LABELS)
    rows = rows.where(~short & ~generic)
    return compared(rows.select("doc_id", "kind", F.lower("label").alias("key"), "label", "value", "side", "page", "chunk_index", "match_index"))


def compared(found: DataFrame) -> DataFrame:
    """Occurrences with ``spelled`` and ``same``, what equal and agreeing values share; empty for duties."""
    of = lambda c: F.when(F.col("side") != "", "").otherwise(c)
    return found.withColumns({"spelled": of(F.lower("value")), "same": of(normal_value(F.col("value")))})


def taking_part(found: DataFrame) -> DataFrame:
    """Of :func:`occurrences` those that :func:`conflict_pairs` pairs, with ``wide``.

    Of equal (label, value, page) the first in the text takes part, and of the statements of a duty the first. ``wide`` is false
    where no pair of a label's values has a summary of :data:`SUMMARY_KEY` characters or more.
    """
    group = ["doc_id", "kind", "key"]
    found = found.repartition(*group).withColumn("ord", F.struct("chunk_index", "match_index"))
    alike = [F.when(F.col("side") == "", F.col("spelled")), F.when(F.col("side") == "", F.col("page")), "side", F.when(F.col("side") == "denied", F.col("ord"))]
    found = first_rows(found, [*group, *alike], ["ord"])
    longest = F.max(F.length("kind") + F.length("key") + 2 * F.length("spelled") + 2 * F.length(F.col("page").cast("string"))).over(Window.partitionBy(*group))
    return found.withColumn("wide", (F.col("side") != "") | (longest + 42 >= SUMMARY_KEY))  # 42: what a summary holds beside these


def conflict_pairs(found: DataFrame, merge: bool = False) -> DataFrame:
    """Pairs of :func:`occurrences` that conflict (:func:`pairs_in_groups`): a label's occurrences meet in one shuffle."""
    own = found.drop("spelled", "same").repartition("doc_id", "kind", "key")  # what follows from the value isn't shuffled
    return pairs_in_groups(compared(own), SUMMARY_KEY if merge else None)


def valued_summary(kind: Column | None = None) -> Column:
    """The summary of a pair of labelled values, with ``kind`` as it begins a sentence."""
    named = F.initcap("kind") if kind is None else kind
    return F.concat(named, F.lit(" conflict for '"), "label", F.lit("': '"), "value_a", F.lit("' (page "), F.col("page_a").cast("string"), F.lit(") vs '"), "value_b", F.lit("' (page "), F.col("page_b").cast("string"), F.lit(")"))


def as_findings(pairs: DataFrame) -> DataFrame:
    """Pairs (:func:`conflict_pairs`) as findings: type, severity, confidence, summary, and where they stand in the order of detection."""
    by_kind = lambda values: reduce(lambda w, kv: w.when(F.col("kind") == kv[0], kv[1]), values[1:], F.when(F.col("kind") == values[0][0], values[0][1]))
    kinds = [k[:3] for k in LABELLED] + [DUTIES]
    valued = valued_summary(by_kind([(k, k.capitalize()) for k, *_ in kinds]))
    duty = F.concat(F.lit("Requirement polarity conflict: '"), F.substring("value_a", 1, 60), F.lit("' vs '"), F.substring("value_b", 1, 60), F.lit("'"))
    at = lambda x: F.struct(F.col(f"chunk_{x}").alias("chunk_index"), F.col(f"match_{x}").alias("match_index"))
    return pairs.select(
        "doc_id", F.col("kind").alias("type"), by_kind([(k, s) for k, _, s in kinds]).alias("severity"), by_kind([(k, c) for k, c, _ in kinds]).alias("confidence"), F.when(F.col("kind") == DUTIES[0], duty).otherwise(valued).alias("summary"),
        F.lit("").alias("explanation"), F.lit(1).alias("page"), by_kind([(k, i) for i, k in enumerate(KINDS)]).alias("source"), at("a").alias("ord_a"), at("b").alias("ord_b"),
    )


def merged(found: DataFrame) -> DataFrame:
    """Findings of the detectors, merged.

    Of findings with the same first 120 characters of the summary, or of the explanation where there is no summary, the first
    stays, in the order of detection (``ord``). ``finding_id`` depends on document and key alone; ``page`` is that which a
    deduction names: 1 for the detectors' findings.
    """
    return named(first_rows(keyed(found), ["doc_id", "key"], ["source", "ord_a", "ord_b", "summary"]))


def keyed(found: DataFrame) -> DataFrame:
    """Findings with ``key``, what equal ones share."""
    said = F.coalesce(F.nullif("summary", F.lit("")), "explanation")
    return found.withColumn("key", F.substring(F.lower(strip(said)), 1, SUMMARY_KEY))


def named(first: DataFrame) -> DataFrame:
    """The findings that stay, with ``finding_id`` and ``ord``."""
    name = F.concat(F.lit("contr-"), F.substring(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "key"), 256), 1, 12))
    return first.select("doc_id", "type", "severity", "confidence", "summary", "explanation", "page", name.alias("finding_id"), F.struct("source", "ord_a", "ord_b", "summary").alias("ord"))


def semantic_findings(semantic: DataFrame) -> DataFrame:
    """``semantic`` conflicts (doc_id, ord, type, severity, confidence, explanation, page_a) as findings with ``key``, of equal ones the first; blank ones go."""
    at = F.struct(F.col("ord").cast("int").alias("chunk_index"), F.lit(0).alias("match_index"))
    none = F.lit(None).cast("string")
    found = semantic.select("doc_id", "type", "severity", "confidence", none.alias("summary"), "explanation", F.coalesce(F.nullif("page_a", F.lit(0)), F.lit(1)).cast("int").alias("page"), F.lit(len(KINDS)).alias("source"), at.alias("ord_a"), at.alias("ord_b"))
    return first_rows(keyed(found).where("key <> ''"), ["doc_id", "key"], ["ord_a", "ord_b"])


def contradictions(chunks: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """The findings of all detectors over ``chunks`` and then ``semantic`` ones, merged (:func:`merged`).

    A summary of labelled values names kind and label within its key, so alike ones belong to one label, and are merged where
    its values meet. Only duties are shuffled by summary. Detected findings come first, so a semantic one can only give way to
    them; one that doesn't begin as theirs do is like none of them, and only documents with others are looked at again.
    """
    valued = named(keyed(as_findings(conflict_pairs(occurrences(chunks, KINDS[:-1]), merge=True))))
    detected = valued.unionByName(merged(as_findings(conflict_pairs(occurrences(chunks, KINDS[-1:])))))
    if semantic is None:
        return detected
    said = materialise(semantic_findings(semantic), "semantic-findings")
    begins = [f"{kind} conflict for '" for kind in KINDS[:-1]] + ["requirement polarity conflict: '"]
    like = said.where(reduce(lambda a, b: a | b, (F.col("key").startswith(b) for b in begins)))
    if not like.isEmpty():
        own = contradictions(chunks.join(like.select("doc_id").distinct(), "doc_id", "left_semi"))
        said = said.join(keyed(own).select("doc_id", "key"), ["doc_id", "key"], "left_anti")
    return detected.unionByName(named(said))


def ambiguities(chunks: DataFrame, most: int = P.MOST_AMBIGUITIES) -> DataFrame:
    """Vague words: the first of each (phrase, page), at most ``most`` a document in the order of chunk, rule and match.

    The phrases don't overlap, so one pattern finds all of them in a pass.
    """
    any_phrase = "|".join(phrase for phrase, *_ in P.AMBIGUITY_RULES)
    rules = F.create_map(*(x for i, (phrase, *rest) in enumerate(P.AMBIGUITY_RULES) for x in (F.lit(phrase), F.struct(F.lit(i).alias("rule"), *(F.lit(v).alias(k) for k, v in zip(("category", "severity", "recommendation"), rest, strict=True))))))
    every = every_match(chunks, WHERE, [Rule(java(rf"\b(?:{any_phrase})\b"))], 0)
    found = every.select("doc_id", "page", "chunk_index", "match_index", F.col("match").alias("phrase"), F.element_at(rules, F.lower("match")).alias("r"))
    found = found.select("doc_id", "page", F.struct("chunk_index", "r.rule", "match_index").alias("ord"), "phrase", "r.category", "r.severity", "r.recommendation")
    found = first_rows(found, ["doc_id", F.lower("phrase"), "page"], ["ord"])
    return found.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).where(F.col("_n") <= most).drop("_n")


#: what every match of a kind's patterns holds in lower case
HELD = {"section": "sec", "clause": "clause", "appendix": "appendix", "figure": "fig", "table": "table", "requirement": "req"}


def scan_rules(chunks: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Matches of several patterns (kind, flags, pattern; one group) in one pass over the table.

    doc_id, page, ord (chunk_index, rule, match_index), kind, match, value (the group, upper case). A pattern that names its
    kind is spared the texts that don't.
    """

    held = lambda kind, pattern: HELD.get(kind, "") if HELD.get(kind, "") in pattern.lower() else ""
    found = every_match(chunks, WHERE, [Rule(java(p, flags), held=held(kind, p)) for kind, flags, p in rules], 1)
    kind = F.get(F.array(*(F.lit(kind) for kind, *_ in rules)), F.col("rule"))
    return found.select("doc_id", "page", F.struct("chunk_index", "rule", "match_index").alias("ord"), kind.alias("kind"), "match", F.upper("g1").alias("value"))


def references(chunks: DataFrame) -> DataFrame:
    """Distinct references with VALID or BROKEN_REFERENCE, as their target is defined in the document or not."""
    uses = [(kind, "i", p) for kind, p in P.REFERENCES.items()]
    target = ["doc_id", "kind", "value"]
    found = scan_rules(chunks, [*uses, *P.DEFINITIONS]).repartition(*target).withColumn("use", F.col("ord.rule") < len(uses))
    # of a target's definitions one is enough; both steps keep the partitioning, and the text is scanned once
    found = first_rows(found, [*target, "use", F.when(F.col("use"), F.lower("match")), F.when(F.col("use"), F.col("page"))], ["ord"])
    known = F.bool_or(~F.col("use")).over(Window.partitionBy(*target))
    used = found.withColumn("known", known).where("use").withColumnRenamed("match", "reference")
    return used.select("doc_id", "reference", F.concat_ws(" ", F.initcap("kind"), "value").alias("target"), "page", F.when(F.col("known"), "VALID").otherwise("BROKEN_REFERENCE").alias("status"), "ord")


def requirement_matrix(chunks: DataFrame) -> DataFrame:
    """Requirements with the pages that define and refer to them; pages that do both count as defining."""
    found = scan(chunks, P.REQUIREMENT, 1, (60, 100))
    lead = F.least("start", F.lit(60))  # what stands before the match in ``around``
    after = F.substring(F.col("around"), lead + F.length("match") + 1, F.lit(5))
    before = F.substring(F.col("around"), lead, F.lit(1))
    prefix = F.when(F.col("match").contains("Functional"), "Functional Requirement").when(F.col("match").contains("Requirement"), "Requirement").otherwise("REQ")
    found = found.select("doc_id", "page", F.struct("chunk_index", "match_index").alias("ord"), F.concat_ws(" ", prefix, "g1").alias("requirement_id"), (after.rlike(r"(?U)^\s*[:\-]") | (F.col("start") == 0) | (before == "\n")).alias("defines"), strip(one_line("around")).alias("around"))
    page_if = lambda c: F.sort_array(F.collect_set(F.when(c, F.col("page"))))
    grouped = found.groupBy("doc_id", "requirement_id").agg(page_if(F.col("defines")).alias("definition_pages"), page_if(~F.col("defines")).alias("mentioned"), F.min(F.struct((~F.col("defines")).alias("later"), "ord", "around")).alias("best"))
    refs = F.array_except("mentioned", "definition_pages")
    status = F.when(F.size("definition_pages") == 0, F.when(F.size(refs) > 0, "MISSING").otherwise("REFERENCED")).otherwise(F.when(F.size(refs) > 0, "DEFINED").otherwise("ORPHANED"))
    return grouped.select("doc_id", "requirement_id", status.alias("status"), "definition_pages", refs.alias("reference_pages"), truncated(F.col("best.around"), 200).alias("description"))


def placeholders(chunks: DataFrame) -> DataFrame:
    """Distinct (placeholder, page)."""
    every = every_match(chunks, WHERE, [Rule(java(P.PLACEHOLDER))], 0)
    found = every.select("doc_id", "page", "match", F.struct("chunk_index", "match_index").alias("ord"))
    return first_rows(found, ["doc_id", F.lower("match"), "page"], ["ord"]).select("doc_id", "page", F.col("match").alias("placeholder"))


def banded(column: str, points: dict[str, float], other: str) -> Column:
    """Points by lower-case severity; those of ``other`` where it is unknown."""
    found = F.lower(F.coalesce(F.col(column), F.lit(other)))
    return reduce(lambda w, kv: w.when(found == kv[0], kv[1]), points.items(), F.when(F.lit(False), 0.0)).otherwise(points[other])


def deductions(chunks: DataFrame, conflicts: DataFrame, refs: DataFrame, requirements: DataFrame, entity_conflicts: DataFrame, vague: DataFrame) -> DataFrame:
    """doc_id, component, points, evidence, page, finding_id: a row for each thing that lowers a score."""
    first_page = lambda c: F.coalesce(F.get(F.col(c), F.lit(0)), F.lit(1)).cast("int")
    name = [c for c, _, _ in P.COMPONENTS]
    text = lambda *parts: F.concat(*(F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts))
    row = lambda frame, i, points, evidence, page, found: frame.select("doc_id", F.lit(name[i]).alias("component"), points.cast("double").alias("points"), evidence.alias("evidence"), page.cast("int").alias("page"), text(*found).alias("finding_id"))
    c = F.col
    said = F.coalesce(F.nullif("summary", F.lit("")), "type")
    return reduce(
        DataFrame.unionByName,
        [
            row(conflicts, 0, banded("severity", P.CONFLICT_POINTS, "medium"), text("Semantic conflict (", F.lower("severity"), "): '", said, "'"), c("page"), [c("finding_id")]),
            row(refs.where("status = 'BROKEN_REFERENCE'"), 1, F.lit(P.REFERENCE_POINTS), text("Broken reference: '", c("reference"), "' → target '", c("target"), "' not found"), c("page"), ["ref-", c("reference"), "-", c("page")]),
            row(requirements.where("status = 'MISSING'"), 2, F.lit(P.REQUIREMENT_POINTS["MISSING"]), text("Requirement '", c("requirement_id"), "' referenced but never defined"), first_page("reference_pages"), ["req-missing-", c("requirement_id")]),
            row(requirements.where("status = 'ORPHANED'"), 2, F.lit(P.REQUIREMENT_POINTS["ORPHANED"]), text("Requirement '", c("requirement_id"), "' defined but never referenced (orphaned)"), first_page("definition_pages"), ["req-orphaned-", c("requirement_id")]),
            row(entity_conflicts, 3, banded("severity", P.ENTITY_POINTS, "medium"), text("Conflicting values for entity '", c("entity"), "': '", c("value_a"), "' vs '", c("value_b"), "'"), first_page("pages"), ["ent-conflict-", c("entity")]),
            row(vague, 4, banded("severity", P.AMBIGUITY_POINTS, "low"), text("Ambiguous term '", c("phrase"), "' (", c("category"), ") — ", c("recommendation")), c("page"), ["amb-", c("phrase"), "-", c("page")]),
            row(placeholders(chunks), 5, F.lit(P.PLACEHOLDER_POINTS), text("Unresolved placeholder: '", c("placeholder"), "' on page ", c("page")), c("page"), ["comp-", c("placeholder"), "-", c("page")]),
        ],
    )


def trust_scores(chunks: DataFrame, lost: DataFrame) -> DataFrame:
    """A row for each document: score, confidence, the six components, and the number of deductions."""
    sums = lost.groupBy("doc_id").agg(*(F.sum(F.when(F.col("component") == c, F.col("points")).otherwise(0.0)).alias(k) for c, k, _ in P.COMPONENTS), F.count(F.lit(1)).alias("n_deductions"))
    sizes = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    parts = {k: F.greatest(F.lit(0.0), 100.0 - F.coalesce(F.col(k), F.lit(0.0))) for _, k, _ in P.COMPONENTS}
    joined = sizes.join(sums, "doc_id", "left").select("doc_id", "n_chunks", F.coalesce("n_deductions", F.lit(0)).alias("n_deductions"), *(v.alias(k) for k, v in parts.items()))
    total = reduce(lambda a, b: a + b, (w * F.col(k) for _, k, w in P.COMPONENTS))
    hit = reduce(lambda a, b: a + b, (F.when(F.col(k) < 100, 1).otherwise(0) for _, k, _ in P.COMPONENTS))
    sure = F.least(F.lit(0.98), F.bround(0.70 + 0.20 * F.least(F.lit(1.0), F.greatest(F.lit(1), F.col("n_chunks")) / 20.0) + 0.10 * hit / 6.0, 3))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(total, 2)))
    whole = lambda i: F.bround(P.COMPONENTS[i][1], 0).cast("int")
    evidence = F.format_string("Trust score computed from %d chunks across 6 dimensions. Breakdown — Contradictions: %d%%, References: %d%%, Requirements: %d%%, Entities: %d%%, Ambiguity: %d%%, Completeness: %d%%. Total deductions: %d.", "n_chunks", *(whole(i) for i in range(6)), "n_deductions")
    return joined.select("doc_id", score.alias("score"), sure.alias("confidence"), *(F.bround(k, 2).alias(k) for _, k, _ in P.COMPONENTS), "n_deductions", "n_chunks", evidence.alias("evidence"))
