import pytest
from pyspark.sql import functions as F

from pagemill.functions import patterns
from pagemill.functions.scan import found, java, matches, re2
from pagemill.operators import audit, entities

SCHEMA = "doc_id long, page int, chunk_index int, text string"


@pytest.fixture(scope="module")
def frame(spark):
    return lambda rows: spark.createDataFrame([(1, page, i, text) for i, (page, text) in enumerate(rows)], SCHEMA)


def test_references(frame):
    found = audit.references(frame([(1, "Please look at Section 3.2 now. Also see Section 4.5."), (2, "Section 3.2 Setup Guidelines\nText")])).collect()
    assert sorted(r.status for r in found) == ["BROKEN_REFERENCE", "VALID", "VALID"]
    assert {r.reference for r in found if r.status == "BROKEN_REFERENCE"} == {"Section 4.5"}


def test_requirements(frame):
    found = audit.requirement_matrix(frame([(1, "REQ-1: first."), (2, "REQ-2 - second."), (3, "These satisfy REQ-1 and also REQ-3.")])).collect()
    assert {r.requirement_id: r.status for r in found} == {"REQ 1": "DEFINED", "REQ 2": "ORPHANED", "REQ 3": "MISSING"}


def test_conflicts(frame):
    found = audit.numeric_conflicts(frame([(1, "The latency is 150ms."), (2, "The latency is 350ms under load."), (2, "The latency is 150ms.")])).collect()
    assert [(r.value_a, r.page_a, r.value_b, r.page_b) for r in found] == [("150ms", 1, "350ms", 2)]
    found = audit.polarity_conflicts(frame([(1, "The system shall encrypt all data."), (2, "The system shall not encrypt all data.")])).collect()
    assert [(r.page_a, r.page_b, r.severity) for r in found] == [(1, 2, "critical")]


def test_entity_conflict(spark):
    facts = spark.createDataFrame([(1, 1, "Budget", "amount", "$50,000", 1, 0.9, "a"), (1, 2, "budget", "Amount", "$75,000", 3, 0.8, "b"), (1, 3, "Budget", "amount", "50000", 4, 0.8, "c")], "doc_id long, ord int, subject string, predicate string, value string, page int, confidence double, evidence string")
    found = entities.fact_conflicts(facts).where("value_b = '$75,000' or value_a = '$75,000'").collect()
    assert (found[0].pages, found[0].confidence, found[0].severity) == ([1, 3], 0.8, "medium")
    assert len(found) == 2


def test_trust_score(frame, spark):
    chunks = frame([(1, "TODO soon Section 9.")])
    # one finding of each kind: high conflict, broken reference, missing requirement, medium clash, medium vague word, a placeholder
    conflicts = spark.createDataFrame([(1, "numerical", "high", 0.9, "s", 4, "contr-1")], "doc_id long, type string, severity string, confidence double, summary string, page int, finding_id string")
    refs = audit.references(chunks)
    requirements = spark.createDataFrame([(1, "REQ 3", "MISSING", [], [3])], "doc_id long, requirement_id string, status string, definition_pages array<int>, reference_pages array<int>")
    clash = spark.createDataFrame([(1, "Budget", "a", "b", [1, 3], "medium")], "doc_id long, entity string, value_a string, value_b string, pages array<int>, severity string")
    lost = audit.deductions(chunks, conflicts, refs, requirements, clash, audit.ambiguities(chunks))
    assert lost.count() == 6
    row = audit.trust_scores(chunks, lost).first()
    assert [row[k] for k in ("contradiction_health", "reference_integrity", "requirement_traceability", "entity_consistency", "ambiguity_analysis", "document_completeness")] == [88, 92, 88, 92, 96, 92]
    assert (row.score, row.confidence) == (90.4, 0.81)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert audit.contradictions(empty).count() == 0 and audit.references(empty).count() == 0


def test_patterns_are_spared_no_text_that_they_match(spark):
    """With the words of all kinds behind it, no text is spared a pattern; its matches stay the same."""
    texts = ["\u017fection 3.1", "See SEC. 4 and \u017fec. 5.", "f\u0131gure 2: f\u0130g. 3", "Clau\u017fe 4.1", "append\u0131x B", "\u212a Table 7 - tables", "REQ-12: re\u0071 3", "1.2 Scope\n 2.3 Next", "none of it", "", None]
    frame = lambda more: spark.createDataFrame([(1, 1, i, None if x is None else x + more) for i, x in enumerate(texts)], "doc_id long, page int, chunk_index int, text string")
    rules = [*((kind, "i", p) for kind, p in patterns.REFERENCES.items()), *patterns.DEFINITIONS]
    rows = lambda more: sorted((tuple(r.ord), r.kind, r.match, r.value) for r in audit.scan_rules(frame(more), rules).collect())
    found = rows("")
    assert found == rows("\n. table req section figure clause appendix.")
    assert {m for _, _, m, _ in found} >= {"\u017fection 3.1", "\u017fec. 5", "f\u0131gure 2", "f\u0130g. 3", "Clau\u017fe 4.1", "Table 7", "1.2 S"}


def test_scans_skip_no_match(spark):
    """Labels at the ends of what a search skips: the same matches as without skipping, and a run without one is left at once."""
    run = "x" * 39
    texts = ["The rate is 5 s. Plain words go on and on for long and hold no number at all. The rate is 6", f"a{run} is 7", f"b a{run} is 7", f"{run} {run} {run} is 8, so", "1 rate\nis 5", "rate - _ -is 5 is 6", "ſize of Kits is 9 GB", "rate is 5 rate is 6\nis 7"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for pattern in (patterns.NUMERIC, patterns.DATE, patterns.MONEY):
        for scan in (found, matches):
            plain, skipping = (scan(F.col("text"), java(pattern), 2, *skip) for skip in ((), (patterns.NO_LABEL,)))
            for row in frame.select("text", plain.alias("plain"), skipping.alias("skipping")).collect():
                assert row.plain == row.skipping, row.text
    gaps = F.split(F.regexp_replace(F.lit('Plain words without numbers. More'), java(patterns.NO_LABEL), '#'), ' ')
    assert spark.range(1).select(gaps.alias('g')).first().g == ['#.', '#']


def test_ascii_texts_are_searched_by_re2(spark):
    """Both engines find the same: each text is searched as it is, by RE2, and with a letter behind it that sends it to Java's."""
    texts = ["Section 3.1 Terms\nThe discount is 5%. The unit budget is $1,204. The ship\x0bdate is 1994-02-03. The system shall not encrypt class A data. REQ-1: holds. See Section 4.1. It may change soon. TODO", "SEC. 4\r\n\tfigure 2: a\x1cReq 3\x1f REQ 4 -\n\n 2.3 Next", "The rate\x1cis 5 s, due Q1 2024; as needed [insert name] __ TBD", "a\x01b\x02 is 7 GB", "", "the service must log  in-out and will not log out"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    patterns_ = [(p, "i", 2) for p in (patterns.NUMERIC, patterns.DATE, patterns.MONEY, patterns.POSITIVE, patterns.NEGATIVE)] + [(p, flags, 1) for _, flags, p in patterns.DEFINITIONS] + [(p, "i", 1) for p in (*patterns.REFERENCES.values(), patterns.REQUIREMENT)] + [(patterns.PLACEHOLDER, "i", 0)]
    some = 0
    for pattern, flags, groups in patterns_:
        assert re2(java(pattern, flags)) is not None, pattern
        for scan in (found, matches):
            by = lambda text: scan(text, java(pattern, flags), groups)  # noqa: B023, E731
            for row in frame.select("text", by(F.col("text")).alias("ascii"), by(F.concat("text", F.lit("#\u00e9"))).alias("other")).collect():
                assert row.ascii == row.other, (pattern, row.text)
                some += len(row.ascii)
        plan = frame.select(found(F.col("text"), java(pattern, flags), groups))._jdf.queryExecution().toString()
        assert "ArrowEvalPython" in plan
    assert some > 50
    for other in (r"a$", r"(?=a)b", r"a++", r"[a&&b]", r"\p{L}", r"\S", r"[a[b]]", "\u00e9", r"(a)\1"):
        assert re2(java(other)) is None, other


def test_findings_that_differ_are_merged_without_meeting(frame):
    """Values so long that summaries are alike in their first characters are merged, as are duties; others aren't shuffled by summary."""
    long = "1" * 60
    chunks = frame([(1, f"The rate is {long}1. The size is 5 GB."), (2, f"The rate is {long}2. The size is 6 GB."), (3, f"The rate is {long}3. The SIZE is 5 gb."), (4, "The size is 7 GB.")])
    found = audit.contradictions(chunks)
    whole = audit.merged(audit.as_findings(audit.conflict_pairs(audit.occurrences(chunks))))
    rows = lambda f: sorted(map(tuple, f.collect()))
    assert rows(found) == rows(whole)
    assert [r.summary[:30] for r in found.orderBy("ord").collect()].count("Numerical conflict for 'The ra") == 2
    assert audit.conflict_pairs(audit.occurrences(chunks)).count() == 3 + 5
    taking = audit.taking_part(audit.occurrences(chunks)).where("kind = 'numerical'").groupBy("key").agg(F.bool_or("wide").alias("wide"), F.bool_and("wide").alias("all"))
    assert {r.key: (r.wide, r.all) for r in taking.collect()} == {"the rate": (True, True), "the size": (False, False)}


def test_findings_read_twice_are_written_once(spark):
    from pagemill.plans.audit_queries import findings

    found = findings(spark, "/root/testdata/sf0.001", reread=True)
    for name in ("contradictions", "references", "requirements", "entity_conflicts", "ambiguities"):
        assert all(f"/{name.replace('_', '-')}-" in f for f in found[name].inputFiles()), name


def test_fact_conflicts_read_facts_once(spark):
    """The facts that both sides of the join read are found once."""
    rows = [(1, 1, "a", "price", "$1,000", 1, 0.9), (1, 2, " A ", "Price", "1000", 2, 0.9), (1, 3, "a", "price", "2000", 3, 0.7), (1, 4, "a", "price", "2000 ", 4, 0.9)]
    facts = spark.createDataFrame(rows, "doc_id long, ord int, subject string, predicate string, value string, page int, confidence double")
    found = entities.fact_conflicts(facts)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Window") == 0
    assert sorted((r.value_a, r.value_b, r.pages, r.severity) for r in found.collect()) == [("$1,000", "2000", [1, 3], "medium"), ("1000", "2000", [2, 3], "medium")]
