"""Pairs, prompts, replies and reports, with expected values written out."""

from pyspark.sql import functions as F

from pagemill.operators import audit, entities, pairs, workspace

CHUNK = "doc_id long, page int, chunk_index int, text string"


def test_monetary_conflict(spark):
    chunks = spark.createDataFrame([(1, 1, 0, "The unit budget is $500 now"), (1, 3, 1, "The unit budget is $900 now")], CHUNK)
    row = audit.money_conflicts(chunks).first()
    assert (row.type, row.severity, row.confidence) == ("monetary", "high", 0.95)
    assert row.summary.startswith("Monetary conflict for '") and row.summary.endswith("(page 1) vs '$900' (page 3)")


def test_replies_and_scores(spark):
    rows = [
        (1, 1, '```json\n{"summary": "s", "confidence": 0.9, "contradiction_strength": 0.7, "is_contradiction": true}\n```', 0.6),
        (1, 2, 'Result: {"is_contradiction": true}', None),
        (1, 3, '{"confidence": 0.9, "is_contradiction": false}', 0.5),
        (1, 4, "none", 0.5),
        (1, 5, "{broken", 0.5),
        (1, 6, "{not json}", 0.5),
        (1, None, None, None),
    ]
    parsed = pairs.parse_replies(spark.createDataFrame(rows, "doc_id long, reply_id int, reply string, similarity double"))
    assert {r.reply_id for r in parsed.where("ok").collect()} == {1, 2, 3}
    found = {r.reply_id: (r.summary, r.score, r.severity) for r in pairs.score_contradictions(parsed).collect()}
    assert found == {1: ("s", 0.76, "high"), 2: ("Contradiction detected", 0.74, "high"), 3: ("Contradiction detected", 0.78, "high")}
    found = {r.reply_id: (r.score, r.severity) for r in pairs.score_semantic_conflicts(parsed).collect()}
    assert found == {1: (0.75, "high"), 2: (0.675, "high")}


def test_nested_findings(spark):
    reply = '{"contradictions": [{"conflictingStatements": [{"text": "a", "page": 1}, {"text": "b"}], "confidence": 0.6}, {"conflictingStatements": [{"text": "alone"}]}, {"summary": "x", "type": "date", "conflictingStatements": [{"text": "c"}, {"text": "d"}, {"text": "e"}]}]}'
    rows = pairs.nested_findings(spark.createDataFrame([(7, 1, reply), (7, 2, "{}"), (8, 1, "no")], "doc_id long, reply_id int, reply string")).orderBy("finding").collect()
    assert [(r.finding, r.type, r.summary, r.confidence, r.contradiction_strength, len(r.statements)) for r in rows] == [(0, "statement", "Contradiction detected", 0.6, 0.8, 2), (2, "date", "x", 0.8, 0.8, 3)]
    vectors = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 1.0]), (2, [0.0, 0.0], [1.0, 1.0]), (3, None, [1.0])], "k int, a array<double>, b array<double>")
    assert [round(r.similarity, 6) for r in pairs.statement_similarity(vectors, vectors.a, vectors.b).orderBy("k").collect()] == [0.707107, 0.5, 0.5]


def test_quotes(spark):
    chunks = spark.createDataFrame([(1, 4, 0, "x" * 450 + " Needle"), (1, 5, 1, "needle again")], CHUNK)
    quotes = spark.createDataFrame([(1, 1, " NEEDLE ", 9), (1, 2, "absent", 9), (1, 3, None, 9)], "doc_id long, quote_id int, quote string, page int")
    found = {r.quote_id: (r.page, r.snippet, r.score) for r in pairs.resolve_quotes(quotes, chunks).collect()}
    assert found == {1: (4, "x" * 400, 1.0), 2: (9, "absent", 0.5), 3: (9, None, 0.5)}


def test_prompt_batches(spark):
    rows = [(1, i, i + 1, text) for i, text in enumerate(["aa", "bb", "c" * 9, "d" * 30, "e"])]
    out = pairs.prompt_batches(spark.createDataFrame(rows, "doc_id long, ord int, page int, text string"), most_chars=13, most_segments=2).orderBy("batch").collect()
    assert out[0].prompt == "[Segment - Page 1 / Chunk 0]\naa\n\n---\n\n[Segment - Page 2 / Chunk 1]\nbb"
    assert [(r.batch, r.n_segments, r.chars) for r in out] == [(0, 2, 4), (1, 1, 9), (2, 1, 30), (3, 1, 1)]


def test_detection_order_and_graph(spark):
    chunks = spark.createDataFrame([(1, 1, 0, "The zeta limit is 5%. The alpha limit is 7%."), (1, 2, 1, "The zeta limit is 6%. The alpha limit is 8%.")], CHUNK)
    found = [r.summary for r in audit.contradictions(chunks).orderBy("ord").collect()]
    assert len(found) == 2 and "zeta" in found[0] and "alpha" in found[1], found
    rows = [(1, 1, "Acme", "ORG", 0.9, 1, "s", "Bolt"), (1, 2, "Acme", "ORG", 0.9, 2, "t", " acme ")]
    merged = entities.merge_entities(spark.createDataFrame(rows, "doc_id long, ord int, text string, type string, confidence double, page int, snippet string, related string"))
    assert [tuple(r) for r in entities.entity_graph(merged).collect()] == [(1, "acme", "bolt")]
    rows = [(1, 1, "Fee", "MONEY", 0.9, 1, "pays $9 million, later $2 million", None), (1, 2, "fee", "MONEY", 0.9, 2, "pays $2 million", None)]
    merged = entities.merge_entities(spark.createDataFrame(rows, "doc_id long, ord int, text string, type string, confidence double, page int, snippet string, related string"))
    row = entities.mention_conflicts(merged).first()
    assert (row.value_a, row.value_b, row.pages, row.confidence, row.severity) == ("$9 m", "$2 m", [1, 2], 0.8, "medium")


def test_failed_keeps_its_progress(spark):
    rows = [(1, "QUEUED", 1), (1, "CHUNKING", 2), (1, "FAILED", 3), (2, "FAILED", 1), (3, "COMPLETED", 5), (3, "QUEUED", 4)]
    changes = spark.createDataFrame(rows, "document_id long, status string, s long").select("document_id", "status", F.timestamp_seconds("s").alias("ts"))
    assert sorted(tuple(r) for r in workspace.latest_status(changes).collect()) == [(1, "FAILED", 45, 2), (2, "FAILED", None, 0), (3, "COMPLETED", 100, 1)]
    said = spark.createDataFrame([(1, k, "user" if k % 2 else "tool", "t") for k in range(14)], "session_id long, turn int, role string, text string")
    out = workspace.recent_messages(said, current=said.where("turn = 13").select("session_id", "turn")).orderBy("position").collect()
    assert [(r.turn, r.position) for r in out] == [(3, 1), (5, 2), (7, 3), (9, 4), (11, 5)]


def test_limits():
    assert [workspace.limits(t) for t in ("heavy", "upload", "chat", "analysis", "standard", "other")] == [(10, 60), (50, 86400), (1000, 86400), (20, 3600), (100, 60), (100, 60)]


def test_similarity_pairs_by_slices(spark):
    """Slices of any size give the pairs of a plain double loop, ties and zero vectors included."""
    import numpy as np

    rng = np.random.default_rng(5)
    docs = {1: rng.integers(-2, 3, (37, 4)).astype(float), 2: rng.standard_normal((3, 4)), 3: rng.standard_normal((1, 4))}
    rows = [(d, 10 * k, v.tolist()) for d, m in docs.items() for k, v in enumerate(m)] + [(1, 5, None)]
    frame = spark.createDataFrame(rows, "doc_id long, ord long, vector array<double>").repartition(3)
    want = []
    for d, m in docs.items():
        length = np.linalg.norm(m, axis=1, keepdims=True)
        unit = m / np.where(length == 0, 1, length)
        found = [(round(abs(s - 0.55), 6), 10 * i, 10 * j, s) for i in range(len(m)) for j in range(i + 1, len(m)) if 0.2 <= (s := round(float(unit[i] @ unit[j]), 6)) <= 0.85]
        want += [(d, k + 1, a, b, s) for k, (_, a, b, s) in enumerate(sorted(found)[:40])]
    assert len([w for w in want if w[0] == 1]) == 40
    for size in (4, 256):
        out = pairs.similarity_pairs(frame, 0.20, 0.85, 0.55, most=40, slice_rows=size)
        assert sorted((r.doc_id, r.rank, r.a, r.b, round(r.similarity, 6)) for r in out.collect()) == sorted(want)
    assert pairs.similarity_pairs(frame.limit(0), 0.2, 0.85, 0.55).count() == 0


FACT = "doc_id long, ord int, subject string, predicate string, value string, page int, confidence double, evidence string, fact_type string, chunk_index int"


def test_heuristic_pairs_and_semantic_conflicts(spark):
    rows = [(1, k, " Budget " if k % 2 else "budget", "is", f"${k}", k, 0.9, "e", "", 0) for k in range(1, 12)] + [(1, 20, "Other", "is", "1", 1, 0.9, "e", "", 0), (2, 1, None, "is", "a", 1, 0.9, "e", "", 0), (2, 2, "", "is", "", 2, 0.9, "e", "", 0)]
    facts = spark.createDataFrame(rows, FACT)
    candidates = pairs.fact_pair_heuristic(facts)
    out = [(r.doc_id, r.rank, r.a, r.b) for r in candidates.orderBy("doc_id", "rank").collect()]
    assert out[:41] == [(1, k + 1, a, b) for k, (a, b) in enumerate([(a, b) for a in range(1, 12) for b in range(a + 1, 12)][:40])] + [(2, 1, 1, 2)] and len(out) == 41
    yes = '```json {"is_contradiction": true, "confidence": 0.9, "conflict_type": "numeric", "explanation": "Two budgets."}```'
    replies = spark.createDataFrame([(1, 1, 2, yes), (1, 1, 3, '{"is_contradiction": true}'), (1, 1, 4, '{"is_contradiction": false}'), (1, 1, 5, "no"), (1, 1, 6, None)], "doc_id long, a int, b int, reply string")
    found = {r.ord: r for r in pairs.semantic_conflicts(candidates, facts, replies).collect()}
    assert set(found) == {1, 2}
    first, second = found[1], found[2]
    # 0.5 * 0.9 + 0.3 * 0.45 + 0.2 * 0.9, and 0.5 * 0.75 + 0.3 * 0.45 + 0.2 * 0.75
    assert (first.conflict_score, first.severity, first.type, first.explanation) == (0.765, "high", "numeric", "Two budgets.")
    assert (second.conflict_score, second.severity, second.type, second.explanation, second.confidence) == (0.66, "high", "logical", "", 0.75)
    assert (first.statement_a, first.page_a, first.page_b, first.semantic_distance) == (" Budget  is $1", 1, 2, 0.45) and first.id.startswith("sconf-")
    chunks = spark.createDataFrame([(1, 1, 0, "The zeta limit is 5%."), (1, 2, 1, "The zeta limit is 6%.")], CHUNK)
    merged = audit.contradictions(chunks, pairs.semantic_conflicts(candidates, facts, replies)).orderBy("ord").collect()
    assert [(r.type, r.summary is None, r.explanation, r.page) for r in merged] == [("numerical", False, "", 1), ("numeric", True, "Two budgets.", 1)]
    lost = audit.deductions(chunks, audit.contradictions(chunks, pairs.semantic_conflicts(candidates, facts, replies)), audit.references(chunks), audit.requirement_matrix(chunks), entities.entity_conflicts(facts.limit(0), entities.merge_entities(spark.createDataFrame([], "doc_id long, ord int, text string, type string, confidence double, page int, snippet string, related string"))), audit.ambiguities(chunks))
    said = {r.evidence: (r.points, r.page, r.finding_id[:6]) for r in lost.collect()}
    assert said["Semantic conflict (high): 'numeric'"] == (12.0, 1, "contr-") and len(said) == 2


def test_semantic_findings_stay_in_their_order(spark):
    given = [(1, 2, "b", "low", 0.5, "Same words", 3), (1, 1, "z", "high", 0.6, " same WORDS ", 0), (1, 3, "c", "low", 0.5, "", 3), (1, 4, "d", "low", 0.5, None, 3)]
    semantic = spark.createDataFrame(given, "doc_id long, ord int, type string, severity string, confidence double, explanation string, page_a int")
    out = audit.contradictions(spark.createDataFrame([], CHUNK), semantic).collect()
    assert [(r.type, r.severity, r.page) for r in out] == [("z", "high", 1)]


def test_contradiction_findings(spark):
    chunks = spark.createDataFrame([(1, 4, 0, "Alpha says Yes. " + "x" * 500), (1, 9, 1, "Beta says no. alpha"), (2, 3, 0, "gamma")], CHUNK)
    item = lambda summary, a, b, more="": f'{{"summary": "{summary}", "conflictingStatements": [{{"text": "{a}", "page": 70}}, {{"text": "{b}", "page": 71}}]{more}}}'
    reply = '{"contradictions": [' + ", ".join([item("One", " alpha SAYS yes ", "beta says no", ', "confidence": 0.9, "contradiction_strength": 0.7, "explanation": "why", "type": "date"'), item(" one ", "x", "y"), item("Two", "alpha", "absent"), '{"summary": "Alone", "conflictingStatements": [{"text": "a"}]}']) + "]}"
    replies = spark.createDataFrame([(1, 1, 0, 1, reply), (2, 1, 0, 0, '{"contradictions": [' + item("Self", "gamma", "") + "]}"), (1, 2, 0, 1, item("no list", "a", "b"))], "doc_id long, reply_id int, a int, b int, reply string")
    same = lambda t: F.array(F.lit(1.0), F.lit(0.0))
    out = {(r.doc_id, r.summary): r for r in pairs.contradiction_findings(replies, chunks, spark.createDataFrame([(1, "Deed")], "doc_id long, name string"), same).collect()}
    assert set(out) == {(1, "One"), (1, "Two"), (2, "Self")}
    one = out[1, "One"]
    # 0.4 * 0.9 + 0.4 * 0.7 + 0.2 * 1, and 0.8, 0.8 and 1
    assert (one.score, one.severity, one.type, one.explanation, one.confidence) == (0.84, "high", "date", "why", 0.9)
    assert [(c.text, c.page, c.document, c.snippet, c.score) for c in one.citations] == [(" alpha SAYS yes ", 4, "Deed", ("Alpha says Yes. " + "x" * 500)[:400], 1.0), ("beta says no", 9, "Deed", "Beta says no. alpha", 1.0)]
    assert [(c.page, c.snippet[:6], c.score) for c in out[1, "Two"].citations] == [(4, "Alpha ", 1.0), (71, "absent", 0.5)]
    assert (out[1, "Two"].score, out[1, "Two"].severity) == (0.84, "high")
    assert [(c.page, c.document, c.score) for c in out[2, "Self"].citations] == [(3, "Document", 1.0), (3, "Document", 1.0)]


def test_facts_with_type_and_chunk(spark):
    rows = [(1, 1, "A", "p", "v", 2, 0.6, "first", "", 4), (1, 2, " a", "P", "V ", 3, 0.9, "second", "numerical", 5), (1, 3, "B", "p", "v", 0, None, None, None, None)]
    out = {r.subject: r for r in entities.shape_facts(entities.dedupe_facts(spark.createDataFrame(rows, FACT))).collect()}
    assert (out["a"].type, out["a"].chunk_id, out["a"].evidence, out["a"].page, out["a"].confidence) == ("numerical", "chunk-4", "first", 3, 0.9)
    assert (out["B"].type, out["B"].chunk_id, out["B"].evidence, out["B"].page, out["B"].confidence) == ("definitional", "chunk-0", "", 1, 0.7)


def test_mentions_on_one_page_stay_in_order(spark):
    rows = [(1, 1, "Fee", "MONEY", 0.5, 2, "pays $9", None), (1, 2, "Fee", "MONEY", 0.7, 1, "pays $8", None), (1, 3, "fee", "MONEY", 0.6, 1, "owes $7", None), (1, 4, "fee", "MONEY", 0.6, 1, "pays $8", "x")]
    merged = entities.merge_entities(spark.createDataFrame(rows, "doc_id long, ord int, text string, type string, confidence double, page int, snippet string, related string"))
    row = merged.first()
    assert [(m.page, m.snippet) for m in row.mentions] == [(1, "pays $8"), (1, "owes $7"), (2, "pays $9")] and (row.entity, row.confidence, row.related) == ("Fee", 0.7, ["x"])
    assert (entities.mention_conflicts(merged).first().value_a, entities.mention_conflicts(merged).first().value_b) == ("$8", "$7")


def test_prompt_batches_many_documents(spark):
    """Documents share calls into Python: no group of them is a call; null texts count as empty."""
    from pagemill.operators.pairs import prompt_batches

    rows = spark.range(2000).selectExpr("id as doc_id", "1 as ord", "2 as page", "if(id = 5, null, 'x') as text")
    made = prompt_batches(rows)
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.doc_id, r.batch, r.n_segments, r.chars) for r in made.where("doc_id in (4, 5)").collect()} == {(4, 0, 1, 1), (5, 0, 1, 0)}
    assert made.count() == 2000
