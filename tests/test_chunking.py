import random

from pagemill.operators.chunking import chunk_documents, orbit
from pagemill.operators.workspace import rate_limit


def plain(tokens, size, overlap):
    """Chunks by looking at every sentence anew."""
    out, first, n = [], 0, len(tokens)
    while first < n:
        end = first + 1
        while end < n and sum(tokens[first : end + 1]) <= size:
            end += 1
        out.append((first, end))
        if end == n:
            break
        starts = [c for c in range(first + 1, end) if sum(tokens[c:end]) <= overlap]
        after = starts[0] if starts else end - 1 if overlap > 0 and end - 1 > first else end
        first = max(first + 1, after)
    return out


def test_orbit():
    rng = random.Random(3)
    for _ in range(500):
        tokens = [rng.randint(1, 12) for _ in range(rng.randint(0, 25))]
        size, overlap = rng.randint(1, 30), rng.randint(0, 12)
        assert orbit(tokens, size, overlap) == plain(tokens, size, overlap)


def test_chunks(spark):
    pages = spark.createDataFrame([(1, 1, "a" * 400), (2, 1, None), (3, 1, "One. Two.")], "doc_id long, page int, text string")
    rows = {r.doc_id: r for r in chunk_documents(pages, 5, 1).collect()}
    assert set(rows) == {1, 3} and rows[1].n_sentences == 1 and rows[3].text == "One.\n\nTwo." and rows[3].chunk_id == "3-chk-0"
    assert chunk_documents(pages.where("doc_id = 9")).count() == 0


def test_rate_limit(spark):
    asked = spark.createDataFrame([(1, f"2024-01-01 00:00:{i:02d}") for i in range(11)], "key long, ts string").selectExpr("key", "cast(ts as timestamp) as ts")
    rows = rate_limit(asked, 10, 60).orderBy("ts").collect()
    assert [r.admitted for r in rows] == [True] * 10 + [False] and rows[4].remaining == 5 and rows[4].reset == 60


def test_chunk_offsets_and_tokenizer(spark):
    from pyspark.sql import functions as F

    from pagemill.operators.chunking import chunk_documents

    pages = [(1, 1, "  One two.   Three four! \n Five?"), (1, 2, "Six seven. Eight."), (2, 1, None), (3, 1, "")]
    frame = spark.createDataFrame(pages, "doc_id long, page int, text string")
    words = lambda t: F.size(F.split(t, " "))
    out = [(r.chunk_index, r.page, r.token_count, r.text, r.start_char, r.end_char) for r in chunk_documents(frame, 4, 0, words).orderBy("chunk_index").collect()]
    flat = "\n\n".join(t for _, _, t in pages[:2])
    assert [flat[a:b] for *_, a, b in out] == ["One two.   Three four!", "Five?\n\nSix seven. Eight."]
    assert [(i, p, n, t) for i, p, n, t, *_ in out] == [(0, 1, 4, "One two.\n\nThree four!"), (1, 2, 4, "Five?\n\nSix seven.\n\nEight.")]


def test_scoped_search(spark):
    from pagemill.operators.retrieval import dense_search

    chunks = spark.createDataFrame([("c1", 1, 1, "a", [1.0, 0.0]), ("c0", 1, 1, "a", [1.0, 0.0]), ("c2", 2, 1, "b", [0.6, 0.8]), ("c3", 3, 1, "c", None)], "chunk_id string, doc_id long, page int, text string, vector array<double>")
    queries = spark.createDataFrame([(7, "q", [1.0, 0.0]), (8, "q", [1.0, 0.0]), (9, "q", None)], "query_id int, text string, vector array<double>")
    scope = spark.createDataFrame([(8, 2)], "query_id int, doc_id long")
    rows = lambda **o: sorted((r.query_id, r.rank, r.chunk_id, r.similarity) for r in dense_search(queries, chunks, 2, **o).collect())
    assert rows(scope=scope, block=1) == [(7, 1, "c0", 1.0), (7, 2, "c1", 1.0), (8, 1, "c2", 0.6)]
    assert rows(allowed={"doc_id": [2]}) == [(7, 1, "c2", 0.6), (8, 1, "c2", 0.6)]
    assert dense_search(queries.limit(0), chunks).count() == 0 and dense_search(queries, chunks.limit(0)).count() == 0


def test_scope_of_many_documents_goes_with_the_chunks(spark):
    """Scopes reach a task with its chunks, block by block of queries: what is sent with the code doesn't grow with them."""
    from pagemill.operators import retrieval

    chunks = spark.createDataFrame([(f"c{i}", i % 50 if i % 7 else None, 1, "t", [1.0, float(i % 9)] if i % 11 else None) for i in range(400)], "chunk_id string, doc_id long, page int, text string, vector array<double>")
    queries = spark.createDataFrame([(q, [1.0, q / 70]) for q in range(130)], "query_id int, vector array<double>")
    scope = spark.createDataFrame([(q, d) for q in range(0, 130, 2) for d in range(q % 4, 50, 4)] + [(4, None), (5, None)], "query_id int, doc_id long")
    allowed = {}
    for q, d in map(tuple, scope.collect()):
        allowed.setdefault(q, set()).add(d)
    want = []
    for q, vector in map(tuple, queries.collect()):
        scored = [(-round(min(max(c.vector[0] * vector[0] + c.vector[1] * vector[1], 0.0), 1.0), 9), c.chunk_id) for c in chunks.where("vector is not null").collect() if q not in allowed or c.doc_id is not None and c.doc_id in allowed[q]] if q < 12 else None
        want += [] if scored is None else [(q, rank + 1, chunk) for rank, (_, chunk) in enumerate(sorted(scored)[:3])]
    for block in (2048, 100):
        found = retrieval.dense_search(queries, chunks, k=3, scope=scope, block=block).where("query_id < 12")
        assert sorted((r.query_id, r.rank, r.chunk_id) for r in found.collect()) == want
    found = retrieval.dense_search(queries.where("query_id < 2"), chunks, k=3, scope=scope)
    assert found.count() == 6


def test_batches_are_bounded(spark):
    """Python gets Arrow batches of some megabytes, however wide the rows are; a session's own bound stays."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from pagemill.session import ship_code

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    ship_code(spark)
    wide = spark.range(4000, numPartitions=1).select("id", F.repeat(F.lit("0123456789"), 1000).alias("text"))
    assert wide.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 9 << 20
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1m")
    ship_code(spark)
    assert spark.conf.get(name) == "1m"
    spark.conf.set(name, before)
