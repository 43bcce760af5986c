"""Runs found block by block against runs found item by item."""

import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators.chains import greedy_links, numbered
from pagemill.operators.chunking import chunk_documents, chunk_long_documents, orbit
from pagemill.operators.pairs import prompt_batches, prompt_batches_long


def test_numbered(spark):
    rows = [(d, i, f"t{i}") for d, n in ((1, 700), (2, 1), (3, 40)) for i in range(n)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows + [(None, 1, "x")], "doc_id long, ord int, text string").repartition(7)
    assert sorted((r.doc_id, r.ord) for r in numbered(frame, ["ord"]).collect()) == sorted((d, i) for d, i, _ in rows)
    assert all(r.n == r.ord for r in numbered(frame, ["ord"]).collect())
    assert numbered(frame.where("false"), ["ord"]).count() == 0


@pytest.mark.parametrize("size,overlap,block", [(30, 7, 31), (12, 0, 13), (12, 11, 40), (3, 50, 4)])
def test_links_over_many_blocks(spark, size, overlap, block):
    """Documents of none to 45 blocks, on and around the borders of blocks; light, heavy and mixed sentences."""
    rng = random.Random(size)
    lengths = [1, 2, block - 1, block, block + 1, block + size, block + size + 1, block + size + 2, 2 * block, 2 * block + 1, 600, 0]
    texts = {d: [rng.choice([1, 1, 2, 5, 40]) if d % 2 else 1 for _ in range(n)] for d, n in enumerate(lengths)}
    items = spark.createDataFrame([(d, i, w) for d, ws in texts.items() for i, w in enumerate(ws)], "doc_id long, n long, weight int")
    found = sorted(tuple(r) for r in greedy_links(items, size, size, overlap, block).collect())
    assert found == sorted((d, k, a, b) for d, ws in texts.items() for k, (a, b) in enumerate(orbit(ws, size, overlap)))


def test_long_documents_have_the_same_chunks(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 30)))
    page = lambda n: "  ".join(word() + rng.choice([".", "!", " " + word() + "?"]) for _ in range(n))
    pages = [(1, p, page(rng.randint(0, 90))) for p in range(1, 30)] + [(2, 1, None), (3, 1, ""), (4, 2, page(3)), (4, 1, page(2)), (5, 1, "a" * 500), (6, 1, page(4)), (6, 1, page(4))]
    frame = spark.createDataFrame(pages, "doc_id long, page int, text string").repartition(5)
    rows = lambda f: sorted(tuple(r) for r in f.collect())
    assert rows(chunk_long_documents(frame, 20, 6, block_items=25)) == rows(chunk_documents(frame, 20, 6))
    assert rows(chunk_long_documents(frame, 20, 0)) == rows(chunk_documents(frame, 20, 0))
    assert chunk_long_documents(frame.where("false")).count() == 0
    with pytest.raises(Exception, match="without tokens"):
        chunk_long_documents(frame, 20, 6, tokens=lambda t: F.length(t) * 0).count()


def test_long_documents_have_the_same_prompts(spark):
    rng = random.Random(4)
    segments = [(d, i, rng.randint(1, 9), "x" * rng.choice([0, 0, 3, 20, 70])) for d, n in ((1, 400), (2, 1), (3, 33)) for i in range(n)]
    frame = spark.createDataFrame(segments, "doc_id long, ord int, page int, text string").repartition(5)
    rows = lambda f: sorted(tuple(r) for r in f.collect())
    for most_chars, most_segments in ((60, 5), (0, 4), (10**6, 7)):
        assert rows(prompt_batches_long(frame, most_chars, most_segments, block_items=9)) == rows(prompt_batches(frame, most_chars, most_segments))
    assert prompt_batches_long(frame.where("false")).count() == 0
