import base64
import hashlib

import numpy as np


def test_warc(spark):
    from pagemill.llm.warc import read_archives, write_archives

    given = [(1, "u", "same"), (2, "u", "same"), (3, "u\n", "other é"), (4, None, None), (5, "u", ""), (6, "u", "z" * 50_000), (6, "u", "z" * 50_000), (None, "u", "same")]
    given += [(i, "u", f"<p>{i % 7} text of page {i}</p>" * 20) for i in range(10, 60)]
    pages = spark.createDataFrame([(*g, "x") for g in given], "page_id long, url string, html string, archive string")
    manifest = write_archives(pages.repartition(3), archive_bytes=20_000)
    out = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in read_archives(manifest).collect()}
    want = set()
    for page_id, _, html in given:
        raw = (html or "").encode()
        last = max(p for p, _, h in given if (h or "") == (html or "") and p is not None)
        older = page_id is None or page_id < last
        want.add((page_id, "revisit" if older else "response", last if older else None, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode()))
    assert out == want
    payloads = {r.page_id: bytes(r.payload).decode() for r in read_archives(manifest).where("record_type = 'response'").collect()}
    assert payloads[6] == "z" * 50_000 and payloads[3] == "other é"
    assert manifest.agg({"records": "sum"}).first()[0] == len(given)
    assert read_archives(write_archives(pages.where("page_id > 99"))).count() == 0


def test_embeddings(spark):
    from pagemill.llm.embedding_dedup import embedding_groups

    rng = np.random.default_rng(3)
    rows = []
    for k in range(12):
        centre = rng.standard_normal(64)
        for j in range(rng.integers(1, 12)):
            rows.append((len(rows), (centre + 0.03 * rng.standard_normal(64) * (j > 1)).astype(np.float32).tolist(), k % 3))
    n = len(rows)
    odd = [(n, None, 1), (n + 1, [0.0] * 64, 1), (n + 2, [float("nan")] * 64, 1), (n + 3, rows[0][1], None), (n + 4, [], 1), (n + 5, [None] * 64, 1), (0, rows[0][1], rows[0][2])]
    frame = spark.createDataFrame([(*r, 0) for r in rows + odd], "vec_id long, embedding array<float>, label int, keys int")
    for size in (3, 512):
        out = embedding_groups(frame, slice_rows=size).collect()
        assert len(out) == n + len(odd)
        by_id = {r.vec_id: r for r in out}
        x = np.array([r[1] for r in rows + odd[-1:]], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        label = np.array([r[2] for r in rows + odd[-1:]])
        near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
        np.fill_diagonal(near, False)
        found = sum(r.n_links for r in out)
        assert 0.95 * near.sum() <= found <= near.sum()
        assert all(by_id[i].n_links == 0 and by_id[i].component_id == i for i in range(n, n + 6))
    assert embedding_groups(frame.where("vec_id < 0")).count() == 0


def test_embeddings_threshold(spark):
    """Pairs just over and under the threshold, as doubles; lengths differ; a label's hot group."""
    from pagemill.llm.embedding_dedup import embedding_groups

    rng = np.random.default_rng(4)
    rows, near = [], 0
    for k in range(300):
        a, b = rng.standard_normal((2, 48))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        cosine = 0.931 if k % 2 else 0.929
        near += k % 2
        rows += [(2 * k, a.tolist(), f"l{k}"), (2 * k + 1, (3.7 * (cosine * a + np.sqrt(1 - cosine**2) * b)).tolist(), f"l{k}")]
    rows += [(1000 + k, rows[1][1][:20], "l0") for k in range(3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    out = {r.vec_id: r for r in embedding_groups(frame).collect()}
    linked = [k for k in range(300) if out[2 * k + 1].component_id == 2 * k]
    assert all(k % 2 for k in linked) and len(linked) >= 0.95 * near
    print("recall at cosine 0.931", len(linked) / near)
    assert [(out[1000 + k].n_links, out[1000 + k].component_id) for k in range(3)] == [(2, 1000)] * 3


def test_toxicity_misspellings(spark):
    """Misspellings that training never saw are told apart; a model of whole words can't."""
    import random

    from pagemill.llm.toxicity import fit, scores

    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(6))
    common = [word() for _ in range(400)]
    some = lambda n: " ".join(rng.choice(common) for _ in range(n))
    bad = ["zorkblat", "quixfump"]
    twist = lambda w: w[: (k := rng.randrange(2, 6))] + w[k] + w[k:]  # noqa: E731  a letter doubled
    docs = [(i, f"{some(20)} {rng.choice(bad)} {some(9)} {rng.choice(bad)}" if i % 2 else some(31)) for i in range(1200)]
    tests = [(5000 + i, f"{some(20)} {twist(rng.choice(bad))} {some(9)} {twist(rng.choice(bad))}" if i % 2 else some(31)) for i in range(300)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    model = fit(frame(docs), spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, toxic int"))
    out = {r.doc_id: r.score for r in scores(frame(tests), model).collect()}
    bad_scores, clean_scores = (np.array([out[5000 + i] for i in range(300) if i % 2 == k]) for k in (1, 0))
    auc = np.mean(bad_scores[:, None] > clean_scores[None, :])  # 0.5 for a model of whole words, which sees nothing it knows
    seen = {w for _, t in docs for w in t.split()}
    unseen = sum(not any(w in bad for w in t.split() if w in seen) for i, t in tests if i % 2)
    print("AUC on unseen misspellings", auc, "caught", np.mean(bad_scores >= 0.5))
    assert unseen == 150 and auc > 0.95 and np.mean(clean_scores >= 0.5) < 0.05
    assert scores(frame(docs[:0]), model).count() == 0
    both = [*docs, (1, docs[1][1]), (7, "other text"), (9, "w " * 40_000)]
    again = fit(frame(both).repartition(5), spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, toxic int"))
    assert np.array_equal(again.margins, fit(frame(both[::-1]), spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, toxic int")).margins)


def test_toxicity_forward_by_force(spark):
    """Scores against a plain computation from the model's margins, for texts of all kinds."""
    import math
    import re
    from zlib import crc32

    from pagemill.llm.toxicity import SubwordModel, scores

    margins = np.random.default_rng(6).standard_normal(512).astype(np.float32)
    texts = ["one two", "Één  tWo_three 4x4", "", None, "!!", "日本 語", "word " * 3000, "x" * 5000, "a", "A-b\nc"]
    rows = [(i, t, "toxic", 1) for i, t in enumerate(texts)] + [(None, "one two", None, 0), (0, "one two", "x", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label string, score int").repartition(3)

    def score(text):
        found = []
        for word in re.findall(r"\w+", (text or "").lower()):
            marked = f"<{word}>"
            grams = {marked} | {marked[i:j] for i in range(len(marked)) for j in range(i + 3, min(i + 5, len(marked)) + 1)}
            found.append(sum(float(margins[crc32(g.encode()) % 512]) for g in grams) / len(grams))
        return 1 / (1 + math.exp(-(sum(found) / max(len(found), 1) + 0.25)))

    out = sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in scores(frame, SubwordModel(margins, 0.25)).collect())
    want = sorted((i is None, i or 0, score(t)) for i, t, *_ in rows)
    assert [o[:2] for o in out] == [w[:2] for w in want] and np.allclose([o[2] for o in out], [w[2] for w in want], atol=1e-5)


def test_toxicity_long_texts_train(spark):
    """Texts of any length train: where only long ones are toxic, that is learnt; beyond the bound rows stay out by their hash."""
    import random

    from pagemill.llm.toxicity import fit, scores

    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(6))
    common = [word() for _ in range(300)]
    some = lambda n: " ".join(rng.choice(common) for _ in range(n))
    docs = [(i, " ".join(f"{some(30)} zorkblat" for _ in range(50)) if i % 2 else some(1500)) for i in range(160)]
    assert min(len(t) for _, t in docs) > 8192
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, toxic int")
    tests = [(1000 + i, f"{some(40)} zorkblat {some(9)} zorkblat" if i % 2 else some(50)) for i in range(100)]
    for size in (24 << 20, 1 << 20):
        out = {r.doc_id: r.score for r in scores(frame(tests), fit(frame(docs), labels, sample_bytes=size)).collect()}
        assert np.mean([(out[1000 + i] >= 0.5) == (i % 2 == 1) for i in range(100)]) > 0.9
    assert not isinstance(fit(frame(docs), labels, sample_bytes=1), float)
