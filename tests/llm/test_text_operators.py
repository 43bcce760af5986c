import hashlib
import random

from collections import Counter

import numpy as np
import pytest

from pagemill.llm.queries import tokenizer_path
from pagemill.session import workspace

WORDS = ["alpha", "beta,", "Gamma", "delé", "<|endoftext|>", "x's", "12%", "\n", "end."]
CASES = [(1, None), (2, ""), (3, " \t\n"), (4, "One two three four."), (5, "One two  three four."), (5, "One two  three four."), (None, "no id"), (6, "a" * 30_000)]


def texts(n=40, seed=1, size=120):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(rng.randint(1, size))) for _ in range(n)]


def rows_of(n=40):
    made = texts(n)
    return CASES + [(100 + i, t) for i, t in enumerate(made)] + [(500 + i, t.replace(" ", "  ")) for i, t in enumerate(made[:10])] + [(600, "\n".join(made[:5])), (601, "q" + "".join(made[3:8]))]


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    return lambda t: whole.encode(t or "", add_special_tokens=False).ids


def test_chunks(ids):
    """Chunks of all kinds against the library, letters up to U+00FF and beyond among them."""
    from pagemill.llm.wordtokens import ChunkTable, encode, read_tokenizer

    table = ChunkTable(read_tokenizer(tokenizer_path("word_bpe_49k.json"))[1])
    rng = random.Random(22)
    kinds = ["abcdefghijklmnopqrstuvwxyz", "ABCxyz", "".join(map(chr, range(0xAA, 0x180))), "aé\u0301ñö", "ß½²µªº", "a1.,!?'s", "<|>endoftxar", "Ünïcødé", "İıſΣς日本"]
    for n in range(6000):
        text = " ".join("".join(rng.choice(kinds[n % len(kinds)]) for _ in range(rng.randint(1, 12))) for _ in range(3))
        assert np.frombuffer(encode(table, text.encode()), "<u4").tolist() == ids(text), text


def test_packing(spark, docs, ids):
    from pagemill.llm.packing import pack

    given = rows_of()
    out = pack(docs(given).repartition(3), tokenizer_path("word_bpe_49k.json"), size=64, open_windows=4, fan_in=2).collect()
    fill = Counter()
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id] and r.length == len(r.ids) // 4
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 64 and sum(v < 64 for v in fill.values()) <= 1
    for doc_id, text in given:
        want = np.array([*ids(text), 2], "<u4").tobytes()
        if (doc_id, text) != (5, "One two  three four."):
            pieces = sorted((r for r in out if r.doc_id == doc_id), key=lambda r: r.start)
            assert b"".join(bytes(r.ids) for r in pieces) == want
    assert pack(docs([]), tokenizer_path("word_bpe_49k.json")).count() == 0


def test_token_counts(spark, docs, ids):
    from pagemill.llm.token_counts import read_cache, token_counts

    given, cache = rows_of(), workspace(spark, "cache")
    first = token_counts(docs(given), tokenizer_path("word_bpe_49k.json"), cache).collect()
    stored = read_cache(spark, cache).count()
    again = token_counts(docs(given), tokenizer_path("word_bpe_49k.json"), cache).collect()
    assert read_cache(spark, cache).count() == stored
    want = Counter((i, len((t or "").encode()), len(ids(t))) for i, t in given)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in first) == want == Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in again)
    assert token_counts(docs([]), tokenizer_path("word_bpe_49k.json"), workspace(spark, "cache")).count() == 0


def test_exact_dedup(docs):
    from pagemill.llm.exact_dedup import exact_groups

    given = rows_of()
    out = exact_groups(docs(given).repartition(3), block_bytes=8, table_bytes=500).collect()
    plain = lambda t: (t or "").encode().translate(None, b" \t\n\x0b\x0c\r")
    groups = Counter(plain(t) for _, t in given)
    assert len(out) == len(given) and sum(r.kept for r in out) == len(groups)
    by_hash = {hashlib.sha256(k).hexdigest(): (k, n) for k, n in groups.items()}
    for r in out:
        content, n = by_hash[r.text_sha256]
        best = min((-len(t or ""), i is None, i or 0) for i, t in given if plain(t) == content)
        assert r.group_size == n and r.keep_id == (None if best[1] else best[2])
    assert exact_groups(docs([])).count() == 0


def test_suffix_dedup(docs):
    from pagemill.llm.suffix_dedup import remove_repeats

    given = rows_of(25)
    out = remove_repeats(docs(given), length=40, gram=8, batches_of_docs=3).collect()
    seen = Counter()
    for _, t in given:
        raw = (t or "").encode()
        seen.update(raw[i : i + 40] for i in range(len(raw) - 39))
    want = []
    for i, t in given:
        raw, gone = (t or "").encode(), bytearray(len((t or "").encode()))
        for k in range(len(raw) - 39):
            if seen[raw[k : k + 40]] > 1:
                gone[k : k + 40] = b"\1" * 40
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        want.append((i, len(raw), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == Counter(want)
    assert remove_repeats(docs([])).count() == 0


@pytest.mark.parametrize("limit", [1, 32])
def test_simhash(docs, limit):
    import xxhash

    from pagemill.llm.simhash import fingerprint_groups

    base = texts(3, seed=9)
    rng = random.Random(4)
    near = [" ".join(w for w in rng.choice(base).split() if rng.random() > 0.02) for _ in range(60)]
    given = [c for c in rows_of(10) if c[0] is not None] + [(700 + i, t) for i, t in enumerate(near)]
    out = fingerprint_groups(docs(given), pair_limit=limit).collect()

    def mark(text):
        w = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(len(w) - 2, 1))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    marks = {i: mark(t) for i, t in given}
    root = {i: i for i in marks}
    for _ in marks:
        for a in marks:
            for b in marks:
                if (marks[a] ^ marks[b]).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in out} == {(i, f"{m:016x}", root[i]) for i, m in marks.items()}
    assert fingerprint_groups(docs([])).count() == 0


def test_similar_groups(docs):
    from pagemill.llm.simhash import similar_groups

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [[word() for _ in range(300)] for _ in range(4)]
    given = [(10 * k, " ".join(w)) for k, w in enumerate(base)]
    for k, w in enumerate(base[:3]):
        for j in range(1, 8):
            copy = list(w)
            copy[rng.randrange(300)] = "other"
            given.append((10 * k + j, " ".join(copy)))
    for limit in (2, 32):
        out = {r.doc_id: r.component_id for r in similar_groups(docs(given), pair_limit=limit, slice_rows=4).collect()}
        assert out == {i: i // 10 * 10 for i, _ in given}


def test_similar_groups_links_grow_with_rows(docs, monkeypatch):
    """A bucket of near copies leaves a forest, not its pairs: 30 texts have 435 of these."""
    from pagemill.llm import simhash

    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    given = [(i, " ".join([*base[: 10 * i], "other", *base[10 * i + 1 :]])) for i in range(30)]
    counts, whole = [], simhash.connected_components
    monkeypatch.setattr(simhash, "connected_components", lambda links: (counts.append(links.distinct().count()), whole(links))[1])
    out = {r.component_id for r in simhash.similar_groups(docs(given)).collect()}
    assert out == {0}
    assert 29 <= counts[0] <= 300


def test_similar_groups_chance_meetings(docs, monkeypatch):
    """Texts that have nothing in common meet in few buckets, however many they are."""
    from pagemill.llm import simhash

    rng = random.Random(9)
    given = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60))) for i in range(600)]
    met, write = {}, simhash.materialise
    monkeypatch.setattr(simhash, "materialise", lambda df, label: met.setdefault(label, write(df, label)))
    assert simhash.similar_groups(docs(given), table_bits=6).where("doc_id <> component_id").count() == 0
    assert met["long-buckets"].count() <= 0.1 * 24 * 600


def test_similar_groups_block_edits(docs):
    """Appended, truncated and replaced blocks at 0.8 to 0.9 are linked, those just under 0.8 aren't."""
    from pagemill.llm.simhash import similar_groups

    rng = random.Random(12)
    some = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    given, near = [], {}
    for k in range(120):
        base, size = some(200), rng.randint(16, 68)
        copy = [base + some(size), base[: 200 - size * 2 // 3], base[:90] + some(size // 2) + base[90 + size // 2 :]][k % 3]
        a, b = shingles(base), shingles(copy)
        given += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        near[2 * k + 1] = len(a & b) / len(a | b) >= 0.8
    assert 30 < sum(near.values()) < 115
    for limit, rows in ((32, 512), (1, 2)):
        out = {r.doc_id: r.component_id for r in similar_groups(docs(given), pair_limit=limit, slice_rows=rows).collect()}
        assert {i for i in near if out[i] != i and not near[i]} == set()
        assert sum(out[i] == i - 1 for i in near if near[i]) >= sum(near.values()) - 1


def test_passages(docs):
    from pagemill.llm.passages import near_passages, without_passages

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shared = [word() for _ in range(70)]
    some = lambda n: [word() for _ in range(n)]
    given = [(i, " ".join(some(40) + shared + some(30))) for i in range(1, 13)] + [(50, " ".join(some(400))), (51, None), (52, ""), (60, " ".join(some(80)))]
    given += [(61, given[-1][1]), (61, given[-1][1])]
    found = near_passages(docs(given)).collect()
    spans = {(r.doc_id, r.first_word, r.end_word) for r in found if 0 < r.other_id < r.doc_id < 13}
    assert spans == {(i, 40, 110) for i in range(2, 13)}
    assert {(r.doc_id, r.other_id) for r in found if r.doc_id > 40} == {(61, 60)}
    left = {r.doc_id: r.text for r in without_passages(docs(given), near_passages(docs(given))).collect()}
    assert left[1] == given[0][1] and left[50] == given[12][1] and left[51] is None and left[61] == ""
    assert len(left[2].split()) == 70 and " ".join(shared) not in left[2]
    assert near_passages(docs([])).count() == 0


def test_passages_recall(docs):
    """Passages of 50 words with one replaced (similarity 41/51), each in two texts, are found with the default functions."""
    from pagemill.llm.passages import near_passages

    rng = random.Random(14)
    some = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    given = []
    for k in range(400):
        shared = some(50)
        near = [*shared[:25], *some(1), *shared[26:]]
        given += [(2 * k, " ".join(some(20) + shared + some(30))), (2 * k + 1, " ".join(some(35) + near + some(15)))]
    found = {(r.doc_id, r.other_id) for r in near_passages(docs(given)).collect()}
    assert found <= {(2 * k + 1, 2 * k) for k in range(400)}
    print("recall", len(found) / 400)
    assert len(found) >= 0.98 * 400


def test_passages_groups(docs):
    """Texts that share a passage, each with another word in its middle, are all found, whatever the size of the group."""
    from pagemill.llm.passages import near_passages

    rng = random.Random(3)
    some = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    for n in (40, 150, 400):
        shared = some(60)
        given = [(i, " ".join(some(30) + shared[:30] + some(1) + shared[31:] + some(30))) for i in range(n)]
        found = {r.doc_id for r in near_passages(docs(given).repartition(3)).collect()}
        print("recall in a group of", n, len(found) / (n - 1))
        assert len(found) >= 0.98 * (n - 1)


def test_passages_brute_force(docs):
    """Random texts with repeated lines and phrases, chains of edits, clashing ids: against all pairs of texts."""
    from pagemill.llm.passages import near_passages, run_hashes, shared_passages, word_values, WordHashes

    rng = random.Random(15)
    some = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n)]
    line, rows = some(12), []
    for k in range(12):
        text = some(rng.randint(70, 200))
        for _ in range(rng.randint(2, 5)):
            copy = list(text)
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 3)] = some(rng.randint(0, 3))
            if rng.random() < 0.5:
                text = copy  # a chain
            at = rng.randrange(len(copy))
            copy[at:at] = line * rng.randint(1, 4)
            rows.append(" ".join(some(rng.randint(0, 40)) + copy + some(rng.randint(0, 40))))
    rng.shuffle(rows)
    given = [(i // 2 if i < 4 else i, t) for i, t in enumerate(rows)]
    given += [(900, None), (901, ""), (902, " ".join(line)), (None, rows[0]), given[9], (903, rows[7] + " " + " ".join(line * 9))]
    table, want, docs_found = WordHashes(), set(), set()
    shingles = [(i, run_hashes(word_values(t.lower().encode(), table), 5)) for i, t in given if t and i is not None]
    for x, (i, a) in enumerate(shingles):
        for y, (j, b) in enumerate(shingles):
            if x != y and (i, y) > (j, x) and i >= j and not (i == j and np.array_equal(a, b)):
                left, right = np.nonzero(a[:, None] == b[None, :])
                if not any(shared_passages(a, b, 46, 0.8, int(d)) for d in np.unique(right - left)):
                    continue
                want.add((i, j))
                docs_found.add(i)
    out = near_passages(docs(given).repartition(4)).collect()
    found = {r.doc_id for r in out}
    assert {(r.doc_id, r.other_id) for r in out} <= want
    print("recall of random texts", len(found & docs_found) / len(docs_found))
    assert len(found & docs_found) >= 0.95 * len(docs_found)
    runs, equal = {}, []
    for i, t in sorted((i, t) for i, t in given if t and i is not None):
        words = t.split()
        for at in range(len(words) - 49):
            if runs.setdefault(tuple(words[at : at + 50]), i) < i:
                covered = np.zeros(len(words), bool)
                for r in out:
                    if r.doc_id == i:
                        covered[r.first_word : r.end_word] = True
                equal.append(covered[at : at + 50].all())
    print("equal runs of 50 words covered", np.mean(equal), len(equal))
    assert np.mean(equal) >= 0.97


def test_passages_long_text(docs):
    """A text of several parts, hashed alike wherever it is cut, and a passage at its end."""
    from pagemill.llm.passages import near_passages

    rng = random.Random(16)
    some = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    shared, long = some(70), some(160_000)
    given = [(1, " ".join(some(9) + shared)), (2, " ".join(long + shared)), (3, "x" + " ".join(long[70_000:])), (4, "y" * 300_000)]
    found = {(r.doc_id, r.other_id): (r.first_word, r.end_word, r.similarity) for r in near_passages(docs(given)).collect()}
    assert found == {(2, 1): (160_000, 160_070, 1.0), (3, 2): (1, 90_000, 1.0)}


def test_window_minima(monkeypatch):
    from pagemill.llm import passages

    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 2**63, 3000).astype(np.uint64)
    want = [i + int(hashes[i : i + 46].argmin()) for i in range(len(hashes) - 45)]
    assert passages.window_minima(hashes, 46).tolist() == want
    monkeypatch.setattr(passages, "POSITION", np.uint64(255))
    assert passages.window_minima(hashes, 46).tolist() == want
    assert passages.window_minima(hashes[:9], 46).tolist() == []


def test_local_holders():
    from pagemill.llm.passages import local_holders

    place = lambda at, tag: at << 32 | tag
    names = np.array([7, 7, 7, 8, 7])
    docs, places = np.array([5, 3, 3, 3, 3]), np.array([place(1, 0), place(4, 9), place(3, 8), place(6, 9), place(5, 8)])
    rows = list(zip(*(c.to_pylist() for c in local_holders(names, docs, places)), strict=True))
    assert [r[:3] for r in rows if r[3] is None] == [(7, 3, place(3, 8)), (7, 3, place(5, 8)), (8, 3, place(6, 9))]
    assert [r[1:] for r in rows if r[3] is not None] == [(3, place(4, 9), 3, place(3, 8)), (5, place(1, 0), 3, place(3, 8))]


def test_shared_passages():
    """Texts with phrases replaced, against brute force over all pairs of their runs that begin and end alike."""
    from pagemill.llm.passages import shared_passages

    rng = np.random.default_rng(13)
    hits = 0
    for k in range(150):
        n = int(rng.integers(60, 76))
        a = rng.permutation(60_000)[:n].astype(np.uint64)
        at = int(rng.integers(5, n - 20))
        gone, new = int(rng.integers(5, 16)), int(rng.integers(5, 16))
        b = np.concatenate([a[:at], 60_001 + np.arange(gone if k % 2 else new), a[at + gone :]]).astype(np.uint64)
        found = shared_passages(a, b, 46, 0.8)
        total = np.zeros((len(a) + 1, len(b) + 1), np.int64)
        total[1:, 1:] = (a[:, None] == b[None, :]).cumsum(0).cumsum(1)
        i0, i1 = np.array([(i, e) for i in range(len(a)) for e in range(i + 46, len(a) + 1)]).T
        j0, j1 = np.array([(j, e) for j in range(len(b)) for e in range(j + 46, len(b) + 1)]).T
        common = total[i1][:, j1] - total[i0][:, j1] - total[i1][:, j0] + total[i0][:, j0]
        score = common / ((i1 - i0)[:, None] + (j1 - j0)[None, :] - common)
        alike = (a[i0][:, None] == b[j0][None, :]) & (a[i1 - 1][:, None] == b[j1 - 1][None, :])
        best = common[alike & (score >= 0.8)].max(initial=0)
        assert (max((total[m[1], m[3]] - total[m[0], m[3]] - total[m[1], m[2]] + total[m[0], m[2]] for m in found), default=0)) == best
        hits += best > 0
    assert 30 < hits < 150


@pytest.mark.parametrize("known", [0, 40, 100_000])
def test_sentencepiece(docs, known):
    import sentencepiece

    from pagemill.llm.sentencepiece_lattice import decode, encode

    path = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    given = CASES + [(7, "  two  spaces €𝄞 Hello\nworld <s>  "), (8, "abcdefgh" * 30), (9, "▁"), (10, "naïve  über" * 7), (11, " "), (12, "ab12.5% don't" * 3)]
    given += [(100 + i, t) for i, t in enumerate(texts(10))]
    coded = encode(docs(given), path, max_known=known)
    out = decode(coded, path).collect()
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in out) == Counter((i, tuple(library.encode(t or ""))) for i, t in given)
    assert Counter((r.doc_id, r.text) for r in out) == Counter((i, (t or "").replace("▁", " ")) for i, t in given)
    assert decode(encode(docs([]), path), path).count() == 0


def test_toxicity(spark, docs):
    from zlib import crc32

    from pagemill.llm.toxicity import fit, scores

    rng = random.Random(8)
    clean = lambda n: " ".join("".join(rng.choice("aeionrst") for _ in range(5)) for _ in range(n))
    given = [(i, f"{clean(20)} zork{clean(1)} {clean(10)} zork{clean(1)} zork{clean(9)}" if i % 3 == 0 else clean(42)) for i in range(1800)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(1800) if crc32(str(i).encode()) % 5], "doc_id long, toxic int")
    model = fit(docs(given), labels)
    out = {r.doc_id: r.score for r in scores(docs([*given, (9000, None), (9001, "")]), model).collect()}
    held = [i for i in range(1800) if crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(out[i] >= 0.5) == (i % 3 == 0) for i in held]) > 0.9
    assert out[9000] == out[9001] and 0 <= out[9000] <= 1
    assert fit(docs(given), labels.where("toxic = 0")) == 0.0 and fit(docs([]), labels.where("doc_id < 0")) == 0.5


def test_pipeline_registered():
    import __spark_entry__
    import corpus_pipeline

    assert len(corpus_pipeline.STAGES) == 5 and __spark_entry__.queries()["pipeline"] is corpus_pipeline.run


def test_pipeline_rows(spark, tmp_path):
    """run() against a brute force: repeated rows, ids shared by different texts, and rows without an id."""
    import corpus_pipeline
    from pagemill.llm.packing import pack
    from pagemill.llm.toxicity import fit, scores

    rng = random.Random(11)
    some = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    toxic = lambda: f"{some(9)} zork zorks {some(3)} zorker zorky zork"
    clean = [some(30) for _ in range(8)]
    training = [(1000 + i, toxic() if i % 3 == 0 else some(17)) for i in range(240)]
    given = training + [(1, clean[0]), (1, clean[0]), (2, clean[0]), (3, clean[1]), (3, toxic()), (4, clean[2]), (5, clean[2]), (5, clean[3]), (5, clean[3])]
    given += [(None, toxic()), (None, clean[4]), (None, clean[4]), (None, clean[0]), (6, None), (None, "")]
    passage = some(60)  # both ids of a pair also stand on a row of their own
    given += [(7, f"{clean[5]} {passage} {some(40)}"), (8, f"{some(45)} {passage} {some(35)}"), (8, clean[6]), (None, f"{some(50)} {passage} {clean[7]}")]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in given], "doc_id long, text string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int((i - 1000) % 3 == 0)) for i, _ in training], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    at = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(given)], "doc_id long, text string")
    score = {given[r.doc_id]: r.score for r in scores(at, fit(docs, labels)).collect()}
    seen, want = set(), []
    for i, t in sorted(given, key=lambda x: (x[0] is None, x[0] or 0)):
        if score[i, t] >= 0.5 or (t or "") in seen:
            continue
        seen.add(t or "")
        if passage in (t or "") and i != 7:
            head, tail = t.split(passage)
            t = head + tail.lstrip()
        want.append((i, t))
    assert (None, clean[4]) in want and sum("zork" in (t or "") for _, t in want) < 8
    wanted = spark.createDataFrame(want, "doc_id long, text string")
    sums = lambda pieces: Counter((r.doc_id, r.doc_tokens) for r in pieces.where("start = 0").collect())
    assert sums(corpus_pipeline.run(spark, str(tmp_path))) == sums(pack(wanted, tokenizer_path("word_bpe_49k.json")))


def test_pipeline_stages(spark, tmp_path):
    """Each stage on nulls, empty texts, repeated rows, further columns of clashing names, and on no rows at all."""
    import corpus_pipeline

    rng = random.Random(19)
    some = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage, long = some(60), some(3000)
    given = [(1, None), (2, ""), (3, some(20)), (4, f"{some(10)} {passage}"), (5, f"{some(15)} {passage}"), (None, some(9)), (6, long), (7, long), (8, f"{long} {some(1)}"), (9, long), (9, long)]
    names = ["node", "ref", "key", "own_id", "span_id", "spans", "_pipeline_row", "rest", "score", "part", "n", "component_id", "kept", "label", "a.b"]
    docs = spark.createDataFrame([(i, t, len(t or ""), *[7] * len(names)) for i, t in given], "doc_id long, text string, n_chars long, " + ", ".join(f"`{c}` long" for c in names))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    ids = lambda df: Counter(r.doc_id for r in df.collect())

    def written(df):
        path = f"{tmp_path}/{rng.random()}"
        df.write.parquet(path)
        return path

    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[: len(docs.columns)] == docs.columns and len(out.columns) == len(docs.columns) + 1, name
        assert all(r[c] == 7 for r in out.collect() for c in names), name
        again = stage(spark, spark.read.parquet(written(out)), str(tmp_path))
        assert again.columns == out.columns and (name == "substring dedup" or ids(again) == ids(out)), name
        kept[name] = ids(out)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    everything = Counter(i for i, _ in given)
    assert kept["toxicity"] in (everything, Counter())
    assert kept["exact dedup"] == everything - Counter([2, 7, 9, 9])
    assert kept["SimHash near-dedup"] == everything - Counter([2, 7, 8, 9, 9])
    assert set(everything - kept["substring dedup"]) == {7, 9}
    assert ids(corpus_pipeline.packing(spark, docs, str(tmp_path)).where("start = 0")) == everything
