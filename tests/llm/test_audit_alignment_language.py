import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest


def divergence_by_force(rows, least_docs, top=10):
    pattern = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = pattern.findall((text or "").translate(lower))
        groups[lang].add(source)
        seen[lang].update(set(found))
        count[lang, source].update(found)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= least_docs]
        whole = Counter()
        for s in sources:
            whole.update(count[lang, s])

        def p(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        f = lambda a, b: (a - b) ** 2 // (a + b)
        of, q = {s: p(count[lang, s]) for s in sources}, p(whole)
        for s in sources:
            pairs = [(sum(f(of[s][t], of[o][t]) for t in kept), o) for o in sources - {s}]
            terms = [(f(of[s][t], q[t]), t) for t in kept if count[lang, s][t] and of[s][t] > q[t]]
            for part, items, last in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for k, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:last]):
                    out.add((lang, s, part, item, value, k + 1))
    return out


def some_texts(seed, n):
    rng = random.Random(seed)
    words = ["Haus", "haus", "été", "ÉTÉ", "a1b", "x-y", "日本", "zz", "don't", " nb", "Ω", "İx"] + ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "en", "fr", None, ""]), rng.choice(["s0", "s0", "s0", "s1", "s2", "é", None])
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 25))), lang, source))
    rows += [(n, None, "en", "s0"), (n + 1, "", "xx", "alone"), (n + 2, "rare words", "xx", "b"), (n + 3, "Haus " * 30_000, "en", "long"), rows[0], rows[0], (None, rows[1][1], "fr", "s1")]
    return rows


@pytest.mark.parametrize("bits", [64, 4])
def test_source_divergence(spark, bits):
    """Against brute force; with digests of 4 bits nearly all terms collide."""
    from pagemill.llm.source_divergence import divergence

    rows = some_texts(5, 150)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, term string, n int").repartition(3)
    want = divergence_by_force([r[1:] for r in rows], 10)
    got = [tuple(r) for r in divergence(frame, digest_bits=bits).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert any(r[0] == "xx" and r[4] == 0 for r in want) and any(r[2] == "term" for r in want)
    assert divergence(frame.where("n > 1"), digest_bits=bits).count() == 0


def test_source_divergence_blocks(spark):
    """Blocks of sources and shares of terms add up to the same values; partial counts are written early too."""
    from pagemill.llm import source_divergence as d
    from pagemill.session import materialise

    rows = some_texts(6, 120)
    frame = spark.createDataFrame([r[1:] for r in rows], "text string, lang string, source string").repartition(2)
    want = {(r[0], r[1], r[3], r[4]) for r in divergence_by_force([r[1:] for r in rows], 10) if r[2] == "pair"}
    counts = d.term_counts(frame, max_entries=20).groupBy("lang", "source", "term").sum("n", "df")
    assert counts.count() == d.term_counts(frame).select("lang", "source", "term").distinct().count()
    terms, _, _ = d.vocabulary(frame, broadcast_digests=0)
    kept = Counter(r["lang"] for r in terms.collect())
    by_source = Counter()
    for r in terms.collect():
        for e in r["entries"]:
            by_source[r["lang"], e["source"]] += e["n"]
    groups = {((r[2] or ""), (r[3] or "")) for r in rows}
    sources = spark.createDataFrame([(lang, s, kept[lang], by_source[lang, s] + 2 * kept[lang]) for lang, s in groups], "lang string, source string, kept long, total long")
    found = d.pair_values(materialise(sources, "s"), terms, block_sources=2, bucket_terms=7)
    assert {tuple(r) for r in found.collect()} == want


def test_shares_are_exact(spark):
    from pagemill.llm.source_divergence import share, shares

    rng = random.Random(1)
    pairs = [(c, t) for t in (1, 7, 10**6, 10**12 + 3, 9 * 10**15) for c in {0, 1, t // 3, t - 1, t, rng.randrange(t + 1)} if c <= t]
    want = [1 + 10**9 * c // t for c, t in pairs]
    assert shares(np.array([c for c, _ in pairs]), np.array([t for _, t in pairs])).tolist() == want
    frame = spark.createDataFrame([(k, c, t) for k, (c, t) in enumerate(pairs)], "k int, c long, t long")
    assert [r[0] for r in frame.orderBy("k").selectExpr(share("c", "t")).collect()] == want


def alignment_by_force(rows, byte_level, piece):
    import sentencepiece
    from tokenizers import Tokenizer

    from pagemill.llm.wordtokens import BYTE_CHARACTERS

    a_side, b_side = Tokenizer.from_file(byte_level), sentencepiece.SentencePieceProcessor(model_file=piece)
    a_side.encode_special_tokens = True
    byte_of = {c: b for b, c in BYTE_CHARACTERS.items()}
    texts = []
    for doc_id, text in rows:
        groups, links = [], []
        if text:
            a = a_side.encode(" " + text, add_special_tokens=False).ids
            b = b_side.encode(text)
            raw_a = [bytes(byte_of[c] for c in a_side.id_to_token(i)) for i in a]
            raw_b = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
                ends = lambda raw: np.cumsum([len(x) for x in raw]).tolist()
                ends_a, ends_b = ends(raw_a), ends(raw_b)
                shared = sorted(set(ends_a) & set(ends_b))
                at = lambda all_ends, ids, low, high: ",".join(str(i) for e, i in zip(all_ends, ids, strict=True) if low < e <= high)
                groups = [f"{at(ends_a, a, low, high)}|{at(ends_b, b, low, high)}" for low, high in zip([0, *shared], shared, strict=False)]
                links = [(x, y) for x, ex, rx in zip(a, ends_a, raw_a, strict=True) for y, ey, ry in zip(b, ends_b, raw_b, strict=True) if ex - len(rx) < ey and ey - len(ry) < ex]
            else:
                a, b = [], []
        else:
            a, b = [], []
        texts.append((doc_id, len(a), len(b), groups, links))
    count = Counter(p for t in texts for p in set(t[4]))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return sorted(
        (-1 if i is None else i, a, b, len(g), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, a, b, g, links in texts
    )


def test_token_alignment(spark, docs):
    import public_tokenizers

    from pagemill.llm.token_alignment import aligned, alignment

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    rng = random.Random(8)
    words = ["the", "don't", "I'LL", "naïve", "日本語", "x  y", "\n", "a\nb", "\t", "  ", "<|endoftext|>", "<s>", "</s>", "<0x41>", "<unk>", "12345", "!?", "😀", "é", " ", "　x", "tokenization", "Überraschung", "\r\n", "\x00", "ﬁ", "​"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " "), (203, "  lead"), (204, "trail  "), (205, "a▁b c"), (206, " one"), (207, "word"), (207, "word"), (None, "word again"), (208, "x" * 700), (209, "long text " * 300), (210, " \n "), (211, "▁")]
    want = alignment_by_force(rows, *paths)
    for hot in (1 << 16, 5):
        out, pairs = alignment(docs(rows).repartition(3), *paths, hot_pairs=hot)
        assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in out.collect()) == want
    assert pairs.count() == pairs.select("a_id", "b_id").distinct().count()
    again = aligned(docs(rows).coalesce(1), *paths, max_chunks=1).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.groups_sha256) for r in again) == [(w[0], w[-1]) for w in want]
    assert alignment(docs(rows[:0]), *paths)[0].count() == 0


def test_token_alignment_on_given_texts(spark):
    import public_tokenizers

    from pagemill.llm.token_alignment import alignment
    from pagemill.session import table

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    frame = table(spark, "/root/testdata/sf0.001", "documents").where("length(text) < 4000")
    want = alignment_by_force([(r.doc_id, r.text) for r in frame.collect()], *paths)
    assert sorted(map(tuple, alignment(frame, *paths)[0].collect())) == want and len(want) > 100


LANGS = {"aa": "abelmnort", "bb": "bcdikrsuz", "cc": "aéèlmoçtu"}


def labelled(seed, n, labels=None):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(labels or sorted(LANGS))
        size = 3000 if i % 40 == 0 else rng.randint(8, 40)
        rows.append((i, " ".join("".join(rng.choice(LANGS[lang]) for _ in range(rng.randint(2, 8))) for _ in range(size)), lang))
    return rows


def test_language_id(spark):
    """Held-out accuracy, calibration and rejection; order and partitions of the rows don't matter."""
    from pagemill.llm.language_id import fit, predict

    frame = lambda rows: spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    rows, tests = labelled(1, 600), labelled(2, 300)
    model = fit(frame([*rows, (900, None, "aa"), (901, "123", "bb"), (902, "abc", None), rows[0]]).repartition(4), sample_rows=150)
    assert model.langs == sorted(LANGS)
    odd = [(2000, None, "aa"), (2001, "", "aa"), (2002, "12 34 ²!", "aa"), (2003, "\n\t", None), (None, tests[0][1], "cc"), (2004, "q" * 300_000, None), (2005, "Ⅷ", None)]
    out = {(r.doc_id, r.lang_pred, r.score, r.accepted) for r in predict(frame([*tests, *odd, tests[1]]), model).collect()}
    by_id = {r[0]: r for r in out}
    right = [by_id[i][1] == lang for i, _, lang in tests]
    assert np.mean(right) > 0.97
    sure = [ok for ok, (i, _, _) in zip(right, tests, strict=True) if by_id[i][3]]
    assert len(sure) > 200 and np.mean(sure) > 0.98
    assert all(by_id[i][1:] == ("und", 0.0, False) for i in (2000, 2001, 2002, 2003, 2005))
    assert by_id[2004][1] in LANGS and by_id[None][1:] == by_id[tests[0][0]][1:] and all(0 <= r[2] <= 1 for r in out)
    assert predict(frame(tests), model).count() == len(tests) and predict(frame([]), model).count() == 0
    again = fit(frame([*rows[::-1], rows[0]]).repartition(2), sample_rows=150)
    assert np.array_equal(again.logits, model.logits) and again.temperature == model.temperature


def test_language_id_few_labels(spark):
    from pagemill.llm.language_id import fit, predict

    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string")
    rows = labelled(3, 30, ["aa"])
    assert {(r.lang_pred, r.score) for r in predict(frame(rows), fit(frame(rows))).collect()} == {("aa", 1.0)}
    assert fit(frame([(1, "abc", None), (2, None, "aa")])) is None
    assert {(r.lang_pred, r.score) for r in predict(frame(rows), None).collect()} == {("und", 0.0)}


def test_language_model_by_force():
    """Word logits and one text's probabilities by a plain loop; misspelt words keep most of their n-grams."""
    from pagemill.llm.language_id import SIZES, LanguageModel, grams, train

    rng = np.random.default_rng(0)
    model = LanguageModel(["x", "y"], np.vstack([rng.standard_normal((64, 2)), np.zeros((1, 2))]), np.array([0.1, -0.2]), 2.0)

    def bucket(gram):
        state = gram[0]
        for k, b in enumerate(gram[1:], 2):
            state = (state * 0x100000001B3 + b + k) % 2**64
        mixed = (state ^ (state >> 29)) * 0x9E3779B97F4A7C15 % 2**64
        return (mixed >> 40) % 64

    def word(w):
        raw = b"<" + w.encode() + b">"
        found = [bucket(raw[i : i + s]) for s in SIZES for i in range(len(raw) - s + 1)]
        return np.mean([model.logits[b] for b in found], axis=0)

    words = ["a", "été", "maison", "x" * 50]
    assert np.allclose(model.word_logits(words), [word(w) for w in words])
    z = (np.mean([word(w) for w in words], axis=0) + model.bias) / 2
    assert np.allclose(model.probabilities(model.word_logits(words).mean(axis=0)[None])[0], np.exp(z) / np.exp(z).sum())
    found, _, _ = grams(["maison", "maisoon"], 1 << 16)
    a, b = (set(found[s].ravel().tolist()) for s in (slice(0, 8), slice(8, None)))
    assert len(a & b) / len(a) > 0.6
    # training moves the loss down
    windows, labels = [["maison", "verte"], ["house"]], np.array([0, 1])
    before = train(windows, labels, ["x", "y"], buckets=512, epochs=1, rate=1e-9, batch=2)
    after = train(windows, labels, ["x", "y"], buckets=512, epochs=30, rate=1.0, batch=2)
    loss = lambda m: -sum(np.log(m.probabilities(m.word_logits(w).mean(axis=0)[None])[0, k]) for w, k in zip(windows, labels, strict=True))
    assert loss(after) < 0.6 * loss(before)
