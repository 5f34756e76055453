from __future__ import annotations

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinespark.llm import hilbert, hmm, linecrf, pieces, purisk, textstats, toxicity
from kinespark.llm.common import crc_mod

DOCS = "doc_id long, text string, lang string, source string, n_chars long, seq string, word string, c int, unit string"
TEXTS = [None, "", " \n\t", "one", "A b\nA b\n\na B é 中", "the cat sat on the mat " * 40, "x" * 5000, "the cat sat"]


def docs_of(spark, texts):
    """Documents with repeated ids, a null id, and columns whose names clash with inner ones."""
    rows = [(i, t, "en", "s", 1, "q", "w", 1, "u") for i, t in enumerate(texts)]
    rows += [(0, texts[4], "en", "s", 1, "q", "w", 1, "u"), rows[4], (None, "the cat", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


# --- text counts and the line model ---------------------------------------------------------


def test_repeated_words_matches_windows():
    rng = random.Random(3)
    for _ in range(300):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(60))]
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        tally = Counter(windows)
        hit = {i + k for i, w in enumerate(windows) if tally[w] > 1 for k in range(8)}
        assert textstats.repeated_words(words) == len(hit)


def test_base_counts():
    got = textstats.base_counts("a #b\na #b\n\n\n c|\n")
    assert got == {"n_words": 5, "word_chars": 8, "n_symbols": 3, "n_dup_lines": 1, "n_repeat_words": 0}
    assert textstats.base_counts(None)["n_words"] == 0


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 8))
        x, crf = rng.normal(size=(n, len(linecrf.FEATURES))), linecrf.LineCrf(rng.normal(size=len(linecrf.FEATURES)), rng.normal(size=(2, 2)))
        gain = x @ crf.weights

        def value(labels):
            return sum(g for g, y in zip(gain, labels) if y) + sum(crf.pairs[a, b] for a, b in zip(labels, labels[1:]))

        best = max(itertools.product((0, 1), repeat=n), key=value)
        assert value(best) == pytest.approx(value(crf.viterbi(x).astype(int).tolist()))


def test_line_rules(spark):
    good, bad = "A plain line of words that ends well.\nAnd one more, as plain as that.", "BUY!! NOW!! | x | y | z\n$$$ %%% BUY!! NOW!!"
    crf = linecrf.fit([good, bad] * 5, [1, 0] * 5)
    assert crf.content_share(good) == 1 and crf.content_share(bad) == 0
    out = linecrf.apply_rules(docs_of(spark, [*TEXTS, good + "\nThe quick brown fox jumps over the lazy dog while seven more of them watch from the hill.", (bad + " ") * 9]), crf).collect()
    assert len(out) == len(TEXTS) + 5
    by = {r.doc_id: r for r in out}
    assert by[8].kept and not by[9].kept and by[0].base_failed and not by[1].kept
    assert linecrf.apply_rules(docs_of(spark, TEXTS).limit(0), crf).count() == 0
    assert linecrf.fit([], []).content_share("a b") == 1


def test_lines_inside_a_document_change_label(spark):
    """Boilerplate planted into good documents is found line by line, and content stays."""
    rng = random.Random(11)
    sentence = lambda: " ".join(rng.choice("the tree house river walks slowly under green old stones while people talk".split()) for _ in range(12)).capitalize() + "."
    shared = ["Subscribe to our newsletter for weekly news and offers today.", "All rights reserved, reprinted with permission of the owner."]
    junk = lambda: " ".join(rng.choice(["BUY!!", "NOW###", "$$$", "|", "CLICK!!"]) for _ in range(14))
    rows = []
    for i in range(120):
        lines = [sentence() for _ in range(6)]
        rows.append((i, "\n".join([*lines[:3], shared[i % 2], *lines[3:], shared[(i + 1) % 2]]), 1))
        rows.append((500 + i, "\n".join([sentence() if k % 4 == 0 else junk() for k in range(8)]), 0))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    assert {linecrf.line_hash(x) for x in shared} == linecrf.shared_lines(docs)
    crf = linecrf.train(docs, labels)
    good, _ = crf.labelled(rows[0][1])
    assert good.tolist() == [True] * 3 + [False] + [True] * 3 + [False]
    shares = {y: [crf.content_share(t) for _, t, z in rows if z == y] for y in (0, 1)}
    assert min(shares[1]) > 0.6 > 0.5 > max(shares[0])
    long = "\n".join([sentence() for _ in range(3000)] + [junk() for _ in range(50)])
    content, _ = crf.labelled(long)
    assert content[:3000].mean() > 0.95 and not content[-50:].any()


# --- classifiers -----------------------------------------------------------------------------


def held_out(spark, sf_dir, fn, label, modulus, rest):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    may = (crc_mod("doc_id", modulus) != rest)
    out = {r.doc_id: r for r in fn(docs, labels, may).collect()}
    return [(out[r.doc_id].score, r[label]) for r in labels.where(~may).collect()]


def auc(rows):
    pairs = [(a, b) for a, y in rows for b, z in rows if y == 1 and z == 0]
    return sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs)


def test_quality_held_out(spark):
    rows = held_out(spark, "/root/testdata/sf0.01", lambda d, lab, m: purisk.score_quality(d, purisk.train(purisk.measure(d), lab, m)), "quality", 4, 2)
    assert auc(rows) > 0.95


def test_class_prior_needs_no_negatives(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = purisk.measure(docs).cache()
    true = labels.agg(F.avg("quality")).first()[0]
    model = purisk.train(rows, labels.where("quality = 1"), F.lit(True))
    assert model.prior == pytest.approx(true, abs=0.06)
    x = np.array([r.x for r in rows.collect()])
    web = purisk.Unlabelled(rows)
    g, h, loss = web.sums(model)
    e = model.expand(x)
    z = e @ model.weights
    assert loss == pytest.approx(np.logaddexp(0, z).sum(), rel=1e-9)
    assert np.allclose(g, (1 / (1 + np.exp(-z))) @ e) and h.shape == (len(z := model.weights), len(z))


def test_toxicity_held_out(spark):
    rows = held_out(spark, "/root/testdata/sf0.01", lambda d, lab, m: toxicity.score_toxicity(d, toxicity.train(d, lab, m)), "toxic", 5, 0)
    assert auc(rows) > 0.8


def test_classifier_edges(spark):
    docs = docs_of(spark, TEXTS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    q = purisk.score_quality(docs, purisk.train(purisk.measure(docs), none, crc_mod("doc_id", 4) != 2)).collect()
    t = toxicity.score_toxicity(docs, toxicity.train(docs, none, crc_mod("doc_id", 5) != 0)).collect()
    assert len(q) == len(t) == len(TEXTS) + 3 and all(0 <= r.score <= 1 for r in q + t) and not any(r.predicted for r in t)
    assert toxicity.drop_toxic(docs, toxicity.ToxicityModel(toxicity.Matcher([], []))).count() == len(TEXTS) + 3


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_matcher_is_one_edit_of_a_long_term():
    m = toxicity.Matcher(["abcab", "bad", "ccabca"], ["zz"], frozenset({"abcbb"}))
    for n in range(1, 7):
        for w in map("".join, itertools.product("abc", repeat=n)):
            exact = w in ("abcab", "bad", "ccabca")
            near = w != "abcbb" and any(edits(w, t) == 1 for t in ("abcab", "ccabca"))
            assert m.match(w) == (toxicity.EXACT if exact else toxicity.FUZZY if near else 0), w
    assert m.match("zzanything") == toxicity.STEM


def test_quotation_counts_less():
    m = toxicity.Matcher(["idiot"], [])
    assert toxicity.counts("you idiot", m)[0] > toxicity.counts('he said "idiot" then', m)[0] > 0
    assert toxicity.counts("you idoit you idiott", m)[2] > 0


# --- nearest neighbours ----------------------------------------------------------------------


def test_hilbert_keys_visit_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = hilbert.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(2)
    vecs = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    vecs += [(i, vecs[7][1]) for i in range(300, 340)] + [(20, vecs[3][1])]
    odd = [(400, None), (401, [0.0] * 4), (402, [1.0, None, 0.0, 0.0]), (500, [float("nan")] * 4), (600, [1.0, 2.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, 1, "k") for i, v in vecs + odd], "vec_id long, embedding array<double>, label int, key string")
    got = {}
    for r in hilbert.nearest(df, F.col("vec_id") % 100 == 0, k=10, window=8).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {0, 100, 200, 300}
    for q, rows in got.items():
        own = next(v for i, v in vecs if i == q)
        best = {}
        for i, v in vecs:
            if i != q:
                best[i] = min(best.get(i, math.inf), math.dist(own, v))
        want = sorted(best, key=lambda i: (best[i], i))[:10]
        assert [v for _, v, _ in sorted(rows)] == want
        assert [s for *_, s in sorted(rows)] == pytest.approx([best[i] for i in want])
    assert hilbert.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


# --- language model --------------------------------------------------------------------------


def test_forward_is_the_sum_over_paths():
    rng = np.random.default_rng(4)
    start, move, emit = rng.dirichlet([1] * 3), rng.dirichlet([1] * 3, 3), rng.dirichlet([1] * 5, 3).T
    model = hmm.Hmm(start, move, emit)
    seqs = [rng.integers(0, 5, n) for n in (1, 4, 6, 2)]
    for s, got in zip(seqs, model.log_likelihoods(seqs)):
        total = 0.0
        for path in itertools.product(range(3), repeat=len(s)):
            p = start[path[0]] * emit[s[0], path[0]]
            for a, b, o in zip(path, path[1:], s[1:]):
                p *= move[a, b] * emit[o, b]
            total += p
        assert got == pytest.approx(math.log(total))


def windows_of(seqs, pad):
    parts = list(hmm._windows(seqs, pad))
    assert sum((c[:, 1] - c[:, 0]).sum() for _, _, c in parts) == sum(map(len, seqs))
    return parts


def counts_of(model, parts, pad):
    got = [model.expected(*p, pad) for p in parts]
    return tuple(sum(g[i] for g in got) for i in range(4))


def test_baum_welch_raises_the_likelihood():
    rng = np.random.default_rng(5)
    seqs = [np.array([i % 2 * 2 + rng.integers(0, 2) for i in range(30)]) for _ in range(40)]
    model, last = hmm.first_guess(np.ones(4), 2, 1), -np.inf
    for _ in range(6):
        s, m, e, ll = counts_of(model, windows_of(seqs, 4), 4)
        assert ll >= last - 1e-6 and e.sum() == pytest.approx(1200)
        last, model = ll, hmm.Hmm(s / s.sum(), m / m.sum(1, keepdims=True), e / e.sum(0))


def test_windows_of_a_long_text_count_as_the_whole(monkeypatch):
    rng = np.random.default_rng(9)
    model = hmm.first_guess(rng.integers(1, 50, 30).astype(float), 4, 3)
    seqs = [rng.integers(0, 30, n) for n in (1, 511, 512, 513, 5000, 90)]
    cut = counts_of(model, windows_of(seqs, 30), 30)
    monkeypatch.setattr(hmm, "CORE", 10_000)
    for a, b in zip(cut, counts_of(model, windows_of(seqs, 30), 30)):
        assert np.abs(np.asarray(a) - np.asarray(b)).max() < 1e-6 * max(1, np.abs(b).max())


def test_language_model_base_score(spark):
    docs = docs_of(spark, TEXTS)
    out = hmm.score_texts(docs, crc_mod("doc_id", 10) == 0, states=2, rounds=2, head=3).collect()
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    rows = docs.select("doc_id", "text").collect()
    count = Counter()
    for r in rows:
        if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10:
            count.update(tokens(r.text))
    total, distinct = sum(count.values()), len(count)
    want = sorted((str(r.doc_id), len(tokens(r.text)), sum(count[w] > 0 for w in tokens(r.text)), round(sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens(r.text)), 6)) for r in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out) == want
    assert all(r.train_tokens == total and r.score < 0 for r in out)
    assert hmm.score_texts(docs.limit(0), crc_mod("doc_id", 10) == 0, states=2, rounds=1, head=3).count() == 0


# --- pieces ----------------------------------------------------------------------------------


def test_pieces_equal_the_library_and_come_back(spark):
    import sentencepiece

    table, model = pieces.load(), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(6)
    texts = [*TEXTS, "  two  blanks \n\n end ", "▁x", "日本語😀\x00\t\r\n", *["".join(rng.choice(" \nabcéethinorüß中1.😀▁") for _ in range(80)) for _ in range(100)]]
    docs = docs_of(spark, texts)
    coded = pieces.encode(docs, table, table_units=200)
    got = coded.select("doc_id", "ids").collect()
    want = sorted((str(r.doc_id), model.encode(r.text or "")) for r in docs.collect())
    assert sorted((str(r.doc_id), r.ids) for r in got) == want
    back = sorted((str(r.doc_id), r.text) for r in pieces.decode(coded, table).select("doc_id", "text").collect())
    assert back == sorted((str(r.doc_id), (r.text or "").replace("▁", " ")) for r in docs.collect())
    assert pieces.encode(docs.limit(0), table).count() == 0


def test_relational_viterbi(spark):
    toy = pieces.PieceTable({"a": (0, -1.0), "b": (1, -2.0), "ab": (2, -2.5), "abc": (3, -4.0), "c": (4, -1.5), "bc": (5, -1.2), " a": (6, -1.0)}, list(range(10, 266)), [b""] * 300, "unigram")
    units = ["abc", " abc", "xabcx", "é", "aabbcc", " "]
    got = pieces.encode_units(spark.createDataFrame([(u,) for u in units], "unit string"), toy).collect()
    spelt = {"xabcx", "é", " "}  # have a character without a piece
    assert {r.unit: r.ids for r in got} == {u: None if u in spelt else toy.encode_unit(u) for u in units}


def test_columnar_lattice_equals_the_merge_loop():
    table = pieces.load()
    rng = random.Random(3)
    units = ["", "\n", " ", " " * 61, "x" * 70, "日本語", "\udce4", *["".join(rng.choice(" abcdeéthinorüß中.😀") for _ in range(rng.randint(1, 64))) for _ in range(400)]]
    got = pieces.Lattice(table).encode(units)
    assert [np.frombuffer(x, "<i4").tolist() for x in got] == [table.encode_unit(u) if u else [] for u in units]


def test_relational_merges_equal_the_merge_loop(spark):
    table = pieces.load()
    rng = random.Random(4)
    units = sorted({"".join(rng.choice(" abcdethinors") for _ in range(rng.randint(1, 20))) for _ in range(60)})
    got = pieces.encode_units(spark.createDataFrame([(u,) for u in units], "unit string"), table).collect()
    assert {r.unit: r.ids for r in got} == {u: table.encode_unit(u) for u in units}


def test_pieces_of_clashing_columns_and_long_texts(spark):
    table = pieces.load()
    long = "the word goes on " * 60_000
    docs = spark.createDataFrame([(1, long, "a", [7]), (2, None, "b", None)], "doc_id long, text string, unit string, ids array<int>")
    coded = pieces.encode(docs, table, table_units=50)
    assert coded.columns == ["doc_id", "unit", "ids"]
    back = {r.doc_id: (r.unit, r.text) for r in pieces.decode(coded, table).collect()}
    assert back == {1: ("a", long), 2: ("b", "")}


# --- pipeline --------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES][1] == "simhash_near_dedup" and corpus_pipeline.ORACLE_SQL is None
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "source", "ids"] and out.count() > 0
