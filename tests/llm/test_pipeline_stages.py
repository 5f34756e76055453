from __future__ import annotations

import random
import re

import pytest

import corpus_pipeline
from kinespark.llm import mixing, nearcopies, pieces, toxicity
from kinespark.llm.common import crc_mod
from test_chat_pii_simhash_mixing import brute_base

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", n) for n, (i, t) in enumerate(rows)], DOCS)


def brute_shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or (frozenset([tuple(words)]) if words else frozenset())


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def brute_groups(texts):
    """Of every text the smallest position in its group."""
    sets = [brute_shingles(t) for t in texts]
    of = {}
    for i, s in enumerate(sets):
        for x in s or [None]:
            of.setdefault(x, []).append(i)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in {j for x in s or [None] for j in of[x] if j < i}:
            if similar(s, sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))]


def planted(seed, bases=12, copies=10):
    """Texts, copies with more and more edits, a line that most share, and short texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    line = " ".join(f"common{i}" for i in range(25))
    out = []
    for b in range(bases):
        words = rng.choices(vocabulary, k=rng.choice([12, 60, 150]))
        for c in range(copies):
            copy = list(words)
            for _ in range(c * len(words) // 150):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy) + (f"\n{line}" if b % 3 else ""))
    out += [f"{line} tail{i} end{i % 4}" for i in range(40)] + [line, line.upper(), "one two", "One  TWO", "one three", "", None, " "]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed, small", [(1, 1), (2, 32)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, seed, small):
    monkeypatch.setattr(nearcopies, "PIVOTS", small)
    texts = planted(seed)
    want = sorted(set(brute_groups(texts)))
    assert 20 < len(want) < len(texts) - 40
    out = corpus_pipeline.near_duplicates(spark, docs_of(spark, enumerate(texts)), None)
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted(r.doc_id for r in out.collect()) == want


def test_near_duplicates_of_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    want = [rows[i][0] for i in sorted(set(brute_groups([t for _, t in rows])))]
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, None).collect()) == want


def test_near_duplicates_without_ids(spark):
    words = [f"v{i}" for i in range(40)]
    near = " ".join([*words[:39], "x"])
    rows = [(None, "first of no id"), (None, "second of no id"), (None, "second  OF no id"), (7, "a b c"), (7, "d e f"), (5, " ".join(words)), (7, near), (None, near)]
    out = corpus_pipeline.near_duplicates(spark, docs_of(spark, rows), None)
    kept = sorted((r.doc_id or 0, r.text) for r in out.collect())
    assert [k for k in kept if k[1].lower() != "second  of no id" and k[1] != "second of no id"] == [(0, "first of no id"), (5, " ".join(words)), (7, "a b c"), (7, "d e f")]
    assert len(kept) == 5
    assert corpus_pipeline.near_duplicates(spark, docs_of(spark, rows).limit(0), None).count() == 0


SF = "/root/testdata/sf0.001"


def test_toxic_stage_equals_scores_of_single_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(1).selectExpr("CAST(NULL AS long) doc_id", "CAST(NULL AS string) text", "lang", "source", "n_chars"))
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), crc_mod("doc_id", 5) != 0)
    rows = docs.collect()
    want = [r for r in rows if model.scores([toxicity.counts(r.text, model.matcher)])[0] < 0.5]
    got = corpus_pipeline.drop_toxic(spark, docs, SF)
    key = lambda r: (r.doc_id or -1, r.text or "")
    assert got.columns == docs.columns and sorted(map(key, got.collect())) == sorted(map(key, want)) and 0 < len(want) < len(rows)


def test_pii_stage_masks_what_the_patterns_find(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r.doc_id: r.text for r in corpus_pipeline.mask_personal_data(spark, docs, SF).collect()}
    rows = docs.collect()
    assert len(out) == len(rows)
    for r in rows:
        spans = brute_base(r.text or "")
        masked = out[r.doc_id]
        for k, found in spans.items():
            assert all(r.text[a:b] not in masked or k == "card" for a, b in found)
        if masked != r.text:  # what lies between the masks is the text's own, in order
            at = 0
            for part in re.split(r"<(?:EMAIL|IP|CARD|PHONE|IBAN|ACCOUNT|SSN|URL_LOGIN|SECRET)>", masked):
                at = r.text.index(part, at) + len(part)
        else:
            assert not any(spans.values())


def test_mixing_stage_equals_a_plain_mix(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copies = {}
    for r in mixing.mix(docs).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r.copies
    got = {}
    for r in corpus_pipeline.mix_sources(spark, docs, SF).collect():
        got[r.doc_id, r.text] = got.get((r.doc_id, r.text), 0) + 1
    assert got == {(r.doc_id, r.text): copies[r.doc_id] for r in docs.collect() if copies[r.doc_id]}


def test_pieces_stage_equals_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.encode_pieces(spark, docs, SF)
    assert {(r.doc_id, r.source): r.ids for r in out.collect()} == {(r.doc_id, r.source): model.encode(r.text or "") for r in docs.collect()}


def test_stages_of_empty_and_clashing_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 AS row", "'k' AS key", "2 AS node", "'x' AS whole", "3 AS copies", "map('a', 1) AS m")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
