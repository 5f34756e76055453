"""The registered queries against plain versions of what they must return."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from kinespark.llm import linecrf, pieces, queries
from test_chat_pii_simhash_mixing import brute_base

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet").collect()


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql_gives_the_same_rows(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(queries.ORACLE[name]).df()[list(got.columns)]
    key = [got.columns[0]]
    assert len(got) == len(want)
    for a, b in zip(got.sort_values(key).values.tolist(), want.sort_values(key).values.tolist()):
        assert all(x == y or (isinstance(x, float) and x == pytest.approx(y, rel=1e-9)) for x, y in zip(a, b)), (a, b)


def test_op2_counts_and_verdicts(spark):
    out = {r.doc_id: r for r in queries.op2_line_crf(spark, SF).collect()}
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    crf = linecrf.train(docs, labels)
    rows = docs.collect()
    assert len(out) == len(rows)
    for d in rows:
        text, r = d.text or "", out[d.doc_id]
        words = WORDS.findall(text)
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        repeats = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
        lines = text.split("\n")
        dup = sum(bool(WORDS.search(x)) and x in lines[:i] for i, x in enumerate(lines))
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r.n_dup_lines, r.n_repeat_words) == (dup, len(repeats))
        failed = len(words) < 20 or 100 * len(repeats) > 30 * len(words)
        assert r.base_failed == failed
        # the best of all labellings, line by line, as a dynamic programme over scores alone
        x, chars = linecrf.line_features(text, crf.shared)
        if not failed:
            best = {0: (0.0, 0.0), 1: (float(x[0] @ crf.weights), float(chars[0]))}
            for f, c in zip(x[1:], chars[1:]):
                step = lambda y: max(((best[z][0] + crf.pairs[z, y], z, best[z][1]) for z in (0, 1)))  # noqa: B023, E731
                from0, from1 = step(0), step(1)
                best = {0: (from0[0], from0[2]), 1: (from1[0] + float(f @ crf.weights), from1[2] + float(c))}
            share = max(best.values())[1] / chars.sum()
            assert r.content_share == pytest.approx(share) and r.kept == (share >= 0.5)
        else:
            assert not r.kept


def test_op3_equals_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    out = {r.doc_id: r for r in queries.op3_sentencepiece(spark, SF).collect()}
    for d in documents(spark):
        ids = np.array(model.encode(d.text or ""), "<i4")
        r = out[d.doc_id]
        assert (r.n_pieces, r.ids_sha256, r.round_trip) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), True)


def test_op4_equals_all_distances(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = set()
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if j != i][:10]
        want |= {(int(ids[i]), k, int(ids[j]), round(float(d[j]), 9)) for k, j in enumerate(order, 1)}
    got = {(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in queries.op4_hilbert(spark, SF).collect()}
    assert got == want


def test_op7_base_equals_the_patterns(spark):
    out = {r.doc_id: r for r in queries.op7_pii(spark, SF).collect()}
    for d in documents(spark):
        spans = brute_base(d.text or "")
        r = out[d.doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(spans[k]) for k in ("email", "ip", "card", "phone"))
        joined = [f"{k}:{a}:{b}" for k in ("email", "ip", "card", "phone") for a, b in spans[k]]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) <= set(r.spans.split(",") if r.spans else [])


def test_op9_base_and_held_out_likelihood(spark):
    out = {r.doc_id: r for r in queries.op9_hmm(spark, SF).collect()}
    docs = documents(spark)
    tokens = {d.doc_id: [*WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), d.text or "")), None] for d in docs}
    count = Counter(w for i, ws in tokens.items() if crc(i, 10) for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in tokens.items():
        r = out[i]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i, 10) == 0, len(ws), sum(count[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0


def flipped(spark, path, column, modulus, rest):
    """The tables, with the labels of the held-out rows turned round."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    docs.write.parquet(f"{path}/documents.parquet")
    rows = [tuple(1 - r[c] if c == column and crc(r.doc_id, modulus) == rest else r[c] for c in labels.columns) for r in labels.collect()]
    spark.createDataFrame(rows, labels.schema).coalesce(1).write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.mark.parametrize("name, column, modulus, rest, least", [("op5_pu_quality", "quality", 4, 2, 0.7), ("op10_toxicity", "toxic", 5, 0, 0.5)])
def test_classifier_queries(spark, tmp_path, name, column, modulus, rest, least):
    rows = {r.doc_id: r for r in queries.QUERIES[name](spark, "/root/testdata/sf0.01").collect()}
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    for r in rows.values():
        assert r.held_out == (crc(r.doc_id, modulus) == rest) and 0 <= r.score <= 1 and r.predicted == (r.score >= least)
    y = {r.doc_id: r[column] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if crc(r.doc_id, modulus) == rest}
    assert sum(rows[i].predicted == v for i, v in y.items()) / len(y) > 0.93
    # held-out labels teach nothing
    a = {r.doc_id: r.score for r in queries.QUERIES[name](spark, SF).collect()}
    b = {r.doc_id: r.score for r in queries.QUERIES[name](spark, flipped(spark, tmp_path, column, modulus, rest)).collect()}
    assert a.keys() == b.keys() and all(a[i] == pytest.approx(b[i], abs=1e-9) for i in a)
