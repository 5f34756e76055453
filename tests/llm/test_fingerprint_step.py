from __future__ import annotations

import re

import xxhash

import corpus_pipeline
from kinespark.llm import nearcopies
from test_chat_pii_simhash_mixing import brute_components
from test_pipeline_stages import brute_groups, docs_of, planted


def brute_fingerprint(text):
    """Of five-word shingles, repeats included."""
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    grams = [" ".join(words[i : i + 5]) for i in range(len(words) - 4)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    out = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return out - (1 << 64) if out >> 63 else out


def close_copies(seed):
    """Planted texts and long ones of which a few words are changed, so that few bits differ."""
    out = planted(seed, bases=6)
    for b in range(4):
        words = [f"long{b}x{i % 700}" for i in range(1500)]
        for c in range(5):
            words[c * 300] = f"other{c}"
            out.append(" ".join(words))
    return out + ["tail " * 30, "tail " * 40]


def test_stage_takes_its_first_candidates_from_fingerprints(spark, monkeypatch):
    """The step sees the fingerprint of every text, and the stage links what its pairs lead to."""
    seen = {}

    def spied(rows, radius, real=nearcopies.by_fingerprint):
        pairs = real(rows, radius)
        seen.update(radius=radius, rows=[(r.row, r.node, r.fp) for r in rows.select("row", "node", "fp").collect()], pairs=[tuple(r) for r in pairs.select("a", "b").collect()])
        return pairs

    monkeypatch.setattr(nearcopies, "by_fingerprint", spied)
    texts = close_copies(3)
    out = corpus_pipeline.near_duplicates(spark, docs_of(spark, enumerate(texts)), None)
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(brute_groups(texts)))
    assert seen["radius"] == 3
    assert sorted(fp for _, _, fp in seen["rows"]) == sorted(map(brute_fingerprint, texts))

    # nodes that hang together by pairs are those that brute force over all fingerprints joins
    node_fp = sorted({(node, fp) for _, node, fp in seen["rows"]})
    names = [node for node, _ in node_fp]
    low = dict(enumerate(brute_components([(i, fp) for i, (_, fp) in enumerate(node_fp)])))
    ends = {}
    for i, node in enumerate(names):
        ends.setdefault(node, []).append(low[i])
    groups = {node: node for node in names}

    def find(x):
        while groups[x] != x:
            x = groups[x]
        return x

    for a, b in seen["pairs"]:
        assert a < b
        groups[find(b)] = find(a)
    want = {x: x for x in low.values()}

    def top(x):
        while want[x] != x:
            x = want[x]
        return x

    for found in ends.values():
        for x in found:
            want[top(x)] = top(found[0])
    parts = lambda of: sorted(sorted(v) for v in of.values())
    got, expected = {}, {}
    for node in ends:
        got.setdefault(find(node), []).append(node)
        expected.setdefault(top(ends[node][0]), []).append(node)
    assert parts(got) == parts(expected) and 8 < len(seen["pairs"]) < len(texts) and len(got) < len(ends)


def test_buckets_leave_out_what_fingerprints_have_linked(spark, monkeypatch):
    """Pairs of the forest join nodes that are not linked yet."""
    texts = close_copies(4)
    given = []

    def kept(pairs, nodes, least, real=nearcopies._possible):
        given.append(pairs.count())
        return real(pairs, nodes, least)

    monkeypatch.setattr(nearcopies, "_possible", kept)
    docs = docs_of(spark, enumerate(texts))
    corpus_pipeline.near_duplicates(spark, docs, None)
    first, forest = given[:2]
    given.clear()
    monkeypatch.setattr(nearcopies, "by_fingerprint", lambda rows, radius: rows.selectExpr("node AS a", "node AS b").limit(0))
    out = corpus_pipeline.near_duplicates(spark, docs, None)
    assert first > 0 and forest < given[1]
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(brute_groups(texts)))
