from __future__ import annotations

import hashlib
import random
import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from kinespark.llm import chat, mixing, pii, queries, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, key string, p string, size string"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", s, 1, "x", "y", "z", "w") for i, t, s in rows], DOCS)


# --- chat ----------------------------------------------------------------------------------

PIECES = [*chat.CONTROLS, "\\", "<", "/", "s>", "[", "INST", "]", "SYS", "é", "\n", " ", "a", "<\\s>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool", "[ROLE] \\x"]), st.lists(st.sampled_from(PIECES), max_size=8).map("".join)), max_size=6))
def test_chat_frames_read_back(turns):
    raw = b""
    for role, text in turns:
        head, foot = chat.frame_of(role)
        raw += head + chat.escape(text).encode() + foot
    assert chat.parse(raw) == [(r, t.encode()) for r, t in turns]


def test_chat_operator_edges(spark):
    rows = [
        (1, 1, "assistant", "b</s>", 9), (1, 0, "user", None, 9), (1, 1, "assistant", "a\\", 9), (1, 1, "assistant", "a\\", 9),
        (2, None, None, "x" * 3_000_000 + "é", 9), (None, 3, "system", "", 9), (3, 0, "tool", "[/ROLE]", 9),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    out = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert set(out) == {1, 2, 3, None}
    one = out[1].formatted.encode()
    assert chat.parse(one) == [("user", b""), ("assistant", b"a\\"), ("assistant", b"a\\"), ("assistant", b"b</s>")]
    assert [chat.unescape(one[s.start : s.end]) for s in out[1].loss_spans] == [b"a\\", b"a\\", b"b</s>"]
    assert chat.parse(out[2].formatted.encode())[0][0] == ""
    assert len(out[2].formatted) > 3_000_000
    assert chat.parse(out[3].formatted.encode()) == [("tool", b"[/ROLE]")]
    assert chat.parse(out[None].formatted.encode()) == [("system", b"")]
    assert chat.format_chats(df.limit(0)).count() == 0


# --- personal data ---------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_base(text):
    digits = lambda x: re.sub(r"[^0-9]", "", x)
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15],
    }


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="0123459@.+- ()ab_é", max_size=60))
def test_pii_base_equals_patterns(text):
    got = pii.find(text)
    assert {k: got[k] for k in pii.BASE} == brute_base(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111111111111111", "+1 (482) 555-7163", "a.b@c.de", "1.2.3.4", "255.255.255.255.1", "300.1.1.1", " ", "-", ".", "x", "@", "+"]), max_size=8).map("".join))
def test_pii_base_on_planted_pieces(text):
    got = pii.find(text)
    assert {k: got[k] for k in pii.BASE} == brute_base(text)


def test_pii_added_kinds():
    text = 'IBAN DE89 3704 0044 0532 0130 00 ok; SSN: 123-45-6789; token = "1eb9c654e721b4f812088970e66a6345"; http://me:pw@host/x; account number 12345678.'
    got = {k: [text[a:b] for a, b in v] for k, v in pii.find(text).items() if v}
    assert got["iban"] == ["DE89 3704 0044 0532 0130 00"]
    assert got["ssn"] == ["123-45-6789"]
    assert got["secret"] == ["1eb9c654e721b4f812088970e66a6345"]
    assert got["url_login"] == ["me:pw"]
    assert got["account"] == ["12345678"]


def test_pii_operator_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "x@y.zz", None), (3, "x@y.zz", "a"), (3, "x@y.zz", "a"), (4, "é " * 200_000 + "q@w.ee", "a")]
    df = docs_of(spark, rows)
    out = pii.find_pii(df).collect()
    assert len(out) == 6
    by = {r.doc_id: r for r in out}
    assert by[1].spans == by[2].spans == "" and by[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[4].spans == "email:400000:400006"
    assert by[None].n_email == 1
    masked = {r.doc_id: r.text for r in pii.mask_pii(df).collect()}
    assert masked[1] is None and masked[2] == "" and masked[3] == "<EMAIL>"
    assert pii.mask_pii(df).columns == df.columns
    assert pii.find_pii(df.limit(0)).count() == 0


def test_pii_long_login_and_wide_padding():
    login = "me:" + "aB3._-" * 500
    text = f"https://{login}@host/x account number:{' ' * 40}12345678, token = {' ' * 30}1eb9c654e721b4f812088970e66a6345"
    got = {k: [text[a:b] for a, b in v] for k, v in pii.find(text).items()}
    assert got["url_login"] == [login]
    assert got["account"] == ["12345678"] and got["secret"] == ["1eb9c654e721b4f812088970e66a6345"]
    assert login not in pii.mask(text)
    assert pii.find("://" + "a" * 300 + "/b@c")["url_login"] == []


# --- simhash -----------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, radius=3):
    fps = [f for _, f in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(rows))]


def test_masks_cover_the_radius():
    rng = random.Random(1)
    for family in range(3):
        masks = simhash.covering_masks(3, family)
        assert len(masks) == 15
        for _ in range(3000):
            diff = sum(1 << b for b in rng.sample(range(64), 3))
            assert any((m & diff) == 0 for m in [x % 2**64 for x in masks])


def test_simhash_query_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = [(d, brute_fingerprint(t)) for d, t in docs]
    want = {d: (f"{f:016x}", c) for (d, f), c in zip(rows, brute_components(rows))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op6_simhash"](spark, sf_dir).collect()}
    assert got == want


@pytest.mark.parametrize("bucket_rows", [4, 2048])
def test_links_of_a_crowded_ball(spark, bucket_rows):
    """Many fingerprints within a few bits: large buckets are dealt again, no link is lost."""
    rng = random.Random(3)
    fps = {0, (1 << 64) - 1}
    for centre in (0x0F0F_1234_5678_9ABC, 0xF000_1111_2222_3333):
        for _ in range(150):
            x = centre
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 5, 7])):
                x ^= 1 << b
            fps.add(x)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in sorted(fps)]
    nodes = spark.createDataFrame(signed, "fp long")
    found = simhash.components(simhash.links(nodes, 3, bucket_rows)).collect()
    root = {r.node % 2**64: r.root % 2**64 for r in found}
    order = sorted(fps)
    want = brute_components([(i, f) for i, f in enumerate(order)])
    groups, expected = {}, {}
    for i, f in enumerate(order):
        groups.setdefault(root.get(f, f), set()).add(f)
        expected.setdefault(want[i], set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_simhash_edges(spark):
    rows = [(5, None, "a"), (4, "", None), (7, "one two", "a"), (7, "One  TWO", "a"), (None, "one two", "a"), (8, "w " * 300_000, "a")]
    df = docs_of(spark, rows)
    out = sorted((r.doc_id or -1, r.component_id) for r in simhash.dedup_groups(df).collect())
    assert out == [(-1, 7), (4, 4), (5, 4), (7, 7), (7, 7), (8, 8)]
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [4, 7, 8]
    assert simhash.dedup_groups(df.limit(0)).count() == 0


def test_keep_one_tells_rows_apart(spark):
    """Texts without an id, and other texts that share one, are rows of their own."""
    rows = [(None, "first of no id", "a"), (None, "second of no id", "a"), (None, "third  one", "a"), (None, "Third one", "b"), (7, "a b c", "a"), (7, "d e f", "a"), (5, "x y z", "a"), (7, "x Y z", "a")]
    out = sorted(((r.doc_id or 0), r.text.lower().replace("  ", " ")) for r in simhash.keep_one(docs_of(spark, rows)).collect())
    assert out == [(0, "first of no id"), (0, "second of no id"), (0, "third one"), (5, "x y z"), (7, "a b c"), (7, "d e f")]


# --- mixing ------------------------------------------------------------------------------------


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    left, total, out = set(order), float(sum(sizes.values())), {}
    while left:
        share = total / sum(weight[s] for s in left)
        over = {s for s in left if share * weight[s] > 3 * sizes[s]}
        if not over:
            out |= {s: share * weight[s] for s in left}
            break
        for s in over:
            out[s] = 3.0 * sizes[s]
            total -= out[s]
        left -= over
    return out


def test_mixing_targets_and_budgets(spark):
    rng = random.Random(5)
    rows = []
    for i in range(4000):
        s = rng.choice(["hot"] * 12 + ["b", "c", None, "tiny"] if i % 40 else ["tiny2", "d"])
        rows.append((i, " ".join("w" for _ in range(rng.randint(0, 30))), s))
    rows += [(9000, "x y z", "hot")] * 3 + [(None, "x y", "b"), (9001, None, "b")]
    df = docs_of(spark, rows)
    out = mixing.mix(df, bins=16).collect()
    assert len(out) == len(rows)
    sizes, taken = {}, {}
    for r in out:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
        assert 0 <= r.copies <= 3
    want = brute_targets(sizes)
    for r in out:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-9)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 16
    again = mixing.mix(df.repartition(7), bins=16).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.copies)
    assert sorted(map(key, out)) == sorted(map(key, again))
    rows_out = mixing.mixed_documents(df, bins=16)
    assert rows_out.columns == df.columns
    assert rows_out.count() == sum(r.copies for r in out)
    assert mixing.mix(df.limit(0)).count() == 0


@pytest.mark.parametrize("id_", [7, None])
def test_mixing_takes_equal_rows_one_by_one(spark, id_):
    """A source of one document many times over gives as many words as its target."""
    same = " ".join("w" * 100)
    rows = [(id_, same, "a")] * 1000 + [(i, " ".join("v" * 100), "b") for i in range(1000)]
    df = docs_of(spark, rows).repartition(5)
    out = mixing.mix(df).collect()
    taken = {s: sum(r.size * r.copies for r in out if r.source == s) for s in "ab"}
    target = {r.source: r.target for r in out}
    assert target["a"] == pytest.approx(200_000 / 3)
    assert all(abs(taken[s] - target[s]) <= 100 for s in "ab")
    assert mixing.mixed_documents(df).where("source = 'a'").count() * 100 == taken["a"]


def test_mixing_weighs_by_quality(spark):
    prose, junk = "plain words that say something to the reader of this text " * 3, "$$ ## 12 %% 99 && ** || 77 <> 31 ## $$ 55 !! ?? 11 22 33 44 55 " * 2
    rows = [(i, prose if i % 2 else junk, "a") for i in range(600)] + [(1000 + i, prose, "b") for i in range(600)]
    out = mixing.mix(docs_of(spark, rows)).where("source = 'a'").collect()
    share = [sum(r.copies for r in out if r.doc_id % 2 == k) for k in (0, 1)]
    assert share[1] > 2 * share[0] > 0
