"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, plus signs, dotted and joined digits, and
identifier cues such as ``IBAN`` or ``token``. From each anchor a deterministic local parser
walks outwards and decides the boundaries. Base kinds: email, ip, card, phone. Kinds added by
the method: iban, account, ssn, url_login, secret.

Offsets are code points, end exclusive. Spans of one kind never overlap; different kinds may.
Defined cases: null text is the empty text and has no span; repeated rows each get a row; an
empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

DIGITS = "0123456789"
_DIGIT = frozenset(DIGITS)
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + DIGITS)
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | frozenset("-")
_PHONE = _DIGIT | frozenset(" ().-")
_SECRET = _ALNUM | frozenset("_-+/=.")
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "account", "ssn", "url_login", "secret")
KINDS = BASE + ADDED
#: cues, matched in the case given and in upper case
CUES = {
    "account": ("account number", "Account number", "account no", "Account no", "acct", "Kontonummer", "routing number"),
    "ssn": ("SSN", "Social Security", "social security"),
    "iban": ("IBAN",),
    "secret": ("token", "api_key", "apikey", "api key", "secret", "password", "passwd"),
}

_machine = None


def automaton() -> ahocorasick.Automaton:
    """Built once in each worker."""
    global _machine
    if _machine is None:
        a = ahocorasick.Automaton()
        for kind, cues in CUES.items():
            for cue in cues:
                a.add_word(cue, (kind, len(cue)))
                a.add_word(cue.upper(), (kind, len(cue)))
        a.add_word("@", ("email", 1))
        a.add_word("+", ("phone", 1))
        a.add_word("://", ("url_login", 3))
        for x in DIGITS:
            for y in DIGITS:
                a.add_word(f"{x}.{y}", ("ip", 3))
                a.add_word(f"{x}{y}", ("card", 2))
                a.add_word(f"{x} {y}", ("card", 3))
                a.add_word(f"{x}-{y}", ("card", 3))
        a.make_automaton()
        _machine = a
    return _machine


def _run(text: str, at: int, allowed: frozenset[str]) -> int:
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    begin = at
    while begin > floor and text[begin - 1] in _LOCAL:
        begin -= 1
    end = _run(text, at + 1, _LABEL)
    if begin == at or end == at + 1:
        return None
    dots = 0
    while end < len(text) and text[end] == ".":
        stop = _run(text, end + 1, _LABEL)
        if stop == end + 1:
            break
        end, dots = stop, dots + 1
    return (begin, end) if dots else None


def _dotted(text: str, at: int, floor: int) -> tuple[list[tuple[int, int]], int]:
    """The matches of four dotted numbers in the chain around ``at``, and the chain's end."""
    begin = at
    while begin > floor and (text[begin - 1] in _DIGIT or (text[begin - 1] == "." and begin - 1 > floor and text[begin - 2] in _DIGIT)):
        begin -= 1
    runs = []
    while True:
        end = _run(text, begin, _DIGIT)
        runs.append((begin, end))
        if end + 1 < len(text) and text[end] == "." and text[end + 1] in _DIGIT:
            begin = end + 1
        else:
            break
    found = []
    for k in range(0, len(runs) - 3, 4):
        if all(int(text[a:b].lstrip("0")[:4] or "0") <= 255 for a, b in runs[k : k + 4]):
            found.append((runs[k][0], runs[k + 3][1]))
    return found, end


def _joined(text: str, at: int, floor: int) -> tuple[int, int]:
    """The longest run of digits around ``at`` joined by single blanks or hyphens."""
    begin = at
    while begin > floor:
        if text[begin - 1] in _DIGIT:
            begin -= 1
        elif text[begin - 1] in " -" and begin - 1 > floor and text[begin - 2] in _DIGIT:
            begin -= 2
        else:
            break
    end, n = begin + 1, len(text)
    while end < n:
        if text[end] in _DIGIT:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in _DIGIT:
            end += 2
        else:
            break
    return begin, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _phone(text: str, at: int) -> tuple[int, int] | None:
    """``at`` is a plus sign; the widest run that ends in a digit."""
    if at + 1 >= len(text) or text[at + 1] not in _DIGIT:
        return None
    end = _run(text, at + 2, _PHONE)
    while end > at + 2 and text[end - 1] not in _DIGIT:
        end -= 1
    return (at, end) if end >= at + 4 else None


def _after_cue(text: str, at: int) -> int:
    """Past quotes, blanks and the signs that join a cue to its value."""
    while at < len(text) and text[at] in " \t\"':=#.":
        at += 1
    return at


def _iban(text: str, at: int) -> tuple[int, int] | None:
    at = _after_cue(text, at)
    head = text[at : at + 4]
    if len(head) < 4 or not (head[:2].isascii() and head[:2].isalpha() and head[:2].isupper() and set(head[2:]) <= _DIGIT):
        return None
    end, n = at + 4, 4
    while end < len(text) and n < 34:
        if text[end] in _ALNUM and not text[end].islower():
            end, n = end + 1, n + 1
        elif text[end] == " " and end + 1 < len(text) and text[end + 1] in _ALNUM and not text[end + 1].islower():
            end += 1
        else:
            break
    body = text[at:end].replace(" ", "")
    moved = body[4:] + body[:4]
    ok = len(body) >= 15 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1
    return (at, end) if ok else None


def _numbered(text: str, at: int, least: int, most: int) -> tuple[int, int] | None:
    at = _after_cue(text, at)
    if at >= len(text) or text[at] not in _DIGIT:
        return None
    begin, end = _joined(text, at, at)
    digits = sum(c in _DIGIT for c in text[begin:end])
    return (begin, end) if least <= digits <= most else None


def _secret(text: str, at: int) -> tuple[int, int] | None:
    begin = _after_cue(text, at)
    if begin == at:
        return None
    end = _run(text, begin, _SECRET)
    while end > begin and text[end - 1] == ".":
        end -= 1
    body = text[begin:end]
    return (begin, end) if len(body) >= 16 and any(c in _DIGIT for c in body) and any(c.isalpha() for c in body) else None


def _login(text: str, at: int) -> tuple[int, int] | None:
    """``at`` follows ``://``; user information in front of an at-sign."""
    end = at
    while end < len(text) and not text[end].isspace() and text[end] not in "/?#@\"'<>":
        end += 1
    return (at, end) if at < end < len(text) and text[end] == "@" else None


def find(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans of every kind, sorted."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return spans
    floor = dict.fromkeys(KINDS, 0)
    for last, (kind, size) in automaton().iter(text):
        begin = last - size + 1
        if begin < floor[kind]:
            continue
        got: tuple[int, int] | None = None
        if kind == "card":
            got = _joined(text, begin, floor["card"])
            floor["card"] = got[1]
            digits = "".join(c for c in text[got[0] : got[1]] if c in _DIGIT)
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans["card"].append(got)
            continue
        if kind == "ip":
            found, floor["ip"] = _dotted(text, begin, floor["ip"])
            spans["ip"].extend(found)
            continue
        if kind == "phone":
            got = _phone(text, begin)
            if got:
                floor["phone"] = got[1]
                if 9 <= sum(c in _DIGIT for c in text[got[0] : got[1]]) <= 15:
                    spans["phone"].append(got)
            continue
        if kind == "email":
            got = _email(text, begin, floor["email"])
        elif kind == "iban":
            got = _iban(text, last + 1)
        elif kind == "account":
            got = _numbered(text, last + 1, 6, 20)
        elif kind == "ssn":
            got = _numbered(text, last + 1, 9, 9)
        elif kind == "secret":
            got = _secret(text, last + 1)
        elif kind == "url_login":
            got = _login(text, last + 1)
        if got and got[0] >= floor[kind]:
            spans[kind].append(got)
            floor[kind] = got[1]
    return spans


def join_spans(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def mask(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlaps merge."""
    if not text:
        return text
    flat = sorted((a, -b, k) for k, s in find(text).items() for a, b in s)
    out, at = [], 0
    for a, b, k in flat:
        b = -b
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, n_<base kind>..., base_sha256, spans) for every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: dict[str, list] = {f"n_{k}": [] for k in BASE} | {"base_sha256": [], "spans": []}
        for text in batch.column(1).to_pylist():
            spans = find(text)
            for k in BASE:
                cols[f"n_{k}"].append(len(spans[k]))
            cols["base_sha256"].append(hashlib.sha256(join_spans(spans, BASE).encode()).hexdigest())
            cols["spans"].append(join_spans(spans, KINDS))
        return pa.RecordBatch.from_pydict({"doc_id": batch.column(0), **cols})

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text")), run, schema)


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with the text masked; columns and rows stay, null texts stay null."""
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        masked = pa.array([mask(t) for t in batch.column(at).to_pylist()], pa.string())
        return batch.set_column(at, batch.schema.field(at).with_type(pa.string()), masked)

    return map_batches(docs, run, docs.schema)
