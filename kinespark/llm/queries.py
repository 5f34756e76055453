"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, hilbert, hmm, linecrf, mixing, pieces, pii, purisk, simhash, toxicity
from .common import arrow_map, crc_mod, map_batches, sliced, stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


@query
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], rows.schema)
    formatted = chat.format_chats(rows.unionByName(extra))

    def read_back(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {k: [] for k in ("turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "turns_read")}
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            raw = text.encode()
            turns = chat.parse(raw)
            out["turns_read"].append(len(turns))
            out["turns_sha256"].append(_sha(b"".join(r.encode() + b"\n" + t + b"\n" for r, t in turns)))
            loss = b"".join(chat.unescape(raw[s["start"] : s["end"]]) for s in spans)
            out["loss_chars"].append(len(loss.decode()))
            out["loss_sha256"].append(_sha(loss))
            out["formatted_chars"].append(len(text))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(out["turns_read"], pa.int64()), pa.array(out["turns_sha256"]), pa.array(out["loss_chars"], pa.int64()), pa.array(out["loss_sha256"]), pa.array(out["formatted_chars"], pa.int64())],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return map_batches(formatted.select("conv_id", "formatted", "loss_spans"), read_back, schema)


def _sql_escape(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for c in chat.CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


ORACLE["op1_chat_format"] = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_sql_escape("text")}) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 17
      ELSE 19 + length({_sql_escape("role")}) END)::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id"""


@query
def op2_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return linecrf.apply_rules(docs, linecrf.train(docs, table(spark, sf_dir, "labels")))


@query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every whole text: digests of the ids and whether the text came back."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    make = pieces.encoder(docs, pieces.load())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = make()
        for part in (x for batch in batches for x in sliced(batch)):
            texts = part.column(1).to_pylist()
            ids = own.texts(texts)
            back = [own.table.decode(np.frombuffer(x, "<i4").tolist()) == (t or "").replace(pieces.SPACE, " ") for x, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([_sha(x) for x in ids]), pa.array(back)],
                ["doc_id", "n_pieces", "ids_sha256", "round_trip"],
            )

    return arrow_map(docs, run, "doc_id long, n_pieces long, ids_sha256 string, round_trip boolean")


@query
def op4_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hilbert.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@query
def op5_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = stored(purisk.measure(docs))
    model = purisk.train(rows, table(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)
    scored = purisk.score_rows(rows, model)
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


@query
def op9_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(table(spark, sf_dir, "documents"), crc_mod("doc_id", 10) == 0)


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.dedup_groups(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return groups.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE["op8_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    len(regexp_extract_all(coalesce(text, ''), '[!-@\[-`{-~]'))::DOUBLE / greatest(length(coalesce(text, '')), 1) AS marks FROM documents),
k AS (
  SELECT doc_id, source, size, -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || text), 1, 13))::BIGINT + 0.5e0) / 4503599627370496e0)
    / (0.1e0 + size::DOUBLE / (size::DOUBLE + 20e0) / (1e0 + 100e0 * marks * marks)) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, (1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3)::DOUBLE AS w, 3e0 * source_size AS cap FROM s),
f AS (
  SELECT *, coalesce(sum(cap) OVER b, 0e0) AS held_cap, sum(w) OVER () - coalesce(sum(w) OVER b, 0e0) AS left_w,
    sum(source_size) OVER ()::DOUBLE AS total
  FROM r WINDOW b AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, (total - held_cap) / left_w AS level, (total - held_cap) / left_w * w >= cap AS held FROM f),
t AS (
  SELECT source, source_size, CASE WHEN held THEN cap ELSE least((SELECT min_by(level, cap / w) FROM h WHERE NOT held) * w, cap) END AS target FROM h),
p AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN size > 0 AND target - epochs * source_size > 0
    AND before + size / 2e0 <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p"""
