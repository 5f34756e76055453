"""The corpus pipeline: stages over ``documents``, each written as Parquet for the next.

Every stage works on all rows its predecessor kept. All but the last return the columns of
``documents``; the last adds the piece ids of the text that the mix has chosen, in its place.
SQL cannot express the stages, so ``ORACLE_SQL`` is None; each stage is tested against a plain
version of what it does.

Defined cases, for all stages: a null text is an empty one, and stays null where texts are passed on;
a null id or source is a value like any other; very long texts are read whole; repeated rows are rows
of their own, of which the near-duplicate stage keeps one; ties go to the smaller id, then to the row
read first; an empty table gives no rows; other columns, whatever their names, are passed on by all
stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kinespark.llm import mixing, nearcopies, pieces, pii, toxicity
from kinespark.llm.common import crc_mod, dropped, scratch, shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return toxicity.drop_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id.

    SimHash fingerprints that covering masks bring within 3 bits give the first candidates. Whole sets
    of five-word shingles decide: groups join texts of a Jaccard similarity of 0.8 or more, and a prefix
    filter finds those whose fingerprints lie further apart.
    """
    return nearcopies.keep_one(docs, shingle=5, least=(4, 5), radius=3)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes its kind in angle brackets."""
    return pii.mask_pii(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, ids) of every row."""
    return pieces.encode(docs.select("doc_id", "source", "text"), pieces.load())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", near_duplicates),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written to the shared folder.

    What a stage stored for itself, and what it read, is deleted once its result is written.
    """
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark).rstrip('/')}/kinespark-pipeline-{uuid.uuid4().hex}"
    before = None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}_{name}"
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            dropped(spark, before)
        before = path
    return docs
