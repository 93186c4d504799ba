"""A training set from raw documents: language filter, near copies out, source mix, packing.

Every stage takes the documents its predecessor kept. ``run`` stores each
stage in the shared scratch folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm import language, mixing, packing, simhash
from panelloom.llm.common import fresh, stored


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; those without a letter and ambiguous ones go.

    Ambiguous is a narrower lead than all but 0.1 % of the held out documents have that the model gets right.
    """
    apart = language.held_out(F.col("doc_id"))
    model = language.train(docs.where(~apart))
    if not model.languages and not docs.where(F.col("text").rlike(r"\p{L}")).isEmpty():
        raise ValueError("no language could be learned: no training document has a lang and a letter")
    lead = language.clean_lead(docs.where(apart), model)
    out = fresh(docs, "found_language")
    found = language.with_language(docs, model, F.col("text"), out, lead)
    known = (F.col(out)["lang"] != language.UNKNOWN) & ~F.col(out)["ambiguous"]
    return found.where(known).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group within 4 bits on 4-word shingles."""
    return simhash.keep_first(docs, shingle=4, distance=4)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come near weights 5, 2, 1, repeating."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' words in sequences of 512 to 4096."""
    return packing.pack(docs)


STAGES = [
    ("language ID", known_language),
    ("simhash near-dedup", without_near_copies),
    ("mixing sources", mixed_sources),
    ("best-fit packing", packed),
]

#: SimHash and learned models are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
