"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm import centroids, chat, imatch, katz, language, licenses, minhash, mixing
from panelloom.llm import neighbours, packing, pages, spelling
from panelloom.llm.simhash import simhash_components


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = chat.linked(chat.as_events(turns), chat.ANSWER)
    return found.withColumn("problems", F.array_join("problems", "; "))


def op6_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    apart = language.held_out(F.col("doc_id"))
    model = language.train(docs.where(~apart))
    found = language.with_language(docs, model, F.col("text"), "found")
    return found.select(
        "doc_id",
        apart.alias("held_out"),
        F.col("found.lang").alias("lang_pred"),
        F.col("found.score").alias("score"),
        F.col("found.ambiguous").alias("ambiguous"),
    )


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    apart = language.held_out(F.col("doc_id"), 7, 2)
    return katz.scores(table(spark, sf_dir, "documents"), apart)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents"), drop_one_in=97))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_components(table(spark, sf_dir, "documents"), percent=85)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_neighbours": op1_neighbours,
    "op2_mixing": op2_mixing,
    "op3_imatch": op3_imatch,
    "op4_licenses": op4_licenses,
    "op5_chat": op5_chat,
    "op6_pages": op6_pages,
    "op7_simhash": op7_simhash,
    "op8_language": op8_language,
    "op9_katz": op9_katz,
    "op10_packing": op10_packing,
    "op11_spelling": op11_spelling,
    "op12_minhash": op12_minhash,
    "op13_centroids": op13_centroids,
}

ORACLE = {
    "op2_mixing": mixing.MIXED_SQL.format(docs="documents"),
    "op5_chat": chat.LINKED_SQL,
    "op11_spelling": spelling.SPELLING_SQL,
    "op12_minhash": minhash.MINHASH_SQL,
    "op13_centroids": centroids.cluster_sql(),
}
