"""The pipeline on a small corpus against plain Python, and the guard around the whole part."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelloom.llm.simhash import fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    words = [f"word{rng.randrange(10**6)}" for _ in range(3000)]
    rows = []
    for i in range(120):
        rows.append([i, " ".join(rng.choices(words, k=rng.randrange(20, 300))), "en", f"src{i % 4}"])
    for i in range(120, 150):
        rows.append([i, rows[i - 120][1], "en", "src0"])
    for i in range(150, 160):
        rows.append([i, "12 34 -- !!", "en", "src1"])
    rows.append([160, None, None, None])
    path = str(tmp_path_factory.mktemp("corpus"))
    frame = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
    frame.write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    (_, language), (_, dedup), (_, mix), (_, pack) = corpus_pipeline.STAGES
    known = language(spark, docs, folder)
    assert known.columns == docs.columns
    assert {r.doc_id for r in known.collect()} == set(range(150))
    single = dedup(spark, known, folder)
    assert single.columns == docs.columns
    texts = {r.doc_id: r.text for r in known.collect()}
    prints = {i: fingerprint(t) for i, t in texts.items()}
    kept = {r.doc_id for r in single.collect()}
    least = {}
    for i in sorted(prints):
        near = [r for r in least.values() if ((prints[r] ^ prints[i]) & (2**64 - 1)).bit_count() <= 4]
        least[i] = min([i, *near])
    assert kept == set(least.values()) == set(range(120))
    mixed = mix(spark, single, folder)
    assert mixed.columns == docs.columns
    packed = pack(spark, mixed, folder).collect()
    assert sum(r.n_tokens for r in packed) == sum(len(r.text.split()) for r in mixed.collect())


def test_run_agrees_with_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, docs.collect()))


def test_stages_keep_clashing_columns_and_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 30 or doc_id = 160")
    for name in ("found_language", "Simhash_ID", "simhash_rows", "mix_source", "mix_rate", "mix_copy", "size", "fp"):
        docs = docs.selectExpr("*", f"doc_id as `{name}`")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert all(r.mix_rate == r.doc_id == r.Simhash_ID for r in out.collect())
        assert stage(spark, docs.where("false"), folder).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == 31


def test_language_stage_decides(spark):
    rng = random.Random(4)
    make = lambda syllables, n: " ".join("".join(rng.choices(syllables, k=3)) for _ in range(n))
    kinds = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ein", "pf"], "cc": ["eau", "que", "oir", "ais"]}
    rows = [(i, make(kinds["abc"[i % 3] * 2], 60), "abc"[i % 3] * 2) for i in range(300)]
    mixed = [" ".join(make(k, 20) for k in kinds.values()) for _ in range(10)]
    noise = ["".join(chr(rng.randrange(0x391, 0x3C9)) if rng.random() < 0.8 else " " for _ in range(400)) for _ in range(10)]
    rows += [(1000 + i, x, None) for i, x in enumerate(mixed + noise)]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA)
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, docs, "").collect()}
    assert len(kept & set(range(300))) >= 297 and not kept & set(range(1000, 1020))
    with pytest.raises(ValueError, match="no language"):
        corpus_pipeline.known_language(spark, docs.withColumn("lang", F.lit(None).cast("string")), "")
