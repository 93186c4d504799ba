"""The registered queries on the smallest driver tables, each against plain Python over the same rows."""

import html
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pytest

from panelloom.llm.queries import ORACLE, QUERIES
from panelloom.llm.simhash import fingerprint
from tests.llm.test_imatch import digits, slow_likeness, slow_print, term_hashes
from tests.llm.test_katz import SlowKatz
from tests.llm.test_simhash import groups, slow_fingerprint

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")


def run(spark, name):
    return QUERIES[name](spark, FOLDER).collect()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").collect()


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def test_op1(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    vectors = np.array([r.embedding for r in rows], dtype=float)
    found = {}
    for r in run(spark, "op1_neighbours"):
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(found) == {int(i) for i in ids if i % 20 == 0}
    hits = 0
    for q, listed in found.items():
        score = dict(zip(ids.tolist(), (vectors @ vectors[ids == q][0]).tolist(), strict=True))
        del score[q]
        best = sorted(score, key=lambda v: (-score[v], v))[:20]
        assert sorted(listed) == list(range(1, 21))
        assert all(s == pytest.approx(score[v], abs=1e-12) for v, s in listed.values())
        hits += len(set(best) & {v for v, _ in listed.values()})
    assert hits >= 0.9 * 20 * len(found)


@pytest.mark.parametrize("name", ["op2_mixing", "op5_chat", "op11_spelling", "op12_minhash", "op13_centroids"])
def test_sql(spark, name):
    assert set(ORACLE) == {"op2_mixing", "op5_chat", "op11_spelling", "op12_minhash", "op13_centroids"}
    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    cursor = con.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    found = QUERIES[name](spark, FOLDER).select(*names).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, cursor.fetchall()))


def test_op3(spark, docs):
    df = {}
    for d in docs:
        for h in term_hashes(d.text):
            df[h] = df.get(h, 0) + 1
    lexicon = {h for h, c in df.items() if 0.01 * len(docs) <= c <= 0.3 * len(docs)}
    order = sorted(docs, key=lambda d: -d.doc_id)
    prints = {d.doc_id: slow_print(d.text, lexicon) for d in docs}
    found = {r.doc_id: r for r in run(spark, "op3_imatch")}
    assert len(found) == len(docs)
    for d, after in zip(order, [*order[1:], order[0]], strict=True):
        cut = len(d.text) // 3
        edited = slow_print(d.text[: len(d.text) - cut] + after.text[:cut], lexicon)
        r = found[d.doc_id]
        assert (r.fingerprint, r.edited_fingerprint) == (digits(prints[d.doc_id]), digits(edited))
        assert r.near_edited == pytest.approx(slow_likeness(prints[d.doc_id], edited))
        assert r.near_next == pytest.approx(slow_likeness(prints[d.doc_id], prints[after.doc_id]))


def test_op4(spark, docs):
    notice = re.compile(
        "Released under the MIT License|Licensed under the Apache License, Version 2.0|Licensed under CC BY-NC 4.0"
        "|This work is licensed under the GNU General Public License, version 3|All rights reserved"
    )
    expected = sorted((d.doc_id, m.start(), m[0]) for d in docs for m in notice.finditer(d.text))
    found = run(spark, "op4_licenses")
    assert sorted((r.doc_id, r.start, r.wording) for r in found) == expected
    assert all(r.exact and r.reduction > 0 for r in found)


def test_op6(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    found = run(spark, "op6_pages")
    assert len(found) == len(pages)
    for r in found:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        blocks = [re.sub(r"</?b>", "", b.replace("<br>", " ")) for b in re.split(r"</?(?:p|h1)>", article)]
        lines = [" ".join(html.unescape(b).split()) for b in blocks]
        assert r.text == "\n".join(x for x in lines if x)
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_op7(spark, docs):
    prints = {d.doc_id: slow_fingerprint(d.text) for d in docs}
    distinct = sorted(set(prints.values()))
    near = [
        (a, b) for i, a in enumerate(distinct) for b in distinct[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4
    ]
    root = groups(distinct, near)
    least = {}
    for i in sorted(prints, reverse=True):
        least[root[prints[i]]] = i
    found = run(spark, "op7_simhash")
    assert sorted(map(tuple, found)) == sorted(
        (i, f"{p & (2**64 - 1):016x}", least[root[p]]) for i, p in prints.items()
    )
    assert all(fingerprint(d.text) == prints[d.doc_id] for d in docs)


def test_op8(spark, docs):
    lang = {d.doc_id: d.lang for d in docs}
    found = run(spark, "op8_language")
    assert len(found) == len(docs)
    assert all(r.held_out == (crc(r.doc_id) % 3 == 1) and 0 <= r.score <= 1 for r in found)
    apart = [r for r in found if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in apart) >= 0.95 * len(apart)


def test_op9(spark, docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {d.doc_id: [*re.findall(r"[^\x20\x09-\x0D]+", d.text.translate(lower)), "\n"] for d in docs}
    model = SlowKatz([t for i, t in tokens.items() if crc(i) % 7 != 2])
    found = run(spark, "op9_katz")
    assert len(found) == len(docs)
    for r in found:
        seq = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (crc(r.doc_id) % 7 == 2, len(seq), model.n)
        assert r.n_known == sum(w in model.c1 for w in seq)
        base = sum(math.log10((model.c1[w] + 1) / (model.n + model.v + 1)) for w in seq)
        score = sum(math.log10(model.p(h, w)) for h, w in zip(["<s>", *seq], seq, strict=False))
        assert (r.base_score, r.score) == (pytest.approx(base), pytest.approx(score))
    apart = [r for r in found if r.held_out]
    assert sum(r.score for r in apart) > sum(r.base_score for r in apart)


def test_op10(spark, docs):
    found = run(spark, "op10_packing")
    words = {d.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", d.text)) for d in docs}
    per, bins, room = {}, {}, {}
    for r in sorted(found, key=lambda r: (r.bin_id, r.bin_offset)):
        per[r.doc_id] = per.get(r.doc_id, 0) + r.n_tokens
        assert r.bin_offset == bins.get(r.bin_id, 0)
        bins[r.bin_id] = r.bin_offset + r.n_tokens
        room[r.bin_id] = r.capacity
    assert per == words
    assert all(room[b] == min(c for c in (512, 1024, 2048, 4096) if c >= n) for b, n in bins.items())
