import hashlib
import random
import re
import struct

import pytest
import xxhash

from panelloom.llm import imatch
from panelloom.llm.imatch import EMPTY, LEVELS, SUBSETS

SCHEMA = "doc_id long, text string, hash string, rank int"


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def term_hashes(text):
    words = {w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w}
    return {signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words}


def array_hash(values):
    seed = EMPTY
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return signed(seed)


def slow_print(text, lexicon):
    own = term_hashes(text)
    band = sorted((own & lexicon) or own)
    out = [array_hash(band)]
    level = band
    for k in range(LEVELS):
        if k:
            level = [h for h in level if (h % 2**64) >> (18 + 2 * k) & 3 == 0]
        for i in range(SUBSETS):
            out.append(array_hash([h for h in level if (h % 2**64) >> (28 + 4 * k) & (SUBSETS - 1) == i]))
    return out


def slow_likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    told = [(x, y) for x, y in zip(a[1:], b[1:], strict=True) if (x, y) != (EMPTY, EMPTY)]
    return sum(x == y for x, y in told) / len(told) if told else 0.0


def digits(a):
    return f"{a[0] % 2**64:016x}-" + "".join(f"{x % 2**32:08x}" for x in a[1:])


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, weights=range(1, 301), k=rng.randrange(1, 120))) for _ in range(120)]
    texts += ["", " \n ", "w1", "Éa éA x", "\U0001f600" * 7, texts[3], texts[3], "w9 " * 30_000]
    ids = [3 * i for i in rng.sample(range(1000), len(texts))]
    rows = [(i, t, None, 1) for i, t in zip(ids, texts, strict=True)]
    rows += [rows[5], (None, "no id", None, 1), (10_000, None, None, 1)]
    n = len(rows)
    df = {}
    for _, t, _, _ in rows:
        for h in term_hashes(t):
            df[h] = df.get(h, 0) + 1
    lexicon = {h for h, c in df.items() if 0.01 * n <= c <= 0.3 * n}
    order = sorted({(i, t or "") for i, t, _, _ in rows}, key=lambda r: (r[0] is None, -(r[0] or 0)))
    following = {r: order[(k + 1) % len(order)] for k, r in enumerate(order)}
    expected = []
    for i, t, _, _ in rows:
        t = t or ""
        after = following[i, t][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        own, other, neighbour = (slow_print(x, lexicon) for x in (t, edited, after))
        expected.append(
            (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), digits(own), digits(other),
             slow_likeness(own, other), slow_likeness(own, neighbour))
        )
    found = [tuple(r) for r in imatch.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()]
    by = lambda r: (r[0] is None, r[0] or 0, r[2])
    for got, want in zip(sorted(found, key=by), sorted(expected, key=by), strict=True):
        assert got[:5] == want[:5]
        assert got[5:] == pytest.approx(want[5:])


def test_one_document_and_none(spark):
    one = spark.createDataFrame([(1, "abcdef", None, 1)], SCHEMA)
    row = imatch.fingerprints(one).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and row.near_next == 1.0
    assert imatch.fingerprints(one.where("false")).count() == 0
