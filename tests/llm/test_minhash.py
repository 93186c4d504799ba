import random

import numpy as np
import pytest

from panelloom.llm import minhash
from panelloom.llm.minhash import Signature, minhash_components, orders_for, set_key, shingles, similar
from tests.llm.test_simhash import groups

SCHEMA = "doc_id long, text string, n int, key string, comp int"


def slow_set(text, size=5):
    flat = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        flat = flat.replace(c, " ")
    words = [w for w in flat.split(" ") if w]
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def slow(rows, percent, size=5):
    """(doc_id, n_shingles, component_id, kept) by all pairs."""
    sets = [slow_set(r[1], size) for r in rows]
    near = [
        (i, j)
        for i, a in enumerate(sets)
        for j, b in enumerate(sets[:i])
        if a and b and 100 * len(a & b) >= percent * len(a | b)
    ]
    root = groups(list(range(len(rows))), near)
    ids = {}
    for i, r in enumerate(rows):
        ids.setdefault(root[i], []).append(r[0])
    least = {g: min((i for i in found if i is not None), default=None) for g, found in ids.items()}
    return sorted(((r[0], len(sets[i]), c := least[root[i]], r[0] == c) for i, r in enumerate(rows)), key=str)


def found(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 1, "k", 2) for i, t in rows], SCHEMA)
    return sorted(map(tuple, minhash_components(docs, **options).collect()), key=str)


def chains(seed, groups_, members, changes, words=120):
    """Groups of texts, each text a few changed words away from another one of its group."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for _ in range(groups_):
        group = [[word() for _ in range(words)]]
        for _ in range(members - 1):
            text = list(rng.choice(group))
            for _ in range(rng.randint(0, changes)):
                text[rng.randrange(words)] = word()
            group.append(text)
        texts += [" ".join(t) for t in group]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("percent, block", [(85, 256), (80, 256), (85, 4), (95, 8)])
def test_against_brute_force(spark, monkeypatch, percent, block):
    monkeypatch.setattr(minhash, "BLOCK", block)  # small: regions cut, ordered deeper, compared in block pairs
    rows = chains(percent, 6, 25, 4)
    expected = slow(rows, percent)
    assert 6 < len({r[2] for r in expected}) < len(rows)
    assert found(spark, rows, percent=percent) == expected


def test_a_dense_region_that_is_not_connected(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):  # all alike to 70 to 90 %, few linked at 92 %
        text = list(base)
        for at in rng.sample(range(300), 4):
            text[at] = f"x{i}y{at}" if i % 3 else f"x{at % 4}"
        rows.append((i, " ".join(text)))
    expected = slow(rows, 92)
    assert len({r[2] for r in expected}) > 20
    assert found(spark, rows, percent=92) == expected


def test_the_last_step_alone_finds_all(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "DEEPER", 1)  # regions of more than 16 are ordered anew
    rows = chains(7, 4, 25, 4)
    alone = lambda self: self._in_blocks(self.members.where("false").withColumn("comp", minhash.F.col("key")))
    monkeypatch.setattr(minhash._Forest, "connect_homes", lambda self: self.confirm(alone(self)))
    monkeypatch.setattr(minhash._Forest, "bridge", lambda self: None)
    assert found(spark, rows, percent=85) == slow(rows, 85)


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [
        (5, text), (3, text.upper()), (3, text.upper()), (9, text.replace("w7 ", "")), (1, None), (2, ""), (4, " \t\n"),
        (6, "one two"), (7, "One\ttwo"), (8, "one two three"), (None, "a b c d e f"), (None, "a b c d e f"),
        (None, text), (10, "same " * 30_000), (11, "same " * 9), (12, "É é"), (13, "é é"),
        (14, " ".join(f"v{i % 20_000}" for i in range(60_000))), (15, " ".join(f"v{i % 20_000}" for i in range(50_000))),
    ]
    expected = slow(rows, 85)
    assert found(spark, rows, percent=85) == expected
    assert {r[0]: r[2] for r in expected}[9] == 3
    assert found(spark, [], percent=85) == []
    assert found(spark, [(1, None), (None, " ")], percent=85) == [(1, 0, 1, True), (None, 0, None, True)]
    assert found(spark, [(1, "only")], percent=85) == [(1, 1, 1, True)]


def test_links_are_confirmed_exactly():
    whole = " ".join(str(i) for i in range(204))  # 200 shingles
    a = shingles(whole)
    near = [shingles(" ".join(str(i) for i in range(k, 204))) for k in (30, 31)]
    assert [len(a), len(near[0])] == [200, 170]
    assert similar(a, near[0], 85) and not similar(a, near[1], 85)
    assert set_key(a) != set_key(near[0]) and set_key(a) == set_key(shingles(whole))


def test_similar_texts_share_a_region():
    orders = orders_for(85, 4, 1e-5)
    assert 1 - (1 - 0.85**4) ** orders >= 1 - 1e-5 > 1 - (1 - 0.85**4) ** (orders - 1)
    signature = Signature(orders, 4)
    rng = np.random.default_rng(0)
    shared = 0
    for _ in range(400):
        both = np.unique(rng.integers(0, 1 << 63, 400, np.uint64))
        a, b = both[:370], both[30:]  # 340 of 400 in common
        heads = [signature.of(x)[0] for x in (a, b)]
        shared += sum(x == y for x, y in zip(*heads, strict=True))
    assert shared / (400 * orders) == pytest.approx(0.85**4, abs=0.03)
