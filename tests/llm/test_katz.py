import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from panelloom.llm import katz

SCHEMA = "doc_id long, text string, out boolean, word string, n int"


class SlowKatz:
    def __init__(self, docs):
        self.c1 = collections.Counter(w for d in docs for w in d)
        self.c2 = collections.Counter()
        for d in docs:
            self.c2.update(zip(["<s>", *d], d, strict=False))
        self.ch = collections.Counter()
        self.after = collections.defaultdict(list)
        for (h, w), n in self.c2.items():
            self.ch[h] += n
            self.after[h].append((w, n))
        self.n, self.v = sum(self.c1.values()), len(self.c1)
        k1 = katz.good_turing(collections.Counter(self.c1.values()))
        self.k2 = katz.good_turing(collections.Counter(self.c2.values()))
        kept = sum(self.keep(k1, c) * c for c in self.c1.values()) / self.n if self.n else 0
        shrink = self.n / (self.n + 1) if kept > 1 - 1e-12 else 1
        self.p1 = {w: shrink * self.keep(k1, c) * c / self.n for w, c in self.c1.items()}
        self.unknown = 1 - sum(self.p1.values())

    @staticmethod
    def keep(table, c):
        return table[c] if c <= katz.DEEPEST else 1.0

    def uni(self, w):
        return self.p1.get(w, self.unknown)

    def p(self, h, w):
        if h not in self.after:
            return self.uni(w)
        kept = sum(self.keep(self.k2, n) * n for _, n in self.after[h]) / self.ch[h]
        shrink = self.ch[h] / (self.ch[h] + 1) if kept > 1 - 1e-12 else 1
        if n := self.c2.get((h, w)):
            return shrink * self.keep(self.k2, n) * n / self.ch[h]
        return (1 - kept * shrink) / (1 - sum(self.uni(x) for x, _ in self.after[h])) * self.uni(w)


def check(spark, rows, monkeypatch, block=40, part=60):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", block)
    monkeypatch.setattr(katz, "PART_TOKENS", part)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = katz.scores(docs, F.col("out")).collect()
    tokens = lambda t: [*(t or "").lower().split(), "\n"]
    model = SlowKatz([tokens(t) for _, t, out, _, _ in rows if not out])
    for h in ["<s>", "\n", *list(model.after)[:20], "never seen"]:
        assert sum(model.p(h, w) for w in [*model.c1, None]) == pytest.approx(1)
    expected = []
    for i, t, out, _, _ in rows:
        seq = tokens(t)
        base = sum(math.log10((model.c1[w] + 1) / (model.n + model.v + 1)) for w in seq)
        score = sum(math.log10(model.p(h, w)) for h, w in zip(["<s>", *seq], seq, strict=False))
        known = sum(w in model.c1 for w in seq)
        expected.append((i, bool(out), len(seq), known, model.n, base, score))
    by = lambda r: (r[0] is None, r[0] or 0, r[6])
    for got, want in zip(sorted(map(tuple, found), key=by), sorted(expected, key=by), strict=True):
        assert got[:5] == want[:5]
        assert got[5:] == pytest.approx(want[5:], rel=1e-9)


def test_scores(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    rows = [
        (i, " ".join(rng.choices(words, weights=[1000 / (k + 1) ** 1.2 for k in range(60)], k=rng.randrange(0, 30))), i % 5 == 1, "x", 1)
        for i in range(200)
    ]
    rows += [(500, None, True, None, None), (None, "W1 w2\tnew", True, None, None), (7, "w1 w1", False, "x", 1)] * 2
    check(spark, rows, monkeypatch)


def test_histories_without_discount_or_training(spark, monkeypatch):
    check(spark, [(1, "a a a a a a a a", False, None, 1), (2, "a b", True, None, 1)], monkeypatch)
    check(spark, [(1, "a b", True, None, 1), (2, None, True, None, 1)], monkeypatch)
    empty = spark.createDataFrame([], SCHEMA)
    assert katz.scores(empty, F.col("out")).count() == 0


def test_deals_out_hot_histories(spark, monkeypatch):
    monkeypatch.setattr(katz, "LEAST_HOT", 20)
    rng = random.Random(4)
    rows = [(i, " ".join(f"the w{rng.randrange(40)}" for _ in range(15)), i % 9 == 0, None, 1) for i in range(60)]
    check(spark, rows, monkeypatch)
