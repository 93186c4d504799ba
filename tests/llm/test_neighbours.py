import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.llm import neighbours
from panelloom.llm.neighbours import nearest, probe_sets

SCHEMA = "vec_id long, embedding array<float>, rank int, query string"


def exact(vectors, queries, k):
    out = {}
    ids = np.array(sorted(vectors))
    rows = np.array([vectors[i] for i in ids])
    for q in queries:
        score = np.array([float(np.dot(vectors[q], x)) for x in rows])
        order = np.lexsort((ids, -np.round(score, 12)))
        out[q] = [(int(ids[i]), score[i]) for i in order if ids[i] != q][:k]
    return out


def run(spark, rows, k=20, **options):
    table = spark.createDataFrame([(*r, None, "x") for r in rows], SCHEMA)
    found = {}
    for r in nearest(table, F.col("vec_id") % 20 == 0, k=k, **options).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(found[r.query_id])
    return found


def test_probe_sets_are_the_cheapest():
    sets = probe_sets(4, 60)
    assert not sets[0].any() and len({tuple(s) for s in sets}) == 60
    assert not any(s[j] and s[7 - j] for s in sets for j in range(4))


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((40, 16))
    rows = [(i, (centres[i % 40] + 0.5 * rng.standard_normal(16)).astype(np.float32)) for i in range(2000)]
    vectors = {i: x.astype(float) for i, x in rows}
    found = run(spark, [(i, x.tolist()) for i, x in rows])
    best = exact(vectors, found, 20)
    assert set(found) == set(range(0, 2000, 20)) and all(len(f) == 20 for f in found.values())
    hits = 0
    for q, listed in found.items():
        for v, s in listed:
            assert s == pytest.approx(float(np.dot(vectors[q], vectors[v])), abs=1e-12)
        assert [s for _, s in listed] == sorted((s for _, s in listed), reverse=True)
        hits += len({v for v, _ in listed} & {v for v, _ in best[q]})
    assert hits >= 0.9 * 20 * len(found)


def test_ties_copies_and_unusable_rows(spark):
    good = [(i, [1.0, 2.0, 0.0]) for i in range(0, 90)]  # one vector for a third of the rows and more
    good += [(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(90, 130)]
    good += [(20_000, [1e6, -1e6, 3e5])]
    bad = [(200, None), (220, []), (240, [0.0, 0.0, 0.0]), (260, [1.0, None, 0.0]), (280, [float("nan"), 1.0, 1.0]),
           (300, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    found = run(spark, good + bad + good[:7], k=5)
    best = exact({i: np.array(x) for i, x in good}, found, 5)
    assert set(found) == {i for i, _ in good if i % 20 == 0}
    # So few rows that every bucket together may fall short: all rows are searched then.
    for q in found:
        assert [v for v, _ in found[q]] == [v for v, _ in best[q]] or {s for _, s in found[q]} == {s for _, s in best[q]}
        assert len(found[q]) == 5 and q not in [v for v, _ in found[q]]
    assert [v for v, _ in found[0]] == [v for v, _ in best[0]]


def test_crowded_buckets_are_cut(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, (np.array([3.0, 0, 0, 0]) + 0.05 * rng.standard_normal(4)).astype(np.float32).tolist()) for i in range(300)]
    whole = run(spark, rows, k=5)
    monkeypatch.setattr("panelloom.llm.neighbours.PART_BYTES", 8 * 4 * 40)  # 40 vectors
    assert run(spark, rows, k=5) == whole
    best = exact({i: np.array(x) for i, x in rows}, whole, 5)
    assert all([v for v, _ in whole[q]] == [v for v, _ in best[q]] for q in whole)


@pytest.mark.parametrize("probes", [3, 200])
def test_both_sides_of_a_group_are_bounded(spark, monkeypatch, probes):
    """Blocks of queries against parts of the vectors, in the tables and for queries that they leave short (few probes)."""
    rng = np.random.default_rng(5)
    rows = [(20 * i if i < 240 else 20 * i + 1, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(400)]
    whole = run(spark, rows, k=4, probes=probes)
    sizes, plain = [], neighbours.meet

    def meet(asked, index, blocks, search):
        for side, by in ((asked, ["part", "block"]), (index, ["part"])):
            sizes.append(max(r["count"] for r in side.groupBy(*by).count().collect()))
        assert blocks > 1
        return plain(asked, index, blocks, search)

    monkeypatch.setattr(neighbours, "PART_BYTES", 8 * 8 * 100)  # 100 vectors
    monkeypatch.setattr(neighbours, "meet", meet)
    assert run(spark, rows, k=4, probes=probes) == whole
    assert sizes and all(n <= 300 for n in sizes)  # a part holds whole buckets of up to 100 vectors
    assert set(whole) == {i for i, _ in rows if i % 20 == 0}


def test_few_rows(spark):
    found = run(spark, [(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, 1.0]), (40, [1.0, 1.0, 1.0])])
    assert found == {0: [(2, 0.0), (1, -1.0)]}
    assert run(spark, [(0, [1.0, 0.0])]) == {}
    assert run(spark, []) == {}
