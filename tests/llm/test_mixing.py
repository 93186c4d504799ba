import random

import pytest

from panelloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, target string, mix_rate double"


def slow_targets(sizes, cycle=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else share[s] for s in order}
        full |= over


@pytest.mark.parametrize("seed", range(3))
def test_targets_share_the_excess(spark, seed):
    rng = random.Random(seed)
    names = [None, "b", "a", "Z", "é", "src10", "src2", "\U0001f600"]
    sizes = {s: rng.choice([0, 1, 3, 50, 1000, 10**7]) for s in names} | {"big": 10**8}
    frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
    found = {r.source: r.target for r in mixing.targets(frame).collect()}
    expected = slow_targets(sizes)
    assert found.keys() == expected.keys()
    assert all(found[s] == pytest.approx(expected[s]) for s in sizes)


def test_mixture(spark):
    rng = random.Random(1)
    rows = [
        (i, " ".join(["w"] * rng.randrange(1, 60)), f"s{rng.randrange(6)}", None, "t", 1.0)
        for i in range(3000)
    ]
    rows += [(3000, None, "s1", 1, "t", 1.0), (3001, " \n", None, 1, "t", 1.0), (None, "a b c", None, 1, "t", 1.0)]
    rows += [(3002, "x y", "s0", 1, "t", 1.0)] * 2
    docs = spark.createDataFrame(rows, SCHEMA)
    found = mixing.mixed(docs).collect()
    assert len(found) == len(rows)
    sizes, taken = {}, {}
    source = {r[0]: r[2] for r in rows}
    for r in found:
        s = source[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r.taken
        assert r.taken == r.copies * r["size"] <= 3 * r["size"]
    expected = slow_targets(sizes)
    for r in found:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(expected[s])
        assert r.copies - 1 < r.target / r.source_size < r.copies + 1
    for s in ("s0", "s1", "s2", "s3", "s4", "s5"):
        assert taken[s] == pytest.approx(expected[s], rel=0.15)
    assert {r.copies for r in found if r.doc_id == 3002} != set()
    again = {(r.doc_id, r.copies) for r in mixing.mixed(docs.repartition(3)).collect()}
    assert again == {(r.doc_id, r.copies) for r in found}

    out = mixing.mix(docs)
    assert out.columns == docs.columns
    counts = {}
    for r in out.select("doc_id").collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    expected_counts = {}
    for r in found:
        expected_counts[r.doc_id] = expected_counts.get(r.doc_id, 0) + r.copies
    assert counts == {k: v for k, v in expected_counts.items() if v}


def test_nothing_to_mix(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mixed(empty).count() == 0 and mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, "", "a", 1, "t", 1.0), (2, None, None, 1, "t", 1.0)], SCHEMA)
    assert {(r["size"], r.target, r.copies) for r in mixing.mixed(blank).collect()} == {(0, 0.0, 0)}
