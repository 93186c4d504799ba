import hashlib

import duckdb
import numpy as np
import pytest

from panelloom.llm import centroids
from panelloom.llm.centroids import Tournament, cluster, cluster_sql

SCHEMA = "vec_id long, embedding array<float>, cluster string, whole int"


def slow(rows, k, rounds, scale=256):
    """The contract in plain Python: every vector against every centroid."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows]
    lot = lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    points = [v for _, v in sorted(kept, key=lot)[:k]]
    apart = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min((apart(v, c), j) for j, c in enumerate(points))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        points = [
            [sum(col) // len(groups[j]) for col in zip(*groups[j], strict=True)] if j in groups else c
            for j, c in enumerate(points)
        ]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    digest = lambda c: hashlib.sha256(",".join(map(str, points[c])).encode()).hexdigest()
    inertia = sum(d for _, _, d in found)
    return sorted((i, c, d, sum(x[2] for x in found if x[1] == c), inertia, digest(c)) for i, c, d in found)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("k, dims, n, grid", [(7, 5, 300, False), (12, 3, 200, True), (40, 2, 9, True), (1, 4, 20, False)])
def test_against_brute_force(spark, k, dims, n, grid):
    rng = np.random.default_rng(k)
    vectors = rng.normal(size=(n, dims)).astype(np.float32)
    if grid:  # few distinct whole numbers: ties between centroids, and equal centroids
        vectors = np.round(vectors).astype(np.float32) / 256
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    found = cluster(frame(spark, rows), dims=dims, k=k, rounds=3).collect()
    assert sorted(map(tuple, found)) == slow(rows, k, 3)


def test_a_tie_goes_to_the_smaller_number():
    best, distance = Tournament([(4, 0), (0, 0), (4, 0), (2, 2)]).nearest(np.array([[2, 0], [4, 0], [0, 0], [3, 1]]))
    assert best.tolist() == [0, 0, 1, 0]
    assert distance.tolist() == [4, 0, 0, 2]


def test_large_whole_numbers_are_exact():
    rng = np.random.default_rng(1)
    big = centroids.LARGEST - 1
    points = [tuple(int(x) for x in rng.integers(-big, big, 64)) for _ in range(6)]
    points.append(tuple(x + (i == 5) for i, x in enumerate(points[0])))
    rows = rng.integers(-big, big, (50, 64))
    best, distance = Tournament(points).nearest(rows)
    for row, b, d in zip(rows.tolist(), best, distance, strict=True):
        apart = [sum((x - y) ** 2 for x, y in zip(row, p, strict=True)) for p in points]
        assert (apart[b], b) == (min(apart), apart.index(min(apart))) and d == apart[b]


def test_what_takes_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [i / 7, -i / 3]) for i in range(12)]
    bad = [(90, None), (91, []), (92, [1.0]), (93, [1.0, None]), (94, [nan, 1.0]), (95, [inf, 0.0]), (96, [0.0, -inf]),
           (97, [1.0, 2.0, 3.0]), (98, [3e38, 0.0])]
    found = cluster(frame(spark, good + bad), dims=2, k=3).collect()
    assert sorted(map(tuple, found)) == slow([(i, [float(np.float32(x)) for x in v]) for i, v in good], 3, 5)
    empty = cluster(frame(spark, []), dims=2)
    assert empty.count() == 0
    assert empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert cluster(frame(spark, bad), dims=2).count() == 0


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [5.0, 5.0]), (None, [5.0, 5.0])]
    found = cluster(frame(spark, rows), dims=2, k=2).collect()
    assert len(found) == 5
    # Both first centroids are rows of vec_id 1, in the order of their components.
    assert {r.cluster for r in found if r.vec_id is None} == {0}
    assert {r.inertia for r in found} == {sum(r.distance for r in found)}


def test_sql(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(150, 4)).astype(np.float32))]
    con = duckdb.connect()
    con.execute("create table e (vec_id bigint, embedding float[])")
    con.executemany("insert into e values (?, ?)", rows)
    expected = con.execute(cluster_sql("e", dims=4, k=9)).fetchall()
    assert sorted(map(tuple, cluster(frame(spark, rows), dims=4, k=9).collect())) == sorted(expected)


def test_bisectors_must_fit_a_task(spark):
    with pytest.raises(ValueError, match="do not fit"):
        cluster(frame(spark, []), dims=64, k=10_000)
