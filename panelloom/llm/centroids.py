"""Centroid clustering in whole numbers, assignment by a tournament of bisectors.

Between two centroids lies a bisecting plane, and the side of a vector says which of
the two is nearer. The normals and thresholds of all pairs are made once per round; a vector then meets
the centroids one after the other, and each of the k - 1 sign tests eliminates one of two.
Everything is a whole number, so a zero is a true tie and goes to the smaller number, and sums
over executors do not depend on their order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import stored

#: A component may have this size at most, so that every sign test and distance fits 64 bits.
LARGEST = 1 << 27
#: Largest number of centroids times components times centroids, 8 bytes each in a task.
NORMALS = 1 << 24
ROWS = 4096  # vectors that a task holds as a matrix at a time


def _whole(vectors: DataFrame, vector: str, dims: int, scale: float) -> DataFrame:
    """Usable vectors with ``whole``, their components as whole numbers."""
    scaled = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    sound = lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= F.lit(LARGEST / scale - 1))
    # NaN is larger than any number here, so the comparison leaves it out like the infinite ones.
    usable = (F.size(vector) == dims) & F.forall(F.col(vector), sound)
    return vectors.where(F.coalesce(usable, F.lit(False))).withColumn("whole", scaled)


class Tournament:
    """Normals and thresholds of the bisectors of all pairs of centroids."""

    def __init__(self, centroids: list[tuple[int, ...]]):
        self.points = np.array(centroids, np.int64)
        squares = (self.points * self.points).sum(axis=1)
        # Positive on the side of the second: 2 x . (c_j - c_i) - (|c_j|^2 - |c_i|^2).
        self.normals = 2 * (self.points[None, :, :] - self.points[:, None, :])
        self.thresholds = squares[None, :] - squares[:, None]

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and the squared distance to it, for each row."""
        best = np.zeros(len(rows), np.int64)
        for j in range(1, len(self.points)):
            side = np.einsum("ij,ij->i", rows, self.normals[best, j]) - self.thresholds[best, j]
            best[side > 0] = j
        apart = rows - self.points[best]
        return best, np.einsum("ij,ij->i", apart, apart)


def _matrices(batches: Iterator[pa.RecordBatch], at: int, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            yield part, part.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _sums(whole: DataFrame, tournament: Tournament, dims: int) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sum of the vectors nearest to each centroid: k (dims + 1) numbers on the driver."""

    k = len(tournament.points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, rows in _matrices(batches, 0, dims):
            best, _ = tournament.nearest(rows)
            counts += np.bincount(best, minlength=k)
            for c in np.unique(best):
                sums[c] += rows[best == c].sum(axis=0)
        # The count goes along as one component more.
        found = [*np.flatnonzero(counts)]
        columns = [found, np.column_stack([sums, counts])[found].tolist()]
        types = pa.schema([("cluster", pa.int32()), ("sums", pa.list_(pa.int64()))])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types, strict=True)], schema=types)

    parts = whole.select("whole").mapInArrow(run, "cluster int, sums array<long>")
    cells = parts.select("cluster", F.posexplode("sums").alias("i", "s"))
    found: dict[int, list[int]] = {}
    for c, i, s in cells.groupBy("cluster", "i").agg(F.sum(F.col("s").cast("decimal(38,0)"))).collect():
        found.setdefault(c, [0] * (dims + 1))[i] = int(s)
    return {c: (sums[dims], sums[:dims]) for c, sums in found.items()}


def cluster(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    dims: int = 64,
    k: int = 40,
    rounds: int = 5,
    scale: float = 256,
    seed: int = 2,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each usable vector.

    Usable are vectors of ``dims`` components, none null or non-finite, nor so large that a squared
    distance passes 64 bits (2**27 after scaling); others give no row. A component x becomes
    floor(scale * x). The first centroids are the ``k`` vectors with the least sha256 of
    ``<seed>:<vec_id>``, in that order (all of them, if fewer; rows that repeat a vec_id follow the order
    of their components; a null vec_id comes last). In each round every vector goes to the
    nearest centroid, of equally near ones to the smaller number, and a centroid with vectors becomes
    the floor of their mean; one without stays. Rows that repeat count as often as they occur. Extra
    columns are not read. No usable vector: no row. An inertia beyond a long is null.
    """
    if k * k * dims > NORMALS:
        raise ValueError(f"the bisectors of {k} centroids of {dims} components do not fit a task")
    mine = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"))
    whole = stored(_whole(mine, "vector", dims, scale).select("vec_id", "whole"), "whole-vectors")
    lot = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = whole.select("whole", lot.alias("lot")).orderBy(F.asc_nulls_last("lot"), "whole").limit(k).collect()
    centroids = [tuple(r[0]) for r in first]
    out = "vec_id {}, cluster int, distance long".format(whole.schema["vec_id"].dataType.simpleString())
    if not centroids:
        return whole.sparkSession.createDataFrame(
            [], f"{out}, cluster_inertia long, inertia long, centroid_sha256 string"
        ).withColumnRenamed("vec_id", vec_id)
    for _ in range(rounds):
        found = _sums(whole, Tournament(centroids), dims)
        for c, (n, sums) in found.items():
            centroids[c] = tuple(s // n for s in sums)
    tournament = Tournament(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _matrices(batches, 1, dims):
            best, distance = tournament.nearest(rows)
            columns = [part.column(0), pa.array(best, pa.int32()), pa.array(distance, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    placed = stored(whole.mapInArrow(run, out), "clusters")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    per = {r[0]: int(r[1]) for r in placed.groupBy("cluster").agg(total).collect()}
    as_long = lambda n: F.lit(n if n < 1 << 63 else None).cast("long")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    at = F.col("cluster") + 1
    return placed.select(
        F.col("vec_id").alias(vec_id),
        "cluster",
        "distance",
        F.element_at(F.array(*[as_long(per.get(c, 0)) for c in range(len(centroids))]), at).alias("cluster_inertia"),
        as_long(sum(per.values())).alias("inertia"),
        F.element_at(F.array(*[F.lit(d) for d in digests]), at).alias("centroid_sha256"),
    )


def _round_sql(i: int, dims: int) -> str:
    """One assignment and update after centroids ``c{i}``: exact floors, also of negative sums."""
    return f"""
a{i} as (select id, arg_min(c, (d, c)) c from (
  select v.id, c.c, list_sum([(v.w[j] - c.w[j]) * (v.w[j] - c.w[j]) for j in range(1, {dims + 1})]) d
  from v cross join c{i} c) group by id),
s{i} as (select a.c, u.j, sum(v.w[u.j])::hugeint s, count(*)::hugeint n
  from a{i} a join v using (id), (select unnest(range(1, {dims + 1})) j) u group by a.c, u.j),
c{i + 1} as materialized (select c.c, coalesce(m.w, c.w) w from c{i} c left join (
  select c, list(((s - ((s % n) + n) % n) // n)::bigint order by j) w from s{i} group by c) m on c.c = m.c),"""


def cluster_sql(table: str = "embeddings", dims: int = 64, k: int = 40, rounds: int = 5) -> str:
    """The same as DuckDB SQL, every vector compared with every centroid. Needs distinct rows."""
    steps = "".join(_round_sql(i, dims) for i in range(rounds))
    return f"""
with v as materialized (
  select row_number() over () id, vec_id, [floor(256 * x::double)::bigint for x in embedding] w
  from {table} where len(embedding) = {dims} and len([x for x in embedding if isfinite(x)]) = {dims}),
c0 as materialized (select row_number() over (order by h, w) - 1 c, w from (
  select sha256('2:' || vec_id) h, w from v order by h, w limit {k})),{steps}
d as (select v.vec_id, v.id, c.c, c.w,
    list_sum([(v.w[j] - c.w[j]) * (v.w[j] - c.w[j]) for j in range(1, {dims + 1})]) d
  from v cross join c{rounds} c),
f as (select id, any_value(vec_id) vec_id, min(d) distance, arg_min(c, (d, c)) c, arg_min(w, (d, c)) w from d group by id)
select vec_id, c::int as cluster, distance::bigint as distance,
  (sum(distance) over (partition by c))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia,
  sha256(array_to_string(w, ',')) as centroid_sha256
from f"""
