"""Largest inner products by multiprobe p-stable hashing.

Vectors are scaled into the unit ball and lifted onto a sphere, where the largest inner product
is the least Euclidean distance. A table cuts Gaussian projections into slots; a
query visits its own bucket and those of slightly moved projections, in the order of their estimated
success. What the tables give is merged and ranked by the inner product of the original vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import stored

PART_BYTES = 32 << 20  # vectors that a task holds at a time
STEP = 7919  # between the parts of a crowded bucket's pieces
IDS_TOGETHER = 100_000  # equal vectors whose ids meet in one group


FOUND_DDL = "query long, first long, score double"
NOTHING = pd.DataFrame(
    {"query": np.array([], np.int64), "first": np.array([], np.int64), "score": np.array([], float)}
)


@dataclass
class Index:
    """Hash tables for vectors of one length, made from the seed alone."""

    size: int
    tables: int
    functions: int
    width: float
    probes: int
    seed: int
    moves: np.ndarray = field(init=False)  # probe sets by expected order, over sorted moves

    def __post_init__(self) -> None:
        rng = np.random.default_rng([self.seed, self.size])
        self.lines = rng.standard_normal((self.tables, self.functions, self.size + 1))
        self.shift = rng.uniform(0, self.width, (self.tables, self.functions))
        self.mix = rng.integers(-(2**62), 2**62, (self.tables, self.functions)) | 1
        self.moves = probe_sets(self.functions, 3 * self.probes)

    def slots(self, vectors: np.ndarray, lift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By table and vector: key of its bucket, and places of its projections within their slots."""
        lifted = np.concatenate([vectors, lift[:, None]], axis=1)
        at = np.einsum("tfd,nd->tnf", self.lines, lifted) + self.shift[:, None, :]
        slot = np.floor(at / self.width)
        keys = (slot.astype(np.int64) * self.mix[:, None, :]).sum(axis=2)
        return keys, at - slot * self.width

    def visits(self, vector: np.ndarray) -> np.ndarray:
        """Keys by table: the own bucket, then perturbed ones, the likeliest to hold a neighbour first."""
        own, place = self.slots(vector[None], np.zeros(1))
        out = []
        for t in range(self.tables):
            away = np.concatenate([place[t, 0], self.width - place[t, 0]]) ** 2
            order = np.argsort(away, kind="stable")
            step = np.concatenate([-self.mix[t], self.mix[t]])[order]
            best = np.argsort(self.moves @ away[order], kind="stable")[: self.probes]
            out.append(own[t, 0] + self.moves[best].astype(np.int64) @ step)
        return np.array(out)


def probe_sets(functions: int, n: int) -> np.ndarray:
    """The first n sets of moves by expected distance, the empty one first, as 0/1 rows.

    Column j is the j-th least of the 2 x functions moves of a query, whose expected squared
    distances are known; a set never moves one projection both ways.
    """
    m = functions
    j = np.arange(1, 2 * m + 1)
    k = 2 * m + 1 - j
    near = j * (j + 1) / (4 * (m + 1) * (m + 2))
    far = 1 - k / (m + 1) + k * (k + 1) / (4 * (m + 1) * (m + 2))
    cost = np.where(j <= m, near, far)
    rows = [np.zeros(2 * m, np.int8)]
    heap = [(cost[0], (0,))]
    while heap and len(rows) < n:
        total, chosen = heapq.heappop(heap)
        if all(2 * m - 1 - x not in chosen for x in chosen):
            row = np.zeros(2 * m, np.int8)
            row[list(chosen)] = 1
            rows.append(row)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
    return np.array(rows)


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def distinct_vectors(good: DataFrame, keep: int) -> DataFrame:
    """(vector, first, ids): each distinct vector with its ``keep`` least ids, ``first`` the least.

    Ids meet in groups of bounded size first, so that a vector that many rows share is
    no burden. Ties between equal vectors go to the least ids, so the others cannot be among the nearest.
    """
    groups = max(1, good.count() // IDS_TOGETHER)
    least = lambda x: F.slice(F.sort_array(F.array_distinct(x)), 1, keep)
    some = good.groupBy("vector", F.pmod(F.xxhash64("id"), F.lit(groups)).alias("group"))
    some = some.agg(least(F.collect_list("id")).alias("ids"))
    found = some.groupBy("vector").agg(least(F.flatten(F.collect_list("ids"))).alias("ids"))
    return found.withColumn("first", F.element_at("ids", 1))


def _best(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    rows = rows.drop_duplicates(["query", "first"])
    rows = rows.sort_values(["query", "score", "first"], ascending=[True, False, True], kind="stable")
    return rows.groupby("query", sort=False).head(k)


def _search(queries: pd.DataFrame, entries: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
    """For each query the k best entries of the buckets it visits here.

    A matrix product shows which pairs can still be among the k best; these
    are then scored pair by pair, so that a score depends on its two vectors alone.
    """
    if not len(queries) or not len(entries):
        return
    entries = entries.sort_values(["key", "first"], kind="stable")
    vectors = np.stack(entries["vector"].to_numpy()).astype(np.float64)
    firsts, keys = entries["first"].to_numpy(), entries["key"].to_numpy()
    asked = np.stack(queries["vector"].to_numpy()).astype(np.float64)
    names = queries["query"].to_numpy()
    visited = np.concatenate(queries["keys"].to_list())
    who = np.repeat(np.arange(len(queries)), queries["keys"].map(len))
    order = np.argsort(visited, kind="stable")
    visited, who = visited[order], who[order]
    floor = np.full(len(queries), -np.inf)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting = 0

    def settle() -> None:
        nonlocal held, waiting
        q, v, s = (np.concatenate(x) for x in zip(*held, strict=True))
        best = _best(pd.DataFrame({"query": q, "first": firsts[v], "score": s, "at": v}), k)
        q, v, s = best["query"].to_numpy(), best["at"].to_numpy(), best["score"].to_numpy()
        counts = np.bincount(q, minlength=len(queries))
        lowest = np.full(len(queries), np.inf)
        np.minimum.at(lowest, q, s)
        full = counts >= k
        floor[full] = lowest[full]
        held, waiting = [(q, v, s)], 0

    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    ends = np.append(starts[1:], len(keys))
    left = np.searchsorted(visited, keys[starts], "left")
    right = np.searchsorted(visited, keys[starts], "right")
    for a, b, i, j in zip(starts, ends, left, right, strict=True):
        for at in range(i, j, 1024):
            q = np.unique(who[at : min(j, at + 1024)])
            for c in range(a, b, 8192):
                rough = asked[q] @ vectors[c : min(b, c + 8192)].T
                x, y = np.nonzero(rough >= floor[q][:, None] - 1e-9 * (1 + np.abs(rough)))
                if len(x):
                    x, y = q[x], y + c
                    held.append((x, y, np.einsum("ij,ij->i", asked[x], vectors[y])))
                    waiting += len(x)
                    if waiting > 500_000:
                        settle()
    if held:
        settle()
        q, v, s = held[0]
        yield pd.DataFrame({"query": names[q], "first": firsts[v], "score": s})


def blocks_of(rows: int, size: int) -> int:
    """Blocks of PART_BYTES that ``rows`` rows of ``size`` bytes fill."""
    return max(1, -(-rows * size // PART_BYTES))


def meet(asked: DataFrame, rows: DataFrame, blocks: int, search: Callable) -> DataFrame:
    """``search`` on each pair of a block of queries (``block``) and a part of the vectors (``part``).

    Both sides of a pair are bounded; a part is repeated once for each block of queries.
    """
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = asked.groupBy("part", "block").cogroup(rows.groupBy("part", "block"))
    return pairs.applyInPandas(search, FOUND_DDL)


def nearest(
    table: DataFrame,
    is_query: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    tables: int = 6,
    functions: int = 10,
    width: float = 2.5,
    probes: int = 500,
    seed: int = 11,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each query.

    Rows with a null id, or a vector that is null, empty, zero or holds null or non-finite
    components, take no part. Vectors are compared with those of the same length. Repeated rows count
    once; equal vectors all count, ties go to the smaller id. A query that finds fewer
    than k others in its buckets is compared with all rows, in blocks. Other columns are not read.
    """
    spark = table.sparkSession
    good = table.where(usable(F.col(vector)) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("id"),
        F.col(vector).cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    good = stored(good, "nearest-rows")
    distinct = stored(distinct_vectors(good, k + 1), "nearest-vectors")
    asking = good.where("asks").select("id", "vector").distinct().join(distinct, "vector")
    asking = stored(asking.select("id", F.col("first").alias("query"), "vector"), "nearest-queries")
    queries = asking.select("query", "vector").distinct()
    asked = queries.count()

    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    stats = distinct.agg(
        F.max(F.sqrt(squares)), F.count("*"), F.max(F.size("vector")), F.collect_set(F.size("vector"))
    ).first()
    longest, n, most, sizes = stats[0] or 1.0, stats[1], stats[2] or 1, stats[3]
    indexes = {d: Index(d, tables, functions, width, probes, seed) for d in sizes}
    parts = max(8, blocks_of(n * tables, most * 8))
    blocks = blocks_of(asked, 8 * (most + tables * (probes + 1) // parts))
    block = F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block")

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, rows in batch.groupby(batch["vector"].map(len)):
                x = np.stack(rows["vector"].to_numpy())
                unit = x / longest
                lift = np.sqrt(np.maximum(0, 1 - (unit * unit).sum(axis=1)))
                keys, _ = indexes[d].slots(unit, lift)
                for t in range(tables):
                    yield pd.DataFrame({"key": keys[t], "first": rows["first"], "vector": list(x)})

    entered = distinct.select("first", "vector").mapInPandas(
        enter, "key long, first long, vector array<double>"
    )
    entered = stored(entered, "nearest-index")
    limit = max(1, PART_BYTES // (8 * most))
    crowded = entered.groupBy("key").count().where(F.col("count") > limit).collect()
    crowded = {r[0]: -(-r[1] // limit) for r in crowded}  # buckets cut in pieces that fit a task
    spread = F.lit(1)
    if crowded:
        pieces = F.create_map(*[F.lit(x) for pair in crowded.items() for x in pair])
        spread = F.coalesce(F.element_at(pieces, F.col("key")), F.lit(1))
    piece = F.pmod(F.xxhash64("first"), spread)
    mixed = F.col("key").bitwiseXOR(F.shiftright("key", 32))
    part = F.pmod(F.pmod(mixed, F.lit(parts)) + piece * STEP, F.lit(parts)).cast("int")
    entered = entered.withColumn("part", part)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for query, own, x in zip(batch["query"], batch["block"], batch["vector"], strict=True):
                keys = np.unique(indexes[len(x)].visits(x / np.linalg.norm(x)))
                cut = [(k, i) for k in keys.tolist() if k in crowded for i in range(1, crowded[k])]
                more = np.array(cut, np.int64).reshape(-1, 2)
                keys, piece = np.append(keys, more[:, 0]), np.append(np.zeros(len(keys), np.int64), more[:, 1])
                part = (np.mod(keys ^ (keys >> 32), parts) + piece * STEP) % parts
                order = np.argsort(part, kind="stable")
                groups = np.split(order, np.flatnonzero(np.diff(part[order])) + 1)
                yield pd.DataFrame(
                    {
                        "part": [part[g[0]] for g in groups],
                        "block": own,
                        "query": query,
                        "vector": [x] * len(groups),
                        "keys": [keys[g] for g in groups],
                    }
                )

    visits = queries.select("*", block).mapInPandas(
        visit, "part int, block int, query long, vector array<double>, keys array<long>"
    )

    def search(left: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        of, own = rows["vector"].map(len), left["vector"].map(len)
        found = [x for d in of.unique() for x in _search(left[own == d], rows[of == d], k + 1)]
        return pd.concat([NOTHING, *found])

    found = stored(meet(visits, entered, blocks, search), "nearest-found")

    # Each query's best, and the queries that the buckets left short.
    others = F.size("ids").cast("long")
    have = found.select("query", "first").distinct().join(distinct.select("first", others.alias("n")), "first")
    have = have.groupBy("query").agg(F.sum("n").alias("n"))
    same_size = distinct.groupBy(F.size("vector").alias("size")).agg(F.sum(others).alias("all"))
    short = queries.withColumn("size", F.size("vector")).join(have, "query", "left").join(same_size, "size")
    short = short.where(F.coalesce("n", F.lit(0)) < F.least(F.lit(k + 1), F.col("all")))
    short = stored(short.select("query", "vector"), "nearest-short")
    if not short.isEmpty():
        parts = blocks_of(n, most * 8)
        key = F.size("vector").cast("long").alias("key")
        part = F.pmod(F.xxhash64("first"), F.lit(parts)).cast("int").alias("part")
        rows = distinct.select("first", "vector", key, part)
        left = short.select("query", "vector", F.array(F.size("vector").cast("long")).alias("keys"), block)
        left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        found = found.unionByName(stored(meet(left, rows, blocks, search), "nearest-rest"))

    # Ids of equal vectors, the query's own taken out, best first.
    listed = found.distinct().join(distinct.select("first", "ids"), "first")
    listed = listed.select("query", "score", F.explode("ids").alias("vec_id"))
    by_score = F.struct((-F.col("score")).alias("lower"), F.col("vec_id").alias("vec_id"))
    best = listed.groupBy("query").agg(
        F.slice(F.sort_array(F.collect_set(by_score)), 1, k + 1).alias("best")
    )
    mine = asking.select(F.col("id").alias("query_id"), "query").distinct().join(best, "query")
    mine = mine.select(
        "query_id",
        F.posexplode(
            F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
        ).alias("at", "x"),
    )
    return mine.select(
        "query_id",
        (F.col("at") + 1).alias("rank"),
        F.col("x.vec_id").alias("vec_id"),
        (-F.col("x.lower")).alias("score"),
    )
