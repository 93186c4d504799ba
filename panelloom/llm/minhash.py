"""MinHash near-dedup by an LSH forest.

A tree of the forest is a sorted order of signatures: documents by their minimum hashes under one
series of hash functions. Documents that share the first ``depth`` of them form a region; in it
they stand in the order of further minima, so that neighbours have the longest common prefixes.
Two documents of the wanted similarity share a region in at least one order but for a chance of ``miss``.

Regions are compared in bounded blocks, neighbours first, and every link is confirmed on the full
sets. What is already connected is not compared again, so a dense group costs about a
comparison per document. A region that stays large and unconnected goes deeper: it is ordered
anew by each of the further series, which splits what is not similar and keeps what is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import components, stored, with_rank

BLOCK = 256  # documents that a task compares at a time, or twice as many
DEEPER = 16  # blocks from which a region is ordered anew instead of compared in pairs of blocks
CHUNK = 2048  # shingles hashed at a time
SEED = 42


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct word shingles; of fewer words, the whole sequence; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    return np.unique(np.fromiter((digest(flat[i:j], SEED) for i, j in spans), np.uint64, n))


def set_key(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes(), SEED)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """If 100 times the intersection is at least ``percent`` times the union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def orders_for(percent: int, depth: int, miss: float) -> int:
    """Orders of a forest in which similar documents share no region with a chance of ``miss``."""
    alike = min(percent / 100, 0.999) ** depth
    return math.ceil(math.log(miss) / math.log1p(-alike))


class Signature:
    """Regions (heads) of a set in each order, and the 16-bit minima that order a region (tails)."""

    def __init__(self, orders: int, depth: int):
        self.orders, self.depth = orders, depth
        factors = np.random.default_rng(SEED).integers(0, 1 << 63, orders * (depth + 4), np.uint64)
        self.factors = factors * np.uint64(2) + np.uint64(1)

    def of(self, hashes: np.ndarray) -> tuple[list[int], list[int]]:
        least = np.full(len(self.factors), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(hashes), CHUNK):
            np.minimum(least, (hashes[at : at + CHUNK, None] * self.factors).min(axis=0), out=least)
        rows = least.reshape(self.orders, -1)
        heads = [xxhash.xxh64_intdigest(r.tobytes(), i) - (1 << 63) for i, r in enumerate(rows[:, : self.depth])]
        short = (rows[:, self.depth :] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)
        tails = short[:, 0] << np.uint64(48) | short[:, 1] << np.uint64(32) | short[:, 2] << np.uint64(16) | short[:, 3]
        return heads, tails.astype(np.int64).tolist()


def _sets(docs: DataFrame, doc_id: str, text: str, size: int, signature: Signature) -> DataFrame:
    """Each row with its number, its set's size and key, and the places of the set in the forest."""
    mine = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    longs = pa.list_(pa.int64())
    types = [("n", pa.int64()), ("key", pa.binary()), ("heads", longs), ("tails", longs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for cell in batch.column(1):
                hashes = shingles(cell.as_py(), size)
                places = signature.of(hashes) if len(hashes) else ([], [])
                found.append((len(hashes), set_key(hashes), *places))
            made = [pa.array(list(x), t) for x, (_, t) in zip(zip(*found, strict=True), types, strict=True)]
            if found:
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], ["doc", "text", *[n for n, _ in types]])

    kind = mine.schema["doc"].dataType.simpleString()
    out = f"doc {kind}, text string, n long, key binary, heads array<long>, tails array<long>"
    return stored(mine.mapInArrow(run, out).withColumn("row", F.monotonically_increasing_id()), "minhash-sets")


def block_links(block: pd.DataFrame, percent: int, size: int) -> list[tuple[bytes, bytes]]:
    """Links between components of a block: all that similar documents of one region connect, confirmed on full sets.

    ``part`` 0 and 1 are compared with each other only, -1 with all. Documents of one ``comp``
    are connected from the start. Neighbours in the order of ``tail`` come first, then the pairs further apart.
    """
    parent: dict = {}

    def top(x):
        while (y := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[y]
        return x

    sets: dict[bytes, np.ndarray] = {}
    for _, region in block.sort_values(["tail", "key"]).groupby("region", sort=False):
        keys, comps = region["key"].tolist(), region["comp"].tolist()
        texts, parts = region["text"].tolist(), region["part"].tolist()
        worth = _worth_comparing(region, percent) if "heads" in region.columns else None
        for gap in range(1, len(keys)):
            if len({top(c) for c in comps}) == 1:
                break
            steps = range(len(keys) - gap) if worth is None else np.flatnonzero(np.diagonal(worth, gap)).tolist()
            for i in steps:
                j = i + gap
                if parts[i] == parts[j] >= 0 or (p := top(comps[i])) == (q := top(comps[j])):
                    continue
                for at in (i, j):
                    if keys[at] not in sets:
                        sets[keys[at]] = shingles(texts[at], size)
                if similar(sets[keys[i]], sets[keys[j]], percent):
                    parent[max(p, q)] = min(p, q)
    # A star for each component, so that components that meet in other blocks are few steps apart.
    return [(top(c), c) for c in list(parent) if top(c) != c]


def _least_equal(percent: int, minima: int) -> float:
    """Five standard deviations below the share of equal minima that similar sets have."""
    wanted = percent / 100
    return wanted - 5 * math.sqrt(wanted * (1 - wanted) / minima)


def _worth_comparing(region: pd.DataFrame, percent: int) -> np.ndarray:
    """Which rows of a region may be similar by their minima and share no region of an earlier order."""
    minima = np.stack(region["tails"].to_list()).view(np.uint16)
    heads = np.stack(region["heads"].to_list())[:, : int(region["order"].iloc[0])]
    comps = region["comp"].astype("category").cat.codes.to_numpy()
    least = _least_equal(percent, minima.shape[1])
    worth = np.empty((len(region), len(region)), bool)
    for i in range(len(region)):
        worth[i] = (minima == minima[i]).mean(axis=1) >= least
        worth[i] &= (comps != comps[i]) & ~(heads == heads[i]).any(axis=1)
    return worth


class _Forest:
    def __init__(self, sets: DataFrame, percent: int, size: int):
        self.sets, self.percent, self.size = sets, percent, size
        whole = sets.where("n > 0").groupBy("key")
        places = whole.agg(F.min("row").alias("row"), F.first("heads").alias("heads"), F.first("tails").alias("tails"))
        self.places = stored(places, "minhash-distinct")
        spread = self.places.select("key", "row", "tails", F.posexplode("heads").alias("order", "region"))
        tail = F.element_at("tails", F.col("order") + 1)
        spread = spread.select("region", "order", "key", "row", tail.alias("tail"))
        shared = spread.groupBy("region").agg(F.count("*").alias("count")).where("count > 1")
        self.members = stored(spread.join(shared.hint("merge"), "region"), "minhash-members")
        #: (key, comp) of the sets that are linked so far; the others are components of their own.
        self.comps: DataFrame | None = None

    def confirm(self, rows: DataFrame) -> None:
        """Compare the documents of each ``block`` and merge the components that links connect."""
        percent, size = self.percent, self.size

        def run(block: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(block_links(block, percent, size), columns=["a", "b"], dtype=object)

        texts = self.sets.select("row", "text")
        made = rows.join(texts.hint("merge"), "row").groupBy("block").applyInPandas(run, "a binary, b binary")
        links = stored(made, "minhash-links")
        if self.comps is not None and links.isEmpty():
            return
        if self.comps is None:
            # So far each document was in one block, whose stars are the components.
            own = links.select(F.col("a").alias("key"), F.col("a").alias("comp")).distinct()
            self.comps = stored(links.select(F.col("b").alias("key"), F.col("a").alias("comp")).unionByName(own), "minhash-comps")
            return
        roots = components(links).select(F.col("node").alias("comp"), F.col("root").alias("now"))
        # A component that is linked for the first time is named after its only set.
        moved = self.comps.join(roots.hint("merge"), "comp", "full")
        own = moved.select(F.coalesce("key", "comp").alias("key"), F.coalesce("now", "comp").alias("comp"))
        named = roots.select(F.col("comp").alias("key"), F.col("now").alias("comp"))
        self.comps = stored(own.unionByName(named).distinct(), "minhash-comps")

    def with_comps(self, rows: DataFrame) -> DataFrame:
        found = rows.join(self.comps.hint("merge"), "key", "left")
        return found.withColumn("comp", F.coalesce("comp", "key"))

    def _in_blocks(self, rows: DataFrame) -> DataFrame:
        """Even blocks of documents in the order of region and tail."""
        order = [F.col("region"), F.col("tail"), F.col("key")]
        ranked = with_rank(rows, order, "rank", "minhash-ranked")
        return ranked.withColumns({"block": F.floor(F.col("rank") / BLOCK), "part": F.lit(-1)})

    def _open(self, rows: DataFrame) -> DataFrame:
        """Rows of the regions that are not connected throughout; of regions with equal members, the first order's."""
        about = rows.groupBy("region").agg(
            F.min("comp").alias("first"), F.max("comp").alias("last"), F.count("*").alias("count"),
            F.min("order").alias("order"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("mark"),
        ).where("first != last")
        once = about.groupBy("count", "mark").agg(F.min(F.struct("order", "region")).alias("r"))
        once = once.select("r.region", "count")
        return stored(rows.drop("count").join(once.hint("merge"), "region"), "minhash-open")

    def connect_homes(self) -> None:
        """Compare each document in its most populous region."""
        best = F.max(F.struct("count", "region", "tail", "row")).alias("home")
        homes = self.members.groupBy("key").agg(best).select("home.region", "home.tail", "home.row", "key")
        self.confirm(self._in_blocks(homes.withColumn("comp", F.col("key"))))

    def bridge(self) -> None:
        """Compare three documents of each component of each region."""
        rows = self._open(self.with_comps(self.members))
        one = F.struct("tail", "key", "row")
        drawn = F.struct(F.xxhash64("key"), "tail", "key", "row")
        picks = rows.groupBy("region", "comp").agg(F.min(one).alias("a"), F.max(one).alias("b"), F.min(drawn).alias("c"))
        c = F.struct("c.tail", "c.key", "c.row")
        few = picks.select("region", "comp", F.explode(F.array_distinct(F.array("a", "b", c))).alias("p"))
        self.confirm(self._in_blocks(few.select("region", "comp", "p.*")))

    def compare_rest(self) -> None:
        """Compare all that share a region and are not connected: small regions whole, large ones in pairs of blocks.

        A region whose blocks would be copied more often than a forest has orders goes deeper first. A pair is compared
        in the first order in which it shares a region, and only if the share of equal minima is not
        five standard deviations below the wanted similarity.
        """
        rows = self._open(self.with_comps(self.members))
        deep = F.col("count") > 2 * BLOCK * DEEPER
        deeper = rows.where(deep).join(self.places.select("key", "tails").hint("merge"), "key").select(
            "region", "key", "row", "comp", F.posexplode("tails").alias("order", "tail")
        )
        deeper = deeper.withColumn("region", F.xxhash64("region", "order", "tail")).withColumn("order", F.lit(0))
        if not rows.where(deep).isEmpty():
            rows = rows.where(~deep).unionByName(self._open(deeper))
        ranked = with_rank(rows, [F.col("region"), F.col("comp"), F.col("key")], "rank", "minhash-ranked")
        start = ranked.groupBy("region").agg(F.min("rank").alias("start"))
        minima = self.places.select("key", "heads", "tails")
        placed = ranked.join(start.hint("merge"), "region").join(minima.hint("merge"), "key")
        large = F.col("count") > 2 * BLOCK
        percent = self.percent

        def promising(block: pd.DataFrame) -> pd.DataFrame:
            kept = [r[_worth_comparing(r, percent).any(axis=1)] for _, r in block.groupby("region", sort=False)]
            return pd.concat(kept) if kept else block

        small = placed.where(~large).withColumn("block", F.floor(F.col("start") / BLOCK)).drop("start", "rank", "count")
        small = stored(small.groupBy("block").applyInPandas(promising, small.schema), "minhash-promising")
        whole = small.withColumn("part", F.lit(-1))
        self.confirm(whole.unionByName(self._block_pairs(placed.where(large)).select(whole.columns)))

    def _block_pairs(self, dense: DataFrame) -> DataFrame:
        """Blocks of a region two by two, but for those of one and the same component.

        Components stand together, so a small one beside a large one meets each of its blocks once.
        """
        own = F.floor((F.col("rank") - F.col("start")) / BLOCK)
        rows = stored(dense.withColumn("own", own).drop("rank", "start", "count"), "minhash-dense")
        about = rows.groupBy("region", "own").agg(F.min("comp").alias("first"), F.max("comp").alias("last"))
        other = about.toDF("region", "other", "other_first", "other_last")
        same = "first = last and other_first = other_last and first = other_first"
        pairs = about.join(other.hint("merge"), "region").where(f"own <= other and not ({same})").select("region", "own", "other")
        block = F.xxhash64("region", "own", "other").alias("block")
        left = pairs.select("region", "own", block, F.when(F.col("own") == F.col("other"), -1).otherwise(0).alias("part"))
        right = pairs.where("own < other").select("region", F.col("other").alias("own"), block, F.lit(1).alias("part"))
        return stored(rows.join(left.unionByName(right).hint("merge"), ["region", "own"]).drop("own"), "minhash-pairs")


def minhash_components(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 5,
    percent: int = 80,
    depth: int = 4,
    miss: float = 1e-5,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row.

    Documents link if 100 times the common shingles are at least ``percent`` times all of both;
    A-Z count as a-z, words are runs without ASCII white space, fewer than ``shingle`` words are one shingle.
    ``component_id`` is the least doc_id reachable; ``kept`` is whether it is the row's own. Null and empty
    texts and those of white space have no shingle, link with nothing and are their own component. Rows that repeat stay,
    equal sets are one; a null doc_id keeps its row and names a component only if no other id is in it
    (then ``component_id`` is null and ``kept`` true). Other columns are not read. No rows: no rows.
    """
    signature = Signature(orders_for(percent, depth, miss), depth)
    sets = _sets(docs, doc_id, text, shingle, signature)
    forest = _Forest(sets, percent, shingle)
    forest.connect_homes()
    forest.bridge()
    forest.compare_rest()
    least = sets.where("n > 0").groupBy("key").agg(F.min("doc").alias("least"))
    # As many sets as documents: never a broadcast, however small the corpus.
    placed = least.join(forest.comps.hint("merge"), "key", "left").select("key", "least", F.coalesce("comp", "key").alias("comp"))
    placed = stored(placed, "minhash-roots")
    first = placed.groupBy("comp").agg(F.min("least").alias("component_id"))
    of = placed.join(first.hint("merge"), "comp").select("key", "component_id")
    linked = sets.where("n > 0").join(of.hint("merge"), "key").select("doc", "n", "component_id")
    alone = sets.where("n = 0").select("doc", "n", F.col("doc").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("doc").alias(doc_id),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("doc").eqNullSafe(F.col("component_id")).alias("kept"),
    )


#: The contract as DuckDB SQL: all pairs that share a shingle, counted. Quadratic in shared passages, for small tables.
MINHASH_SQL = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w != '') w from documents),
sets as materialized (select doc_id, case when coalesce(len(w), 0) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) end s from words),
shingles as materialized (select doc_id, len(s) n, unnest(s) h from sets),
links as materialized (select a.doc_id a, b.doc_id b from shingles a join shingles b on a.h = b.h and a.doc_id < b.doc_id
  and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges as materialized (select a, b from links union all select b, a from links),
reach as (select doc_id, doc_id root from sets
  union select edges.b, reach.root from reach join edges on reach.doc_id = edges.a where reach.root < edges.b),
root as (select doc_id, min(root) component_id from reach group by doc_id)
select doc_id, len(s)::bigint as n_shingles, component_id, component_id = doc_id as kept
from sets join root using (doc_id)"""
