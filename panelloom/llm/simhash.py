"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within r bits of each other share a word within half of r of both.
So every fingerprint is dealt to all words of its ball (the variants), and
fingerprints that meet on a variant are candidates. The shuffle goes by the low
``p`` bits of the variant; the variants of the other bits are made after it, in
blocks of bounded size, so a fingerprint crosses the network
1 + p + p(p-1)/2 times at radius 2 and not 2081 times.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import components, fresh, stored

BLOCK = 4_000_000  # variants that a task holds at a time
CHUNK = 65_536  # shingles whose bits are counted at a time


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of one text as a signed 64-bit number; 0 without words.

    Letters A-Z are lower-cased, words are runs without ASCII white space, shingles
    count as often as they occur, and a text of fewer words is one shingle. A bit is set if
    more than half of the shingles' XXH64 have it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        spans = zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)
        hashes = b"".join([digest(flat[i:j], seed) for i, j in spans])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def with_fingerprint(
    docs: DataFrame, text: str, out: str, shingle: int = 4, seed: int = 42
) -> DataFrame:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint(x.as_py(), shingle, seed) for x in batch], pa.int64())

    return docs.withColumn(out, F.arrow_udf(run, "long")(F.col(text)))


def _masks(bits: list[int], flips: int) -> np.ndarray:
    found = [0]
    for k in range(1, flips + 1):
        found += [sum(1 << b for b in c) for c in combinations(bits, k)]
    return np.array(found, np.uint64)


def _ball(bits: int, flips: int) -> int:
    return sum(comb(bits, k) for k in range(flips + 1))


def _meet(
    prints: np.ndarray, rest: np.ndarray, bits: list[int], outer: int, inner: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of prints on a common variant: one at most ``inner`` flips away, with each other.

    ``rest``: flips a print still has of ``outer``; ``bits``: bits that they may go to.
    Above BLOCK variants the work is cut in two by the first of those bits.
    """
    if len(prints) < 2:
        return
    total = sum(_ball(len(bits), k) * int(n) for k, n in enumerate(np.bincount(rest)))
    if total > BLOCK and bits:
        side = (prints >> np.uint64(bits[0])) & np.uint64(1)
        for value in (0, 1):
            keep = (side == value) | (rest > 0)
            spent = rest - (side != value)
            yield from _meet(prints[keep], spent[keep], bits[1:], outer, inner)
        return
    free = np.uint64(sum(1 << b for b in bits))
    keys, owners = [], []
    for k in np.unique(rest):
        at = np.flatnonzero(rest == k)
        masks = _masks(bits, int(k))
        keys.append(((prints[at] & free)[:, None] ^ masks[None, :]).ravel())
        owners.append((at, len(masks)))
    flat = np.concatenate(keys)
    ordered = np.sort(flat)
    shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(shared):
        return
    # Most variants belong to one print; a table of 20 mixed bits passes over nearly all of them.
    mixed = lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
    table = np.zeros(1 << 20, bool)
    table[mixed(shared)] = True
    at = np.flatnonzero(table[mixed(flat)])
    place = np.minimum(np.searchsorted(shared, flat[at]), len(shared) - 1)
    at = at[shared[place] == flat[at]]
    key, owner, start = flat[at], np.empty(len(at), np.int64), 0
    for rows, width in owners:
        inside = (at >= start) & (at < start + len(rows) * width)
        owner[inside] = rows[(at[inside] - start) // width]
        start += len(rows) * width
    flips = np.bitwise_count((prints[owner] & free) ^ key) + (outer - rest[owner])
    far = flips > inner
    order = np.lexsort((prints[owner], far, key))
    key, owner, far = key[order], owner[order], far[order]
    first = np.concatenate(([True], key[1:] != key[:-1]))
    centre = np.flatnonzero(first)[np.cumsum(first) - 1]
    good = ~first & ~far[centre]
    yield prints[owner[centre[good]]], prints[owner[good]]


def _forest(
    links: list[tuple[int, int]], a: np.ndarray, b: np.ndarray
) -> list[tuple[int, int]]:
    """Links that connect the same prints, one fewer than the prints of each component."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[y]
        return x

    kept = []
    for x, y in [*links, *set(zip(a.tolist(), b.tolist(), strict=True))]:
        if (p := top(x)) != (q := top(y)):
            parent[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def ball_links(prints: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b) between distinct ``fp`` that connect all fingerprints within ``distance`` bits.

    Fingerprints on a common variant are linked through one of them, and
    every pair is verified. Within a task only links that join two parts go out, so a
    dense group gives as many rows as it has members, not its pairs.
    """
    spark = prints.sparkSession
    outer, inner = (distance + 1) // 2, distance // 2
    n = prints.count()
    load = lambda p: max(1, BLOCK // _ball(64 - p, outer))
    p = min(24, max(4, (n // load(8)).bit_length()))
    while n and p < 48:
        part = F.col("fp").bitwiseAND((1 << p) - 1)
        most = prints.groupBy(part).count().agg(F.max("count")).first()[0]
        if most <= 4 * load(p) or most <= 20_000:
            break
        p += 4
    low = (1 << p) - 1
    flips = F.array(*[F.lit(int(m)) for m in _masks(list(range(p)), outer)])
    dealt = prints.select("fp", F.explode(flips).alias("flip")).select(
        "fp", F.col("fp").bitwiseAND(low).bitwiseXOR(F.col("flip")).alias("part")
    )
    bits = list(range(p, 64))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        mine = np.unique(group["fp"].to_numpy()).view(np.uint64)
        here = np.uint64(int(group["part"].iloc[0]))
        rest = outer - np.bitwise_count((mine ^ here) & np.uint64(low)).astype(np.int64)
        links: list[tuple[int, int]] = []
        for a, b in _meet(mine, rest, bits, outer, inner):
            near = np.bitwise_count(a ^ b) <= distance
            links = _forest(links, a[near].view(np.int64), b[near].view(np.int64))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("part").applyInPandas(meet, "a long, b long")


def simhash_components(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 4,
    distance: int = 4,
    seed: int = 42,
) -> DataFrame:
    """(doc_id, fp, component_id) for each row; component_id is the least doc_id reachable.

    Null and empty texts have fingerprint 0 and link like others. Rows that repeat
    stay and share a component; a null doc_id keeps its row and counts in a
    component only if it has no other. Other columns of ``docs`` are not read.
    """
    texts = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    prints = with_fingerprint(texts, "text", "fp", shingle, seed).select("doc", "fp")
    prints = stored(prints, "simhash")
    least = stored(prints.groupBy("fp").agg(F.min("doc").alias("least")), "simhash-distinct")
    links = stored(ball_links(least.select("fp"), distance), "simhash-links")
    roots = components(links).withColumnRenamed("node", "fp")
    placed = stored(
        least.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")),
        "simhash-roots",
    )
    first = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of = placed.join(first, "root").select("fp", "component_id")
    return prints.join(of, "fp").select(F.col("doc").alias(doc_id), "fp", "component_id")


def keep_first(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 4,
    distance: int = 4,
    seed: int = 42,
) -> DataFrame:
    """The document with the least doc_id of each component; of rows that repeat it, one.

    Rows with a null doc_id go by their text instead, behind all others. All columns are kept.
    """
    key, rows = fresh(docs, "simhash_id"), fresh(docs, "simhash_rows")
    by_text = F.xxhash64(text).bitwiseAND((1 << 61) - 1) + F.lit(1 << 62)
    named = docs.withColumn(key, F.coalesce(F.col(doc_id).cast("long"), by_text))
    found = simhash_components(named, key, text, shingle, distance, seed)
    kept = found.where(F.col(key) == F.col("component_id"))
    kept = stored(kept.groupBy(key).agg(F.count("*").alias(rows)), "simhash-kept")
    # As many ids as documents: never a broadcast, however small the corpus.
    mine = named.join(kept.hint("merge"), key)
    once = mine.where(F.col(rows) == 1).select(*docs.columns)
    again = mine.where(F.col(rows) > 1).dropDuplicates([key]).select(*docs.columns)
    return once.unionByName(again)
