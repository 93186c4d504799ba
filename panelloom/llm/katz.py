"""Katz backoff scores of documents from a bigram model of the corpus.

Documents are kept as blocks of token numbers with a word list each. The corpus word list gives every
word its rank by count. Blocks send their distinct bigrams, with counts, to the partition of the
history; there the bigram table is added up, stored and answered from, and each block scores its documents. What
is shuffled are words and bigrams by block, compressed, never one row per token.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import put, stored, with_rank

END = b"\n"  # no word contains it
BLOCK_TOKENS = 600_000  # a block closes at so many tokens; one longer document is a block
PART_TOKENS = 2_000_000  # tokens for each partition of the bigram table
LEAST_HOT = 10_000  # tokens after one word that a partition takes at any rate
DEEPEST = 5  # counts above it are trusted as they are
UNKNOWN = (1 << 32) - 1


def squeeze(x: np.ndarray, kind: type) -> bytes:
    """Numbers as compressed bytes, like places together."""
    flat = np.ascontiguousarray(x, kind).view(np.uint8).reshape(len(x), np.dtype(kind).itemsize)
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(flat.T).tobytes())


def expand(data: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(width, -1).T).view(kind).ravel()


def _numbers() -> defaultdict[bytes, int]:
    """Gives each new word the next number. (A counter, as a bound method of the dict would keep it alive.)"""
    return defaultdict(count().__next__)


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents: a row with the documents, and a row for each distinct word."""
    from pyspark import TaskContext

    serial = TaskContext.get().partitionId() << 32
    ids: list = []
    held: list[bool] = []
    tokens: list[np.ndarray] = []
    words: defaultdict[bytes, int] = _numbers()

    def close() -> Iterator[pa.RecordBatch]:
        lengths = [len(t) for t in tokens]
        flat = np.concatenate(tokens)
        learned = np.repeat(~np.array(held, bool), lengths)
        counts = np.bincount(flat[learned], minlength=len(words))
        row = {"block": [serial], "word": [None], "local": [None], "n": [None]}
        row |= {"ids": [ids], "held": [held], "lengths": [lengths], "tokens": [squeeze(flat, np.int32)]}
        yield pa.RecordBatch.from_pydict(row, BLOCKS)
        n = len(words)
        columns = [np.full(n, serial), list(words), np.arange(n, dtype=np.int32), counts]
        arrays = [pa.array(c, f.type) for c, f in zip(columns, BLOCKS, strict=False)]
        arrays += [pa.nulls(n, f.type) for f in list(BLOCKS)[4:]]
        yield pa.RecordBatch.from_arrays(arrays, schema=BLOCKS)

    size = 0
    for batch in batches:
        for doc, text, out in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = (text or "").encode("utf-8", "surrogatepass").lower().split()
            found.append(END)
            ids.append(doc)
            held.append(out)
            tokens.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
            size += len(found)
            if size >= BLOCK_TOKENS:
                yield from close()
                ids, held, tokens, words, size = [], [], [], _numbers(), 0
                serial += 1
    if tokens:
        yield from close()


BLOCKS = pa.schema(
    [
        ("block", pa.int64()),
        ("word", pa.binary()),
        ("local", pa.int32()),
        ("n", pa.int64()),
        ("ids", pa.list_(pa.int64())),
        ("held", pa.list_(pa.bool_())),
        ("lengths", pa.list_(pa.int32())),
        ("tokens", pa.binary()),
    ]
)
BLOCKS_DDL = (
    "block long, word binary, local int, n long, ids array<long>, held array<boolean>, "
    "lengths array<int>, tokens binary"
)


SCORES = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_())]
    + [(x, pa.int64()) for x in ("n_tokens", "n_known", "train_tokens")]
    + [(x, pa.float64()) for x in ("base_score", "score")]
)
SCORES_DDL = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
    "base_score double, score double"
)


def good_turing(n: dict[int, int]) -> np.ndarray:
    """Share of its count that an n-gram seen r times keeps, r = 0 to DEEPEST.

    Katz's form if the counts of counts allow it, else one absolute discount for all.
    """
    top = DEEPEST + 1
    out = np.ones(top)
    if all(n.get(r) for r in range(1, top + 1)):
        cut = top * n[top] / n[1]
        if cut < 1:
            for r in range(1, top):
                out[r] = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut)
            if (out[1:] > 0).all() and (out[1:] < 1).all():
                return out
    ones, twos = n.get(1, 0), n.get(2, 0)
    discount = ones / (ones + 2 * twos) if ones and twos else 0.5
    out[1:] = [(r - discount) / r for r in range(1, top)]
    return out


@dataclass
class Unigrams:
    """Word counts by rank: ranks from starts[i] on have count counts[i], which falls."""

    starts: np.ndarray
    counts: np.ndarray
    tokens: int
    types: int
    keep: np.ndarray
    shrink: float  # all seen probabilities by this, should no discount leave anything over
    unknown: float

    @classmethod
    def of(cls, sizes: dict[int, int]) -> Unigrams:
        """From the number of words of each count; there are at most sqrt(2 x tokens) such counts."""
        counts = np.array(sorted(sizes, reverse=True), np.int64)
        numbers = np.array([sizes[c] for c in counts.tolist()], np.int64)
        starts = np.concatenate(([0], np.cumsum(numbers)[:-1])).astype(np.int64)
        tokens, keep = int((counts * numbers).sum()), good_turing(sizes)
        kept = (numbers * counts * keep_of(keep, counts)).sum() / tokens if tokens else 0.0
        shrink = tokens / (tokens + 1) if kept > 1 - 1e-12 else 1.0
        return cls(starts, counts, tokens, int(numbers.sum()), keep, shrink, 1 - kept * shrink)

    def count(self, rank: np.ndarray) -> np.ndarray:
        if not len(self.counts):
            return np.zeros(len(rank), np.int64)
        at = np.searchsorted(self.starts, np.minimum(rank, self.types - 1), "right") - 1
        return np.where(rank < self.types, self.counts[at], 0)

    def probability(self, rank: np.ndarray) -> np.ndarray:
        c = self.count(rank)
        seen = keep_of(self.keep, c) * c / max(1, self.tokens) * self.shrink
        return np.where(c > 0, seen, self.unknown)


def keep_of(keep: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.where(counts <= DEEPEST, keep[np.minimum(counts, DEEPEST)], 1.0)


def _bigrams(row: dict) -> tuple[np.ndarray, ...]:
    """Ranks of a block's tokens, and its distinct bigrams: key, token -> key, training counts.

    A key is history << 32 | word. The history of a first word is START = number of types.
    """
    rank = expand(row["ranks"], np.uint32).astype(np.int64)[expand(row["tokens"], np.int32)]
    lengths = np.array(row["lengths"], np.int64)
    before = np.concatenate(([0], rank[:-1]))
    before[np.concatenate(([0], np.cumsum(lengths)[:-1]))] = row["start"]
    keys = before << 32 | rank
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(first) - 1
    learned = np.repeat(~np.array(row["held"], bool), lengths)
    counts = np.bincount(place[learned], minlength=int(first.sum()))
    return rank, ordered[first], place, counts


def _part_of(keys: np.ndarray, parts: int, hot: np.ndarray) -> np.ndarray:
    """Partition of each bigram: by history, or by the pair if the history is a hot one."""
    history = keys >> 32
    spread = np.where(np.isin(history, hot), keys, history).astype(np.uint64)
    mixed = (spread + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _by_part(keys: np.ndarray, parts: int, hot: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the known-history keys by partition, each in the order of the keys."""
    known = np.flatnonzero(keys >= 0)  # an unknown history sets the sign
    part = _part_of(keys[known], parts, hot)
    order = np.argsort(part, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        if len(at):
            yield int(part[at[0]]), known[at]


def _histories(keys: np.ndarray, hot: np.ndarray) -> np.ndarray:
    found = np.unique(keys >> 32)
    return found[~np.isin(found, hot)]


def _sums(
    keys: np.ndarray, counts: np.ndarray, words: Unigrams
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By history, in order: bigrams seen 1 to DEEPEST times and all tokens; mass of the words seen."""
    seen = counts > 0
    keys, counts = keys[seen], counts[seen]
    history, at = np.unique(keys >> 32, return_inverse=True)
    table = np.zeros((len(history), DEEPEST + 1), np.int64)
    low = counts <= DEEPEST
    np.add.at(table, (at[low], counts[low] - 1), 1)
    table[:, DEEPEST] = np.bincount(at, counts, len(history)).astype(np.int64)
    mass = np.bincount(at, words.probability(keys & UNKNOWN), len(history))
    return history, table, mass


ANSWERS_DDL = "kind string, key long, part int, a binary, b binary, c binary"


def _answer(group: pd.DataFrame, words: Unigrams, hot: np.ndarray) -> pd.DataFrame:
    """One partition of the bigram table, and what each block needs of it.

    Rows: ``table`` (keys, counts), ``counts`` (bigrams seen 1 to DEEPEST + 1 times), ``hot``
    (this partition's sums for a hot history), ``answer`` (for a block: counts in the order
    of its keys, then sums and mass of its histories in order).
    """
    part = int(group["part"].iloc[0])
    asked = [(b, np.cumsum(expand(k, np.int64)), expand(n, np.int32)) for b, k, n in zip(
        group["block"], group["keys"], group["counts"], strict=True
    )]
    keys, at = np.unique(np.concatenate([k for _, k, _ in asked]), return_inverse=True)
    weights = np.concatenate([n for _, _, n in asked])
    counts = np.bincount(at, weights, len(keys)).astype(np.int64)
    seen = counts > 0
    rows = [("table", 0, part, squeeze(np.diff(keys[seen], prepend=0), np.int64), squeeze(counts[seen], np.int64), b"")]
    rare = np.bincount(counts[counts <= DEEPEST + 1], minlength=DEEPEST + 2)
    rows.append(("counts", 0, part, squeeze(rare, np.int64), b"", b""))
    history, table, mass = _sums(keys, counts, words)
    for i in np.flatnonzero(np.isin(history, hot)):
        rows.append(("hot", int(history[i]), part, squeeze(table[i], np.int64), squeeze(mass[i : i + 1], np.float64), b""))
    for block, own, _ in asked:
        n = counts[np.searchsorted(keys, own)]
        mine = _histories(own, hot)
        place = np.minimum(np.searchsorted(history, mine), max(0, len(history) - 1))
        found = history[place] == mine if len(history) else np.zeros(len(mine), bool)
        sums = np.zeros((len(mine), DEEPEST + 1), np.int64)
        share = np.zeros(len(mine))
        sums[found], share[found] = table[place[found]], mass[place[found]]
        rows.append(("answer", int(block), part, squeeze(n, np.int64), squeeze(sums.ravel(), np.int64), squeeze(share, np.float64)))
    return pd.DataFrame(rows, columns=["kind", "key", "part", "a", "b", "c"])


def _weights(table: np.ndarray, mass: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By history: the factor of its discounted frequencies and its backoff weight.

    What the discounts leave over goes to the unseen words in proportion to their own
    probability, so that the probabilities of all words sum to one. A history without any
    discount gives up 1 / (count + 1).
    """
    r = np.arange(1, DEEPEST + 1)
    total = table[:, DEEPEST]
    safe = np.maximum(1, total)
    kept = (table[:, :DEEPEST] * r * keep[1:]).sum(axis=1) + total - (table[:, :DEEPEST] * r).sum(axis=1)
    kept = kept / safe
    none = kept > 1 - 1e-12
    shrink = np.where(none, total / (safe + 1), 1.0)
    left = 1 - kept * shrink
    return shrink / safe, np.where(total > 0, left / (1 - mass), 1.0)


def _score(row: dict, words: Unigrams, keep: np.ndarray, parts: int, hot: dict) -> dict:
    rank, keys, place, _ = _bigrams(row | {"start": words.types})
    hot_ids = np.array(sorted(hot), np.int64)
    n = np.zeros(len(keys), np.int64)
    factor, backoff = np.ones(len(keys)), np.ones(len(keys))
    answers = {x["part"]: x for x in row["answers"] or []}
    hot_table = np.array([hot[h][0] for h in hot_ids.tolist()]).reshape(-1, DEEPEST + 1)
    hot_mass = np.array([hot[h][1] for h in hot_ids.tolist()])
    hot_weights = _weights(hot_table, hot_mass, keep)
    for part, at in _by_part(keys, parts, hot_ids):
        x = answers[part]
        n[at] = expand(x["a"], np.int64)
        own = _weights(expand(x["b"], np.int64).reshape(-1, DEEPEST + 1), expand(x["c"], np.float64), keep)
        history = keys[at] >> 32
        is_hot = np.isin(history, hot_ids)
        for where, ids, (f, b) in ((is_hot, hot_ids, hot_weights), (~is_hot, _histories(keys[at], hot_ids), own)):
            if where.any():
                i = np.searchsorted(ids, history[where])
                factor[at[where]], backoff[at[where]] = f[i], b[i]
    p = np.where(n > 0, keep_of(keep, n) * n * factor, backoff * words.probability(keys & UNKNOWN))
    lengths = np.array(row["lengths"], np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    c = words.count(rank)
    base = np.log10((c + 1) / (words.tokens + words.types + 1))
    total = lambda x: np.add.reduceat(x, starts)
    return {
        "doc_id": row["ids"],
        "held_out": row["held"],
        "n_tokens": lengths,
        "n_known": total((c > 0).astype(np.int64)),
        "train_tokens": np.full(len(lengths), words.tokens),
        "base_score": total(base),
        "score": total(np.log10(p)[place]),
    }


def scores(
    docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    Words are lower-cased (A-Z) runs without ASCII white space; every document ends with
    one end token. The model learns from rows that are not held out: Good-Turing discounted bigrams,
    then words, then one unknown word for all others. ``score`` is the base-10 log probability of the
    document, ``base_score`` that under add-one word frequencies. Null and empty
    texts are an end token; repeated rows are learned and scored one by one; without any
    training row every word is the unknown word. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(doc_id).cast("long"), F.col(text), F.coalesce(held_out, F.lit(False)))
    blocks = put(given.mapInArrow(_tokenise, BLOCKS_DDL), "katz-blocks")
    blocks = spark.read.schema(BLOCKS_DDL).parquet(blocks)
    listed = blocks.where("word is not null").select("block", "word", "local", "n")
    texts = blocks.where("word is null").select("block", "ids", "held", "lengths", "tokens")

    known = listed.where("n > 0").groupBy("word").agg(F.sum("n").alias("n"))
    known = with_rank(known, [F.col("n").desc(), F.col("word")], "rank", "katz-words")
    words = Unigrams.of({r[0]: r[1] for r in known.groupBy("n").count().collect()})
    ranks = listed.select("block", "word", "local").join(known.select("word", "rank"), "word", "left")

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        rank = np.empty(len(group), np.int64)
        rank[group["local"].to_numpy()] = group["rank"].fillna(UNKNOWN).to_numpy(np.int64)
        return pd.DataFrame({"block": group["block"].iloc[:1], "ranks": [squeeze(rank, np.uint32)]})

    ranks = ranks.select("block", "local", "rank").groupBy("block")
    ranks = stored(ranks.applyInPandas(gather, "block long, ranks binary"), "katz-ranks")
    numbered = texts.join(ranks, "block")

    amount = texts.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)))
    tokens = amount.first()[0] or 0
    parts = max(8, -(-tokens // PART_TOKENS))
    ends = texts.agg(F.sum(F.size(F.filter("held", lambda x: ~x)))).first()[0] or 0
    limit = max(LEAST_HOT, tokens // (2 * parts))  # a history above it is dealt out by pairs
    heavy = next(iter(words.starts[words.counts <= limit].tolist()), words.types)
    hot = np.array([*range(heavy), *([words.types] if ends > limit else [])], np.int64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                _, keys, _, counts = _bigrams(row | {"start": words.types})
                found = [
                    (part, row["block"], squeeze(np.diff(keys[at], prepend=0), np.int64), squeeze(counts[at], np.int32))
                    for part, at in _by_part(keys, parts, hot)
                ]
                names = ["part", "block", "keys", "counts"]
                types = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                arrays = [pa.array(x, t) for x, t in zip(zip(*found, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    asked = numbered.mapInArrow(ask, "part int, block long, keys binary, counts binary")
    answers = asked.groupBy("part").applyInPandas(lambda g: _answer(g, words, hot), ANSWERS_DDL)
    answers = stored(answers, "katz-bigrams")
    rare = [expand(r[0], np.int64) for r in answers.where("kind = 'counts'").select("a").collect()]
    rare = np.sum(rare, axis=0) if rare else np.zeros(DEEPEST + 2, np.int64)
    keep = good_turing({r: int(rare[r]) for r in range(1, DEEPEST + 2)})
    sums: dict[int, list] = {}
    for h, a, b in answers.where("kind = 'hot'").orderBy("key", "part").select("key", "a", "b").collect():
        table, mass = expand(a, np.int64), expand(b, np.float64)[0]
        old = sums.get(h, [0, 0.0])
        sums[h] = [old[0] + table, old[1] + mass]
    hot_sums = {int(h): sums.get(int(h), [np.zeros(DEEPEST + 1, np.int64), 0.0]) for h in hot}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield pa.RecordBatch.from_pydict(_score(row, words, keep, parts, hot_sums), SCORES)

    replies = answers.where("kind = 'answer'").groupBy(F.col("key").alias("block"))
    replies = replies.agg(F.collect_list(F.struct("part", "a", "b", "c")).alias("answers"))
    return numbered.join(replies, "block", "left").mapInArrow(score, SCORES_DDL)
