"""Variable-capacity best-fit packing of documents into training sequences.

Packing by best fit, longest first, needs only how many pieces there are of each
length. That histogram has at most as many rows as the longest sequence has tokens, whatever
the corpus, so it is packed on the driver in runs of equal bins; pieces
then find their bin by their rank, each on its own.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import stored, with_rank, word_count

LENGTHS = (512, 1024, 2048, 4096)


def sequence_cost(length: int) -> float:
    """Cost of a sequence in a training step: a linear part and one for attention."""
    return length + length * length / 65536


@dataclass
class Plan:
    """Runs of ranks to runs of bins: rank r of run i is in bin bin[i] + (r - rank[i]) // each[i]."""

    rank: list[int] = field(default_factory=list)
    size: list[int] = field(default_factory=list)
    each: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)  # first bin of each run of equal bins
    capacity: list[int] = field(default_factory=list)


def plan_bins(
    counts: dict[int, int],
    lengths: Sequence[int] = LENGTHS,
    cost: Callable[[int], float] = sequence_cost,
) -> Plan:
    """Pack ``counts[size]`` pieces of each size, longest first.

    A piece goes to the open bin with the least room that holds it. If none does, the
    bin length is opened whose cost for each token is least, its filling judged by what
    shorter pieces are still unpromised; ties go to the longer one. In the end a bin
    shrinks to the least length for its contents. Runs of bins with equal contents are
    kept as one entry, so the work depends on the number of sizes only.
    """
    lengths = sorted(lengths)
    plan, bins = Plan(), 0
    spare = dict(counts)  # pieces not yet promised to a bin
    open_runs: dict[int, list[tuple[int, int, int]]] = {}  # room: (first bin, bins, used)
    rooms: list[int] = []
    closed: list[tuple[int, int, int]] = []

    def keep(first: int, n: int, used: int, room: int) -> None:
        if n and not room:
            closed.append((first, n, used))
        elif n:
            if room not in open_runs:
                open_runs[room] = []
                insort(rooms, room)
            open_runs[room].append((first, n, used))

    def place(rank: int, size: int, n: int, run: tuple[int, int, int], room: int) -> int:
        """Puts up to n pieces into a run of bins with so much room; returns how many."""
        first, width, used = run
        each = room // size
        whole = min(width, n // each)
        if whole:
            plan.rank.append(rank)
            plan.size.append(size)
            plan.each.append(each)
            plan.bin.append(first)
            plan.offset.append(used)
            keep(first, whole, used + each * size, room - each * size)
        done = whole * each
        if whole < width and (rest := n - done):
            plan.rank.append(rank + done)
            plan.size.append(size)
            plan.each.append(rest)
            plan.bin.append(first + whole)
            plan.offset.append(used)
            keep(first + whole, 1, used + rest * size, room - rest * size)
            done, whole = n, whole + 1
        keep(first + whole, width - whole, used, room)
        return done

    def filling(length: int, size: int, n: int) -> tuple[dict[int, int], int]:
        """Pieces that would fill a bin opened for this size, and their tokens."""
        own = min(n, length // size)
        use, room = {size: own}, length - own * size
        at = bisect_left(sizes, min(room, size - 1) + 1) - 1
        while room and at >= 0:
            if take := min(spare[sizes[at]], room // sizes[at]):
                use[sizes[at]] = take
                room -= take * sizes[at]
            at = bisect_left(sizes, min(room, sizes[at] - 1) + 1) - 1
        return use, length - room

    rank = 0
    sizes = sorted(counts)
    for size in reversed(sizes):
        left = counts[size]
        while left:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                run = open_runs[room].pop()
                if not open_runs[room]:
                    del open_runs[room]
                    rooms.pop(at)
                done = place(rank, size, left, run, room)
                spare[size] = max(0, spare[size] - done)
            else:
                fits = [x for x in lengths if x >= size]
                looked = [(x, *filling(x, size, left)) for x in fits]
                length, use, _ = min(looked, key=lambda x: (cost(x[0]) / x[2], -x[0]))
                n = min([left // use[size], *(spare[k] // v for k, v in use.items() if k != size)])
                n = max(1, n)
                for k, v in use.items():
                    spare[k] = max(0, spare[k] - n * v)
                done = place(rank, size, min(left, n * use[size]), (bins, n, 0), length)
                bins += n
            rank, left = rank + done, left - done
    ends = closed + [run for runs in open_runs.values() for run in runs]
    for first, _, used in sorted(ends):
        plan.first.append(first)
        plan.capacity.append(next(x for x in lengths if x >= used))
    return plan


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    size: Column | None = None,
    lengths: Sequence[int] = LENGTHS,
    cost: Callable[[int], float] = sequence_cost,
) -> DataFrame:
    """One row for each piece: (doc_id, piece, start, n_tokens, bin_id, bin_offset, capacity).

    ``size`` is the tokens of a document, by default the words of ``text``. Documents longer than the longest sequence
    are cut into pieces of that length. Documents without a token (null
    or empty texts) give one row without a bin. Repeated rows are packed
    one by one; pieces of equal size go in order of doc_id, nulls first.
    Other columns of ``docs`` are not read.
    """
    longest = max(lengths)
    size = word_count(F.col("text")) if size is None else size
    sized = docs.select(F.col(doc_id).alias("doc_id"), size.cast("long").alias("size"))
    last = F.greatest(F.lit(0), F.ceil(F.col("size") / longest) - 1).cast("int")
    pieces = sized.select("doc_id", "size", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * longest
    pieces = pieces.select(
        "doc_id",
        "piece",
        start.alias("start"),
        F.least(F.lit(longest), F.greatest(F.lit(0), F.col("size") - start)).cast("int").alias("n_tokens"),
    )
    order = [F.col("n_tokens").desc(), F.col("doc_id"), F.col("piece")]
    ranked = with_rank(pieces, order, "rank", "pack-pieces")
    counts = ranked.where("n_tokens > 0").groupBy("n_tokens").count().collect()
    plan = plan_bins({r[0]: r[1] for r in counts}, lengths, cost)
    table = {k: np.array(v, np.int64) for k, v in vars(plan).items()}

    def find(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ranks, tokens in batches:
            rank, n = ranks.to_numpy(), tokens.to_numpy()
            if not len(table["rank"]):
                found = {x: np.zeros(len(rank), np.int64) for x in ("bin", "offset", "capacity")}
            else:
                at = np.maximum(0, np.searchsorted(table["rank"], rank, "right") - 1)
                within = rank - table["rank"][at]
                bin_ = table["bin"][at] + within // table["each"][at]
                offset = table["offset"][at] + within % table["each"][at] * table["size"][at]
                run = np.maximum(0, np.searchsorted(table["first"], bin_, "right") - 1)
                found = {"bin": bin_, "offset": offset, "capacity": table["capacity"][run]}
            yield pa.StructArray.from_arrays(
                [pa.array(v, pa.int64(), mask=n == 0) for v in found.values()], list(found)
            )

    udf = F.arrow_udf(find, "bin long, offset long, capacity long")
    found = ranked.withColumn("at", udf("rank", "n_tokens"))
    return found.select(
        "doc_id",
        "piece",
        "start",
        "n_tokens",
        F.col("at.bin").alias("bin_id"),
        F.col("at.offset").cast("int").alias("bin_offset"),
        F.col("at.capacity").cast("int").alias("capacity"),
    )
