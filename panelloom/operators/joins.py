"""Full outer joins in which a missing key matches a missing key, built for skewed keys.

Spark's own ``full`` join runs a key through one task and cannot split a hot
one. Three forms avoid that:

* ``fold_full`` - tables with one row per key: a union and one aggregate.
* ``attach_unique`` - many rows per key against one row per key, where the rows
  per key are few: a union and one window.
* ``full_join`` - anything else, many-to-many included: an inner join, whose hot
  keys AQE splits on either side, plus the rows of each side without a partner.

``fold_full`` looks for duplicates by itself and then takes the third form;
``attach_unique`` checks its claim while it runs and fails on a duplicate, so
neither returns a wrong result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.functions.windows import nulls_last
from panelloom.sources.sinks import stage


def holds(condition: Column, message: str) -> Column:
    """A filter that keeps every row and fails the job when the condition is false."""
    return F.assert_true(condition, message).isNull()


def _shared(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def null_safe_join(left: DataFrame, right: DataFrame, by: Sequence[str], how: str) -> DataFrame:
    """Equi-join where NULL keys match each other; the key columns come from the left."""
    other = right.select("*", *[F.col(k).alias(f"_r_{k}") for k in by]).drop(*by)
    on = [left[k].eqNullSafe(other[f"_r_{k}"]) for k in by]
    joined = left.join(other, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in by])


def row_bytes(df: DataFrame) -> Column:
    """Rough size of a row: eight bytes for a number, the length of a text."""
    size = F.lit(0)
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            size = size + F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) + 8
        elif isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
            size = size + F.octet_length(F.to_json(F.struct(f"`{f.name}`")))
        else:
            size = size + 8
    return size.cast("bigint")


def broadcast_checked(df: DataFrame, max_bytes: int = 16 << 20) -> DataFrame:
    """Mark a table for broadcast only after measuring that it is small.

    A larger table is returned as it is; the join then shuffles, and AQE
    splits its hot keys.
    """
    size = df.agg(F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= max_bytes else df


def broadcast_or_merge(df: DataFrame) -> DataFrame:
    """``broadcast_checked``, and a merge join for a larger table, which Spark might broadcast by the size of its files."""
    checked = broadcast_checked(df)
    return df.hint("merge") if checked is df else checked


_ZERO = {
    T.StringType: "''",
    T.BooleanType: "false",
    T.DateType: "date '1970-01-01'",
    T.TimestampType: "timestamp '1970-01-01'",
    T.TimestampNTZType: "timestamp_ntz '1970-01-01'",
}


def _with_keys(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str], list[Column]]:
    """Non-null key columns, equal exactly where the ``by`` columns are, NULL matching NULL, in place of these.

    Also the names of the key columns, and the ``by`` columns as expressions of them: a row that is shuffled and
    sorted holds each key once, and the missing ones as bits of a number. Only keys of nested types, compared as text, stay beside it.
    """
    keys, nested, own = [], [], []
    missing = [F.lit(0).cast("bigint")] * (len(by) // 32 + 1)
    for i, k in enumerate(by):
        kind, key = df.schema[k].dataType, F.col(f"`{k}`")
        if isinstance(kind, T.NumericType):
            zero = F.lit(0).cast(kind)
        elif type(kind) in _ZERO:
            zero = F.expr(_ZERO[type(kind)])
        else:
            keys.append(F.to_json(F.struct(key)).alias(f"_k{i}"))
            nested.append(key)
            own.append(key)
            continue
        keys.append(F.coalesce(key, zero).alias(f"_k{i}"))
        bit = F.lit(1 << i % 32).cast("bigint")
        missing[i // 32] = missing[i // 32].bitwiseOR(F.when(key.isNull(), bit).otherwise(F.lit(0)))
        own.append(F.when(F.col(f"_n{i // 32}").bitwiseAND(bit) == 0, F.col(f"_k{i}")).alias(k))
    flags = [m.alias(f"_n{i}") for i, m in enumerate(missing)]
    rest = [F.col(f"`{c}`") for c in df.columns if c not in by]
    names = [f"_k{i}" for i in range(len(keys))] + [f"_n{i}" for i in range(len(flags))]
    return df.select(*keys, *flags, *nested, *rest), names, own


def full_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str] | None = None,
    suffixes: tuple[str, str] = ("_x", "_y"),
    right_unique: bool = False,
) -> DataFrame:
    """Full outer join for any multiplicity; ``by`` defaults to the shared columns.

    Spark cannot split a hot key of a full join. Here the matches are an inner
    join, which AQE can split on both sides, and the rows without a partner are
    two anti joins against distinct keys (combined map-side). All are merge joins by the same null-safe key
    columns, so each side is shuffled once and its shuffle is reused; the distinct keys are the
    only others. ``right_unique`` says that no key is hot on the right; matches
    and left-only rows are then one left join, to which the right is broadcast if it is measured to be small. The result is the same.
    """
    by = list(by) if by is not None else _shared(left, right)
    if not by:
        raise ValueError("the tables share no column")
    clash = [c for c in _shared(left, right) if c not in by]
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    # Each row of a result: its keys, then the other columns.
    rest = [[F.col(f"`{c}`") for c in t.columns if c not in by] for t in (left, right)]
    left, keys, left_by = _with_keys(left, by)
    right, _, right_by = _with_keys(right, by)
    # Merge joins by hint: by the size of its compressed files Spark would send the driver tables that do not fit it.
    left_keys, right_keys = [t.select(*keys).distinct().hint("merge") for t in (left, right)]
    right_only = right.join(left_keys, keys, "left_anti").select(*right_by, *rest[1])
    # Both sides' own keys are part of a match, so that each side's shuffle has the same columns throughout.
    renamed = right.withColumnsRenamed({k: f"_r{k}" for k in (*keys, *by)})
    on = reduce(Column.__and__, [F.col(k) == F.col(f"_r{k}") for k in keys])
    if right_unique:
        joined = left.join(broadcast_or_merge(renamed), on, "left")
    else:
        left_only = left.join(right_keys, keys, "left_anti").select(*left_by, *rest[0])
        joined = left.join(renamed.hint("merge"), on, "inner")
    joined = joined.select(*left_by, *rest[0], *rest[1])
    if not right_unique:
        joined = joined.unionByName(left_only, allowMissingColumns=True)
    return joined.unionByName(right_only, allowMissingColumns=True)


def fold_full(
    tables: Sequence[DataFrame], by: Sequence[str] | None = None, duplicates: str = "auto"
) -> DataFrame:
    """Full join of many tables on ``by`` (default: the columns all share).

    With one row per key and table this is a union and one aggregate. ``duplicates`` says what
    happens if a table repeats a key: ``'auto'`` stores the aggregate with the row counts of its keys and, if
    one is repeated, takes exact many-to-many joins instead; ``'raise'`` fails the job; ``'join'`` chains
    the joins at once, storing each step, because a join reads its inputs more than once.
    """
    if duplicates == "join":
        stored = [stage(t, "fold") for t in tables]
        return reduce(lambda left, right: stage(full_join(left, right, by), "fold"), stored)
    if by is None:
        by = [c for c in tables[0].columns if all(c in t.columns for t in tables[1:])]
    by = list(by)
    names = [c for t in tables for c in t.columns if c not in by]
    repeated = sorted({c for c in names if names.count(c) > 1})
    if repeated:
        raise ValueError(f"columns found in more than one table: {repeated}")
    parts = [t.withColumn("_table", F.lit(i)) for i, t in enumerate(tables)]
    # Pairs of pairs: the padded plan stays log(n) deep for a long list of tables.
    while len(parts) > 1:
        pairs = [parts[i : i + 2] for i in range(0, len(parts), 2)]
        parts = [p[0].unionByName(p[1], allowMissingColumns=True) if p[1:] else p[0] for p in pairs]
    stacked = parts[0]
    per_table = [
        F.count_if(F.col("_table") == i).alias(f"_rows_{i}") for i in range(len(tables))
    ]
    folded = stacked.groupBy(*by).agg(*[F.max(f"`{c}`").alias(c) for c in names], *per_table)
    most = [F.col(f"_rows_{i}") for i in range(len(tables))]
    single = F.greatest(*most) <= 1 if len(most) > 1 else most[0] <= 1
    if duplicates == "raise":
        folded = folded.filter(holds(single, "fold_full: a table repeats a key"))
    elif duplicates == "auto":
        folded = stage(folded, "fold")
        if not folded.filter(~single).isEmpty():
            return fold_full(tables, by, "join")
    else:
        raise ValueError(f"unknown mode {duplicates!r} for repeated keys")
    return folded.drop(*[f"_rows_{i}" for i in range(len(tables))])


def repeats_key(df: DataFrame, by: Sequence[str]) -> bool:
    """If two rows share a key, NULL like any value. The count combines map-side."""
    return not df.groupBy(*by).agg(F.count("*").alias("_n")).filter("_n > 1").isEmpty()


def attach_unique(
    rows: DataFrame, attributes: DataFrame, by: Sequence[str], order_by: Sequence[str] = ()
) -> DataFrame:
    """Full join of rows with a table holding at most one row per key.

    Each key's rows share a task, so they must be few (months of a place);
    use ``full_join`` otherwise. When both tables are already partitioned by a
    subset of ``by``, the union keeps that partitioning and nothing is shuffled.
    ``order_by`` names the order of a later window over ``by``, which then
    needs no second sort.
    """
    by = list(by)
    names = [c for c in attributes.columns if c not in by]
    clash = [c for c in names if c in rows.columns]
    if clash:
        raise ValueError(f"columns found in both tables: {clash}")
    both = rows.withColumn("_side", F.lit(0)).unionByName(
        attributes.withColumn("_side", F.lit(1)), allowMissingColumns=True
    )
    whole = Window.partitionBy(*by)
    if order_by:
        whole = whole.orderBy(*nulls_last(order_by)).rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing
        )
    filled = both.select(
        *[c for c in both.columns if c not in names],
        *[F.first(c, ignorenulls=True).over(whole).alias(c) for c in names],
        F.sum("_side").over(whole).alias("_attributes"),
        F.min("_side").over(whole).alias("_least"),
    )
    return (
        filled.filter(holds(F.col("_attributes") <= 1, "attach_unique: the attribute table repeats a key"))
        # Keep the rows, and an attribute row only where its key has no rows.
        .filter(F.col("_side") == F.col("_least"))
        .drop("_side", "_attributes", "_least")
    )


def collapse_events(events: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per period: the number of events and the smallest value of each column."""
    rest = [c for c in events.columns if c not in by]
    return events.groupBy(*by).agg(
        F.count("*").alias("n_events"), *[F.min(c).alias(c) for c in rest]
    )


def attach_events(
    rows: DataFrame,
    events: DataFrame,
    by: Sequence[str],
    mode: str = "parity",
    periods: DataFrame | None = None,
) -> DataFrame:
    """Full join of period rows with an event table.

    ``parity`` repeats a row for each event of its period; ``collapse`` first
    reduces the events to one row per period, so sums do not grow. All places
    share the few period keys, so a shuffle by period would be skewed: the event
    table is broadcast when its counted size allows. ``periods`` may give the
    distinct keys of ``rows`` if they are known; otherwise ``rows`` is read twice.
    """
    by = list(by)
    if mode == "collapse":
        events = collapse_events(events, by)
    elif mode != "parity":
        raise ValueError(f"unknown event mode {mode!r}")
    present = rows.select(*by).distinct() if periods is None else periods.select(*by)
    matched = null_safe_join(rows, broadcast_or_merge(events), by, "left")
    only_events = null_safe_join(events, present, by, "left_anti")
    return matched.unionByName(only_events, allowMissingColumns=True)
