"""Mixing sources to target weights by whole and random repeats of documents.

Sizes are summed per source, the target of each source is settled, and a document goes out
floor(rate) times plus once more if a hash of its id falls below the fraction of the rate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import fresh, stored, with_rank, word_count

SEED = "mix"


def targets(
    sizes: DataFrame,
    source: str = "source",
    size: str = "size",
    cycle: Sequence[int] = (5, 2, 1),
    most: int = 3,
) -> DataFrame:
    """(source, source_size, weight, target): one row per source, stored.

    The sources in code point order, null last, get the weights of ``cycle`` in turn and
    share the whole size by them. A target stops at ``most`` times its source's size;
    what is over goes to the others by weight, until no target is above. Each round of that
    is one aggregate whose two sums the driver reads; no source table comes to it.
    """
    per = sizes.groupBy(F.col(source).alias("source")).agg(
        F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("source_size")
    )
    per = with_rank(per, [F.col("source").asc_nulls_last()], "place", "mix-sources")
    turn = F.array(*[F.lit(int(w)) for w in cycle])
    per = per.withColumn("weight", F.element_at(turn, (F.col("place") % len(cycle) + 1).cast("int")))
    wide = lambda c: c.cast("decimal(38,0)")  # noqa: E731  # counts times weights pass 64 bits
    room = wide(F.col("source_size") * most)
    left, weights, full = None, None, F.lit(False)
    while True:
        row = per.agg(
            F.sum(wide(F.col("source_size"))).alias("total"),
            F.sum(F.when(full, room)).alias("used"),
            F.sum(F.when(~full, F.col("weight"))).alias("weights"),
        ).first()
        now = (int((row["total"] or 0) - (row["used"] or 0)), int(row["weights"] or 0))
        if now == (left, weights) or not now[1]:
            left, weights = now
            break
        left, weights = now
        full = room * weights < F.col("weight") * wide(F.lit(str(left)))
    share = F.col("weight").cast("double") * F.lit(float(left)) / F.lit(float(max(1, weights)))
    target = F.when(full, room.cast("double")).otherwise(share)
    return stored(per.select("source", "source_size", "weight", target.alias("target")), "mix-targets")


def copies(doc_id: Column, text: Column, rate: Column, seed: str = SEED) -> Column:
    """Times that a document goes out. The draw comes from its id, or its text for a null id."""
    key = F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit(""))))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13)
    draw = F.conv(digits, 16, 10).cast("double") / F.lit(float(2**52))
    whole = F.floor(rate)
    return (whole + (draw < rate - whole).cast("long")).cast("long")


def mixed(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    cycle: Sequence[int] = (5, 2, 1),
    most: int = 3,
    seed: str = SEED,
) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of each row.

    Null and empty texts have size 0; a source of only such documents has target
    0 and gives none. A null source is a source like any other. Rows that repeat
    a doc_id share its draw. Other columns of ``docs`` are not read.
    """
    sizes = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        F.when(F.col(doc_id).isNull(), F.md5(F.coalesce(F.col(text), F.lit("")))).alias("key"),
    )
    sizes = stored(sizes, "mix-sizes")
    shares = targets(sizes, cycle=cycle, most=most).withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    found = sizes.join(shares, sizes["source"].eqNullSafe(F.col("of")))
    key = F.coalesce(F.col("doc_id").cast("string"), F.col("key"))
    found = found.withColumn("copies", copies(key, F.lit(None), rate, seed))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return found.select("doc_id", "size", "source_size", "target", "copies", taken)


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    cycle: Sequence[int] = (5, 2, 1),
    most: int = 3,
    seed: str = SEED,
) -> DataFrame:
    """The mixed corpus: the rows of ``docs`` with all their columns, repeated as the rates say."""
    shares = targets(
        stored(
            docs.select(
                F.col(source).alias("source"), word_count(F.col(text)).alias("size")
            ).groupBy("source").agg(F.sum("size").alias("size")),
            "mix-sizes",
        ),
        cycle=cycle,
        most=most,
    )
    of, rate, n = (fresh(docs, x) for x in ("mix_source", "mix_rate", "mix_copy"))
    rates = shares.select(
        F.col("source").alias(of),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
        .otherwise(0.0)
        .alias(rate),
    )
    times = copies(F.col(doc_id), F.col(text), F.col(rate), seed)
    found = docs.join(rates, docs[source].eqNullSafe(rates[of])).withColumn(n, times)
    found = found.where(F.col(n) > 0).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))))
    return found.select(*docs.columns)


#: The same rows in DuckDB SQL. A source is full if, in order of room by weight, the water
#: level of it and all later ones lies above its room.
MIXED_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, text,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM {docs}
), per AS (
  SELECT source, sum(size)::HUGEINT AS source_size,
         (ARRAY[5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source
), ordered AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(3 * source_size) OVER before, 0) AS used,
         sum(weight) OVER after AS weights
  FROM per
  WINDOW before AS (ORDER BY 3 * source_size / weight::DOUBLE, source NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (ORDER BY 3 * source_size / weight::DOUBLE, source NULLS LAST
                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), filled AS (
  SELECT *, 3 * source_size * weights < weight * (total - used) AS is_full FROM ordered
), level AS (
  SELECT max(total) - coalesce(sum(3 * source_size) FILTER (is_full), 0) AS remaining,
         greatest(1, coalesce(sum(weight) FILTER (NOT is_full), 0)) AS weights
  FROM filled
), shares AS (
  SELECT f.source, f.source_size,
         CASE WHEN is_full THEN (3 * f.source_size)::DOUBLE
              ELSE f.weight::DOUBLE * l.remaining::DOUBLE / l.weights::DOUBLE END AS target
  FROM filled f, level l
), rated AS (
  SELECT d.doc_id, d.size, s.source_size::BIGINT AS source_size, s.target,
         CASE WHEN s.source_size > 0 THEN s.target / s.source_size::DOUBLE ELSE 0.0 END AS rate,
         ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, md5(coalesce(d.text, '')))), 1, 13))
           ::BIGINT::DOUBLE / 4503599627370496.0 AS draw
  FROM sized d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, size, source_size, target,
       (floor(rate) + (draw < rate - floor(rate))::INT)::BIGINT * size AS taken
FROM rated
"""
