"""Helpers the corpus operators share: stored steps, global ranks, components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.sources.sinks import scratch_path

#: A word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def put(df: DataFrame, name: str) -> str:
    """Write a step to the shared scratch folder and return its path.

    Reading it back cuts the lineage, so a lost executor costs no more than the
    step at hand. Shuffle files of the step go as soon as it is written.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4194304")  # long texts
    path = scratch_path(spark, name)
    # Unlike snappy's, its buffers are not direct memory, which large cells would blow up.
    df.write.parquet(path, compression="zstd")
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    path = put(df, name)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a step that no later step reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def word_count(text: Column) -> Column:
    """Number of words; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_rank(df: DataFrame, order: Sequence[Column], rank: str, name: str) -> DataFrame:
    """``df`` with its row's place, from 0, in ``order``, stored.

    The rows are dealt out by range and numbered where they lie; only the row
    count of each partition comes to the driver.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = stored(dealt.withColumn(rank, F.monotonically_increasing_id()), name)
    part = F.shiftright(F.col(rank), 33).cast("int")
    counts = {r[0]: r[1] for r in dealt.groupBy(part).count().collect()}
    starts, total = [], 0
    for i in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(i, 0)
    within = F.col(rank).bitwiseAND((1 << 33) - 1)
    first = F.element_at(F.array(*[F.lit(x).cast("long") for x in starts or [0]]), part + 1)
    return dealt.withColumn(rank, first + within)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links: (node, root), root the smallest node reachable.

    Alternates large-star and small-star steps, which take a number of rounds that
    grows with the logarithm of the component sizes. A round is a minimum per node
    (combined before its shuffle) and a join; each is stored, so that a lost
    executor brings back one round at most. Null ends and self links count for nothing.
    """
    spark = links.sparkSession
    edges = links.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u"))
    edges = edges.where("v is not null and u is not null and v < u").distinct()
    path, mark = put(edges, "links"), None
    while True:
        edges = spark.read.parquet(path)
        found = edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if found == mark:
            break
        mark = found
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        # Large star: larger neighbours hang on to the smallest one.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), "m")
        large = stored(large.select("u", F.col("m").alias("v")).where("v < u").distinct(), "large")
        # Small star: the smaller neighbours and the node itself do.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                )
            ).alias("e")
        )
        path = put(small.select("e.u", "e.v").where("v < u").distinct(), "links")
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    own = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return roots.select(F.col("u").alias("node"), "root").unionByName(own)
