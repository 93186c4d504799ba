import random

from pyspark.sql import functions as F

from panelloom.functions.windows import calendar_index, running_sum, running_sum_blocked
from tests.conftest import rows


def brute(data, by, order):
    """Running sum per group in order; missing from the first missing value on."""
    groups = {}
    for r in data:
        groups.setdefault(tuple(r[b] for b in by), []).append(r)
    out = {}
    for members in groups.values():
        total = 0
        for r in sorted(members, key=lambda r: tuple((r[o] is None, r[o] or 0) for o in order)):
            total = None if total is None or r["v"] is None else total + r["v"]
            out[r["id"]] = total
    return out


def test_missing_value_ends_the_sum(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, None), (1, 3, 7), (2, 1, 1), (2, None, 2), (2, 2, 3)], "g int, k int, v int")
    got = rows(df.withColumn("s", running_sum("v", ["g"], ["k"])), "g", "k", "s")
    assert got == [(1, 1, 5), (1, 2, None), (1, 3, None), (2, 1, 1), (2, 2, 4), (2, None, 6)]


def test_ties_stay_apart(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 1, 5)], "g int, k int, v int")
    assert [s for (s,) in rows(df.select(running_sum("v", ["g"], ["k"]).alias("s")))] == [5, 10]


def test_blocked_sum_with_a_hot_group_equals_brute_force(spark):
    draw = random.Random(5)
    data = []
    for i in range(4000):
        # Group 0 holds a third of all rows; one group in five meets a missing value.
        g = 0 if i % 3 == 0 else draw.choice([None, *range(1, 40)])
        v = None if g is not None and g % 5 == 3 and draw.random() < 0.1 else draw.randint(-9, 9)
        data.append({"id": i, "g": g, "k": draw.choice([None, *range(200)]), "v": v})
    df = spark.createDataFrame([tuple(r.values()) for r in data], "id int, g int, k int, v int")
    for blocks in (1, 7, 64):
        got = running_sum_blocked(df, "v", "s", ["g"], ["k", "id"], blocks)
        assert got.columns == ["id", "g", "k", "v", "s"]
        assert {r.id: r.s for r in got.collect()} == brute(data, ["g"], ["k", "id"])


def test_hot_group_is_spread_over_blocks(spark):
    df = spark.range(9000).select(F.lit(1).alias("g"), F.col("id").alias("k"), F.lit(1).alias("v"))
    got = running_sum_blocked(df, "v", "s", ["g"], ["k"], 16)
    assert got.filter("s = k + 1").count() == 9000
    ranged = df.repartitionByRange(16, "g", "k").groupBy(F.spark_partition_id()).count()
    assert ranged.agg(F.max("count")).first()[0] < 1500


def test_calendar_is_dense_and_puts_missing_months_last(spark):
    df = spark.createDataFrame([(2016, 2), (2016, 1), (2016, 2), (2017, 5), (2016, None)], "year int, month_number int")
    assert rows(calendar_index(df)) == [(2016, 1, 1), (2016, 2, 2), (2016, None, 3), (2017, 5, 4)]
