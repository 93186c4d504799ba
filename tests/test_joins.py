import random
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelloom.operators import joins as J
from tests.conftest import rows


def brute_full(left, right):
    """Full outer join of (key, value) pairs where a missing key equals a missing key."""
    out = Counter()
    for k, a in left:
        partners = [b for j, b in right if j == k]
        out.update((k, a, b) for b in partners or [None])
    keys = {k for k, _ in left}
    out.update((k, None, b) for k, b in right if k not in keys)
    return out


def pairs(spark, data, value):
    return spark.createDataFrame(data, f"k int, {value} int")


@pytest.mark.parametrize("seed", range(4))
def test_full_join_equals_brute_force(spark, seed):
    draw = random.Random(seed)
    left = [(draw.choice([None, 1, 2, 3, 4]), i) for i in range(12)]
    right = [(draw.choice([None, 3, 4, 5, 6]), i) for i in range(10)]
    got = J.full_join(pairs(spark, left, "a"), pairs(spark, right, "b"))
    assert Counter(map(tuple, got.select("k", "a", "b").collect())) == brute_full(left, right)


def test_right_unique_changes_only_the_plan(spark):
    left = [(None, 1), (None, 2), (1, 3), (2, 4)]
    right = [(None, 7), (2, 8), (9, 9)]
    got = J.full_join(pairs(spark, left, "a"), pairs(spark, right, "b"), right_unique=True)
    assert Counter(map(tuple, got.select("k", "a", "b").collect())) == brute_full(left, right)


def test_full_join_without_broadcast_splits_a_hot_key(spark):
    """A third of the rows under one key, shuffled joins, tiny skew threshold: same result."""
    left = lambda s: s.range(6000).select(F.when(F.col("id") % 3 > 0, F.col("id")).cast("int").alias("k"), F.col("id").alias("a"))
    right = lambda s: s.range(0, 9000, 2).select(F.when(F.col("id") > 10, F.col("id")).cast("int").alias("k"), F.col("id").alias("b"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    session = spark.newSession()
    for k, v in settings.items():
        session.conf.set(k, v)
    totals = J.full_join(left(session), right(session)).agg(
        F.count("*"), F.count_if(F.col("a").isNull()), F.count_if(F.col("b").isNull()), F.sum("a"), F.sum("b")
    )
    counts = totals.collect()[0]
    plan = totals._jdf.queryExecution().executedPlan().toString()
    l_rows = [(i if i % 3 else None, i) for i in range(6000)]
    r_rows = [(i if i > 10 else None, i) for i in range(0, 9000, 2)]
    r_by = Counter(k for k, _ in r_rows)
    l_by = Counter(k for k, _ in l_rows)
    l_only = [a for k, a in l_rows if k not in r_by]
    r_only = [b for k, b in r_rows if k not in l_by]
    matched = sum(l_by[k] * r_by[k] for k in l_by)
    assert counts[0] == matched + len(l_only) + len(r_only)
    assert (counts[1], counts[2]) == (len(r_only), len(l_only))
    assert counts[3] == sum(a * max(1, r_by[k]) for k, a in l_rows)
    assert counts[4] == sum(b * max(1, l_by[k]) for k, b in r_rows)
    assert "skew=true" in plan and "FullOuter" not in plan


def test_clashing_columns_get_suffixes(spark):
    left, right = pairs(spark, [(1, 2)], "v"), pairs(spark, [(1, 3)], "v")
    assert rows(J.full_join(left, right, ["k"]), "k", "v_x", "v_y") == [(1, 2, 3)]


def series(spark):
    a = spark.createDataFrame([(1, "jan", 5), (None, "jan", 1)], "p int, m string, a int")
    b = spark.createDataFrame([(1, "jan", 6), (2, "fev", 7)], "p int, m string, b int")
    c = spark.createDataFrame([(None, "jan", 8), (1, "jan", None)], "p int, m string, c int")
    return [a, b, c]


def test_fold_equals_chained_joins(spark):
    want = [(1, "jan", 5, 6, None), (2, "fev", None, 7, None), (None, "jan", 1, None, 8)]
    for how in ("auto", "raise", "join"):
        assert rows(J.fold_full(series(spark), duplicates=how), "p", "m", "a", "b", "c") == want


def test_fold_fails_on_a_repeated_key_and_join_mode_multiplies(spark):
    a = pairs(spark, [(1, 2), (1, 3), (None, 4)], "a")
    b = pairs(spark, [(1, 5), (1, 6)], "b")
    with pytest.raises(PySparkException, match="repeats a key"):
        J.fold_full([a, b], duplicates="raise").select("k").collect()
    for how in ("auto", "join"):
        got = J.fold_full([a, b], duplicates=how)
        assert Counter(map(tuple, got.select("k", "a", "b").collect())) == brute_full(
            [(1, 2), (1, 3), (None, 4)], [(1, 5), (1, 6)]
        )


def test_fold_rejects_overlapping_columns(spark):
    with pytest.raises(ValueError, match="more than one"):
        J.fold_full([pairs(spark, [(1, 2)], "v"), pairs(spark, [(1, 2)], "v")], ["k"])


def test_attach_unique_keeps_both_sides(spark):
    left = [(None, 1), (None, 2), (1, 3), (2, 4)]
    right = [(None, 7), (2, None), (9, 9)]
    got = J.attach_unique(pairs(spark, left, "a"), pairs(spark, right, "b"), ["k"])
    assert Counter(map(tuple, got.select("k", "a", "b").collect())) == brute_full(left, right)


def test_attach_unique_fails_on_a_repeated_attribute(spark):
    with pytest.raises(PySparkException, match="repeats a key"):
        J.attach_unique(pairs(spark, [(1, 3)], "a"), pairs(spark, [(1, 7), (1, 8)], "b"), ["k"]).count()


def test_attached_tables_share_one_partitioning(spark):
    left = pairs(spark, [(1, 3)], "a").repartition("k")
    right = pairs(spark, [(1, 7)], "b").repartition("k")
    plan = J.attach_unique(left, right, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan


def events(spark):
    return spark.createDataFrame([(2016, 1, "x"), (2016, 1, "y"), (2030, 1, "z")], "year int, month_number int, e string")


def test_events_repeat_rows_in_parity_mode_only(spark):
    by = ["year", "month_number"]
    panel = spark.createDataFrame([(2016, 1, 10), (2016, 2, 20), (None, None, 30)], "year int, month_number int, v int")
    parity = rows(J.attach_events(panel, events(spark), by), "year", "month_number", "v", "e")
    assert parity == [
        (2016, 1, 10, "x"), (2016, 1, 10, "y"), (2016, 2, 20, None), (2030, 1, None, "z"), (None, None, 30, None),
    ]
    collapsed = rows(J.attach_events(panel, events(spark), by, "collapse"), "year", "month_number", "v", "n_events", "e")
    assert collapsed == [
        (2016, 1, 10, 2, "x"), (2016, 2, 20, None, None), (2030, 1, None, 1, "z"), (None, None, 30, None, None),
    ]


def test_events_too_many_to_broadcast_give_the_same_rows(spark, monkeypatch):
    by = ["year", "month_number"]
    panel = spark.range(300).selectExpr(
        "cast(2016 + id % 3 as int) as year", "cast(if(id % 2 = 0, 1, null) as int) as month_number", "id"
    )
    many = spark.range(40).selectExpr(
        "cast(2015 + id % 4 as int) as year", "cast(if(id % 5 < 3, 1, null) as int) as month_number", "id as e"
    )
    want = rows(J.attach_events(panel, many, by))
    monkeypatch.setattr(J, "broadcast_checked", lambda df: df)
    assert rows(J.attach_events(panel, many, by)) == want
    assert rows(J.attach_events(panel, many, by, periods=panel.select(*by).distinct())) == want
    left = [((r.year, r.month_number), r.id) for r in panel.collect()]
    right = [((r.year, r.month_number), r.e) for r in many.collect()]
    assert Counter(((y, m), a, b) for y, m, a, b in want) == brute_full(left, right)


def test_broadcast_only_below_the_byte_limit(spark):
    hinted = lambda df, n: "ResolvedHint" in J.broadcast_checked(df, n)._jdf.queryExecution().analyzed().toString()
    assert hinted(spark.range(10), 80) and not hinted(spark.range(10), 79)
    text = spark.range(10).selectExpr("repeat('x', 1000) as t", "array(id) as a")
    assert hinted(text, 20_000) and not hinted(text, 10_000)


def shuffles(df):
    """Exchanges and reused exchanges of the plan that ran, broadcasts off."""
    df.write.format("noop").mode("overwrite").save()
    final = df._jdf.queryExecution().executedPlan()
    df.collect()
    plan = final.toString()
    plan = plan.split("== Initial Plan ==")[0]
    return sum("Exchange hashpartitioning" in x and "Reused" not in x for x in plan.splitlines()), plan


def test_full_join_shuffles_each_side_once(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    session.conf.set("spark.sql.adaptive.enabled", "false")
    left = session.range(0, 1000).selectExpr("if(id % 7 = 0, null, id % 300) as k", "id as a")
    right = session.range(0, 900).selectExpr("if(id % 5 = 0, null, id % 400) as k", "id as b")
    joined = J.full_join(left, right)
    count, plan = shuffles(joined)
    assert count <= 4 and plan.count("ReusedExchange") >= 2
    lk = [(r.k, r.a) for r in left.collect()]
    rk = [(r.k, r.b) for r in right.collect()]
    got = Counter((k, a, b) for k, a, b in joined.select("k", "a", "b").collect())
    assert got == brute_full(lk, rk)


@pytest.mark.parametrize("kind", ["string", "double", "date", "boolean", "decimal(9,2)", "binary", "timestamp", "array<int>"])
def test_null_keys_match_in_every_type(spark, kind):
    value = {"date": "date '1970-01-01'", "timestamp": "timestamp '1970-01-01'", "boolean": "false", "array<int>": "array(0)"}.get(kind, "'0'")
    left = spark.sql(f"select cast({value} as {kind}) as k, 1 as a union all select null, 2")
    right = spark.sql(f"select cast({value} as {kind}) as k, 3 as b union all select null, 4")
    assert sorted((r.a, r.b) for r in J.full_join(left, right).collect()) == [(1, 3), (2, 4)]


def test_repeated_keys_fan_out_by_default(spark):
    a = spark.createDataFrame([(1, 1), (1, 2), (None, 3)], "k int, a int")
    b = spark.createDataFrame([(1, 5), (1, 6), (2, 7), (None, 8)], "k int, b int")
    assert rows(J.fold_full([a, b]), "k", "a", "b") == [
        (1, 1, 5), (1, 1, 6), (1, 2, 5), (1, 2, 6), (2, None, 7), (None, 3, 8),
    ]
    with pytest.raises(Exception, match="repeats a key"):
        J.fold_full([a, b], duplicates="raise").collect()


def test_full_join_broadcasts_nothing_by_the_size_of_files(spark):
    """By its compressed files a stored table looked small, and Spark sent the driver what did not fit it."""
    left = spark.range(40).selectExpr("id % 9 as k", "cast(id % 2 as string) as m", "id as a")
    right = spark.range(30).selectExpr("id % 12 as k", "cast(id % 2 as string) as m", "id as b")
    for tables in ((left, right), (right, left)):
        plan = J.full_join(*[J.stage(t) for t in tables])._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 3
    plan = J.fold_full([left, right], duplicates="join")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_full_join_carries_each_key_once(spark):
    """A row that is shuffled and sorted holds its keys once, and one number for the missing ones."""
    left = spark.range(8).selectExpr("if(id % 3 = 0, null, id) as k", "cast(id as int) as y", "string(id) as m", "id as a")
    keyed, keys, own = J._with_keys(left, ["k", "y", "m"])
    assert keyed.columns == [*keys, "a"] and len(keys) == 4
    assert rows(keyed.select(*own, "a"), *left.columns) == rows(left)


def test_full_join_of_many_and_nested_keys(spark):
    names = [f"c{i}" for i in range(40)]
    some = spark.range(41).select(*[F.when(F.col("id") != i, F.lit(i)).alias(n) for i, n in enumerate(names)], F.array("id").alias("l"))
    both = J.full_join(some.withColumn("a", F.lit(1)), some.withColumn("b", F.lit(2)), [*names, "l"])
    assert rows(both, "a", "b") == [(1, 2)] * 41 and rows(both, *names, "l") == rows(some)
