import datetime as dt
from collections import Counter

import numpy as np
import pytest

from panelloom.plans.cohort import cohort_population
from tests.conftest import rows

SCHEMA = "place string, born date"


@pytest.mark.parametrize("youngest,oldest", [(0, 0), (0, 11), (12, 59), (6, 6)])
def test_equals_a_row_for_each_month_of_age(spark, youngest, oldest):
    rng = np.random.default_rng(youngest + oldest)
    start = dt.date(2010, 3, 31)
    births = [(p, start + dt.timedelta(days=int(d))) for p, n in (("a", 400), ("b", 30), (None, 5)) for d in rng.integers(0, 1400, n)]
    births += [("late", max(d for _, d in births)), ("a", None)]
    index = [(p, d.year * 12 + d.month - 1) for p, d in births if d]
    first, last = min(m for _, m in index), max(m for _, m in index)
    alive = Counter((p, m + age) for p, m in index for age in range(youngest, oldest + 1))
    want = [(p, m // 12, m % 12 + 1, alive[p, m]) for p in ("a", "b", "late", None) for m in range(first, last + 1)]
    found = cohort_population(spark.createDataFrame(births, SCHEMA), ["place"], "born", youngest, oldest)
    key = lambda r: (r[0] is None, str(r[0]), r[1:])
    assert sorted(rows(found), key=key) == sorted(want, key=key)


def test_no_births_and_bad_ages(spark):
    nobody = spark.createDataFrame([("a", None)], SCHEMA)
    assert cohort_population(nobody, ["place"], "born", 0, 11).collect() == []
    with pytest.raises(ValueError, match="ages 5 to 4"):
        cohort_population(nobody, ["place"], "born", 5, 4)
