"""Comparison of monthly doses with a second, annual source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions.aggregates import columns_with_prefix, sum_by
from panelloom.functions.scalars import divide
from panelloom.operators.joins import fold_full


def reconcile(
    base: DataFrame,
    annual: DataFrame,
    by: Sequence[str],
    second: str = "vacc_cob_polio",
    total: Sequence[str] = ("vacc_vip_3_dose", "vacc_vop_3_dose"),
    prefix: str = "vacc",
    thousands: bool = False,
    duplicates: str = "auto",
) -> DataFrame:
    """Annual sums of the monthly series next to the annual source, with their difference.

    Keys found on one side only stay, with the other side missing; a key that the annual
    source repeats gives a row each time (``duplicates`` as in ``fold_full``). With
    ``thousands`` the two totals are also given divided by 1000.
    """
    by = list(by)
    sums = sum_by(base, by, columns_with_prefix(base, prefix))
    both = fold_full([sums, annual], by, duplicates)
    out = (
        both.withColumn("vacc_total", sum((F.col(c) for c in total[1:]), F.col(total[0])))
        .withColumn("diff_vacc", F.col("vacc_total") - F.col(second))
        .withColumn("perc_diff", divide("diff_vacc", second) * 100)
    )
    if thousands:
        out = out.withColumn("vacc_total_k", F.col("vacc_total") / 1000).withColumn(
            f"{second}_k", F.col(second) / 1000
        )
    return out
