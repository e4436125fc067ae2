"""Counting which items occur together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frequent_only(items: DataFrame, item: str, min_count: int) -> DataFrame:
    """Rows whose item occurs at least ``min_count`` times.

    A pair is never more frequent than its rarer item, so no pair that reaches
    ``min_count`` is lost.
    """
    frequent = items.groupBy(item).agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_count)
    return items.join(frequent.select(item), item, "left_semi")


def pair_counts(items: DataFrame, owner: str, item: str, a: str, b: str, count_as: str, by: Sequence[str] = ()) -> DataFrame:
    """How many owners hold both items of each pair (a < b), per value of the columns ``by``.

    Owners are first reduced to their distinct item set and equal sets are
    counted, so copies of one set are worked on once with a weight. A set is no
    larger than one posting's skill list. Pairs are written out per distinct
    set and summed map-side; there is no self join.
    """
    sets = (
        items.groupBy(*by, owner)
        .agg(F.array_sort(F.collect_set(item)).alias("_set"))
        .filter(F.size("_set") > 1)
        .groupBy(*by, "_set")
        .agg(F.count("*").alias("_weight"))
    )
    return (
        sets.select(*by, F.posexplode("_set").alias("_i", a), "_set", "_weight")
        .select(*by, a, F.explode(F.expr("slice(_set, _i + 2, size(_set))")).alias(b), "_weight")
        .groupBy(*by, a, b)
        .agg(F.sum("_weight").alias(count_as))
    )
