"""Deduplication that stays balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order.

    ``row_number() = 1`` lets Spark cut every key to one row per task before the
    shuffle (WindowGroupLimit), so a key with a third of all rows sends one row
    per map task and no more.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def not_yet_stored(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key is not in the stored table.

    The stored side is history and usually far larger than one batch, so it is
    first reduced to the batch's keys. Where Spark finds the batch's key column
    small enough to broadcast, history is only scanned, one column and no
    shuffle; otherwise both meet in a shuffle of the key column. Keys are unique
    on both sides, so neither is skewed.
    """
    candidates = stored.select(key).join(incoming.select(key), key, "left_semi")
    return incoming.join(candidates, key, "left_anti")


def flag_all_but_best(
    df: DataFrame,
    key: str,
    best_first: Sequence[Column],
    identity: Sequence[str],
    flag: str,
) -> DataFrame:
    """Keep every row and set ``flag`` on all rows of a key except the best one.

    The best row has the smallest ``best_first`` values. Ranking all rows of a
    key in one window would put a hot key into one task. Instead the best row of each key is found (cut to one row per task before
    the shuffle) and matched back on the rows' own identity, which is unique
    and therefore evenly spread. ``identity`` must not be NULL.
    """
    best = first_per_key(
        df.select(key, *identity, *[c.alias(f"_o{i}") for i, c in enumerate(best_first)]),
        [key],
        [F.col(f"_o{i}") for i in range(len(best_first))],
    ).select(*identity, F.lit(False).alias("_dup"))
    return (
        df.join(best, list(identity), "left")
        .withColumn(flag, F.coalesce("_dup", F.lit(True)))
        .drop("_dup")
        .select(*[c for c in df.columns if c != flag], flag)
    )
