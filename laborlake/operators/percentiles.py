"""Exact continuous percentiles per group, without holding a group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS_PER_UNIT_OF_LOG = 4096


def _bin(value: Column) -> Column:
    """Order-preserving bin of a positive number, about 0.024 % wide."""
    return F.floor(F.ln(value) * BINS_PER_UNIT_OF_LOG)


def exact_percentiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    *,
    count_as: str = "sample_size",
    min_count: int = 1,
    decimals: int = 2,
    times: str | None = None,
) -> DataFrame:
    """Interpolated percentiles of a positive column; one row per group. ``times`` says how often a row's value counts.

    The built-in ``percentile`` keeps all distinct values of a group in one
    task's memory. Here equal values are first counted (shuffled by value, so
    no group is hot), then counted per narrow bin. The bins alone say which
    ones hold the wanted ranks; only the values of those few bins are looked at.
    Results are exact: bins choose what to read, never what to return.
    """
    counts = (
        df.groupBy(*groups, value).agg((F.count("*") if times is None else F.sum(times)).alias("_n")).withColumn("_bin", _bin(F.col(value)))
    )
    # One row per bin: bounded by the bins of the value range, not by the rows.
    whole = Window.partitionBy(*groups)
    upto = whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    position = {name: (F.col(count_as) - 1) * F.lit(p) for name, p in probabilities.items()}
    ranks = {
        **{f"_{name}_lo": F.floor(at) for name, at in position.items()},
        **{f"_{name}_hi": F.ceil(at) for name, at in position.items()},
    }
    bins = (
        counts.groupBy(*groups, "_bin")
        .agg(F.sum("_n").alias("_in_bin"))
        .withColumns({"_upto": F.sum("_in_bin").over(upto), count_as: F.sum("_in_bin").over(whole)})
        .filter(F.col(count_as) >= min_count)
        .withColumns({"_before": F.col("_upto") - F.col("_in_bin"), **ranks})
    )

    def holds(rank: str, first: str, end: str) -> Column:
        return (F.col(first) <= F.col(rank)) & (F.col(rank) < F.col(end))

    # Bins that hold the lower or upper neighbour of any percentile.
    wanted = bins.filter(reduce(or_, (holds(r, "_before", "_upto") for r in ranks))).select(
        *groups, "_bin", "_before", count_as, *ranks
    )
    # Few values are left: those in at most two bins per percentile and group. They are
    # brought together by group once, which serves both the ranking and the result.
    in_bin = (
        Window.partitionBy(*groups, "_bin")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    same_bin = reduce(
        lambda a, b: a & b, [F.col(f"c.{k}").eqNullSafe(F.col(f"w.{k}")) for k in (*groups, "_bin")]
    )
    ranked = (
        counts.alias("c")
        .join(wanted.alias("w"), same_bin)
        .select(
            *[f"c.{g}" for g in groups], "c._bin", f"c.{value}", "c._n",
            "w._before", f"w.{count_as}", *[f"w.{r}" for r in ranks],
        )
        .repartition(*groups)
        .withColumn("_end", F.col("_before") + F.sum("_n").over(in_bin))
        .withColumn("_start", F.col("_end") - F.col("_n"))
    )
    picked = ranked.groupBy(*groups).agg(
        F.max(count_as).alias(count_as),
        *[F.max(F.when(holds(r, "_start", "_end"), F.col(value))).alias(r) for r in ranks],
    )

    def interpolated(name: str) -> Column:
        low, high, at = F.col(f"_{name}_lo"), F.col(f"_{name}_hi"), position[name]
        return low + (high - low) * (at - F.floor(at))

    return picked.select(
        *groups,
        count_as,
        *[round_half_up(interpolated(name), decimals).alias(name) for name in probabilities],
    )


def round_half_up(c: Column, decimals: int) -> Column:
    """Round through decimal, as SQL numeric does, so binary noise cannot tip a half."""
    return F.round(c.cast("decimal(28,6)"), decimals).cast("double")
