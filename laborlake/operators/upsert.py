"""Keyed merge of two tables of one schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def merge_upsert(target: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows, plus target rows whose key does not come in.

    Keys are unique on both sides and must not be NULL, so the anti join is
    evenly spread. Columns follow the target.
    """
    kept = target.join(incoming.select(*keys), list(keys), "left_anti")
    return kept.select(*target.columns).unionByName(incoming.select(*target.columns))
