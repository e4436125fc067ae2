"""Text cleaning, keys and hashes."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from laborlake.functions.parse import null_if_empty, strip


def clean(c: Column, size: int | None = None) -> Column:
    """Stripped text, NULL when empty, cut to ``size`` characters."""
    text = null_if_empty(strip(c.cast("string")))
    return text if size is None else F.substring(text, 1, size)


def or_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def key_part(c: Column) -> Column:
    """Case- and margin-insensitive key part; a missing value is an empty part."""
    return F.lower(strip(or_blank(c)))


def posting_hash(title: Column, company: Column, posted: Column, source: Column) -> Column:
    """Content hash of a posting. Missing parts stay in place as empty text."""
    return F.sha2(
        F.concat_ws("|", key_part(title), key_part(company), or_blank(posted), or_blank(source)),
        256,
    )


def parts_hash(*parts: Column) -> Column:
    """Hash of the non-empty parts only."""
    kept = [F.when(p.cast("string") != "", F.lower(strip(p.cast("string")))) for p in parts]
    return F.sha2(F.concat_ws("|", *kept), 256)


def dedup_key(title: Column, company: Column, location: Column, posted: Column) -> Column:
    """'title|company|location|day' with missing parts kept as empty text."""
    return F.concat_ws(
        "|",
        key_part(title),
        key_part(company),
        key_part(location),
        or_blank(posted.cast("date").cast("string")),
    )


def currency_code(c: Column) -> Column:
    """Upper-case currency, blank or missing as USD. Only spaces count as blank, as in SQL."""
    return F.upper(F.coalesce(null_if_empty(F.trim(c)), F.lit("USD")))


def has_text(c: Column) -> Column:
    return c.isNotNull() & (c.cast("string") != "")


def as_text(c: Column, data_type: str) -> Column:
    """Storage text of any value: nested values as JSON, NaN as NULL."""
    if data_type.startswith(("array", "struct", "map")):
        return F.to_json(c)
    if data_type in ("double", "float"):
        return F.when(~F.isnan(c), c.cast("string"))
    return c.cast("string")


def identifier(value: str, *, prefix: str, max_len: int = 63) -> str:
    """Column or table name made safe: lower case, [a-z0-9_], not starting with a digit."""
    name = re.sub(r"[^a-z0-9]+", "_", (value or "").lower()).strip("_") or prefix
    if name[0].isdigit():
        name = f"{prefix}_{name}"
    return name[:max_len]


def raw_table_name(dataset_key: str, file_name: str) -> str:
    """Name of the raw table of one file, at most 63 characters."""
    stem = re.sub(r"\.[^.]*$", "", file_name.rsplit("/", 1)[-1]) or file_name
    name = "kaggle_raw_{}_{}".format(
        identifier(dataset_key, prefix="dataset"), identifier(stem, prefix="file")
    )
    if len(name) <= 63:
        return name
    return f"{name[:54]}_{hashlib.sha1(name.encode()).hexdigest()[:8]}"
