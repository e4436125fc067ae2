"""Text -> typed values. Every parser returns NULL instead of raising, also in ANSI mode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from laborlake.functions import lexicons as lx

# All characters Unicode calls white space; Spark's plain trim strips only U+0020.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_INTEGER = r"^[+-]?[0-9]+$"
_OFFSET = r"([0-9]:[0-9]{1,2}(?:[.][0-9]+)?)[ ]*([+-][0-9]{2}(?::?[0-9]{2})?)$"
_ISO = (
    r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
    r"(T[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}Z?|\s+[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2})?$"
)
_DAY_FIRST = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$"


def strip(c: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.btrim(c, F.lit(WHITESPACE))


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _as_number(text: Column) -> Column:
    """Double from text that is a plain decimal; NULL for 'nan', '5d', hex and the like."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def positive(c: Column) -> Column:
    """Keep numbers above zero; NaN counts as missing."""
    return F.when((c > 0) & ~F.isnan(c), c)


def money(c: Column) -> Column:
    """Amount text with ',' and '$' allowed; only values above zero."""
    return positive(_as_number(strip(F.translate(c.cast("string"), ",$", ""))))


def money_k(c: Column) -> Column:
    """Like ``money`` but '120k' is 120,000, and a 'k' amount may be zero or negative."""
    text = F.translate(F.lower(strip(c.cast("string"))), ",$", "")
    thousands = _as_number(strip(F.substring(text, 1, F.length(text) - 1))) * 1000
    return F.when(F.endswith(text, F.lit("k")), thousands).otherwise(
        positive(_as_number(strip(text)))
    )


def integer(c: Column) -> Column:
    text = strip(c.cast("string"))
    return F.when(text.rlike(_INTEGER), text.try_cast("int"))


def salary_range(c: Column) -> Column:
    """Struct(low, high) of the amounts above 100 named in free text such as '$120k - $150k'.

    A 'k' amount is written out in place before numbers are picked, so the
    pieces are: amounts with 'k', and every other single character.
    """
    squeezed = F.regexp_replace(c, r"(?U)[€£¥$,\s]", "")
    pieces = F.regexp_extract_all(squeezed, F.lit(r"(?is)[0-9]+\.?[0-9]*k|."), F.lit(0))
    spelled = F.array_join(
        F.transform(
            pieces,
            lambda p: F.when(
                p.rlike("(?i)^[0-9].*k$"),
                (F.regexp_replace(p, "(?i)k$", "").try_cast("double") * 1000)
                .try_cast("bigint")
                .cast("string"),
            ).otherwise(p),
        ),
        "",
    )
    found = F.filter(
        F.transform(
            F.regexp_extract_all(spelled, F.lit(r"[0-9]+\.?[0-9]*"), F.lit(0)),
            lambda n: n.try_cast("double"),
        ),
        lambda n: n > 100,
    )
    return F.struct(F.array_min(found).alias("low"), F.array_max(found).alias("high"))


def _boolean(c: Column, yes: Sequence[str], no: Sequence[str]) -> Column:
    text = F.lower(strip(c.cast("string")))
    return F.when(text.isin(*yes), F.lit(True)).when(text.isin(*no), F.lit(False))


def boolean_wide(c: Column) -> Column:
    return _boolean(c, lx.TRUE_WIDE, lx.FALSE_WIDE)


def boolean_bulk(c: Column) -> Column:
    return _boolean(c, lx.TRUE_BULK, lx.FALSE_BULK)


def timestamp(c: Column, *, strip_first: bool = False) -> Column:
    """Zone-less timestamp in UTC.

    Accepts ISO with 'T' (an optional 'Z'), ISO with a blank, an ISO date and
    day/month/year, read from the first 19 characters. A fraction behind them is
    dropped; an offset such as -08:00, -0800 or -08 behind a time is taken off, so
    the result is the time in UTC. Without an offset the time stands as it is. A
    time without seconds gives NULL, whatever its offset.
    """
    offset = F.regexp_extract(strip(c), _OFFSET, 2)
    hours = F.try_to_number(F.substring(offset, 2, 2), F.lit("99"))
    rest = F.coalesce(F.try_to_number(F.substring(F.regexp_replace(offset, ":", ""), 4, 2), F.lit("99")), F.lit(0))
    minutes = hours * 60 + rest
    ahead = F.make_dt_interval(mins=F.when(offset.startswith("-"), -minutes).otherwise(minutes).cast("int"))
    local = _local_timestamp(F.regexp_replace(strip(c) if strip_first else F.rtrim(c, F.lit(WHITESPACE)), _OFFSET, "$1"))
    return F.when(offset == "", local).otherwise(local - ahead)


def _local_timestamp(c: Column) -> Column:
    text = F.substring(c, 1, 19)
    iso = F.regexp_replace(text, _DAY_FIRST, "$3-$2-$1")
    plain = F.regexp_replace(F.rtrim(iso, F.lit("Z")), r"\s+", " ")
    return F.when(iso.rlike(_ISO), plain.try_cast("timestamp_ntz"))


def skill_list(c: Column) -> Column:
    """Lower-cased list from '["a", "b"]', "['a', 'b']" or 'a, b'; never NULL."""
    text = strip(c)
    parsed = F.coalesce(
        F.from_json(text, "array<string>"),
        F.from_json(F.regexp_replace(text, "'", '"'), "array<string>"),
    )
    as_json = F.transform(F.filter(parsed, lambda x: x.isNotNull() & (x != "")), _lower_strip)
    inner = F.btrim(text, F.lit("[]"))
    usable_json = text.startswith("[") & text.endswith("]") & parsed.isNotNull()
    return F.coalesce(F.when(usable_json, as_json), split_list(inner), F.array().cast("array<string>"))


def split_list(c: Column) -> Column:
    """Comma-separated text as a lower-cased list without empty entries."""
    parts = F.transform(F.split(c, ",", -1), _lower_strip)
    return F.filter(parts, lambda x: x != "")


def bulk_skills(c: Column) -> Column:
    """Skill column of a bulk file: bracketed text as a list, other text split at commas."""
    text = strip(c)
    plain = text.contains(",") & ~text.startswith("[")
    return F.coalesce(
        F.when(plain, split_list(text)).otherwise(skill_list(text)),
        F.array().cast("array<string>"),
    )


def _lower_strip(x: Column) -> Column:
    return strip(F.lower(x))
