"""Column expressions and small frames that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def fold(doc_id: Column, n: int) -> Column:
    """Remainder by which rows are held out: crc32 of the id as text, modulo ``n``."""
    return F.crc32(doc_id.cast("string")) % n


#: Largest table of labels, in rows, that is handed to each task whole (about 16 bytes a row).
BROADCAST_LABELS = 1_000_000


def labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """``docs`` rows with a 0/1 column ``label`` where ``labels`` has one for the id; repeated labels of an id agree on the larger.

    Up to ``BROADCAST_LABELS`` labels go to the documents, so that no text moves; more are joined by a shuffle.
    """
    labels = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = labels.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    return docs.join(F.broadcast(known) if labels.count() <= BROADCAST_LABELS else known, "doc_id")


def unused(df: DataFrame, name: str) -> str:
    """``name``, or that with underscores before it, so that ``df`` has no such column, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """The whole row as ``given``, and other columns beside it, whose names can't clash with the row's."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("given"), *[c.alias(name) for name, c in more.items()])


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(f"given.`{c}`") for c in columns])


#: Bits of the map that tells which rows may be in a set, whatever its size: 4 MB, as rows of 64 bits 8 MB.
SET_BITS = 1 << 25


def met(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``packed`` rows of ``docs`` with their key (row, doc_id) and whether ``rows`` (row, doc_id) may have it: ``met``.

    A bitmap of a fixed number of bits is handed to every task; it may let other rows pass, never stop one. So texts of
    rows that are not in a set need no shuffle, unless the set is far larger than the map.
    """
    bits = rows.select(F.pmod("row", F.lit(SET_BITS)).alias("bit"))
    blocks = bits.selectExpr("bit div 64 AS block", "shiftleft(1L, cast(bit % 64 AS int)) AS bits").groupBy("block").agg(F.bit_or("bits").alias("bits"))
    keyed = packed(docs, row=F.xxhash64("doc_id", "text"), doc_id=F.col("doc_id"))
    place = F.pmod("row", F.lit(SET_BITS))
    joined = keyed.withColumn("place", place).join(F.broadcast(blocks), F.expr("place div 64") == F.col("block"), "left")
    hit = F.coalesce(F.expr("(shiftrightunsigned(bits, cast(place % 64 AS int)) & 1L) = 1"), F.lit(False))
    return joined.select("given", "row", "doc_id", hit.alias("met"))


def listed(docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs``, packed, in two parts: those that ``rows`` (row, doc_id and more) surely doesn't have, and the others beside
    their row there (``found``, null if there is none). The others, few if the set is, move in one join at every size."""
    marked = met(docs, rows)
    more = F.struct(*[F.col(c) for c in rows.columns]).alias("found")
    known = rows.select(F.col("row").alias("_row"), F.col("doc_id").alias("_doc_id"), more).hint("merge")
    same = (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    return marked.where(~F.col("met")), marked.where("met").join(known, same, "left").select("given", "row", "doc_id", "found")


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is not in ``rows`` (row, doc_id), with their columns."""
    sure, others = listed(docs, rows)
    return unpacked(sure.select("given").unionByName(others.where("found is null").select("given")), docs.columns)
