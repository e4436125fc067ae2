"""Mixing sources to target weights: tokens per source give repetition rates, and rates give copies of documents.

Sources in code-point order (null last) take the weights in turn and share ``factor`` times all tokens by weight.
A target stops at ``most`` times its source's size, and what is above goes to the others by weight until none is above.
The end of that sharing is a common level: with sources sorted by cap over weight, the level that is left for the
sources from the k-th on is ``(total - caps before k) / (weights from k on)``, and the first source whose cap is above
its share of that level ends the capped ones. So two running sums over one row per source are enough.

Each document is taken ``floor(rate)`` times and once more where a hash of the seed and the document, read as a
fraction, is below the rest of the rate. A document's copies depend on nothing but its source's rate, so reruns,
retries and other partitionings agree.

Defined results: a null text has size 0; a source without tokens has target and rate 0; a null source is a source of
its own; repeated rows get the same number of copies; an empty table gives an empty mix. Rows with a null id are drawn
by the digest of their text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laborlake.llm import columns
from laborlake.sources.staging import freed, staged

#: Salts that deal out the rows of one source when rates are joined by a shuffle.
SALTS = 32
#: Largest table of rates, in rows, that is handed to each task whole (about 100 bytes a row).
BROADCAST_SOURCES = 50_000
#: Hexadecimal digits of the digest that make the drawn fraction: 52 bits, exact in a double.
DIGITS = 13


def source_rates(
    sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), factor: tuple[int, int] = (3, 2), most: int = 2
) -> DataFrame:
    """One row per source of ``sizes`` (source, size): source, source_size, target, rate. ``factor`` is a fraction.

    Sums are whole numbers until the one division, so the result doesn't depend on their order.
    """
    up, down = factor
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int"))
    by_cap = Window.orderBy((most * F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    shared = (
        per.withColumn("weight", weight.cast("long"))
        .withColumn("_all", F.sum("source_size").over(everything))
        .withColumn("_caps", F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0)))
        .withColumn("_weights", F.sum("weight").over(after))
        .withColumn("_left", up * F.col("_all") - down * F.col("_caps"))
        .withColumn("_capped", down * most * F.col("source_size") * F.col("_weights") <= F.col("weight") * F.col("_left"))
        .withColumn("_rank", F.row_number().over(by_cap))
        .withColumn("_first", F.min(F.when(~F.col("_capped"), F.col("_rank"))).over(everything))
        .withColumn("_left", F.max(F.when(F.col("_rank") == F.col("_first"), F.col("_left"))).over(everything))
        .withColumn("_weights", F.max(F.when(F.col("_rank") == F.col("_first"), F.col("_weights"))).over(everything))
    )
    target = F.when(
        F.col("_first").isNull() | (F.col("_rank") < F.col("_first")), (most * F.col("source_size")).cast("double")
    ).otherwise((F.col("weight") * F.col("_left")).cast("double") / (down * F.col("_weights")).cast("double"))
    return shared.select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    )


def drawn(seed: str, doc_id: Column, text: Column) -> Column:
    """A fraction in [0, 1) from the seed and the document's id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.md5(text.cast("binary")), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def with_rates(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """``docs`` (with a column ``source``) beside their source's row of ``rates``, whatever share of rows a source has.

    A table of rates within ``BROADCAST_SOURCES`` rows goes to each task; a larger one is repeated per salt and joined
    by a shuffle in which a source's rows are dealt over ``SALTS`` keys.
    """
    if rates.count() <= BROADCAST_SOURCES:
        return docs.join(F.broadcast(rates.withColumnRenamed("source", "__source")), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    dealt = docs.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    spread = rates.withColumnRenamed("source", "__source").withColumn("__salted", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = (F.col("__salt") == F.col("__salted")) & F.col("source").eqNullSafe(F.col("__source"))
    return dealt.join(spread, same).drop("__source", "__salt", "__salted")


def copies(docs: DataFrame, seed: str = "mix", **shares) -> DataFrame:
    """doc_id, source, size, source_size, target, rate and ``copies`` of every row of ``docs``, without its text.

    Texts are measured once; the narrow rows are written, so that the second pass doesn't read them again.
    """
    narrow = docs.select(
        "doc_id", "source", columns.n_words(F.col("text")).alias("size"), drawn(seed, F.col("doc_id"), F.col("text")).alias("__drawn")
    )
    sizes = staged(narrow, "mix-sizes")
    rates = staged(source_rates(sizes, **shares), "mix-rates")
    whole = F.floor("rate")
    more = F.when(F.col("__drawn") < F.col("rate") - whole, 1).otherwise(0)
    return with_rates(sizes, rates).withColumn("copies", (whole + more).cast("long")).drop("__drawn")


def mix(docs: DataFrame, seed: str = "mix", **shares) -> DataFrame:
    """Every row of ``docs`` as often as the mix takes it, with ``copy`` numbered from 1 (replacing a column of that name). Other
    columns stay as they are, whatever their names."""
    sizes = docs.select("source", columns.n_words(F.col("text")).alias("size"))
    with freed(docs.sparkSession):
        rates = staged(source_rates(sizes, **shares), "mix-rates", keep=True).select("source", "rate")
    keyed = columns.packed(docs, source=F.col("source"), doc_id=F.col("doc_id"))
    whole = F.floor("rate")
    more = F.when(drawn(seed, F.col("given.doc_id"), F.col("given.text")) < F.col("rate") - whole, 1).otherwise(0)
    times = (whole + more).cast("int")
    return (
        with_rates(keyed, rates)
        .withColumn("times", times)
        .where("times > 0")
        .withColumn("number", F.explode(F.sequence(F.lit(1), F.col("times"))))
        .select(*[F.col(f"given.`{c}`") for c in docs.columns if c != "copy"], F.col("number").alias("copy"))
    )
