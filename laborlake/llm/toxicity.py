"""Toxicity by two class-conditional Kneser-Ney models that back off to shared counts.

The models are bigram models over lower-cased runs of letters and digits. Per class, a word after another has its
discounted count over the count of the word before, and what discounting leaves goes to the class's continuation model:
after how many different words it stands. That one is discounted too, and what is left there goes to continuation counts
pooled over both classes, so rare expressions fall back on one estimate for both and weigh little. Discounts follow
from the counts of counts. Both classes back off with the same weights, and the larger class's counts are brought to the
smaller one's size before they are discounted: what neither class knows, or only the larger one could have seen, says
nothing. Without that, the log-ratio would mostly tell how much text each class has of a language.

Every pair of words that training texts hold has its own estimate, however rare it is. Its log-ratio is the mean of the
pair's own and that of its last word alone, weighted by the chance that the pair's split between the classes differs from
what that word predicts: the likelihood ratio of the two against ``PRIOR``. So a pair that stands in one toxic text hardly moves
its word's estimate, and one in many does.

Counting covers every labelled training text but those set aside for calibration, whole. Tasks emit each pair of words
once per chunk, Spark adds up, and one aggregation gives contexts, continuations and counts of counts. Counts and evidence
are written tables that grow with the input; the driver gets sums over them, and a map of ``MAP_BITS`` bits. Evidence is kept
of the words that have some, and of the pairs whose evidence is not their last word's. Texts meet it in a join of the words and
pairs that the map lets through; it lets others through too, and stops none. Words are numbers of ``BITS`` bits (a hash).

A text is scored by the mean log-ratio of its words and by its most toxic stretch of ``STRETCH`` words, brought to a chance
by logistic regression on training texts that were not counted: a fifth of each label's, at least one and at most about half
of ``SAMPLE``, weighted back to the labels' shares.

Defined results: a null, empty or wordless text has mean 0 and a score like any; repeated rows count as often as they stand
there; an empty table gives an empty result. Where nothing can be learned (a label with fewer than two training documents, or
texts set aside that all measure the same) every score is 0.5, ``learned`` is false, and no document counts as toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laborlake.llm import columns, wordhash
from laborlake.sources.staging import freed, staged

BITS = 31
SIZE = 1 << BITS
#: Bits of the map that tells which words and pairs may have evidence, whatever their number: 8 MB.
MAP_BITS = 26
STRETCH = 32
SAMPLE = 20_000
#: Added to each word's shared count; log-ratio that is noise.
ADDED, MARGIN = 5, 1.5
#: Log-ratio of the likelihoods of a pair's own split and of its last word's at which both weigh the same.
PRIOR = 8.0
#: Places by hash of a document; documents set aside up to which their number is exact.
PLACES, EXACT = 1 << 30, 1000
CONTEXT, CONTINUATION, COUNTS = range(3)
#: In a pair's place of the word before: the word alone.
ALONE = SIZE


def numbers(words: wordhash.Words) -> tuple[np.ndarray, np.ndarray]:
    """Each word's number and that of the word before it in its text (0 at the start)."""
    own = (words.hashes >> np.uint64(64 - BITS)).astype(np.int64)
    before = np.zeros_like(own)
    before[1:] = own[:-1]
    starts = words.offsets[:-1]
    before[starts[starts < len(own)]] = 0
    return own, before


def once_per_text(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and key of each key's first place in each text."""
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
    return text[fresh], key[fresh]


def places(keys: np.ndarray) -> np.ndarray:
    return (wordhash.mixed(keys.view(np.uint64)) >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = batch.column("label").to_numpy()
        for lo, hi, words in wordhash.chunks(batch.column("text"), wordhash.PUNCTUATION):
            own, before = numbers(words)
            text, pair = once_per_text(words.text_of(), (before << BITS) | own)
            bad = label[lo:hi][text].astype(bool)
            found, where = np.unique(pair, return_inverse=True)
            both = [np.bincount(where[m], minlength=len(found)) for m in (bad, ~bad)]
            yield pa.record_batch({"pair": pa.array(found), "bad": pa.array(both[0], pa.int64()), "good": pa.array(both[1], pa.int64())})


def pairs(counted: DataFrame) -> DataFrame:
    """Each pair of words of labelled texts (label, text), and how many bad and good texts hold it."""
    return (
        counted.mapInArrow(_counted, "pair bigint, bad bigint, good bigint")
        .groupBy("pair")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    )


def _before(pair: Column) -> Column:
    return F.shiftright(pair, BITS)


def _own(pair: Column) -> Column:
    return pair.bitwiseAND(F.lit(SIZE - 1).cast("long"))


def _sums(found: DataFrame) -> DataFrame:
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

    def entry(kind: int, *values):
        return F.struct(F.lit(kind).alias("kind"), *[v.cast("long").alias(c) for v, c in zip(values, ("id", *"abcd"))])

    bad, good, pair = F.col("bad"), F.col("good"), F.col("pair")
    in_bad, in_good = (bad > 0).cast("long"), (good > 0).cast("long")
    entries = F.array(
        entry(CONTEXT, _before(pair), bad, good, in_bad, in_good),
        entry(CONTINUATION, _own(pair), in_bad, in_good, one, none),
        entry(COUNTS, none, bad == 1, bad == 2, good == 1, good == 2),
    )
    rows = found.select(F.explode(entries).alias("s"))
    return rows.select("s.*").groupBy("kind", "id").agg(*[F.sum(c).alias(c) for c in "abcd"])


def statistics(counted: DataFrame) -> DataFrame:
    """(kind, id, a, b, c, d) of labelled texts (label, text). CONTEXT by word: how often it stands before another in
    bad and good texts, and before how many. CONTINUATION by word: after how many words it stands in bad, good and all
    texts. COUNTS: pairs that stand once and twice in bad, in good texts."""
    return _sums(pairs(counted))


def _discount(once: float, twice: float) -> float:
    return once / (once + 2 * twice) if once else 0.5


def evidence(found: DataFrame, stats: DataFrame) -> DataFrame:
    """(key, value): evidence of the words that have some (behind ``ALONE``), and of ``pairs`` whose evidence is another than their last word's."""
    totals = stats.groupBy("kind").agg(
        *[F.sum(c).alias(c) for c in "abcd"],
        *[F.count_if(F.col(c) == n).alias(f"{c}{n}") for c in "ab" for n in (1, 2)],
        *[F.count_if(F.col(c) > 0).alias(f"{c}s") for c in "abc"],
    )
    got = {r.kind: r for r in totals.collect()}
    if CONTEXT not in got:
        return found.sparkSession.createDataFrame([], "key bigint, value double")
    context, after, counts = (got[kind] for kind in (CONTEXT, CONTINUATION, COUNTS))
    # The class with fewer texts gives discounts and what is left to the shared counts; the other is brought to its size.
    small = "ab"[after.a > after.b]
    size = max(after[small], 1)
    cut = _discount(after[f"{small}1"], after[f"{small}2"])
    to_shared = cut * max(after[f"{small}s"], 1) / size
    shared = (F.col("c") + ADDED) / (after.c + ADDED * max(after.cs, 1))
    words = stats.where(F.col("kind") == CONTINUATION).select(
        F.col("id").alias("own"),
        *[(F.greatest(F.col(c) * (size / max(after[c], 1)) - cut, F.lit(0.0)) / size + to_shared * shared).alias(f"word_{c}") for c in "ab"],
    )
    words = words.withColumn("word_ratio", F.log(F.col("word_a") / F.col("word_b")))

    tokens = max(context[small], 1)
    scale = {c: tokens / max(context[c], 1) for c in "ab"}
    cut = _discount(*((counts.a, counts.b) if small == "a" else (counts.c, counts.d)))
    parts = found.select(
        *[f(F.col("pair")).alias(name) for f, name in ((_before, "before"), (_own, "own"))],
        "pair", "bad", "good",
        *[F.greatest(F.col(n) * scale[c] - cut, F.lit(0.0)).alias(f"own_{c}") for n, c in (("bad", "a"), ("good", "b"))],
    )
    contexts = parts.groupBy("before").agg(
        F.greatest(F.sum("bad") * scale["a"], F.sum("good") * scale["b"], F.lit(1.0)).alias("most"), F.sum("own_a").alias("all_a"), F.sum("own_b").alias("all_b")
    )
    contexts = contexts.select("before", "most", F.greatest(1 - F.greatest("all_a", "all_b") / F.col("most"), F.lit(1e-3)).alias("left"))

    # A pair of which discounting leaves nothing in either class is as its last word alone.
    met = parts.where("own_a > 0 or own_b > 0").join(words, "own").join(contexts, "before")
    chance = [F.col(f"own_{c}") / F.col("most") + F.col("left") * F.col(f"word_{c}") for c in "ab"]
    odds = F.col("word_a") * context.a / (F.col("word_b") * context.b) if context.a and context.b else F.lit(1.0)
    n, expected = F.col("bad") + F.col("good"), odds / (1 + odds)
    likelier = sum(
        (F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (n * p))).otherwise(0.0) for c, p in (("bad", expected), ("good", 1 - expected))), F.lit(0.0)
    )
    weight = 1 / (1 + F.exp(PRIOR - likelier))
    ratio = weight * F.log(chance[0] / chance[1]) + (1 - weight) * F.col("word_ratio")

    def above(x: Column) -> Column:
        return F.greatest(x - MARGIN, F.lit(0.0))

    own = met.select(F.col("pair").alias("key"), above(ratio).alias("value"), above(F.col("word_ratio")).alias("word")).where("value <> word").drop("word")
    alone = words.select((F.col("own") + F.lit(ALONE << BITS)).alias("key"), above(F.col("word_ratio")).alias("value")).where("value > 0")
    return own.unionByName(alone)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        place = places(batch.column("key").to_numpy())
        yield pa.record_batch({"block": pa.array(place >> 6), "bit": pa.array((place & 63).astype(np.int32))})


def _map(found: DataFrame) -> np.ndarray:
    """The map of the keys of ``evidence``, as 64 bits a number."""
    placed = found.select("key").mapInArrow(_placed, "block bigint, bit int")
    blocks = placed.groupBy("block").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    out[blocks["block"].to_numpy()] = blocks["bits"].to_numpy().view(np.uint64)
    return out


def _met(given: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text (row, text) the words and pairs that may have evidence, at a pair's first place, and the text's number of words."""
    for batch in batches:
        rows = batch.column("row").to_numpy()
        for lo, hi, words in wordhash.chunks(batch.column("text"), wordhash.PUNCTUATION):
            own, before = numbers(words)
            text, pair = words.text_of(), (before << BITS) | own
            order = np.lexsort((pair, text))
            fresh = np.ones(len(pair), bool)
            fresh[1:] = (text[order[1:]] != text[order[:-1]]) | (pair[order[1:]] != pair[order[:-1]])
            first = np.sort(order[fresh])
            at, n = first - words.offsets[text[first]], np.diff(words.offsets)[text[first]]
            for key in (pair[first], own[first] + (ALONE << BITS)):
                place = places(key)
                on = ((given.value[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
                columns_ = {"row": rows[lo:hi][text[first[on]]], "at": at[on].astype(np.int32), "n": n[on].astype(np.int32), "key": key[on]}
                yield pa.record_batch({name: pa.array(x) for name, x in columns_.items()})


def _measures(texts: DataFrame, found: DataFrame, given: Broadcast) -> DataFrame:
    """(row, mean, best) of the ``texts`` (row, text) with evidence: mean log-ratio, and the best mean of a stretch. Others have 0."""
    met = texts.mapInArrow(partial(_met, given), "row bigint, at int, n int, key bigint").join(found, "key")
    # A pair's evidence stands for its last word's; rows of one text that is there more than once are the same.
    pair = (F.col("key") < ALONE << BITS).cast("int").alias("pair")
    words = met.repartition("row").groupBy("row", "at").agg(F.first("n").alias("n"), F.max(F.struct(pair, "value")).alias("x")).where("x.value > 0")
    behind = Window.partitionBy("row").orderBy("at").rangeBetween(1 - STRETCH, 0)
    return (
        words.select("row", "n", F.col("x.value").alias("value"), F.sum("x.value").over(behind).alias("stretch"))
        .groupBy("row")
        .agg((F.sum("value") / F.first("n")).alias("mean"), (F.max("stretch") / STRETCH).alias("best"))
    )


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0, strength: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and weights (the last is the constant) of a logistic regression, by Newton steps."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = strength * np.eye(len(w))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (y - p)) - strength * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, w


def _set_aside(trained: DataFrame, sample: int) -> dict[int, tuple[int, int]] | None:
    """By label: documents in ``trained`` (doc_id, label), and the ``_place`` up to which they are set aside. None where a
    label has too few to count some and set others aside."""
    ids = trained.distinct()
    sizes = {r["label"]: r["count"] for r in ids.groupBy("label").count().collect()}
    if min(sizes.get(k, 0) for k in (0, 1)) < 2:
        return None
    out = {}
    for k in (0, 1):
        n = sizes[k]
        wanted = max(1, min(n // 5, sample // 2))
        upto = wanted * PLACES // n
        if wanted <= EXACT:  # a share by hash may hold none of few
            upto = ids.where(F.col("label") == k).select(_place().alias("p")).orderBy("p").limit(wanted).agg(F.max("p")).first()[0]
        out[k] = (n, upto)
    return out


def _place() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(PLACES))


@dataclass
class Classifier:
    """Evidence with its map, and what brings a text's measures to a chance."""

    evidence: DataFrame
    given: Broadcast
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def _chance(self, *measures: Column) -> Column:
        z = [(x - float(c)) / float(s) * float(w) for x, c, s, w in zip(measures, self.centre, self.scale, self.weights)]
        return 1 / (1 + F.exp(-(sum(z, F.lit(float(self.weights[-1]))))))

    def chances(self, texts: DataFrame) -> DataFrame:
        """(row, score) of the ``texts`` (row, text) with evidence; that of others is ``plain``."""
        return _measures(texts, self.evidence, self.given).select("row", self._chance(F.col("mean"), F.col("best")).alias("score"))

    def plain(self) -> float:
        z = float((-self.centre / self.scale) @ self.weights[:-1] + self.weights[-1])
        return float(1 / (1 + np.exp(-z)))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", F.lower("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier | None:
    """Learned from the labelled rows of ``docs`` outside the held-out fifth; None where nothing can be learned."""
    spark, texts = docs.sparkSession, _texts(docs)
    seen = F.coalesce(columns.fold(F.col("doc_id"), 5), F.lit(0)) != 0
    found_aside = _set_aside(columns.labelled(texts.where(seen).select("doc_id"), labels, "toxic"), sample)
    if found_aside is None:
        return None
    aside = _place() <= F.when(F.col("label") == 1, found_aside[1][1]).otherwise(found_aside[0][1])
    labelled = columns.labelled(texts.where(seen), labels, "toxic")
    with freed(spark):
        counts = staged(pairs(labelled.where(~aside).select("label", "text")), "toxic-pairs")
        found = staged(evidence(counts, staged(_sums(counts), "toxic-statistics")), "toxic-evidence", keep=True)
    given = spark.sparkContext.broadcast(_map(found))
    measured = _measures(labelled.where(aside).select("row", "text"), found, given)
    both = labelled.where(aside).select("row", "label").join(measured, "row", "left")
    got = both.select("label", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", "best")]).toArrow()
    y = got["label"].to_numpy().astype(float)
    x = np.column_stack([got["mean"].to_numpy(), got["best"].to_numpy()])
    if not x.std(0).any():
        return None
    weight = np.where(y == 1, found_aside[1][0] / y.sum(), found_aside[0][0] / (1 - y).sum())
    return Classifier(found, given, *calibrate(x, y, weight / weight.mean()))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """row, doc_id, score (chance of label 1) and learned (false: the score says nothing) of every row of ``docs``; labels of
    the held-out fifth are not read."""
    texts = _texts(docs)
    found = train(docs, labels, sample)
    if found is None:
        return texts.select("row", "doc_id", F.lit(0.5).alias("score"), F.lit(False).alias("learned"))
    scored = texts.select("row", "doc_id").join(found.chances(texts.select("row", "text")), "row", "left")
    return scored.select("row", "doc_id", F.coalesce("score", F.lit(found.plain())).alias("score"), F.lit(True).alias("learned"))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that are not toxic at ``threshold``, with their columns, whatever their names; all rows where
    nothing was learned. Of texts only those move whose row may be among the few that differ from a text without evidence."""
    found = train(docs, labels, sample)
    if found is None:
        return docs
    texts = _texts(docs)
    toxic = F.col("score") >= threshold
    plain = found.plain() >= threshold
    others = found.chances(texts.select("row", "text")).where(~toxic if plain else toxic)
    rows = staged(texts.select("row", "doc_id").join(others.select("row"), "row").distinct(), "toxic-rows", keep=True)
    if not plain:
        return columns.without(docs, rows)
    return columns.unpacked(columns.listed(docs, rows)[1].where("found is not null").select("given"), docs.columns)
