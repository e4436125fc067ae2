"""Benchmark decontamination by greedy string tiling.

1. Texts and items are lower-cased and cut into runs of letters and digits; a seed is a run of ``SEED`` words.
2. A bitmap of all items' seed hashes, of a fixed number of bits, tells which runs of a document can matter at all; it
   may let others pass, never stop one. Only those runs leave the scan of the documents.
3. The runs' seeds are joined to the items' seeds, and each pair of document and item that shares a seed gets the
   document's runs and the item's words.
4. Each pair is tiled: longest matches first, found by running Karp-Rabin hashes at falling lengths, marked so that no
   word of either side is used twice. An item covered by tiles to ``LEAST_COVERAGE`` of its words or more is in the
   document, in whatever order its parts stand.

Tiles shorter than a seed don't count, and words of a tile stand in runs whose seeds all are the item's, so the runs
hold every tile. Larger benchmarks fill the bitmap; then more runs reach the join, and results stay the same.

Defined results: null or empty texts, and items of fewer than ``SEED`` words, match nothing; repeated documents are
reported as one; items with a null id are left out; repeated items with one id are tiled one by one and the best counts.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlake.llm import columns, wordhash
from laborlake.sources.staging import freed, staged

SEED = 5
LEAST_COVERAGE = 0.6
#: Bits of the bitmap, whatever the size of the benchmark: 2 MB.
BITS = 1 << 24


def _lowered(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.lower("text").alias("text"))


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and seeds (hashes) of each item."""
    for batch in batches:
        words, seeds = [], []
        for lo, hi, found in wordhash.chunks(batch.column("text"), wordhash.PUNCTUATION):
            for i in range(hi - lo):
                own = found.hashes[found.offsets[i] : found.offsets[i + 1]]
                words.append(own.tobytes())
                n = max(0, len(own) - SEED + 1)
                seeds.append(np.unique(wordhash.run_hashes(own, np.arange(n), SEED).view(np.int64)))
        yield pa.record_batch(
            {"item_id": batch.column("item_id"), "words": pa.array(words, pa.binary()), "seeds": pa.array(seeds, pa.list_(pa.int64()))}
        )


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """Bits set at each seed's remainder; at most ``BITS`` / 64 rows reach the driver."""
    blocks = (
        seeds.select(F.pmod("seed", F.lit(BITS)).alias("bit"))
        .selectExpr("bit div 64 AS block", "shiftleft(1L, cast(bit % 64 AS int)) AS bits")
        .groupBy("block")
        .agg(F.bit_or("bits").alias("bits"))
        .toArrow()
    )
    out = np.zeros(BITS // 64, np.int64)
    out[blocks["block"].to_numpy()] = blocks["bits"].to_numpy()
    return out.view(np.uint64)


def _runs_with(bitmap_of):
    """Runs of words of which every seed may be an item's."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = bitmap_of.value
        for batch in batches:
            for lo, _, words in wordhash.chunks(batch.column("text"), wordhash.PUNCTUATION):
                at = wordhash.whole_runs(words, SEED)
                seeds = wordhash.run_hashes(words.hashes, at, SEED)
                bit = seeds & np.uint64(BITS - 1)
                hit = ((bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)
                at, seeds = at[hit], seeds[hit]
                if not len(at):
                    continue
                text = np.searchsorted(words.offsets, at, "right") - 1
                cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1])]))
                n = np.diff(np.append(cut, len(at)))
                take = pa.array(text[cut] + lo)
                yield pa.record_batch(
                    {
                        "row": batch.column("row").take(take),
                        "doc_id": batch.column("doc_id").take(take),
                        "start": pa.array((at[cut] - words.offsets[text[cut]]).astype(np.int32)),
                        "words": pa.array([words.hashes[a : a + k + SEED - 1].tobytes() for a, k in zip(at[cut], n)], pa.binary()),
                        "seeds": pa.ListArray.from_arrays(pa.array(np.append(cut, len(at)).astype(np.int32)), pa.array(seeds.view(np.int64))),
                    }
                )

    return found


def _starts(hashes: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the runs of ``size`` words of which all are free."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    taken = np.concatenate([[0], np.cumsum(~free)])
    at = np.flatnonzero(taken[size:] == taken[:-size])
    return at, wordhash.run_hashes(hashes, at, size)


def tiles(item: np.ndarray, text: np.ndarray, barred: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiles (item start, text start, words): the longest match of free words first (of equal ones the first in the
    item, then in the text), both sides marked, down to ``least`` words. ``barred`` words of the text match nothing."""
    free_item, free_text = np.ones(len(item), bool), ~barred
    found: list[tuple[int, int, int]] = []
    size = max(least, min(len(item), len(text)))
    while True:
        at_item, hash_item = _starts(item, free_item, size)
        at_text, hash_text = _starts(text, free_text, size)
        common = np.isin(hash_text, hash_item)
        matches = []
        if common.any():
            places = defaultdict(list)
            for a, h in zip(at_item.tolist(), hash_item.tolist()):
                places[h].append(a)
            known: dict[int, int] = {}
            for b, h in zip(at_text[common].tolist(), hash_text[common].tolist()):
                for a in places[h]:
                    if known.get(a - b, -1) >= b + size:  # inside a match found on this diagonal
                        continue
                    k = size
                    while a + k < len(item) and b + k < len(text) and free_item[a + k] and free_text[b + k] and item[a + k] == text[b + k]:
                        k += 1
                    known[a - b] = b + k
                    matches.append((-k, a, b))
        heapq.heapify(matches)
        while matches:
            k, a, b = heapq.heappop(matches)
            free = free_item[a : a - k] & free_text[b : b - k]
            if free.all():
                free_item[a : a - k] = free_text[b : b - k] = False
                found.append((a, b, -k))
                continue
            # What others left of it takes its turn by its own length; parts shorter than ``size`` are found later.
            edge = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
            for i, j in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if j - i >= size:
                    heapq.heappush(matches, (i - j, a + i, b + i))
        if size == least:
            return found
        size = max(least, size // 2)


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, covered, parts = [], [], []
        for words, runs in zip(batch.column("words").to_pylist(), batch.column("runs").to_pylist()):
            item = np.frombuffer(words, np.uint64)
            text = [np.frombuffer(r["words"], np.uint64) for r in sorted(runs, key=lambda r: r["start"])]
            bar = np.zeros(1, np.uint64)
            joined = np.concatenate([x for t in text for x in (t, bar)])
            barred = np.zeros(len(joined), bool)
            barred[np.cumsum([len(t) + 1 for t in text]) - 1] = True
            found = tiles(item, joined, barred)
            sizes.append(len(item))
            covered.append(sum(k for _, _, k in found))
            parts.append(len(found))
        yield pa.record_batch(
            {
                "row": batch.column("row"), "doc_id": batch.column("doc_id"), "item_id": batch.column("item_id"),
                "item_words": pa.array(sizes, pa.int64()), "covered": pa.array(covered, pa.int64()), "tiles": pa.array(parts, pa.int64()),
            }
        )


def coverage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row, doc_id, item_id, item_words, covered, tiles) for each document and item that share a seed; ``row`` is
    ``row_key`` of the document."""
    spark = docs.sparkSession
    items = _lowered(benchmark.where("item_id is not null"), "item_id").mapInArrow(
        _item_words, "item_id bigint, words binary, seeds array<bigint>"
    )
    items = staged(items.withColumn("item", F.xxhash64("item_id", "words")), "tiling-items").dropDuplicates(["item"])
    seeds = staged(items.select("item", F.explode("seeds").alias("seed")), "tiling-seeds")
    bitmap = spark.sparkContext.broadcast(_bitmap(seeds))
    runs = staged(
        docs.select(row_key().alias("row"), "doc_id", F.lower("text").alias("text")).mapInArrow(
            _runs_with(bitmap), "row bigint, doc_id bigint, start int, words binary, seeds array<bigint>"
        ),
        "tiling-runs",
    )
    key = ["row", "doc_id", "start"]
    shared = (
        runs.select(*key, F.explode("seeds").alias("seed"))
        .join(seeds, "seed")
        .groupBy(*key)
        .agg(F.collect_set("item").alias("items"))
    )
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    with_items = runs.drop("seeds").alias("a").join(shared.alias("b"), same).select("a.*", F.explode("b.items").alias("item"))
    pairs = staged(
        with_items.groupBy("row", "doc_id", "item").agg(F.collect_set(F.struct("start", "words")).alias("runs")), "tiling-pairs"
    )
    sides = pairs.join(items.select("item", "item_id", "words"), "item").select("row", "doc_id", "item", "item_id", "words", "runs")
    # Pairs are few bytes and much work: a fixed number of tasks, so that they are not packed into one by size.
    sides = sides.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "row", "item").drop("item")
    return sides.mapInArrow(_tiled, "row bigint, doc_id bigint, item_id bigint, item_words bigint, covered bigint, tiles bigint")


def row_key():
    return F.xxhash64("doc_id", "text")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_COVERAGE) -> DataFrame:
    """One row per contaminated document: row, doc_id, the items in it, the best coverage and its tiles."""
    found = coverage(docs, benchmark).withColumn("share", F.col("covered") / F.col("item_words")).where(F.col("share") >= least)
    return found.groupBy("row", "doc_id").agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("share").alias("coverage"), F.max("tiles").alias("tiles")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_COVERAGE) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns, whatever their names."""
    with freed(docs.sparkSession):
        out = staged(contaminated(docs, benchmark, least).select("row", "doc_id"), "tiling-found", keep=True)
    return columns.without(docs, out)
