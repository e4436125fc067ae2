"""Substring deduplication: words covered by a window of words that also starts anywhere else.

1. **Segments.** Each window of ``WINDOW`` words has an anchor: its run of ``ANCHOR`` words with the smallest hash,
   leftmost on ties. Consecutive windows with one anchor form a segment. Equal windows have equal anchors, so they meet
   under the anchor's hash; each segment has at most ``WINDOW - ANCHOR + 1`` windows.
2. **Counting.** Anchors that stand once are done: none of their windows repeats. A segment that stands twice as a
   whole repeats with all its windows. Only anchors with several *different* segments need a search.
3. **Search.** Those segments, one copy of each, are dealt over shards by anchor. Each shard builds compressed
   FM-indexes (Burrows-Wheeler transform in a wavelet matrix) of at most ``SHARD_WORDS`` words and streams the segments
   that stand once through it by backward search: matching statistics tell for each end the longest run up to it that
   stands at two places; where that reaches the window, the window repeats. An index ends between anchors, never inside.
4. **Hot anchors.** An anchor with more than ``ANCHOR_SEGMENTS`` different segments would make one task's work grow, so
   its segments are dealt by their windows' hashes and counted instead; the count is as exact as the search.

All that is compared are 64-bit hashes of words and of runs of words. Texts are moved twice by document, everything else
is narrow. No step brings the occurrences of one passage together in a task: they are pre-aggregated, or joined from
written tables, where Spark can split a hot key.

Defined results: a null or empty text has no words and nothing is removed; repeated rows repeat all their windows;
texts below ``WINDOW`` words keep everything; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlake.llm import wordhash
from laborlake.llm.fm_index import FMIndex
from laborlake.sources.staging import staged

WINDOW, ANCHOR = 35, 8
SHARD_WORDS = 60_000
ANCHOR_SEGMENTS = 100
#: Rows of segments per search task.
TASK_SEGMENTS = 20_000
LONGEST = 2 * WINDOW - ANCHOR


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``row``, a hash of both: rows alike in both are one row here, and get the same result."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


def _anchored(words: wordhash.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and number of windows of each segment, and its anchor's hash."""
    at = wordhash.whole_runs(words, WINDOW)
    if not len(at):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty.astype(np.uint64)
    n = len(words.hashes)
    grams = wordhash.run_hashes(words.hashes, np.arange(n - ANCHOR + 1), ANCHOR)
    low = np.uint64((1 << 28) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span, reach = WINDOW - ANCHOR + 1, 1
    while reach < span:
        ahead = min(reach, span - reach)
        least = np.minimum(least[: len(least) - ahead], least[ahead:])
        reach += ahead
    anchor = (least[at] & low).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return at[cut], np.diff(np.append(cut, len(at))), grams[anchor[cut]]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, ids = batch.column("row"), batch.column("doc_id")
        for lo, _, words in wordhash.chunks(batch.column("text")):
            start, n, key = _anchored(words)
            text = np.searchsorted(words.offsets, start, "right") - 1
            take = pa.array(text + lo)
            yield pa.record_batch(
                {
                    "row": rows.take(take),
                    "doc_id": ids.take(take),
                    "start": pa.array((start - words.offsets[text]).astype(np.int32)),
                    "n": pa.array(n.astype(np.int32)),
                    "key": _as_long(key),
                    "seg": _as_long(wordhash.run_hashes(words.hashes, start, n + WINDOW - 1)),
                }
            )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words' hashes of the segments listed in ``segs`` beside each text."""
    for batch in batches:
        lists = batch.column("segs")
        for lo, hi, words in wordhash.chunks(batch.column("text")):
            own = lists.slice(lo, hi - lo)
            flat = own.flatten()
            text = np.repeat(np.arange(hi - lo), own.value_lengths().to_numpy(zero_copy_only=False))
            starts = words.offsets[text] + flat.field("start").to_numpy()
            sizes = flat.field("n").to_numpy() + WINDOW - 1
            take = pa.array(text + lo)
            yield pa.record_batch(
                {
                    "row": batch.column("row").take(take),
                    "doc_id": batch.column("doc_id").take(take),
                    **{c: flat.field(c) for c in ("start", "n", "key", "occurs", "hot")},
                    "words": pa.array([words.hashes[a : a + k].tobytes() for a, k in zip(starts, sizes)], pa.binary()),
                }
            )


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All words of the binary rows one behind the other, and words per row."""
    sizes = np.array([len(x) // 8 for x in (b.as_py() for b in column)], np.int64)
    return np.frombuffer(b"".join(b.as_py() for b in column), np.uint64), sizes


def _runs(row: pa.Array, doc_id: pa.Array, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"row": row, "doc_id": doc_id, "start": pa.array(start.astype(np.int32)), "n": pa.array(n.astype(np.int32))})


def _searched(rows: pa.Table) -> pa.RecordBatch:
    """Windows of the rows that stand once and repeat, by one index over all the rows."""
    rows = rows.combine_chunks()
    hashes, sizes = _unpacked(rows["words"].combine_chunks())
    numbers = np.unique(hashes, return_inverse=True)[1] + 1
    # A passage ends with a 0; text i begins at begin[i].
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.zeros(begin[-1], np.int64)
    text[np.arange(len(hashes)) + np.repeat(np.arange(len(sizes)), sizes)] = numbers
    index = FMIndex(text, LONGEST)
    once = np.flatnonzero(rows["occurs"].to_numpy() == 1)
    n = rows["n"].to_numpy()[once].astype(np.int64)
    of = np.repeat(np.arange(len(once)), n)
    shift = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    length = index.matching(text, begin[once][of] + shift + WINDOW, WINDOW)
    hit = length >= WINDOW
    of, shift = of[hit], shift[hit]
    # Neighbouring windows of a segment as one run.
    first = np.concatenate([[True], (of[1:] != of[:-1]) | (shift[1:] != shift[:-1] + 1)]) if len(of) else np.zeros(0, bool)
    cut = np.flatnonzero(first)
    take = pa.array(once[of[cut]])
    start = rows["start"].to_numpy()[once[of[cut]]] + shift[cut]
    return _runs(rows["row"].combine_chunks().take(take), rows["doc_id"].combine_chunks().take(take), start, np.diff(np.append(cut, len(of))))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key: an index is closed at the first change of key beyond ``SHARD_WORDS``."""
    kept: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        keys = batch.column("key").to_numpy()
        lengths = batch.column("n").to_numpy() + WINDOW
        changes = np.concatenate([[last is not None and keys[0] != last], keys[1:] != keys[:-1]]) if len(keys) else []
        begun = 0
        for k in np.flatnonzero(changes):
            size += int(lengths[begun:k].sum())
            kept.append(batch.slice(begun, k - begun))
            begun = int(k)
            if size >= SHARD_WORDS:
                yield _searched(pa.Table.from_batches(kept))
                kept, size = [], 0
        if len(keys):
            kept.append(batch.slice(begun))
            size += int(lengths[begun:].sum())
            last = keys[-1]
    kept = [b for b in kept if b.num_rows]
    if kept:
        yield _searched(pa.Table.from_batches(kept))


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, sizes = _unpacked(batch.column("words"))
        n = batch.column("n").to_numpy().astype(np.int64)
        of = np.repeat(np.arange(len(n)), n)
        shift = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        begin = np.cumsum(sizes) - sizes
        take = pa.array(of)
        yield pa.record_batch(
            {
                "row": batch.column("row").take(take),
                "doc_id": batch.column("doc_id").take(take),
                "start": pa.array((batch.column("start").to_numpy()[of] + shift).astype(np.int32)),
                "occurs": batch.column("occurs").take(take),
                "window": _as_long(wordhash.run_hashes(hashes, begin[of] + shift, WINDOW)),
            }
        )


def _covered(start: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` words the windows cover: ``n`` windows from each start."""
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, start, 1)
    np.add.at(edges, start + n + WINDOW - 1, -1)
    return np.cumsum(edges[:-1]) > 0


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_words, n_removed and the kept words joined by one space."""
    for batch in batches:
        lists = batch.column("runs")
        totals, removed, kept = [], [], []
        for lo, hi, words in wordhash.chunks(batch.column("text")):
            data = words.data.tobytes()
            for i in range(hi - lo):
                a, b = int(words.offsets[i]), int(words.offsets[i + 1])
                runs = lists[lo + i].values
                stay = np.arange(a, b)
                if runs is not None and len(runs):
                    gone = _covered(runs.field("start").to_numpy().astype(np.int64), runs.field("n").to_numpy().astype(np.int64), b - a)
                    stay = stay[~gone]
                totals.append(b - a)
                removed.append(b - a - len(stay))
                kept.append(b" ".join([data[s:e] for s, e in zip(words.starts[stay].tolist(), words.ends[stay].tolist())]))
        yield pa.record_batch(
            {
                "doc_id": batch.column("doc_id"),
                "n_words": pa.array(totals, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept": pa.array(kept, pa.binary()).cast(pa.string()),
            }
        )


RUNS = "row bigint, doc_id bigint, start int, n int"


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(row, doc_id, start, n): from word ``start`` on, ``n`` windows of the row repeat. Rows are those of ``_identified``."""
    spark = docs.sparkSession
    texts = _identified(docs)
    segments = staged(texts.mapInArrow(_segments, f"{RUNS}, key bigint, seg bigint"), "substring-segments")
    keys = staged(
        segments.groupBy("key")
        .agg(F.count("*").alias("times"), F.min("seg").alias("lo"), F.max("seg").alias("hi"))
        .where("times > 1")
        .select("key", (F.col("lo") != F.col("hi")).alias("several")),
        "substring-keys",
    )
    candidates = staged(segments.join(keys, "key"), "substring-candidates")
    alike = candidates.where("not several").select("row", "doc_id", "start", "n")

    distinct = staged(
        candidates.where("several")
        .groupBy("key", "seg")
        .agg(F.count("*").alias("occurs"), *[F.first(c).alias(c) for c in ("row", "doc_id", "start", "n")]),
        "substring-distinct",
    )
    per_key = staged(distinct.groupBy("key").agg((F.count("*") > ANCHOR_SEGMENTS).alias("hot")), "substring-hot")
    copies = candidates.where("several").join(distinct.where("occurs > 1").select("key", "seg"), ["key", "seg"])
    copies = copies.select("row", "doc_id", "start", "n")

    listed = (
        distinct.join(per_key, "key")
        .groupBy("row", "doc_id")
        .agg(F.collect_list(F.struct("start", "n", "key", "occurs", "hot")).alias("segs"))
    )
    on = (F.col("t.row") == F.col("l.row")) & F.col("t.doc_id").eqNullSafe(F.col("l.doc_id"))
    beside = texts.alias("t").join(listed.alias("l"), on).select("t.row", "t.doc_id", "t.text", "l.segs")
    piece = f"{RUNS}, key bigint, occurs bigint, hot boolean, words binary"
    pieces = staged(beside.mapInArrow(_pieces, piece), "substring-pieces")

    cold = pieces.where("not hot")
    tasks = max(1, distinct.count() // TASK_SEGMENTS, spark.sparkContext.defaultParallelism)
    found = cold.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(_search, RUNS)

    windows = staged(
        pieces.where("hot").mapInArrow(_window_hashes, "row bigint, doc_id bigint, start int, occurs bigint, window bigint"),
        "substring-windows",
    )
    often = staged(
        windows.groupBy("window").agg(F.sum("occurs").alias("times")).where("times > 1").select("window"), "substring-often"
    )
    counted = windows.where("occurs = 1").join(often, "window").select("row", "doc_id", "start", F.lit(1).alias("n"))
    return alike.unionByName(copies).unionByName(found).unionByName(counted)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept`` (the words left, joined by one space) of every row of ``docs``."""
    texts = _identified(docs)
    runs = repeated_runs(docs).groupBy("row", "doc_id").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    on = (F.col("t.row") == F.col("r.row")) & F.col("t.doc_id").eqNullSafe(F.col("r.doc_id"))
    beside = texts.alias("t").join(runs.alias("r"), on, "left").select("t.doc_id", "t.text", "r.runs")
    return beside.mapInArrow(_cut_out, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
