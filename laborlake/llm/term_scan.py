"""Ranked lexical search without an index of the documents: one scan with an Aho-Corasick automaton of all items' terms.

1. The items' distinct terms become patterns with a blank on either side. Blocks of about ``PAIRS`` (item, term) pairs
   are handed to tasks whole as an automaton; more items make more blocks, and each block is one scan of the documents.
2. In each text everything but letters and digits becomes a blank and A-Z small letters, byte by byte, with a blank
   before and behind. Neighbouring terms share their blank, so the automaton meets every term of the text that an item
   has, and none inside a longer one. Its outputs are term numbers; their counts are the term frequencies.
3. Documents, terms and documents per term are summed by Spark over what the scan wrote, and give the weights.
4. Outputs map to items: each task adds up what a term gives to the items that have it and keeps the ``k`` best documents
   of each item; Spark ranks what the tasks kept. A document's scores are whole numbers, so sums do not depend on order.

Defined results: null and empty texts have no term and are no document; items without a term, or whose terms stand
nowhere, have no row; repeated documents are ranked one by one; rows of one ``item_id`` (null too) are one item; of equal
scores the smaller ``doc_id`` comes first, a null one last; empty tables give no row. Texts are scanned whole, one at a
time. Columns other than doc_id, item_id and text, of whatever name, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laborlake.sources.staging import staged

#: A term is a run of ASCII letters and digits and of anything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (item, term) pairs of one block: about 20 MB as an automaton.
PAIRS = 200_000
TOP = 10
#: Scores that are added up at once in a task.
ADDED_AT_ONCE = 1 << 20

#: Bytes as they are scanned: A-Z lowered, the other ASCII signs blank.
SCANNED = bytes((b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32) for b in range(256))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item."""
    found = F.regexp_extract_all(F.translate(F.col("text"), UPPER, LOWER), F.lit(TERM), F.lit(0))
    return items.select("item_id", F.explode(found).alias("term")).distinct()


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, term in enumerate(terms or [" "]):  # an automaton without patterns can't scan
        out.add_word(f" {term} ", k if terms else -1)
    out.make_automaton()
    return out


def _scanned(automaton_of):
    """n, terms met and how often, of each text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton_of.value
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch.column("text"):
                raw = (b" %b " % (text.as_py() or "").encode()).translate(SCANNED)
                inside = np.frombuffer(raw, np.uint8) != 32
                sizes.append(int((inside[1:] & ~inside[:-1]).sum()))
                met = np.fromiter((k for _, k in machine.iter(raw.decode())), np.int64)
                own, times = np.unique(met[met >= 0], return_counts=True)
                terms.append(own)
                counts.append(times)
            offsets = pa.array(np.cumsum([0, *map(len, terms)]).astype(np.int32))
            flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (terms, counts)]
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"), "n": pa.array(sizes, pa.int64()),
                    "terms": pa.ListArray.from_arrays(offsets, pa.array(flat[0], pa.int64())),
                    "counts": pa.ListArray.from_arrays(offsets, pa.array(flat[1], pa.int64())),
                }
            )

    return scan


class _Best:
    """The ``k`` best documents of each item among those offered."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.least = k, np.ones(items, np.int64)
        self.rows = np.zeros((4, 0), np.int64)  # item, score, id is null, doc_id

    def offer(self, item: np.ndarray, score: np.ndarray, null: np.ndarray, doc: np.ndarray) -> None:
        good = score >= self.least[item]
        self.rows = np.concatenate([self.rows, np.stack([item, score, null, doc])[:, good]], axis=1)
        if self.rows.shape[1] > 4 * self.k * len(self.least):
            self.cut()

    def cut(self) -> np.ndarray:
        item, score, null, doc = self.rows
        rows = self.rows = self.rows[:, np.lexsort((doc, null, -score, item))]
        first = np.searchsorted(rows[0], rows[0])
        place = np.arange(rows.shape[1]) - first
        last = rows[:, place == self.k - 1]
        self.least[last[0]] = last[1]
        self.rows = rows[:, place < self.k]
        return self.rows


def _ranked(given, k: int):
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, starts, item_of, items, documents, words = given.value
        best = _Best(items, k)
        for batch in batches:
            ids = batch.column("doc_id")
            null, doc = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy()
            m = 10 + (90 * batch.column("n").to_numpy() * documents) // words
            lists = batch.column("terms")
            size = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(ids)), size)
            term, tf = lists.flatten().to_numpy(), batch.column("counts").flatten().to_numpy()
            gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
            fan = starts[term + 1] - starts[term]
            # Rows are taken in pieces, so that what terms give to items is a bounded array; a row stays whole.
            before = np.concatenate([[0], np.cumsum(np.bincount(row, weights=fan, minlength=len(ids)))]).astype(np.int64)
            at = 0
            while at < len(ids):
                to = max(at + 1, min(int(np.searchsorted(before, before[at] + ADDED_AT_ONCE, "right")) - 1, at + max(1, ADDED_AT_ONCE // items)))
                lo, hi = np.searchsorted(row, [at, to])
                n = fan[lo:hi]
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[term[lo:hi]], n)
                scores = np.zeros((to - at) * items, np.int64)
                np.add.at(scores, np.repeat(row[lo:hi] - at, n) * items + item_of[place], np.repeat(gain[lo:hi], n))
                found = np.flatnonzero(scores)
                who = found // items + at
                best.offer(found % items, scores[found], null[who], doc[who])
                at = to
        item, score, null, doc = best.cut()
        yield pa.record_batch(
            {"item": pa.array(item, pa.int64()), "doc_id": pa.array(doc, pa.int64(), mask=null.astype(bool)), "score": pa.array(score, pa.int64())}
        )

    return rank


def _block(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The best documents that each task found for the items of one block of (item_id, term) pairs."""
    spark = docs.sparkSession
    held = pairs.toArrow()
    ids = held["item_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    words = held["term"].combine_chunks().dictionary_encode()
    item, term = ids.indices.to_numpy(), words.indices.to_numpy()
    order = np.lexsort((item, term))
    starts = np.searchsorted(term[order], np.arange(len(words.dictionary) + 1))
    machine = spark.sparkContext.broadcast(automaton(words.dictionary.to_pylist()))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = staged(texts.mapInArrow(_scanned(machine), "doc_id bigint, n bigint, terms array<bigint>, counts array<bigint>"), "search-scan")
    documents, total = scanned.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    # Not more rows than the block has terms.
    holding = scanned.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()
    df = np.zeros(len(words.dictionary), np.int64)
    df[holding["term"].to_numpy()] = holding["df"].to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    given = spark.sparkContext.broadcast((weight, starts, item[order].astype(np.int64), len(ids.dictionary), documents, max(total, 1)))
    best = scanned.where(F.size("terms") > 0).mapInArrow(_ranked(given, k), "item bigint, doc_id bigint, score bigint")
    names = spark.createDataFrame(pa.table({"item": pa.array(np.arange(len(ids.dictionary))), "item_id": ids.dictionary.cast(pa.int64())}))
    return best.join(F.broadcast(names), "item").select("item_id", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, pairs: int = PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents (doc_id, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    terms = staged(item_terms(items.select(F.col("item_id").cast("long").alias("item_id"), "text")), "search-terms")
    blocks = max(1, math.ceil(terms.count() / pairs))
    number = F.pmod(F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("-"))), F.lit(blocks))
    found = [_block(docs, terms.where(number == b), k) for b in range(blocks)]
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    kept = reduce(DataFrame.unionByName, found).where("score > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return kept.select("item_id", "rank", "doc_id", "score")
