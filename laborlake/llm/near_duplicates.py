"""Near duplicates by Order MinHash, verified by banded alignment.

1. Texts are lower-cased and cut into runs of letters and digits; equal sequences are one node. Each shingle of
   ``SHINGLE`` words is labelled with how often it stood before in the text. For each of ``SKETCHES`` hash functions the
   ``KEPT`` labelled shingles with the smallest values are put in text order and hashed: one bucket. Two texts share
   a bucket only if they agree in these shingles and in their order. At a similarity of 0.8 one bucket is shared with
   a probability of about 0.8^4, so all 20 are missed by about 3 in 100,000. Among few shingles one more weighs more (4 of 5
   are kept by both with 1/5 only), so texts of up to ``SHORT`` shingles have 20 more buckets, of ``KEPT_SHORT`` each.
2. Buckets are worked on in rounds, so that a group of thousands of near copies never makes all its pairs. First each
   bucket's texts are compared with its most central one, that whose buckets hold most texts: where copies were made
   by editing one text, that is the text itself. Then, in buckets that hold several of the components found, one member of
   each is compared with one of another, ``DRAWN`` times, all drawn by hash; in buckets of up to ``FEW`` texts, all are compared
   across components. Fuller buckets are drawn from again as long as that halves the texts outside their bucket's largest
   component; what is left there is compared in full with all texts of the bucket that are in other components, in groups
   of two blocks of about ``BLOCK`` texts. So any two texts of a bucket are in one class or have been compared. The last
   step is quadratic in the texts of a bucket that belong together with few others, spread over tasks.
3. A pair holds if the longest chain of equal labelled shingles in the same order in both texts, within the band
   that such a chain can reach at all, is ``LEAST`` of the shingles of both together or more: ordered shingle
   similarity. Chains are found by sparse dynamic programming over the matches in the band.
4. Components grow by large-star and small-star steps over written tables.

Only hashes of words and shingles are moved between tasks; texts are moved once, to fetch the shingles of nodes that
have candidates. Nodes, buckets, links and components never leave the executors; the driver sees counts.

Defined results: texts without a word, and null texts, are classes of their own; texts of fewer words than a shingle
have only copies; repeated rows are one class; a class is named by its smallest doc_id (null where it has none);
an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlake.llm import columns, wordhash
from laborlake.sources.staging import freed, staged

SHINGLE, KEPT, SKETCHES, LEAST = 5, 4, 20, 0.8
#: Shingles of a short text, and how many of them its further sketches keep.
SHORT, KEPT_SHORT = 20, 2
#: Texts of a bucket up to which all are compared, and how often members are drawn.
FEW, DRAWN = 32, 2
#: Texts of a block, and pairs that are compared without drawing again.
BLOCK, EASY = 128, 10_000_000
_SEEDS = wordhash.mixed(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS = wordhash.mixed(_SEEDS) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def row_key():
    return F.xxhash64("doc_id", "text")


def labelled_shingles(words: wordhash.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles with their occurrence label, text by text, and each text's first one (one more than texts)."""
    at = wordhash.whole_runs(words, SHINGLE)
    grams = wordhash.run_hashes(words.hashes, at, SHINGLE)
    offsets = np.searchsorted(at, words.offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)).astype(np.uint64)
    own = grams + text * _STEP  # shingles of different texts apart
    order = np.argsort(own, kind="stable")
    fresh = np.concatenate([[True], own[order][1:] != own[order][:-1]]) if len(own) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(own)), 0))
    label = np.zeros(len(own), np.uint64)
    label[order] = (np.arange(len(own)) - first).astype(np.uint64)
    return wordhash.mixed(grams ^ (label * _STEP)), offsets


def order_sketch(shingles: np.ndarray, kept: int = KEPT) -> np.ndarray:
    """For each hash function the hash of its ``kept`` smallest shingles in text order."""
    values = (shingles[None, :] ^ _SEEDS[:, None]) * _FACTORS[:, None]
    values ^= values >> np.uint64(32)
    if len(shingles) > kept:
        least = np.sort(np.argpartition(values, kept - 1, axis=1)[:, :kept], axis=1)
    else:
        least = np.broadcast_to(np.arange(len(shingles)), values.shape)
    out = _SEEDS.copy()
    for k in range(least.shape[1]):
        out = wordhash.mixed(out * _STEP + shingles[least[:, k]])
    return out


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The buckets of a text."""
    own = order_sketch(shingles)
    return np.concatenate([own, order_sketch(shingles, KEPT_SHORT)]) if len(shingles) <= SHORT else own


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, sketches = [], []
        for lo, hi, words in wordhash.chunks(batch.column("text"), wordhash.PUNCTUATION):
            sizes = np.diff(words.offsets)
            nodes.append(np.where(sizes > 0, wordhash.run_hashes(words.hashes, words.offsets[:-1], sizes).view(np.int64), 0))
            shingles, offsets = labelled_shingles(words)
            for i in range(hi - lo):
                own = shingles[offsets[i] : offsets[i + 1]]
                sketches.append(sketch(own).view(np.int64) if len(own) else None)
        node = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
        yield pa.record_batch(
            {
                "row": batch.column("row"), "doc_id": batch.column("doc_id"),
                "node": pa.array(node, pa.int64(), mask=node == 0), "sketch": pa.array(sketches, pa.list_(pa.int64())),
            }
        )


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for lo, hi, words in wordhash.chunks(batch.column("text"), wordhash.PUNCTUATION):
            shingles, offsets = labelled_shingles(words)
            short = (shingles >> np.uint64(32)).astype(np.uint32)
            out += [short[offsets[i] : offsets[i + 1]].tobytes() for i in range(hi - lo)]
        yield pa.record_batch({"node": batch.column("node"), "shingles": pa.array(out, pa.binary())})


def chain_length(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest chain of equal values at rising places of both, at most ``band`` places apart. Values are distinct on each side."""
    _, at_a, at_b = np.intersect1d(a, b, return_indices=True)
    near = np.abs(at_a - at_b) <= band
    at_a, at_b = at_a[near], at_b[near]
    places = at_b[np.argsort(at_a)]
    if len(places) < 2 or (places[1:] > places[:-1]).all():
        return len(places)
    tails: list[int] = []
    for p in places.tolist():
        k = bisect_left(tails, p)
        tails[k : k + 1] = [p]
    return len(tails)


def similarity(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> float:
    """Ordered shingle similarity, or 0 where the sizes alone keep it below ``least``."""
    both = len(a) + len(b)
    needed = int(np.ceil(both * least / (1 + least) - 1e-9))
    most = max(len(a), len(b))
    if not needed or needed > min(len(a), len(b)):
        return 0.0
    chain = chain_length(a, b, most - needed)
    return chain / (both - chain)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column("left_shingles"), batch.column("right_shingles")
        holds = [
            similarity(np.frombuffer(a.as_py(), np.uint32), np.frombuffer(b.as_py(), np.uint32)) >= LEAST for a, b in zip(left, right)
        ]
        yield pa.record_batch({"u": batch.column("u"), "v": batch.column("v"), "holds": pa.array(holds, pa.bool_())})


def _compared(group: pa.Table) -> pa.Table:
    """Links between different components, of all pairs of two blocks or of one."""
    node, component = group["node"].to_numpy(), group["component"].to_pylist()
    block, first, second = (group[c].to_numpy() for c in ("block", "first", "second"))
    texts = [np.frombuffer(x.as_py(), np.uint32) for x in group["shingles"]]
    sizes = np.array([len(x) for x in texts])
    flat = np.concatenate(texts)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(len(texts)), sizes)[order]
    needed = np.ceil((sizes[:, None] + sizes[None, :]) * LEAST / (1 + LEAST) - 1e-9)
    above: dict[int, int] = {}

    def top(c: int) -> int:
        while c in above:
            c = above[c]
        return c

    found = []
    for i in np.flatnonzero(block == first):
        lo, hi = np.searchsorted(flat, texts[i], "left"), np.searchsorted(flat, texts[i], "right")
        n = hi - lo
        at = np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())
        shared = np.bincount(owner[at], minlength=len(texts))
        near = (shared >= needed[i]) & ((block == second) if first[0] != second[0] else (np.arange(len(texts)) > i))
        for j in np.flatnonzero(near):
            x, y = top(component[i]), top(component[j])
            if x != y and similarity(texts[i], texts[j]) >= LEAST:
                above[x] = y
                found.append((node[i], node[j]))
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.table({"u": pa.array(pairs.max(1, initial=-(1 << 63))), "v": pa.array(pairs.min(1, initial=(1 << 63) - 1))})


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Each node has one edge to a smaller node, or none; none has edges on both sides."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above"))
    )
    nodes = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return nodes.agg(F.count_if((F.col("below") > 1) | ((F.col("below") > 0) & (F.col("above") > 0))).alias("n")).first()["n"] == 0


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``links`` (u, v); a component is named by its smallest node."""
    edges = staged(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "near-edges")
    while not _are_stars(edges):
        around = _both_ways(edges)
        least = staged(around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "near-least")
        # Large star: larger neighbours to the least one around.
        large = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large, "near-large")
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "near-least")
        # Small star: smaller neighbours, and the node itself, to the least of them.
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        edges = staged(small.where("u <> v").distinct(), "near-edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()


class _Search:
    """The candidate rounds over one table of sketched documents."""

    def __init__(self, docs: DataFrame, sketched: DataFrame) -> None:
        with_sketch = sketched.where("sketch is not null")
        members = with_sketch.select("node", F.explode("sketch").alias("bucket")).groupBy("node", "bucket").agg(F.count("*").alias("_n"))
        with freed(docs.sparkSession):
            members = staged(members.select("node", "bucket"), "near-buckets")
            full = staged(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "near-full")
            members = staged(members.join(full, "bucket"), "near-shared")
            central = staged(members.groupBy("node").agg(F.sum("n").alias("w")), "near-central", keep=True)
            self.members = staged(members.select("node", "bucket").join(central, "node"), "near-members", keep=True)
        # Shingles of every node that shares a bucket: the one time that texts move. The plan is the same at every size.
        wanted = with_sketch.join(central.select("node"), "node").groupBy("node").agg(*[F.first(c).alias(c) for c in ("row", "doc_id")])
        same = (F.col("t.row") == F.col("w.row")) & F.col("t.doc_id").eqNullSafe(F.col("w.doc_id"))
        texts = docs.select(row_key().alias("row"), "doc_id", "text").alias("t").hint("merge")
        fetched = texts.join(wanted.alias("w"), same).select("w.node", F.lower("t.text").alias("text"))
        self.shingles = staged(fetched.mapInArrow(_shingled, "node bigint, shingles binary"), "near-shingles").dropDuplicates(["node"])
        self.done: DataFrame | None = None
        self.links: DataFrame | None = None

    def placed(self, parts: DataFrame) -> DataFrame:
        found = self.members.join(parts, "node", "left")
        return found.withColumn("component", F.coalesce("component", "node"))

    def central(self) -> DataFrame:
        """Per bucket its texts beside the most central one."""
        lead = staged(self.members.groupBy("bucket").agg(F.max(F.struct("w", "node")).alias("x")).select("bucket", F.col("x.node").alias("lead")), "near-lead")
        return self.members.join(lead, "bucket").where("node <> lead").select(F.col("node").alias("u"), F.col("lead").alias("v"))

    def star(self, placed: DataFrame, seed: int) -> DataFrame:
        """Per bucket with several components: a member of each, beside one of them for all."""
        one = staged(
            placed.groupBy("bucket", "component").agg(F.min(F.col("node").bitwiseXOR(F.col("bucket")).bitwiseXOR(F.lit(seed))).alias("o")), "near-one"
        )
        lead = staged(
            one.groupBy("bucket").agg(F.min("o").alias("lead"), F.count("*").alias("n")).where("n > 1").select("bucket", "lead"), "near-lead"
        )
        node = lambda o: F.col(o).bitwiseXOR(F.col("bucket")).bitwiseXOR(F.lit(seed))
        return one.join(lead, "bucket").where("o <> lead").select(node("o").alias("u"), node("lead").alias("v"))

    def across(self, placed: DataFrame) -> DataFrame:
        """All pairs of members of different components, in buckets of up to ``FEW`` texts."""
        kinds = staged(placed.groupBy("bucket", "component").agg(F.count("*").alias("n")), "near-kinds")
        mixed = staged(
            kinds.groupBy("bucket").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"))
            .where((F.col("kinds") > 1) & (F.col("n") <= FEW)).select("bucket"),
            "near-mixed",
        )
        kinds = staged(kinds.join(mixed, "bucket").select("bucket", "component"), "near-kinds")
        some = staged(placed.join(mixed, "bucket"), "near-some")
        a, b = kinds.select("bucket", F.col("component").alias("c1")), kinds.select("bucket", F.col("component").alias("c2"))
        sides = staged(a.join(b, "bucket").where("c1 < c2"), "near-sides")
        left = some.select("bucket", F.col("component").alias("c1"), F.col("node").alias("u"))
        right = some.select("bucket", F.col("component").alias("c2"), F.col("node").alias("v"))
        return sides.join(left, ["bucket", "c1"]).join(right, ["bucket", "c2"]).select("u", "v")

    def open(self, placed: DataFrame) -> DataFrame:
        """Per bucket of over ``FEW`` texts in several components: the largest one, how many texts are in it, and in others."""
        kinds = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
        per = kinds.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.max(F.struct("n", "component")).alias("x"))
        per = per.where((F.col("n") > FEW) & (F.col("kinds") > 1))
        return staged(per.select("bucket", F.col("x.component").alias("main"), F.col("x.n").alias("inside"), (F.col("n") - F.col("x.n")).alias("rest")), "near-open")

    def remainder(self, placed: DataFrame, opened: DataFrame) -> DataFrame:
        """Links of texts outside the largest component of an open bucket, to all texts of it in other components."""
        rest, own = F.ceil(F.col("rest") / BLOCK).cast("int"), F.ceil(F.col("inside") / BLOCK).cast("int")
        outside, dealt = F.col("component") != F.col("main"), F.xxhash64("node", F.lit("block"))
        # Blocks 0 to rest - 1 are outside, the others inside, and those meet no block of the inside.
        block = F.when(outside, F.pmod(dealt, rest)).otherwise(rest + F.pmod(dealt, own)).cast("int")
        last = F.when(outside, rest + own - 1).otherwise(rest - 1)
        some = placed.join(opened, "bucket").select("bucket", "node", "component", block.alias("block"), last.alias("last"))
        told = some.join(self.shingles.hint("merge"), "node").select("*", F.explode(F.sequence(F.lit(0), "last")).alias("other"))
        told = told.select(
            "bucket", "node", "component", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "shingles"
        )
        found = staged(told.groupBy("bucket", "first", "second").applyInArrow(_compared, "u bigint, v bigint").distinct(), "near-remainder")
        self.links = self.links.unionByName(found).distinct()
        return found

    def check(self, pairs: DataFrame) -> DataFrame:
        """Verify the pairs that haven't been looked at yet; those that hold are added to the links and returned."""
        pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        if self.done is not None:
            pairs = pairs.join(self.done, ["u", "v"], "left_anti")
        pairs = staged(pairs, "near-pairs")
        left = self.shingles.select(F.col("node").alias("u"), F.col("shingles").alias("left_shingles")).hint("merge")
        right = self.shingles.select(F.col("node").alias("v"), F.col("shingles").alias("right_shingles")).hint("merge")
        checked = pairs.join(left, "u").join(right, "v").select("u", "v", "left_shingles", "right_shingles")
        checked = staged(checked.mapInArrow(_verified, "u bigint, v bigint, holds boolean"), "near-checked")
        seen, found = checked.select("u", "v"), checked.where("holds").select("u", "v")
        self.done = seen if self.done is None else self.done.unionByName(seen)
        self.links = found if self.links is None else self.links.unionByName(found)
        return found


def links_and_components(docs: DataFrame, sketched: DataFrame) -> tuple[DataFrame, DataFrame]:
    search = _Search(docs, sketched)
    parts = _parts(search.check(search.central()))
    placed = staged(search.placed(parts), "near-placed")
    pairs = search.across(placed)
    for seed in range(DRAWN):
        pairs = pairs.unionByName(search.star(placed, int(_SEEDS[seed].view(np.int64))))
    parts = _grown(parts, search.check(pairs))
    before, seed = None, DRAWN
    while True:
        placed = staged(search.placed(parts), "near-placed")
        opened = search.open(placed)
        left = opened.agg(F.sum("rest").alias("rest"), F.sum(F.col("rest") * (F.col("rest") + F.col("inside"))).alias("pairs")).first()
        if not left["rest"]:
            return search.links, parts
        if left["pairs"] <= EASY or (before is not None and 2 * left["rest"] > before):
            parts = _grown(parts, search.remainder(placed, opened))
            return search.links, parts
        drawn = search.star(placed.join(opened.select("bucket"), "bucket"), int(_SEEDS[seed % SKETCHES].view(np.int64)))
        parts = _grown(parts, search.check(drawn))
        before, seed = left["rest"], seed + 1


def _grown(parts: DataFrame, found: DataFrame) -> DataFrame:
    """``parts`` with new links; they are stars already, so only those have to be worked in."""
    stars = parts.select(F.col("node").alias("u"), F.col("component").alias("v"))
    return _parts(stars.unionByName(found))


def _parts(links: DataFrame) -> DataFrame:
    """The components as a table; those written on the way to it are freed."""
    with freed(links.sparkSession):
        return staged(components(links), "near-parts", keep=True)


def classes(docs: DataFrame) -> DataFrame:
    """row, doc_id, class_id (the class's smallest doc_id), n_links (links of its text to other texts among the pairs
    that were compared; pairs already in one class mostly aren't), first (the row stands for its class: its smallest by doc_id, row) and times (how often the row stands in ``docs``), for every different row of ``docs``."""
    sketched = staged(
        docs.select(row_key().alias("row"), "doc_id", F.lower("text").alias("text")).mapInArrow(
            _sketched, "row bigint, doc_id bigint, node bigint, sketch array<bigint>"
        ),
        "near-sketched",
    )
    links, parts = links_and_components(docs, sketched)
    degrees = staged(_both_ways(links).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n_links")), "near-degrees")
    rows = staged(
        sketched.groupBy("row", "doc_id", "node").agg(F.count("*").alias("times"))
        .join(parts, "node", "left").join(degrees, "node", "left")
        .select("row", "doc_id", "times", F.coalesce("component", "node", "row").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                F.col("node").isNull().alias("blank")),
        "near-rows",
    )
    named = staged(
        rows.groupBy("blank", "component")
        .agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row"))).alias("x"), F.min("row").alias("row"))
        .select("blank", "component", F.col("x.doc_id").alias("class_id"), F.coalesce("x.row", "row").alias("first_row")),
        "near-classes",
    )
    joined = rows.join(named, ["blank", "component"])
    first = (F.col("row") == F.col("first_row")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    return joined.select("row", "doc_id", "class_id", "n_links", first.alias("first"), "times")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` per class: that with the smallest doc_id (of several, the smallest row key), with its columns,
    whatever their names. Texts of rows that are alone in their class don't move."""
    with freed(docs.sparkSession):
        found = classes(docs).where(~F.col("first") | (F.col("times") > 1)).select("row", "doc_id", "first")
        found = staged(found, "near-listed", keep=True)
    sure, others = columns.listed(docs, found)
    kept = others.where("found is null or found.first").dropDuplicates(["row", "doc_id"])
    return columns.unpacked(sure.select("given").unionByName(kept.select("given")), docs.columns)
