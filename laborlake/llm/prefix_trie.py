"""Prefix trie of conversations, built as a burst trie over shards.

A turn is named by a digest of its role and text (16 bytes), a conversation by its turns' names one behind the other, so
that the order of bytes is the order of turns and texts are read once and never move. Equal conversations become one
row with a weight first: a group of copies, however large, is one sequence.

1. All sequences start in one container, that of the root. A container of more than one sequence and ``LIMIT`` turns
   bursts: its node becomes a trie head, and its sequences go to one container per next turn; those that end there stay
   with the head. Sizes are summed map-side, so a turn that most conversations share moves nothing to one task.
2. The containers left, of one sequence or at most ``LIMIT`` turns, are dealt over tasks, sorted and swept: a sequence
   shares with the one before it as many nodes as their common prefix has turns, and a container's subtree sums are added
   up at its end.
3. What containers and heads sum up is added to every head above them.
4. The conversations that end at a node are hashed in one sorted stream, a few bytes of state for each, whatever their
   number.

Defined results: a null role or text is empty; a null turn number comes before all others and turns of one number stand in
the order of their names; rows with a null ``conv_id`` belong to no conversation and are left out; repeated rows are
repeated turns; a conversation without turns is a member of the root only; an empty table has no node, not even a root.
A conversation is one row of about 24 bytes a turn. Other columns, of whatever name, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laborlake.sources.staging import staged

#: Bytes of a turn's name; turns in a container that doesn't burst; burst nodes handed to tasks whole (a shuffle beyond).
WIDTH, LIMIT, BROADCAST_HEADS = 16, 1 << 14, 50_000
NODE = "depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ended binary"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn, bytes) of rows (conv_id, turn, role, text): place from 0, name, and bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = F.concat_ws(":", F.length(role).cast("string"), role, text)
    named = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("number"),
        F.unhex(F.md5(name.cast("binary"))).alias("turn"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("number").asc_nulls_first(), "turn")
    return named.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "turn", "bytes")


def sequences(placed: DataFrame) -> DataFrame:
    """(conv_id, seq, bytes, key) of rows as ``turns`` gives them; a row with a null ``turn`` only names its conversation."""
    row = F.struct("pos", F.hex("turn").alias("turn"), "bytes")
    listed = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("turn").isNotNull(), row))).alias("t"))
    named = listed.select(
        "conv_id",
        F.unhex(F.array_join(F.transform("t", lambda x: x["turn"]), "")).alias("seq"),
        F.transform("t", lambda x: x["bytes"]).alias("bytes"),
    )
    return named.withColumn("key", F.unhex(F.md5("seq")))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's conv_ids, comma-joined; rows come sorted by key and conv_id."""
    now, sha = None, None
    for batch in batches:
        done = []
        for key, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
            if key != now:
                if sha is not None:
                    done.append((now, sha.hexdigest()))
                now, sha = key, hashlib.sha256(b"%d" % conv)
            else:
                sha.update(b",%d" % conv)
        yield pa.record_batch({"key": pa.array([k for k, _ in done], pa.binary()), "ends": pa.array([h for _, h in done], pa.string())})
    if sha is not None:
        yield pa.record_batch({"key": pa.array([now], pa.binary()), "ends": pa.array([sha.hexdigest()])})


def _swept_container(rows: list[tuple]) -> list[list]:
    """Nodes (depth, conv, parent conv, n, children, leaves, saved, key that ends there) of one container, its top first.
    ``rows`` are (head, seq, bytes, n, conv, parent_conv, key), sorted by seq."""
    head, parent_conv = rows[0][0], rows[0][5]
    top = len(head) // WIDTH
    depth, parent, size, conv, last, ended = [top], [-1], [0], [None], [rows[0][2][top - 1] if top else 0], [None]
    open_nodes, before = [0], head
    for _, seq, lengths, n, smallest, _, key in rows:
        shared, most = top, min(len(seq), len(before)) // WIDTH
        while shared < most and seq[shared * WIDTH : (shared + 1) * WIDTH] == before[shared * WIDTH : (shared + 1) * WIDTH]:
            shared += 1
        del open_nodes[shared - top + 1 :]
        for d in range(shared + 1, len(seq) // WIDTH + 1):
            depth.append(d)
            parent.append(open_nodes[-1])
            size.append(0)
            conv.append(None)
            last.append(lengths[d - 1])
            ended.append(None)
            open_nodes.append(len(depth) - 1)
        at = open_nodes[-1]
        size[at], conv[at], ended[at], before = n, smallest, key, seq
    children, leaves, saved = [0] * len(depth), [0] * len(depth), [0] * len(depth)
    for k in range(len(depth) - 1, -1, -1):  # a node comes before its children
        saved[k] += (size[k] - 1) * last[k]
        leaves[k] = leaves[k] or 1
        if (p := parent[k]) >= 0:
            size[p] += size[k]
            conv[p] = conv[k] if conv[p] is None else min(conv[p], conv[k])
            children[p] += 1
            leaves[p] += leaves[k]
            saved[p] += saved[k]
    above = [parent_conv if p < 0 else conv[p] for p in parent]
    return [list(x) for x in zip(depth, conv, above, size, children, leaves, saved, ended)]


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by container and sequence; one container is held at a time."""
    names = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ended"]
    kinds = [pa.int64()] * 7 + [pa.binary()]

    def nodes(rows: list[tuple]) -> pa.RecordBatch:
        found = list(zip(*_swept_container(rows)))
        tops = [rows[0][0]] + [None] * (len(found[0]) - 1)
        return pa.record_batch({n: pa.array(v, k) for n, v, k in zip(names, found, kinds)} | {"top": pa.array(tops, pa.binary())})

    held: list[tuple] = []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("head", "seq", "bytes", "n", "conv", "parent_conv", "key")]
        for row in zip(*columns):
            if held and held[0][0] != row[0]:
                yield nodes(held)
                held = []
            held.append(row)
    if held:
        yield nodes(held)


def _handed(found: DataFrame, count: int) -> DataFrame:
    return F.broadcast(found) if count <= BROADCAST_HEADS else found


def _burst(distinct: DataFrame, limit: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Heads (head, n, conv, last, ended) and the sequences of the containers left (head, parent_conv and their own columns).

    One round looks at twice as many levels as the one before, so that long common beginnings take few rounds. What a
    node's sequences hold falls from level to level, so what lies above a head is a head.
    """
    left, heads, containers = staged(distinct.withColumn("parent_conv", F.lit(None).cast("long")), "trie-sequences"), [], []
    depth, step = 0, 1
    while True:
        levels = F.expr(f"sequence({depth}, least({depth + step - 1}, length(seq) div {WIDTH}))")
        through = left.select("key", "n", "conv", "bytes", "seq", F.explode(levels).alias("d")).select(
            "key", "n", "conv", "d",
            F.expr(f"substring(seq, 1, {WIDTH} * d)").alias("head"),
            F.expr(f"length(seq) div {WIDTH} - d").alias("turns"),
            F.when(F.col("d") > 0, F.get("bytes", F.col("d").cast("int") - 1)).otherwise(F.lit(0)).alias("last"),
        )
        nodes_ = through.groupBy("head").agg(
            F.sum("turns").alias("turns"),
            F.count("*").alias("sequences"),
            F.sum("n").alias("n"),
            F.min("conv").alias("conv"),
            F.max("last").alias("last"),
            F.max(F.when(F.col("turns") == 0, F.col("key"))).alias("ended"),
        )
        burst = staged(nodes_.where((F.col("turns") > limit) & (F.col("sequences") > 1)), "trie-heads")
        count = burst.count()
        start = F.expr(f"substring(seq, 1, {WIDTH * depth})")
        if not count:
            containers.append(left.withColumn("head", start))
            return heads, containers
        heads.append(burst.select("head", "n", "conv", "last", "ended"))
        found = _handed(burst.select("head", F.col("conv").alias("above")), count)
        deepest = through.select("key", "d", "head").join(found, "head").groupBy("key").agg(F.max(F.struct("d", "above")).alias("deepest"))
        marked = staged(left.join(deepest, "key", "left"), "trie-marked")
        under = F.col("deepest.d") + 1
        last_level = F.col("deepest.d") == depth + step - 1
        longer = F.length("seq") > WIDTH * F.col("deepest.d")  # else it ends at the head
        containers.append(marked.where("deepest is null").drop("deepest").withColumn("head", start))
        below = marked.where(F.col("deepest").isNotNull() & longer).withColumn("parent_conv", F.col("deepest.above"))
        containers.append(below.where(~last_level).withColumn("head", F.substring("seq", F.lit(1), (WIDTH * under).cast("int"))).drop("deepest"))
        left = below.where(last_level).drop("deepest")
        depth, step = depth + step, step * 2


def _above(head: str = "head"):
    """Prefixes of a head, the head itself apart, from the root on."""
    return F.expr(f"transform(sequence(1, length({head}) div {WIDTH}), k -> substring({head}, 1, {WIDTH} * (k - 1)))")


def nodes(placed: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per node of the trie of conversations given as rows of ``turns``: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256. ``conv_id`` and ``depth`` name a node."""
    named = staged(sequences(placed), "trie-conversations")
    distinct = named.groupBy("key").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("conv"), F.first("seq").alias("seq"), F.first("bytes").alias("bytes")
    )
    heads, containers = _burst(distinct, limit)
    rows = reduce(DataFrame.unionByName, containers).select("head", "seq", "bytes", "n", "conv", "parent_conv", "key")
    dealt = rows.repartition("head").sortWithinPartitions("head", "seq")
    swept = staged(dealt.mapInArrow(_sweep, f"{NODE}, top binary"), "trie-swept")
    found = swept.drop("top")
    if heads:
        found = found.unionByName(_head_nodes(staged(reduce(DataFrame.unionByName, heads), "trie-burst"), swept))
    ends = named.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_hashed, "key binary, ends string")
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return found.join(ends, F.col("ended") == F.col("key"), "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", nobody).alias("ends_sha256")
    )


def _head_nodes(heads: DataFrame, swept: DataFrame) -> DataFrame:
    """The burst nodes with what lies above and below them."""
    own = (F.col("n") - 1) * F.col("last")
    none = F.lit(0).cast("long")
    tops = swept.where("length(top) > 0").select(F.col("top").alias("head"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    below = tops.unionByName(heads.where("length(head) > 0").select("head", none.alias("leaves"), own.alias("saved")))
    sums = below.select(F.explode(_above()).alias("above"), "head", "leaves", "saved").groupBy("above").agg(
        F.sum("leaves").alias("leaves"),
        F.sum("saved").alias("saved"),
        F.count_if(F.length("head") == F.length("above") + WIDTH).alias("children"),
    )
    up = heads.select(F.col("head").alias("up"), F.col("conv").alias("parent_conv_id"))
    is_up = F.when(F.length("head") > 0, F.expr(f"substring(head, 1, length(head) - {WIDTH})")) == F.col("up")
    return heads.join(sums, F.col("head") == F.col("above")).join(up, is_up, "left").select(
        F.expr(f"length(head) div {WIDTH}").alias("depth"),
        F.col("conv").alias("conv_id"),
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") + own).alias("saved_tokens"),
        "ended",
    )
