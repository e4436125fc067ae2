"""The prefix trie against a trie of Python tuples."""

import hashlib
import random

import pytest

from laborlake.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, seq int, head string, pos int, n int"
OWN = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "h", 2, 3) for r in rows], SCHEMA)


def plain(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            name = hashlib.md5(f"{len(role)}:{role}:{text}".encode()).hexdigest()
            convs.setdefault(conv, []).append((turn is not None, turn or 0, name, role, text))
    told = {c: tuple(t[3:] for t in sorted(ts)) for c, ts in convs.items()}
    members = {}
    for c, ts in told.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    children = {p: sum(q[:-1] == p and q != () for q in members if len(q) == len(p) + 1) for p in members}
    out = set()
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(cs) if told[c] == p)
        out.add(
            (
                min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], sum(not children[q] for q in below),
                sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q), hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return out


def built(spark, rows, limit):
    out = prefix_trie.nodes(prefix_trie.turns(frame(spark, rows)), limit)
    assert out.columns == list(OWN)
    got = [tuple(r) for r in out.collect()]
    assert len(set(got)) == len(got)
    return set(got)


@pytest.mark.parametrize("limit", [0, 7, 10_000])
def test_trie_equals_a_plain_one_however_often_it_bursts(spark, limit):
    rng = random.Random(limit)
    rows = []
    for c in range(60):
        n = rng.randrange(6)
        rows += [(c * 7 - 50, k, ("user", "assistant")[k % 2], rng.choice(["é", "b", "cc"])) for k in range(n)]
    rows += [(1000 + c, k, "user", f"same {k}") for c in range(40) for k in range(3)]  # a group of copies
    rows += [(2000 + c, k, "user", f"long {k % 5}") for c in range(3) for k in range(40 + c)]
    rng.shuffle(rows)
    assert built(spark, rows, limit) == plain(rows)


def test_odd_rows_have_their_defined_place(spark):
    rows = [
        (1, None, "user", "first"), (1, 0, None, None), (1, 2, "user", ""), (1, 2, "user", "tie"), (2, 5, "user", "x"), (2, 5, "user", "x"),
        (None, 0, "user", "nobody's"), (3, 0, "user", "y" * 100_000), (4, None, None, None), (5, 0, "us", "erx"), (6, 0, "user", "x"),
    ]
    for limit in (1, 1000):
        assert built(spark, rows, limit) == plain(rows)


def test_conversations_without_turns_end_at_the_root_and_no_rows_give_no_node(spark):
    assert built(spark, [], 10) == set()
    placed = spark.createDataFrame([(4, None, None, None), (9, None, None, None)], "conv_id long, pos long, turn binary, bytes long")
    ends = hashlib.sha256(b"4,9").hexdigest()
    assert [tuple(r) for r in prefix_trie.nodes(placed).collect()] == [(4, 0, None, 2, 0, 1, 0, ends)]
