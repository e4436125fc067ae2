"""Ranked search against plain counting."""

import math
import random
import re
from collections import Counter

import pytest

from laborlake.llm import term_scan

from .conftest import sentence

ITEMS = "item_id long, text string, term string, score long, rank int"


def items(spark, rows):
    return spark.createDataFrame([(*r, "t", 5, 6) for r in rows], ITEMS)


def terms(text):
    small = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(term_scan.TERM, small)


def plain(docs, wanted, k):
    told = [(d, Counter(terms(t))) for d, t, *_ in docs]
    told = [(d, c) for d, c in told if c]
    n, words = len(told), sum(sum(c.values()) for _, c in told)
    df = Counter(t for _, c in told for t in c)
    own = {}
    for item, text in wanted:
        own.setdefault(item, set()).update(terms(text))
    out = []
    for item, ts in own.items():
        found = []
        for d, c in told:
            m = 10 + 90 * sum(c.values()) * n // words
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts & set(c))
            if s > 0:
                found.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def got(spark, docs, wanted, **more):
    out = term_scan.search(docs, wanted, **more)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("pairs", [20, 100_000])
def test_search_equals_counting_in_one_block_or_many(spark, make, odd_rows, pairs, monkeypatch):
    monkeypatch.setattr(term_scan, "ADDED_AT_ONCE", 64)
    rng = random.Random(4)
    rows = odd_rows + [(100 + i, sentence(rng, rng.randrange(40), 30)) for i in range(150)]
    rows += [(300 + i, "w1 W2 wé2! w3_w4 É9 é9 漢字w5 w1w2 -w6-") for i in range(9)]
    wanted = [(i, sentence(rng, 6, 40)) for i in range(12)] + [(20, "W3 É9, (漢字w5) w1w2"), (20, "w6"), (21, None), (22, ""), (23, "nowhere"), (None, "w7 é w8")]
    assert got(spark, make(rows).repartition(5), items(spark, wanted), k=4, pairs=pairs) == plain(rows, wanted, 4)


def test_no_items_and_no_documents(spark, make, empty):
    assert got(spark, make([(1, "a b")]), items(spark, [])) == []
    assert got(spark, empty, items(spark, [(1, "a")])) == []
    assert got(spark, make([(1, None), (2, "--")]), items(spark, [(1, "a"), (2, None)])) == []


def test_terms_end_where_the_text_says(spark, make):
    rows = [(1, "concatenate cat"), (2, "concatenate"), (3, "CAT,cat;Cat"), (4, "çat cat́")]
    assert got(spark, make(rows), items(spark, [(1, "cat")])) == plain(rows, [(1, "cat")], 10)
    assert {r[2] for r in got(spark, make(rows), items(spark, [(1, "cat")]))} == {1, 3}
