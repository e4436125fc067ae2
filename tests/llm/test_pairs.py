"""Substring dedup, decontamination and near duplicates against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from laborlake.llm import decontaminate, near_duplicates, substrings

from .conftest import sentence


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_removal(rows):
    seen = Counter()
    for _, text in rows:
        w = words(text)
        seen.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    out = []
    for doc_id, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        out.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def passages():
    rng = random.Random(4)
    shared = [sentence(rng, n) for n in (34, 35, 36, 60, 120)]
    rows = []
    for i in range(150):
        parts = [sentence(rng, rng.randrange(0, 90), 5000)]
        for s in rng.sample(shared, rng.randrange(0, 3)):
            parts += [s, sentence(rng, rng.randrange(0, 40), 5000)]
        rows.append((i, "\n".join(parts)))
    long = words(sentence(rng, 300, 5000))
    for i in range(30):  # copies with one word changed
        w = list(long)
        w[rng.randrange(300)] = f"changed{i}"
        rows.append((200 + i, " ".join(w)))
    rows += [(300, "a " * 100), (301, "a b " * 40), (302, "a b c " * 11 + "a"), (303, " ".join(long[:35])), (304, None), (305, ""), (306, "same text"), (306, "same text")]
    line = sentence(rng, 20)
    rows += [(400 + i, f"{sentence(rng, 40, 9000)} {line} {sentence(rng, 40, 9000)}") for i in range(150)]
    return rows


@pytest.mark.parametrize(("hot", "shard"), [(100, 60_000), (3, 200)])
def test_repeats_are_cut_out(make, monkeypatch, hot, shard):
    monkeypatch.setattr(substrings, "ANCHOR_SEGMENTS", hot)
    monkeypatch.setattr(substrings, "SHARD_WORDS", shard)
    rows = passages()
    got = substrings.remove_repeats(make(rows)).collect()
    assert sorted([tuple(r) for r in got], key=str) == plain_removal(rows)


def test_repeats_of_odd_and_empty_tables(odd, empty, odd_rows):
    got = substrings.remove_repeats(odd).collect()
    assert sorted([tuple(r) for r in got], key=str) == plain_removal([r[:2] for r in odd_rows])
    assert substrings.remove_repeats(empty).count() == 0


def plain_tiles(item, text, least=5):
    """Longest free match first, by trying all."""
    free_i, free_t, found = [True] * len(item), [True] * len(text), []
    while True:
        best = (0, 0, 0)
        for a in range(len(item)):
            for b in range(len(text)):
                k = 0
                while a + k < len(item) and b + k < len(text) and free_i[a + k] and free_t[b + k] and item[a + k] == text[b + k]:
                    k += 1
                if k > best[0]:
                    best = (k, a, b)
        k, a, b = best
        if k < least:
            return found
        free_i[a : a + k] = [False] * k
        free_t[b : b + k] = [False] * k
        found.append((a, b, k))


def test_tiles_equal_greedy_search():
    rng = random.Random(6)
    for n in range(300):
        words = 3 + n % 6
        item = [rng.randrange(words) for _ in range(rng.randrange(5, 30))]
        text = [rng.randrange(words) for _ in range(12)] + item[10:] + [99] + item[:10] + [rng.randrange(words) for _ in range(12)]
        a, b = np.array(item, np.uint64), np.array(text, np.uint64)
        assert decontaminate.tiles(a, b, np.zeros(len(b), bool)) == plain_tiles(item, text)


def test_benchmark_items_are_found_in_any_order(make, spark):
    rng = random.Random(8)
    items = [sentence(rng, 30, 3000) for _ in range(12)]
    clean = [(i, sentence(rng, 120, 3000)) for i in range(60)]
    leaks = []
    for k, item in enumerate(items[:10]):
        w = item.split()
        turned = " ".join(w[15:] + w[:15]) if k % 2 else item.upper().replace(" ", ", ")
        leaks.append((100 + k, f"{sentence(rng, 50, 3000)} {turned}. {sentence(rng, 50, 3000)}"))
    part = [(200, f"{sentence(rng, 50, 3000)} {' '.join(items[11].split()[:10])} {sentence(rng, 50, 3000)}")]
    bench = spark.createDataFrame([*enumerate(items), (50, "too short"), (51, None), (None, items[10])], "item_id long, text string")
    docs = make(clean + leaks + part + [(300, None), (301, ""), (100, leaks[0][1])])
    found = {r.doc_id: r.item_ids for r in decontaminate.contaminated(docs, bench).collect()}
    assert found == {100 + k: [k] for k in range(10)}
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, _ in clean} | {200, 300, 301}


def test_decontamination_of_odd_and_empty_tables(odd, empty, odd_rows, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(odd, none).count() == len(odd_rows)
    some = spark.createDataFrame([(1, odd_rows[5][1])], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contaminated(odd, some).collect()} == {5, 6}
    assert decontaminate.decontaminate(odd, some).count() == len(odd_rows) - 3
    assert decontaminate.contaminated(empty, some).count() == 0


def shingles(text):
    w = [x for x in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower()) if x]
    seen, out = Counter(), []
    for i in range(len(w) - 4):
        s = tuple(w[i : i + 5])
        out.append((s, seen[s]))
        seen[s] += 1
    return tuple(w), out


def plain_similarity(a, b):
    """Longest common subsequence of labelled shingles over those of both together."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1] / (len(a) + len(b) - row[-1])


def families(rng):
    rows, n = [], 0
    for size in (2, 3, 5, 40):
        base = sentence(rng, 120, 5000).split()
        for k in range(size):
            w = list(base)
            for _ in range(k % 4):
                w[rng.randrange(len(w))] = f"e{n}"
            rows.append((n, " ".join(w)))
            n += 1
    for _ in range(60):
        rows.append((n, sentence(rng, rng.randrange(3, 150), 5000)))
        n += 1
    w = rows[0][1].split()
    rows += [(n, " ".join(w[60:] + w[:60])), (n + 1, " ".join(w[:60])), (n + 2, rows[0][1].upper().replace(" ", ", ")), (n + 3, "a b"), (n + 4, "a  B!")]
    return rows


def plain_classes(rows):
    parts = {d: d for d, _ in rows}

    def top(x):
        while parts[x] != x:
            x = parts[x]
        return x

    told = [(d, *shingles(t)) for d, t in rows]
    for i, (a, wa, sa) in enumerate(told):
        for b, wb, sb in told[:i]:
            if wa and (wa == wb or (sa and sb and len(set(sa) & set(sb)) > 20 and plain_similarity(sa, sb) >= 0.8)):
                x, y = top(a), top(b)
                parts[max(x, y)] = min(x, y)
    return {d: top(d) for d, _ in rows}


def test_classes_equal_those_of_all_pairs(make):
    rows = families(random.Random(12))
    got = {r.doc_id: r.class_id for r in near_duplicates.classes(make(rows)).collect()}
    assert got == plain_classes(rows)


def pairs_without_original(rng, n):
    """Pairs of close texts, all edited from one text that is not there; of different pairs most are below the threshold."""
    base, rows = sentence(rng, 120, 5000).split(), []
    for k in range(n):
        w = list(base)
        for at in range(3 + rng.randrange(8), 120, 30):
            w[at] = f"p{k}x{at}"
        rows.append((2 * k, " ".join(w)))
        w[rng.randrange(10, 110)] = f"q{k}"
        w[rng.randrange(10, 110)] = f"r{k}"
        rows.append((2 * k + 1, " ".join(w)))
    return rows


@pytest.mark.parametrize(("few", "block", "easy"), [(2, 8, 0), (2, 128, 10_000_000), (32, 128, 10_000_000)])
def test_full_buckets_without_an_original_equal_all_pairs(make, monkeypatch, few, block, easy):
    for name, value in (("FEW", few), ("BLOCK", block), ("EASY", easy)):
        monkeypatch.setattr(near_duplicates, name, value)
    rows = pairs_without_original(random.Random(21), 40)
    got = {r.doc_id: r.class_id for r in near_duplicates.classes(make(rows)).collect()}
    assert got == plain_classes(rows) and len(set(got.values())) > 20


def test_one_row_per_class_stays(make):
    rows = families(random.Random(13))
    docs = make(rows + rows[:3])
    left = near_duplicates.deduplicate(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(plain_classes(rows).values()))


def test_one_of_near_copies_with_the_same_id_stays(make):
    text = sentence(random.Random(15), 60, 5000)
    left = near_duplicates.deduplicate(make([(7, text), (7, f"{text} more"), (8, text), (None, f"{text} other")])).collect()
    assert [r.doc_id for r in left] == [7]


def test_short_texts_share_a_bucket():
    rng = np.random.default_rng(16)
    for n in (4, 5, 8, 12, 15):
        missed = 0
        for _ in range(1000):
            long = rng.integers(0, 1 << 63, n + n // 4).astype(np.uint64)
            short = near_duplicates.sketch(long[:n])
            missed += not set(short.tolist()) & set(near_duplicates.sketch(long).tolist())
        assert missed == 0


def test_chains_in_a_band_equal_longest_common_subsequences():
    rng = random.Random(14)
    for _ in range(80):
        a = rng.sample(range(1000), 40)
        b = list(a)
        for _ in range(rng.randrange(0, 12)):
            k = rng.randrange(len(b))
            b[k : k + 1] = rng.choice([[], [2000 + len(b)], [b[k], 3000 + len(b) + k]])
        if rng.random() < 0.3:
            b = b[20:] + b[:20]
        b = list(dict.fromkeys(b))
        want = plain_similarity(a, b)
        got = near_duplicates.similarity(np.array(a, np.uint32), np.array(b, np.uint32))
        assert got == pytest.approx(want) if want >= 0.8 else got < 0.8


def test_near_duplicates_of_odd_and_empty_tables(odd, empty):
    got = near_duplicates.classes(odd).collect()
    by_id = {(r.doc_id, r.class_id, r.times) for r in got}
    assert {(5, 5, 1), (6, 5, 2), (1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 1)} <= by_id
    left = near_duplicates.deduplicate(odd)
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, [1, None, 2, 3, 4, 5, None, 7, 8]))
    assert near_duplicates.classes(empty).count() == 0 and near_duplicates.deduplicate(empty).count() == 0
