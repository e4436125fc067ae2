"""Hashed words and the FM-index against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from laborlake.llm import wordhash
from laborlake.llm.fm_index import FMIndex

TEXTS = ["a b  c\n d", None, "", " é\tà a\x0bb\x0c ", "x" * 10, "a b c d", "\xa0nbsp stays", "漢字 \U0001f600!", "a"]


def test_words_are_cut_at_ascii_white_space_only():
    got = []
    for lo, hi, words in wordhash.chunks(pa.array(TEXTS)):
        for i in range(hi - lo):
            a, b = words.offsets[i], words.offsets[i + 1]
            got.append([bytes(words.data[s:e]).decode() for s, e in zip(words.starts[a:b], words.ends[a:b])])
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in TEXTS]


def test_equal_words_and_runs_have_equal_hashes_wherever_they_stand(monkeypatch):
    monkeypatch.setattr(wordhash, "CHUNK", 8)
    seen = {}
    for _, _, words in wordhash.chunks(pa.array(TEXTS * 3)):
        names = [bytes(words.data[s:e]) for s, e in zip(words.starts, words.ends)]
        for name, h in zip(names, words.hashes.tolist()):
            assert seen.setdefault(name, h) == h
        at = wordhash.whole_runs(words, 2)
        for i, h in zip(at.tolist(), wordhash.run_hashes(words.hashes, at, 2).tolist()):
            assert seen.setdefault((names[i], names[i + 1]), h) == h
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("symbols", [1, 2, 5, 50])
def test_matching_statistics(symbols):
    rng = np.random.default_rng(symbols)
    text = rng.integers(1, symbols + 1, 300)
    text[rng.integers(0, 300, 10)] = 0
    text[-1] = 0
    got = FMIndex(text, 16).matching(text, np.arange(1, 301), 9)
    plain = text.tolist()
    for end in range(1, 301):
        n = 0
        while n < 9 and end - n - 1 >= 0 and plain[end - n - 1] > 0:
            run = plain[end - n - 1 : end]
            if sum(plain[i : i + n + 1] == run for i in range(300 - n)) < 2:
                break
            n += 1
        assert got[end - 1] == n


def test_index_is_smaller_than_its_suffix_array():
    rng = random.Random(1)
    text = np.array([rng.randrange(1, 200) for _ in range(5000)] + [0])
    index = FMIndex(text, 16)
    packed = sum(bits.words.nbytes + bits.before.nbytes for _, bits, _ in index.levels)
    assert packed < 5001 * 8
