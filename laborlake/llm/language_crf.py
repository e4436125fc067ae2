"""Language identification by a linear-chain conditional random field over the words of a text.

A word's features are its affixes (first and last two and three bytes), its byte trigrams with the word's ends marked, and
itself (lexicon); each is a row of a hashed weight table with a column per language. A learned matrix scores one
language after another, so words of one language keep together and a text may switch. The forward-backward pass gives
each word the chances of its languages; a text's language is the one with the largest mean chance over its words.

Training sequences are spliced from pieces of labelled texts, so that switches occur in them. The pieces come from about
``SAMPLE`` labelled rows, chosen by a hash, as many of each language (all of a rarer one), and at most ``PIECES`` of
``PIECE_WORDS`` words from places all over each text; the bound of rows is the parameter ``sample``. Both the word weights and the
moves follow the exact slope of the sequences' likelihood. Prediction reads every word of every text; a chunk of texts is worked on in step, the n-th words
of all its texts at once.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is everything if no row has a
language; on ties the language first in code-point order is taken; repeated rows get equal results; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laborlake.llm import wordhash

SAMPLE, PIECES = 3_000, 6
#: Places by hash of a row.
PLACES = 1 << 30
#: Words of a piece, and pieces spliced into a training sequence.
PIECE_WORDS, SPLICED = 12, 4
SLOTS = 1 << 17
UNKNOWN = "und"
_KINDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


@dataclass
class Features:
    """Slots of each word's five affix and lexicon features, and of its trigrams with each word's first one."""

    own: np.ndarray
    trigrams: np.ndarray
    first: np.ndarray


def features(words: wordhash.Words) -> Features:
    data, starts, ends = words.data.astype(np.uint64), words.starts, words.ends
    n = ends - starts

    def byte(at: np.ndarray, inside: np.ndarray) -> np.ndarray:
        return np.where(inside, data[np.clip(at, 0, max(len(data) - 1, 0))] if len(data) else 0, np.uint64(32))

    def slot(key: np.ndarray, kind: int) -> np.ndarray:
        return (wordhash.mixed(key + _KINDS[kind]) >> np.uint64(64 - 17)).astype(np.int64)

    b = [byte(starts + k, k < n) for k in range(3)]
    e = [byte(ends - 1 - k, k < n) for k in range(3)]
    eight, sixteen = np.uint64(8), np.uint64(16)
    own = np.stack(
        [
            slot(b[0] << eight | b[1], 0), slot(b[0] << sixteen | b[1] << eight | b[2], 0) , slot(e[1] << eight | e[0], 1),
            slot(e[2] << sixteen | e[1] << eight | e[0], 1), slot(words.hashes, 2),
        ],
        axis=1,
    )
    # One trigram per byte of the word and one for its end.
    count = n + 1
    first = np.concatenate([[0], np.cumsum(count)])
    word = np.repeat(np.arange(len(n)), count)
    at = np.arange(first[-1]) - first[word] + starts[word]
    tri = [byte(at - k, (at - k >= starts[word]) & (at - k < ends[word])) for k in range(3)]
    return Features(own, slot(tri[2] << sixteen | tri[1] << eight | tri[0], 3), first)


@dataclass
class Field:
    """Weights: ``table`` by slot and language, ``moves`` from language to language."""

    languages: list[str]
    table: np.ndarray
    moves: np.ndarray

    def emissions(self, f: Features) -> np.ndarray:
        out = self.table[f.own].sum(1)
        if len(out):
            sums = np.add.reduceat(self.table[f.trigrams], f.first[:-1], axis=0)
            out += sums / np.diff(f.first)[:, None]
        return out


@dataclass
class Passes:
    """Both passes over the words, scaled per word: weights of words and moves, and what lies ahead of and behind a word."""

    emitted: np.ndarray
    moved: np.ndarray
    ahead: np.ndarray
    behind: np.ndarray

    def chances(self) -> np.ndarray:
        both = self.ahead * self.behind
        return both / np.maximum(both.sum(1, keepdims=True), 1e-30)

    def pair_chances(self, at: np.ndarray) -> np.ndarray:
        """Chances of the languages of the words ``at`` and of those before them."""
        joint = self.ahead[at - 1][:, :, None] * self.moved[None] * (self.emitted[at] * self.behind[at])[:, None, :]
        return joint / np.maximum(joint.sum((1, 2), keepdims=True), 1e-30)


def forward_backward(emissions: np.ndarray, moves: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Chances of each word's languages; text i has the words from ``offsets[i]`` to ``offsets[i + 1]``."""
    return passes(emissions, moves, offsets).chances()


def passes(emissions: np.ndarray, moves: np.ndarray, offsets: np.ndarray) -> Passes:
    k = emissions.shape[1]
    e = np.exp(emissions - emissions.max(1, keepdims=True)) if len(emissions) else emissions
    t = np.exp(moves - moves.max()).astype(e.dtype)
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = offsets[:-1][order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    # Texts that have a word at each place: a prefix of the order.
    active = np.searchsorted(-sizes, -np.arange(longest), "left")
    ahead, behind = np.empty_like(e), np.empty_like(e)
    state = np.full((len(begin), k), 1 / k, e.dtype)
    for place in range(longest):
        m = active[place]
        at = begin[:m] + place
        state = (state[:m] @ t if place else state[:m]) * e[at]
        state /= state.sum(1, keepdims=True)
        ahead[at] = state
    state = np.full((len(begin), k), 1 / k, e.dtype)
    for place in range(longest - 1, -1, -1):
        m = active[place]
        at = begin[:m] + place
        behind[at] = state[:m]
        step = (e[at] * state[:m]) @ t.T
        state[:m] = step / step.sum(1, keepdims=True)
    return Passes(e, t, ahead, behind)


def fit(texts: list[str], languages: list[str], epochs: int = 6, rate: float = 0.5) -> Field:
    """Learn from pieces (text, language), spliced at random, by adaptive gradient steps on the sequences' likelihood."""
    names = sorted(set(languages))
    label = np.array([names.index(x) for x in languages])
    (_, _, words), = list(wordhash.chunks(pa.array(["\n".join(texts)]), wordhash.PUNCTUATION))
    # All pieces as one text: cut again by the pieces' own sizes.
    sizes = np.array([_count(t) for t in texts])
    first = np.concatenate([[0], np.cumsum(sizes)])
    field = Field(names, np.zeros((SLOTS, len(names))), np.zeros((len(names), len(names))))
    seen_table, seen_moves = np.full_like(field.table, 1e-6), np.full_like(field.moves, 1e-6)
    f = features(words)
    random = np.random.default_rng(11)
    for _ in range(epochs):
        pieces = random.permutation(len(texts))
        # Runs of one language as well as switches: half of the sequences repeat a language.
        if random.random() < 0.5:
            pieces = pieces[np.argsort(label[pieces] + random.random(len(pieces)) * 2)]
        for batch in np.array_split(pieces, max(1, len(pieces) // (SPLICED * 64))):
            at = np.concatenate([np.arange(first[p], first[p + 1]) for p in batch]) if len(batch) else np.zeros(0, int)
            if not len(at):
                continue
            groups = [batch[i : i + SPLICED] for i in range(0, len(batch), SPLICED)]
            lengths = np.array([sizes[g].sum() for g in groups])
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            gold = np.repeat(label[batch], sizes[batch])
            count = np.diff(f.first)[at]
            begin = np.concatenate([[0], np.cumsum(count)])
            tri = f.trigrams[np.repeat(f.first[:-1][at] - begin[:-1], count) + np.arange(begin[-1])]
            part = Features(f.own[at], tri, begin)
            emissions = field.emissions(part)
            both = passes(emissions, field.moves, offsets)
            slope = both.chances()
            slope[np.arange(len(gold)), gold] -= 1
            grad = np.zeros_like(field.table)
            for c in range(5):
                np.add.at(grad, part.own[:, c], slope)
            np.add.at(grad, tri, np.repeat(slope / count[:, None], count, axis=0))
            moves = _pair_slopes(both, gold, offsets)
            for weights, seen, g in ((field.table, seen_table, grad / len(groups)), (field.moves, seen_moves, moves / len(groups))):
                seen += g * g
                weights -= rate * g / np.sqrt(seen)
    return Field(names, field.table.astype(np.float32), field.moves)


def _pair_slopes(both: Passes, gold: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Expected less seen counts of one language after another."""
    inner = np.ones(len(gold), bool)
    inner[offsets[:-1][offsets[:-1] < len(gold)]] = False
    at = np.flatnonzero(inner)
    out = both.pair_chances(at).sum(0)
    np.subtract.at(out, (gold[at - 1], gold[at]), 1)
    return out


def _count(text: str) -> int:
    (_, _, words), = list(wordhash.chunks(pa.array([text]), wordhash.PUNCTUATION))
    return len(words.hashes)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most ``PIECES`` pieces of ``PIECE_WORDS`` words, evenly spread over each text."""
    for batch in batches:
        langs, out = [], []
        for lo, hi, words in wordhash.chunks(batch.column("text"), wordhash.PUNCTUATION):
            data = words.data.tobytes()
            for i in range(hi - lo):
                a, b = int(words.offsets[i]), int(words.offsets[i + 1])
                for s in sorted({int(x) for x in np.linspace(a, max(a, b - PIECE_WORDS), PIECES)}) if b > a else []:
                    spans = zip(words.starts[s : min(b, s + PIECE_WORDS)].tolist(), words.ends[s : min(b, s + PIECE_WORDS)].tolist())
                    out.append(" ".join(data[x:y].decode(errors="ignore") for x, y in spans))
                    langs.append(batch.column("lang")[lo + i].as_py())
        yield pa.record_batch({"lang": pa.array(langs, pa.string()), "piece": pa.array(out, pa.string())})


def _predicted(field_of, keep: list[str], with_runs: bool):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field: Field = field_of.value
        k = len(field.languages)
        for batch in batches:
            best, score, runs = [np.zeros(0, np.int64)], [np.zeros(0)], []
            for _, _, words in wordhash.chunks(batch.column("text"), wordhash.PUNCTUATION):
                chance = forward_backward(field.emissions(features(words)), field.moves, words.offsets)
                sums = np.zeros((len(chance) + 1, k))
                np.cumsum(chance, axis=0, out=sums[1:])
                n = np.diff(words.offsets)
                mean = (sums[words.offsets[1:]] - sums[words.offsets[:-1]]) / np.maximum(n, 1)[:, None]
                best.append(mean.argmax(1))
                score.append(mean.max(1))
                if with_runs:
                    top = chance.argmax(1)
                    for i in range(len(n)):
                        own = top[words.offsets[i] : words.offsets[i + 1]]
                        cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else []
                        ends = np.append(cut[1:], len(own)) if len(own) else []
                        runs.append([{"lang": field.languages[own[a]], "start": int(a), "n": int(z - a)} for a, z in zip(cut, ends)])
            names = np.array(field.languages, object)[np.concatenate(best)]
            out = {c: batch.column(c) for c in keep}
            out |= {"lang_pred": pa.array(names, pa.string()), "score": pa.array(np.concatenate(score).astype(np.float64))}
            if with_runs:
                out["runs"] = pa.array(runs, pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("n", pa.int32())])))
            yield pa.record_batch(out)

    return predict


def train(labelled: DataFrame, sample: int = SAMPLE) -> Field | None:
    """Learn from rows (doc_id, text, lang): about ``sample`` of them, as many of each language where it has them."""
    rows = labelled.where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").count().collect()  # a row per language, as many as the weights have columns
    if not sizes:
        return None
    each = max(1, sample // len(sizes))
    shares = [(r["lang"], math.ceil(min(1.0, each / r["count"]) * PLACES)) for r in sizes]
    drawn = F.broadcast(labelled.sparkSession.createDataFrame(shares, "lang string, share long"))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(PLACES))
    chosen = rows.join(drawn, "lang").where(place < F.col("share")).select("lang", F.lower("text").alias("text"))
    got = chosen.mapInArrow(_pieces, "lang string, piece string").toArrow().sort_by([("lang", "ascending"), ("piece", "ascending")])
    return fit(got["piece"].to_pylist(), got["lang"].to_pylist()) if got.num_rows else None


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, field: Field | None, with_runs: bool = False) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs``; with ``with_runs`` also ``runs``: the words' languages as runs of words."""
    texts = docs.select("doc_id", F.lower("text").alias("text"), has_letter(F.col("text")).alias("lettered"))
    runs = ", runs array<struct<lang: string, start: int, n: int>>" if with_runs else ""
    if field is None:
        return texts.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(field)
    out = texts.mapInArrow(
        _predicted(shared, ["doc_id", "lettered"], with_runs), f"doc_id bigint, lettered boolean, lang_pred string, score double{runs}"
    )
    return out.select(
        "doc_id",
        F.when(F.col("lettered"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("lettered"), F.col("score")).otherwise(0.0).alias("score"),
        *(["runs"] if with_runs else []),
    )
