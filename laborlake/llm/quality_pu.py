"""Quality classifier by positive-unlabelled learning: non-negative unbiased risk over trusted positives and web text.

Each text has a short vector of shape features. Trusted positives are labelled rows; negatives are never named: all
other texts stand for the mixture. The class prior is estimated from both: a first model ranks positives above the
mixture, and where that ranking is purest, the mixture's mass over the positives' mass is the prior. The final model
(one hidden layer) minimises ``prior * risk(positives as 1) + max(0, risk(mixture as 0) - prior * risk(positives as 0))``.

Features are computed for every whole text, once, and written. The fit uses at most about ``SAMPLE`` positives and as
many texts of the mixture, chosen by a hash of the row; that bound is the parameter ``sample``.

Defined results: null and empty texts have zero features and a score like any; without a positive row every score is
0.5; repeated rows count as often as they stand there; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlake.llm import columns, wordhash
from laborlake.sources.staging import staged

#: Rows of either kind that the fit sees at most, about.
SAMPLE = 20_000
FEATURES = 14
_BYTE_KINDS = [
    np.isin(np.arange(256), np.frombuffer(kind, np.uint8))
    for kind in (b"#*$%&<>@^~=+\\{}[]", b"|", b"!?", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:", b"\n", b"aeiouAEIOU")
]


def text_features(words: wordhash.Words, bounds: np.ndarray) -> np.ndarray:
    """``FEATURES`` numbers per text."""

    def per_text(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(marks) + 1)
        np.cumsum(marks, out=sums[1:])
        return sums[at[1:]] - sums[at[:-1]]

    size = np.maximum(np.diff(bounds), 1)
    n = np.diff(words.offsets)
    some = np.maximum(n, 1)
    lengths = (words.ends - words.starts).astype(float)
    mean = per_text(lengths, words.offsets) / some
    spread = np.sqrt(np.maximum(per_text(lengths**2, words.offsets) / some - mean**2, 0))
    text = words.text_of()
    again = np.zeros(len(text))
    again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (text[1:] == text[:-1])
    own = words.hashes + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(own)
    fresh = np.zeros(len(own))
    if len(own):
        fresh[order] = np.concatenate([[True], own[order][1:] != own[order][:-1]])
    columns_ = [per_text(kind[words.data], bounds) / size for kind in _BYTE_KINDS]
    columns_ += [np.log1p(n), mean, spread, per_text(again, words.offsets) / some, per_text(fresh, words.offsets) / some]
    columns_ += [per_text(fresh, words.offsets) / np.maximum(np.sqrt(n), 1)]
    return np.stack(columns_, axis=1).astype(np.float32)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [np.zeros((0, FEATURES), np.float32)]
        for _, _, words in wordhash.chunks(batch.column("text")):
            out.append(text_features(words, words.bounds))
        flat = np.concatenate(out)
        x = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * FEATURES), pa.array(flat.ravel()))
        yield pa.record_batch({"row": batch.column("row"), "doc_id": batch.column("doc_id"), "x": x})


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """A hidden layer of tanh units over standardised features."""

    centre: np.ndarray
    scale: np.ndarray
    inner: np.ndarray
    shift: np.ndarray
    outer: np.ndarray

    def hidden(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        return np.tanh(z @ self.inner + self.shift), z

    def margin(self, x: np.ndarray) -> np.ndarray:
        h, z = self.hidden(x)
        return h @ self.outer[: h.shape[1]] + z @ self.outer[h.shape[1] : -1] + self.outer[-1]

    def step(self, x: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        """Gradients for the slopes of the loss in the margins."""
        h, z = self.hidden(x)
        back = slope[:, None] * self.outer[: h.shape[1]] * (1 - h**2)
        return [z.T @ back, back.sum(0), np.concatenate([h.T @ slope, z.T @ slope, [slope.sum()]])]


def fit(positive: np.ndarray, mixture: np.ndarray, prior: float | None, epochs: int = 40, hidden: int = 12, batch: int = 1024) -> Model:
    """Minimise the non-negative unbiased risk; without a prior, the plain risk of positives against the mixture."""
    random = np.random.default_rng(7)
    both = np.concatenate([positive, mixture])
    d = both.shape[1]
    model = Model(both.mean(0), both.std(0) + 1e-4, random.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), np.zeros(hidden + d + 1))
    params = [model.inner, model.shift, model.outer]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    t = 0
    for _ in range(epochs):
        p_rows, u_rows = random.permutation(len(positive)), random.permutation(len(mixture))
        for at in range(0, max(len(positive), len(mixture)), batch):
            p = positive[p_rows[np.arange(at, at + batch) % len(positive)]]
            u = mixture[u_rows[np.arange(at, at + batch) % len(mixture)]]
            mp, mu = model.margin(p), model.margin(u)
            # Logistic losses: slope of loss(+) is s-1, of loss(-) is s.
            sp, su = _sigmoid(mp) - 1, _sigmoid(mu)
            if prior is None:
                grads = [a + b for a, b in zip(model.step(p, sp / len(p)), model.step(u, su / len(u)))]
            else:
                negative = np.logaddexp(0, mu).mean() - prior * np.logaddexp(0, mp).mean()
                from_p, from_u = model.step(p, prior * _sigmoid(mp) / len(p)), model.step(u, su / len(u))
                if negative >= 0:
                    grads = [a - b + c for a, b, c in zip(model.step(p, prior * sp / len(p)), from_p, from_u)]
                else:  # the risk of negatives is overfitted: step back
                    grads = [b - c for b, c in zip(from_p, from_u)]
            t += 1
            for k, g in enumerate(grads):
                g = g + 1e-4 * params[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] -= 0.01 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return model


def estimate_prior(positive: np.ndarray, mixture: np.ndarray) -> float:
    """Least ratio of the mixture's to the positives' mass above a threshold, on halves that the ranking hasn't seen."""
    model = fit(positive[::2], mixture[::2], None, epochs=15)
    p, u = model.margin(positive[1::2]), model.margin(mixture[1::2])
    if not len(p) or not len(u):
        return 0.5
    cuts = np.quantile(p, np.linspace(0.05, 0.6, 12))
    ratios = [(u >= c).mean() / max((p >= c).mean(), 1e-9) for c in cuts]
    return float(np.clip(min(ratios), 0.05, 0.98))


def _sampled(rows: DataFrame, most: int) -> np.ndarray:
    n = rows.count()
    share = min(1.0, most / max(n, 1))
    chosen = rows.where(F.pmod(F.xxhash64("row", F.lit("sample")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("row", "x")
    x = chosen.toArrow().sort_by("row")["x"].combine_chunks()
    return x.flatten().to_numpy().reshape(-1, FEATURES).astype(float)


def _scored(model: Model | None):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, FEATURES).astype(float)
            s = _sigmoid(model.margin(x)) if model else np.full(len(x), 0.5)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(s, pa.float64())})

    return score


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id and score (chance of quality 1) of every row of ``docs``; labels of the held-out fifth are not read."""
    features = staged(
        docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text").mapInArrow(
            _featured, "row bigint, doc_id bigint, x array<float>"
        ),
        "quality-features",
    )
    seen = features.where(F.coalesce(columns.fold(F.col("doc_id"), 5), F.lit(0)) != 0)
    positive = _sampled(columns.labelled(seen, labels, "quality").where("label = 1"), sample)
    mixture = _sampled(seen, sample)
    model = None
    if len(positive):
        model = fit(positive, mixture, estimate_prior(positive, mixture))
    return features.mapInArrow(_scored(model), "doc_id bigint, score double")
