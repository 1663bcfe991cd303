"""Operator 9, quality classifier by positive-unlabelled learning.

A small network on form features of a text minimises the non-negative unbiased risk
  prior * E_p[l(+)] + max(0, E_u[l(-)] - prior * E_p[l(-)])
where E_p is over trusted positives (labels.quality = 1) and E_u over web text whose label
isn't looked at. The class prior is estimated first: where no negatives are, unlabelled
text is as dense as prior times the positives, so the least ratio of the two shares above
a threshold of a plain positive-against-unlabelled score bounds it.

Training takes at most ``MAX_TRAIN`` documents of either kind, chosen by a hash of the id;
their feature rows, not their texts, reach the driver. Scoring reads each text once, where
it lies, without a shuffle.

Defined cases: null text is empty and is scored too; a null id isn't held out; a document
with contrary labels is no trusted positive; labels of unknown documents and null labels
are ignored; without any positive all scores are the prior, 0.5; empty gives empty.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod

MAX_TRAIN = 8_000
THRESHOLD = 0.3
SEGMENTS = 8
#: Classes of bytes whose shares are features.
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t\n\r", "stop": b".,;:", "shout": b"!?", "bar": b"|", "sign": b"#$%&*@^~<>=+_/\\{}[]", "quote": b"\"'()-`"}
N_CLASSES = len(CLASSES) + 1
#: Every byte's class, as a table for bytes.translate.
CLASS_OF = bytes(next((i for i, b in enumerate(CLASSES.values()) if v in b), len(CLASSES)) for v in range(256))
SPACE = list(CLASSES).index("space")
N_FEATURES = 3 * N_CLASSES + 13


def features(text: str | None) -> np.ndarray:
    """Numbers that describe the form of a whole text."""
    out = np.zeros(N_FEATURES)
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return out
    kinds = np.frombuffer(raw.translate(CLASS_OF), np.uint8)
    cuts = [len(raw) * i // SEGMENTS for i in range(SEGMENTS + 1)]
    counted = np.array([np.bincount(kinds[a:b], minlength=N_CLASSES) for a, b in zip(cuts, cuts[1:])])
    shares = counted / np.maximum(1, np.diff(cuts))[:, None]
    out[:N_CLASSES] = counted.sum(0) / len(raw)
    out[N_CLASSES : 2 * N_CLASSES] = shares.max(0)
    out[2 * N_CLASSES : 3 * N_CLASSES] = shares.min(0)
    n = len(words)
    counts = Counter(words)
    gaps = np.flatnonzero(kinds == SPACE)
    lengths = np.diff(np.concatenate(([-1], gaps, [len(raw)]))) - 1
    lengths = lengths[lengths > 0]
    lines = raw.split(b"\n")
    out[3 * N_CLASSES :] = (
        np.log1p(n) / 8, np.log1p(len(raw)) / 10, lengths.mean() / 8, lengths.std() / 8, min(lengths.max(), 100) / 50, (lengths <= 3).mean(),
        len(counts) / n, np.log(len(counts) + 1) / np.log(n + 1), max(counts.values()) / n, sum([c for c in counts.values() if c > 1]) / n,
        sum(map(eq, words, words[1:])) / n, 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)) / 5,
    )
    return out


def sampled(docs: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows at most, by a hash of the id (rows that repeat an id come together)."""
    share = min(1.0, most / max(docs.count(), 1))
    return docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(share * 1_000_003) + 1)


def rows_of(docs: DataFrame) -> np.ndarray:
    """Feature rows on the driver; the caller bounds their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t.as_py()).astype("<f4").tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["f"])

    got = docs.select("text").mapInArrow(run, "f binary").toPandas()["f"]
    return np.array([np.frombuffer(bytes(b), "<f4") for b in got], float).reshape(len(got), N_FEATURES)


class Network:
    """One hidden layer; ``grad_step`` takes the gradient of the risk in each row's output."""

    def __init__(self, width: int, hidden: int = 24, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.p = [rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        self.m, self.v, self.t = [np.zeros_like(x) for x in self.p], [np.zeros_like(x) for x in self.p], 0

    def normed(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def odds(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def grad_step(self, z: np.ndarray, g: np.ndarray, rate: float = 0.01, decay: float = 1e-4) -> None:
        h = np.tanh(z @ self.p[0] + self.p[1])
        back = (g[:, None] * self.p[2]) * (1 - h * h)
        grads = [z.T @ back + decay * self.p[0], back.sum(0), h.T @ g + decay * self.p[2], np.array([g.sum()])]
        self.t += 1
        for i, d in enumerate(grads):
            self.m[i] = 0.9 * self.m[i] + 0.1 * d
            self.v[i] = 0.999 * self.v[i] + 0.001 * d * d
            self.p[i] = self.p[i] - rate * (self.m[i] / (1 - 0.9**self.t)) / (np.sqrt(self.v[i] / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fresh(positive: np.ndarray, unlabelled: np.ndarray) -> Network:
    net = Network(positive.shape[1])
    net.mean, net.scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    return net


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 150) -> float:
    """Share of positives among the unlabelled, from a positive-against-unlabelled score on held-out halves."""
    fit_p, see_p, fit_u, see_u = positive[::2], positive[1::2], unlabelled[::2], unlabelled[1::2]
    if not len(see_p) or not len(see_u):
        return 0.5
    net = fresh(fit_p, fit_u)
    zp, zu = net.normed(fit_p), net.normed(fit_u)
    for _ in range(rounds):
        gp, gu = -sigmoid(-net.odds(zp)) / len(zp), sigmoid(net.odds(zu)) / len(zu)
        net.grad_step(np.vstack([zp, zu]), np.append(gp, gu))
    sp, su = np.sort(net.odds(net.normed(see_p))), np.sort(net.odds(net.normed(see_u)))
    at = np.quantile(sp, np.linspace(0.01, 0.7, 70))
    ratio = (1 - np.searchsorted(su, at) / len(su)) / (1 - np.searchsorted(sp, at) / len(sp))
    return float(np.clip(ratio.min(), 0.05, 0.98))


def risk(odds_p: np.ndarray, odds_u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """(positive part, negative part, the gradient to follow in all odds) of the non-negative risk with the logistic loss."""
    up, uu = -prior * sigmoid(odds_p) / len(odds_p), sigmoid(odds_u) / len(odds_u)
    positive = prior * np.logaddexp(0, -odds_p).mean()
    negative = np.logaddexp(0, odds_u).mean() - prior * np.logaddexp(0, odds_p).mean()
    if negative >= 0:
        return positive, negative, np.append(up - prior * sigmoid(-odds_p) / len(odds_p), uu)
    return positive, negative, np.append(-up, -uu)


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 800, batch: int = 1024) -> Network:
    """Minimise the non-negative risk over batches; where its second part is negative, step back out of it."""
    net = fresh(positive, unlabelled)
    rng = np.random.default_rng(6)
    all_p, all_u = net.normed(positive)[rng.permutation(len(positive))], net.normed(unlabelled)[rng.permutation(len(unlabelled))]
    for r in range(rounds):
        zp = all_p[(r * batch + np.arange(min(batch, len(all_p)))) % len(all_p)]
        zu = all_u[(r * batch + np.arange(min(batch, len(all_u)))) % len(all_u)]
        *_, g = risk(net.odds(zp), net.odds(zu), prior)
        net.grad_step(np.vstack([zp, zu]), g, rate=0.01 if r < rounds // 2 else 0.002)
    return net


def learn(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> tuple[Network | None, float]:
    """(network, class prior) from trusted positives and unlabelled text outside the held-out fifth."""
    rows = docs.where(crc32_mod(id_col, 5) != 0).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.where(F.col("quality").isNotNull() & (crc32_mod("doc_id", 5) != 0)).groupBy("doc_id").agg(F.min("quality").alias("q"))
    positive = rows_of(sampled(known.where("q = 1"), most).join(rows, "doc_id"))
    unlabelled = rows_of(sampled(rows, most))
    if not len(positive) or not len(unlabelled):
        return None, 0.5
    prior = class_prior(positive, unlabelled)
    return train(positive, unlabelled, prior), prior


def scored(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    net, _ = learn(docs, labels, most, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if net is None or not batch.num_rows:
                score = np.full(batch.num_rows, 0.5)
            else:
                score = sigmoid(net.odds(net.normed(np.array([features(t.as_py()) for t in batch.column(2)]))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held_out = (crc32_mod(id_col, 5) == 0) & F.col(id_col).isNotNull()
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` less the documents that the classifier rejects; the columns and all other rows stay."""
    gone = scored(docs, labels, id_col=id_col, text_col=text_col).where("predicted = 0 and doc_id is not null").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti")
