"""Operator 10, language ID: unigram pieces, marginalised over segmentations.

Every language has probabilities of the pieces of a fixed public vocabulary. A word's
probability is the sum over all its segmentations into pieces, by the forward algorithm; a
text's is the product over its words (runs of letters, lower-cased). The probabilities come
from expectation maximisation: forward-backward counts of pieces over the words of labelled
training documents, weighted by how often each word occurs per language.

Training words are counted by Spark over about ``MAX_TRAIN`` documents of each language,
chosen by a hash of the id. In every round tasks find the expected counts of pieces over
their share of all these words and Spark sums them by language and piece: what reaches the
driver has the vocabulary's size. Scoring needs no shuffle; a worker keeps the scores of up
to ``CACHED`` words.

Defined cases: null text, or text without a letter, is ``und`` with score 0; a null id isn't
held out; characters outside the vocabulary cost a fixed small probability; equal scores go
to the language that sorts first; with nothing to learn from, all is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, materialize

MAX_TRAIN, ROUNDS = 3_000, 3
#: Words of one language whose segmentations a task holds at once.
AT_ONCE = 5_000
CACHED = 400_000
UNKNOWN = 1e-7
LETTERS = regex.compile(r"\p{L}+")
START = "▁"


def vocabulary(path: str) -> dict[str, int]:
    """Pieces in lower case that consist of letters, with the mark of a word's start."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    good = sorted(p for p in pieces if p == p.lower() and (p.removeprefix(START) or START).replace(START, "a").isalpha())
    return {p: i for i, p in enumerate(good)}


def prefixes(vocabulary: dict[str, int]) -> set[str]:
    return {p[:i] for p in vocabulary for i in range(1, len(p) + 1)}


class Lattice:
    """All segmentations of a list of words: (word, start, end, piece) of every edge."""

    def __init__(self, words: list[str], vocab: dict[str, int], prefix: set[str]):
        rows: list[tuple[int, int, int, int]] = []
        unknown = len(vocab)
        get = vocab.get
        for r, word in enumerate(words):
            w = START + word
            n = len(w)
            for i in range(n):
                single = False
                for j in range(i + 1, n + 1):
                    s = w[i:j]
                    if s not in prefix:
                        break
                    k = get(s)
                    if k is not None:
                        rows.append((r, i, j, k))
                        single = single or j == i + 1
                if not single:
                    rows.append((r, i, i + 1, unknown))
        edges = np.array(rows, np.int64).reshape(-1, 4)
        edges = edges[np.lexsort((edges[:, 0], edges[:, 2]))]
        self.word, self.start, self.end, self.piece = edges.T
        self.n, self.size = len(words), np.array([len(w) + 1 for w in words], np.int64)
        self.cut = np.searchsorted(self.end, np.arange(1, int(self.size.max(initial=0)) + 2))

    def forward(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(alpha by word and position, log of the scale left out) under piece probabilities p."""
        alpha = np.zeros((self.n, int(self.size.max(initial=0)) + 1))
        alpha[:, 0] = 1.0
        for e, (a, b) in enumerate(zip(self.cut, self.cut[1:]), 1):
            alpha[:, e] = np.bincount(self.word[a:b], alpha[self.word[a:b], self.start[a:b]] * p[self.piece[a:b]], self.n)
        return alpha

    def log_total(self, p: np.ndarray) -> np.ndarray:
        """log P(word); very long words are scored through a rescaled recursion."""
        alpha = self.forward(p)
        return np.log(np.maximum(alpha[np.arange(self.n), self.size], 1e-300))

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected counts of pieces when word w occurs weight[w] times."""
        alpha = self.forward(p)
        beta = np.zeros_like(alpha)
        rows = np.arange(self.n)
        beta[rows, self.size] = 1.0
        order = np.argsort(-self.start, kind="stable")
        starts = self.start[order]
        at = np.searchsorted(-starts, -np.arange(alpha.shape[1] - 2, -2, -1))
        for s, (a, b) in zip(range(alpha.shape[1] - 2, -1, -1), zip(at, at[1:])):
            k = order[a:b]
            beta[:, s] += np.bincount(self.word[k], beta[self.word[k], self.end[k]] * p[self.piece[k]], self.n)
        total = np.maximum(alpha[rows, self.size], 1e-300)
        share = alpha[self.word, self.start] * p[self.piece] * beta[self.word, self.end] / total[self.word]
        return np.bincount(self.piece, share * weight[self.word], len(p))


def long_words(words: list[str], most: int = 40) -> list[str]:
    """Words cut to runs of at most ``most`` letters, so that no probability underflows; no letter is lost."""
    return [w[i : i + most] for w in words for i in range(0, len(w), most)] if any(len(w) > most for w in words) else words


def words_of(text: str | None) -> list[str]:
    return long_words(LETTERS.findall(text.lower())) if text else []


class Model:
    """Languages and their piece probabilities; the last entry of a row is an unknown character."""

    def __init__(self, languages: list[str], vocab: dict[str, int], p: np.ndarray):
        self.languages, self.vocab, self.p = languages, vocab, p

    def log_words(self, words: list[str], prefix: set[str]) -> np.ndarray:
        """log P(word) by word and language."""
        lattice = Lattice(words, self.vocab, prefix)
        return np.stack([lattice.log_total(p) for p in self.p], 1)


def begin(size: int) -> np.ndarray:
    """Equal probabilities of pieces; the last is an unknown character's."""
    return np.append(np.full(size, 1.0 / size), UNKNOWN)


def expected_counts(words: list[str], weights: np.ndarray, p: np.ndarray, vocab: dict[str, int], prefix: set[str]) -> np.ndarray:
    """Expected counts of pieces over weighted words, AT_ONCE at a time."""
    out = np.zeros(len(p))
    for i in range(0, len(words), AT_ONCE):
        out += Lattice(words[i : i + AT_ONCE], vocab, prefix).expected(p, weights[i : i + AT_ONCE])
    return out


def training_words(docs: DataFrame, most: int, text_col: str, lang_col: str, id_col: str) -> tuple[list[str], DataFrame]:
    """(languages, (lang, word, count)) of training documents: lang is a number, words are cut as when scoring."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ((crc32_mod(id_col, 3) != 1)))
    rows = rows.select(F.col(lang_col).alias("name"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("h"))
    sizes = sorted(rows.groupBy("name").count().collect())  # one row a language
    shares = [(r["name"], i, int(min(1.0, most / r["count"]) * 1_000_003) + 1) for i, r in enumerate(sizes)]
    table = docs.sparkSession.createDataFrame(shares, "name string, lang int, share long")
    chosen = rows.join(F.broadcast(table), "name").where(F.pmod("h", F.lit(1_000_003)) < F.col("share"))
    found = chosen.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{1,40}"), F.lit(0))).alias("word"))
    return [r["name"] for r in sizes], found.groupBy("lang", "word").count()


def fit(languages: list[str], counted: DataFrame, vocab: dict[str, int], rounds: int = ROUNDS, smooth: float = 0.1) -> Model:
    """Expectation maximisation over the word counts (lang, word, count), from equal probabilities."""
    spark = counted.sparkSession
    p = np.tile(begin(len(vocab)), (len(languages), 1))
    prefix = prefixes(vocab)
    for _ in range(rounds):
        held = spark.sparkContext.broadcast((p, vocab, prefix))

        def expectations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p, vocab, prefix = held.value
            sums = np.zeros(p.shape)
            for batch in batches:
                lang, words, weights = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_numpy().astype(float)
                for k in np.unique(lang).tolist():
                    mine = np.flatnonzero(lang == k)
                    sums[k] += expected_counts([words[i] for i in mine], weights[mine], p[k], vocab, prefix)
            k, piece = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(piece, pa.int32()), pa.array(sums[k, piece])], names=["lang", "piece", "seen"])

        summed = counted.mapInArrow(expectations, "lang int, piece int, seen double").groupBy("lang", "piece").agg(F.sum("seen").alias("seen")).toPandas()
        seen = np.full(p.shape, smooth)
        np.add.at(seen, (summed["lang"].to_numpy(), summed["piece"].to_numpy()), summed["seen"].to_numpy())
        p = np.concatenate([seen[:, :-1] / seen[:, :-1].sum(1, keepdims=True), np.full((len(languages), 1), UNKNOWN)], 1)
        held.unpersist()
    return Model(languages, vocab, p)


def identified(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    languages, words = training_words(docs, most, text_col, lang_col, id_col)
    model = fit(languages, materialize(words, "words"), vocabulary(model_path)) if languages else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix = prefixes(model.vocab) if model else set()
        known: dict[str, int] = {}
        table = np.zeros((CACHED, len(model.languages) if model else 0))
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                texts = [words_of(t.as_py()) if model else [] for t in batch.column(2)]
                names, scores = [], []
                for j in range(0, len(texts), 50):
                    some = texts[j : j + 50]
                    new = list(set().union(*some).difference(known))
                    if len(known) + len(new) > len(table):
                        known.clear()
                        new = list(set().union(*some))
                        if len(new) > len(table):
                            table = np.zeros((len(new), table.shape[1]))
                    for k in range(0, len(new), 5_000):
                        part = new[k : k + 5_000]
                        table[len(known) : len(known) + len(part)] = model.log_words(part, prefix)
                        known.update(zip(part, range(len(known), len(known) + len(part))))
                    for words in some:
                        if not words:
                            names.append("und")
                            scores.append(0.0)
                            continue
                        odds = table[[known[w] for w in words]].sum(0)
                        best = int(odds.argmax())
                        names.append(model.languages[best])
                        scores.append(float(1 / np.exp(np.maximum(odds - odds[best], -700)).sum()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    held_out = (crc32_mod(id_col, 3) == 1) & F.col(id_col).isNotNull()
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
