"""Toxicity of texts: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is its character n-grams, word borders included, hashed into buckets that each have an embedding; a misspelling
shares most n-grams with the word it stands for. The embeddings of a window of words are averaged and a linear softmax
gives its class. A document's log-odds are the log-mean-exp of those of its windows, so a few toxic words count in a
long text. Embeddings and softmax learn together, by Adam on the whole sample. As the softmax is linear, the scores of
a trained model need one number per bucket.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the labelled sample: rows of each class, and the length beyond which a text is left out of it.
SAMPLE_ROWS, SAMPLE_CHARS = 2_000, 20_000
BUCKETS_LOG2, DIM, WINDOW = 17, 8, 4
EPOCHS, RATE, DECAY = 60, 0.1, 1e-5
GRAMS = (3, 4, 5)
THRESHOLD = 0.3
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)
_WORD = re.compile(r"[^\W_]+")
_CHARS = 1 << 20


_ALNUM: list[np.ndarray] = []


def _alnum() -> np.ndarray:
    """Of each code point whether it is a letter or digit, made once per process."""
    if not _ALNUM:
        _ALNUM.append(np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000))
    return _ALNUM[0]


def _spelled(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts in lower case, words apart by one zero (one in front), and the words of each text."""
    parts, words = [np.zeros(1, np.uint32)], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _alnum()[codes]
        # a word's letters, and the sign after them
        codes = np.where(letter, codes, 0).astype(np.uint32)
        after = np.zeros(len(codes), bool)
        after[1:] = letter[:-1]
        kept = codes[letter | after]
        words[i] = int((letter[:-1] & ~letter[1:]).sum()) + int(letter[-1]) if len(letter) else 0
        parts.append(kept if not len(letter) or not letter[-1] else np.append(kept, np.uint32(0)))
    return np.concatenate(parts), words


def _buckets(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the bucket of the n-gram at each place, and whether it lies in one word."""
    inside = codes != 0
    for n in GRAMS:
        m = len(codes) - n + 1
        if m <= 0:
            return
        h = np.full(m, n, np.uint32)
        valid = np.ones(m, bool)
        for k in range(n):
            h += codes[k : k + m] * _FACTORS[k]
            if 0 < k < n - 1:
                valid &= inside[k : k + m]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
        h *= np.uint32(0x297A2D39)
        yield h >> np.uint32(32 - BUCKETS_LOG2), valid


@dataclass
class Model:
    """One number per bucket (embedding times softmax weights), the bias, and the score of texts without words."""

    weights: np.ndarray
    bias: float
    base: float
    embeddings: np.ndarray | None = field(default=None, repr=False)

    def log_odds(self, texts: list[str]) -> np.ndarray:
        """Of texts with words; NaN for those without."""
        codes, words = _spelled(texts)
        ends = np.flatnonzero(codes == 0)  # the k-th word lies between ends[k] and ends[k + 1]
        total, many = np.zeros(len(codes) + 1), np.zeros(len(codes) + 1)
        for bucket, valid in _buckets(codes):
            total[1 : len(bucket) + 1] += np.where(valid, self.weights[bucket], 0)
            many[1 : len(bucket) + 1] += valid
        total, many = np.cumsum(total), np.cumsum(many)
        out = np.full(len(texts), np.nan)
        first = 0
        for i, n in enumerate(words):
            if n:
                at = ends[first + np.minimum(np.arange(0, n + WINDOW, WINDOW), n)]
                at = at[: -(-n // WINDOW) + 1]
                z = np.diff(total[at]) / np.maximum(np.diff(many[at]), 1) + self.bias
                out[i] = np.logaddexp.reduce(z) - np.log(len(z))
            first += n
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        z = np.concatenate([self.log_odds(part) for part in _parts(texts)]) if len(texts) else np.empty(0)
        return np.where(np.isnan(z), self.base, 1 / (1 + np.exp(-np.clip(z, -50, 50))))


def _parts(texts: list[str]) -> Iterator[list[str]]:
    """Texts in lots of about a million characters."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= _CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray, seed: int = 7) -> Model:
    """Train on a sample. ``weights`` restore the shares that the classes have outside it."""
    labels, weights = np.asarray(labels, float), np.asarray(weights, float)
    base = float((labels * weights).sum() / weights.sum()) if len(labels) else 0.0
    size = 1 << BUCKETS_LOG2
    number: dict[str, int] = {}
    rows = [np.array([number.setdefault(w, len(number)) for w in _WORD.findall(t.lower())], np.int32) for t in texts]
    usable = np.array([len(r) > 0 for r in rows], bool)
    if not usable.any() or len(set(labels[usable])) < 2:
        return Model(np.zeros(size, np.float32), float(np.log((base + 1e-6) / (1 - base + 1e-6))), base)
    words = np.concatenate(rows)
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))[usable]
    labels, weights = labels[usable], weights[usable] / weights[usable].sum()
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    doc_of_word = np.repeat(np.arange(len(lengths)), lengths)
    in_doc = np.arange(len(words)) - starts[doc_of_word]
    n_windows = -(-lengths // WINDOW)
    first_window = np.concatenate([[0], np.cumsum(n_windows)[:-1]])
    window = first_window[doc_of_word] + in_doc // WINDOW
    doc_of_window = np.repeat(np.arange(len(lengths)), n_windows)

    codes, _ = _spelled(list(number))
    word_at = np.cumsum(codes == 0) - 1  # of the place before the word's first letter on
    # per n apart, so that the steps below make small arrays only
    found = [(b[v].astype(np.int32), word_at[: len(b)][v].astype(np.int32)) for b, v in _buckets(codes)]
    n_words = len(number)
    del number, codes, word_at, rows
    grams_in_word = sum(np.bincount(w, minlength=n_words) for _, w in found)
    in_window = np.maximum(np.bincount(window, grams_in_word[words]), 1)

    rng = np.random.default_rng(seed)
    E = rng.uniform(-1 / DIM, 1 / DIM, (size, DIM))
    W, bias = rng.normal(0, 1, (DIM, 2)), np.zeros(2)
    bias[1] = np.log((base + 1e-6) / (1 - base + 1e-6))
    state = [(p, np.zeros_like(p), np.zeros_like(p)) for p in (E, W, bias)]
    for epoch in range(1, EPOCHS + 1):
        s = E @ W  # of both classes
        delta = s[:, 1] - s[:, 0]
        of_word = sum(np.bincount(w, delta[g], minlength=n_words) for g, w in found)
        z = np.bincount(window, of_word[words]) / in_window + bias[1] - bias[0]
        top = np.maximum.reduceat(z, first_window)
        share = np.exp(z - top[doc_of_window])
        total = np.add.reduceat(share, first_window)
        odds = np.log(total / n_windows) + top
        wrong = weights * (1 / (1 + np.exp(-odds)) - labels)
        back = wrong[doc_of_window] * share / total[doc_of_window]
        by_word = np.bincount(words, (back / in_window)[window], minlength=n_words)
        by_gram = sum(np.bincount(g, by_word[w], minlength=size) for g, w in found)
        d = W[:, 1] - W[:, 0]
        dw = by_gram @ E
        grads = (by_gram[:, None] * d + DECAY * E, np.stack([-dw, dw], 1) + DECAY * W, np.array([-back.sum(), back.sum()]))
        for (p, m, v), g in zip(state, grads):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            p -= RATE * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
    s = E @ W
    return Model((s[:, 1] - s[:, 0]).astype(np.float32), float(bias[1] - bias[0]), base, E.astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """Learn from ``labels`` (doc_id, label 0 or 1) of ``docs`` (doc_id, text).

    The sample has at most ``rows`` documents of each class, those with the least hash of doc_id, of at most ``chars``
    characters each. The classes' shares are counted over all labels. Rows without doc_id or label teach nothing; of
    several labels of one doc_id the largest counts. Without labels every score is 0.
    """
    known = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    sample: DataFrame | None = None
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    for label in counts:
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        sample = part if sample is None else sample.union(part)
    if sample is None:
        return fit([], np.empty(0), np.empty(0))
    # at most two times ``rows`` ids
    taken = (
        docs.select("doc_id", "text")
        .join(F.broadcast(sample), "doc_id")
        .where(F.length("text") <= chars)
        .dropDuplicates(["doc_id"])
        .orderBy("doc_id")
        .limit(rows * len(counts))
        .toPandas()
    )
    seen = taken["label"].value_counts()
    weights = np.array([counts[label] / seen[label] for label in taken["label"]])
    return fit(taken["text"].tolist(), taken["label"].to_numpy(), weights)


def _scorer(model: Model) -> Callable:
    weights, bias, base = model.weights, model.bias, model.base

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(weights, bias, base)
        for texts in batches:
            yield pd.Series(own.scores([t or "" for t in texts]))

    return score


def score_toxicity(docs: DataFrame, model: Model, column: str = "toxicity") -> DataFrame:
    """``docs`` with all their columns and the probability that the text is toxic.

    Every text is scored whole. Texts without words (null and empty ones too) get the base rate of the labels. Equal
    texts have equal scores; an empty table stays empty. A column named like the new one is replaced.
    """
    udf = F.pandas_udf(_scorer(model), "double")
    return docs.withColumn(column, udf("text"))
