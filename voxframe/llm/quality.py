"""Quality of texts: random Fourier features of document statistics, ridge regression, isotonic calibration.

The statistics of each text are worked out once. On the labelled rows they are standardised and mapped to cosines of
random projections, whose inner products approximate a Gaussian kernel. Every partition sums its part of the normal
equations, per fold; the sums meet in one aggregation. Each fold is then scored by the weights of the others, these
scores are counted in narrow bins, and pooling adjacent violators over the bins turns scores into probabilities.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from voxframe.llm.common import stored

FEATURES, WIDTH, RIDGE, FOLDS = 128, 4.0, 1e-3, 5
#: Scores are calibrated in bins of this width between LOW and HIGH.
BIN, LOW, HIGH = 0.001, -0.5, 1.5
STATISTICS = (
    "log_bytes log_words word_length word_length_sd upper digits punctuation marks exclaims bars non_ascii "
    "lines_per_word distinct_words distinct_lines entropy top_word short_words word_end_marks upper_words distinct_pairs"
).split()
_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
_PUNCTUATION = (_BYTES > 32) & (_BYTES < 127) & ~_UPPER & ~_LOWER & ~_DIGIT
_MARK = np.isin(_BYTES, list(b"#$%&*+<=>@\\^_`{}~"))


def statistics(text: str | None) -> np.ndarray:
    """The STATISTICS of one whole text; of one without words, the first is its length and the rest are 0."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(len(STATISTICS))
    out[0] = np.log1p(len(data))
    words = data.split()
    if not words:
        return out
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, m = len(data) - counts[_SPACE].sum(), len(words)
    share = counts[counts > 0] / len(data)
    b = np.frombuffer(data, np.uint8)
    space = _SPACE[b]
    ends = np.flatnonzero(~space & np.append(space[1:], True))
    begins = np.flatnonzero(~space & np.insert(space[:-1], 0, True))
    lengths = ends - begins + 1
    _, number = np.unique(np.fromiter(map(hash, words), np.int64, m), return_inverse=True)
    often = np.bincount(number)
    pairs = len(np.unique(number[1:] * len(often) + number[:-1])) if m > 1 else 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    out[1:] = (
        np.log1p(m),
        lengths.mean(),
        lengths.std(),
        counts[_UPPER].sum() / n,
        counts[_DIGIT].sum() / n,
        counts[_PUNCTUATION].sum() / n,
        counts[_MARK].sum() / n,
        (counts[33] + counts[63]) / n,
        counts[124] / n,
        counts[128:].sum() / n,
        len(lines) / m,
        len(often) / m**0.8,
        len(set(lines)) / len(lines),
        -(share * np.log2(share)).sum(),
        often.max() / m,
        (lengths <= 3).mean(),
        _PUNCTUATION[b[ends]].mean(),
        _UPPER[b[begins]].mean(),
        pairs / max(m - 1, 1),
    )
    return out


@F.pandas_udf(ArrayType(DoubleType()))
def _statistics(text: pd.Series) -> pd.Series:
    return pd.Series([statistics(t) for t in text], dtype=object)


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every row, written to the shared folder: texts are read once."""
    return stored(docs.select("doc_id", _statistics("text").alias("stats")), "statistics")


@dataclass
class Model:
    """Scaling, projections, ridge weights, and the calibrated probability at and beyond each bin edge."""

    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    chances: np.ndarray

    def cosines(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -5, 5)
        z = np.cos(x @ self.turn + self.shift) * np.sqrt(2 / self.turn.shape[1])
        return np.column_stack([z, np.ones(len(z))])

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.cosines(stats) @ self.weights, self.edges, self.chances)


def pool_adjacent_violators(x: np.ndarray, hits: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising step function closest to the shares ``hits / totals`` at rising ``x``: block middles and shares."""
    blocks: list[list[float]] = []
    for at, k, n in zip(x, hits, totals):
        blocks.append([at * n, k, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    made = np.array(blocks)
    return made[:, 0] / made[:, 2], made[:, 1] / made[:, 2]


def _sums(model: Model) -> Callable:
    """Per partition and fold: the upper triangle of [Z y]'[Z y]."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = FEATURES + 2
        total = np.zeros((FOLDS, size, size))
        for frame in frames:
            z = np.column_stack([model.cosines(np.stack(frame["stats"])), frame["label"]]) if len(frame) else np.empty((0, size))
            for fold in range(FOLDS):
                part = z[frame["fold"].to_numpy() == fold]
                total[fold] += part.T @ part
        i, j = np.triu_indices(size)
        for fold in range(FOLDS):
            yield pd.DataFrame({"fold": fold, "i": i, "j": j, "v": total[fold][i, j]})

    return sums


def train(measured: DataFrame, labels: DataFrame, seed: int = 11) -> Model | None:
    """Learn from all ``labels`` (doc_id, label 0 or 1) of ``measured`` texts; None without any.

    Rows without doc_id or label teach nothing; of several labels of one doc_id the largest counts. What reaches the
    driver are means, one triangle of FEATURES numbers a fold, and counts per bin.
    """
    known = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").cast("double").alias("label"))
    rows = measured.join(known, "doc_id").select("stats", "label", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))
    rows = stored(rows, "labelled")
    n = len(STATISTICS)
    moments = rows.agg(*[f(F.col("stats")[i]) for f in (F.avg, F.stddev_pop) for i in range(n)]).first()
    if moments[0] is None:
        return None
    rng = np.random.default_rng(seed)
    model = Model(
        np.array(moments[:n]),
        np.maximum(np.array(moments[n:]), 1e-9),
        rng.normal(0, 1 / WIDTH, (n, FEATURES)),
        rng.uniform(0, 2 * np.pi, FEATURES),
        np.zeros(FEATURES + 1),
        np.zeros(1),
        np.zeros(1),
    )
    sums = rows.mapInPandas(_sums(model), "fold int, i int, j int, v double").groupBy("fold", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    equations = np.zeros((FOLDS, FEATURES + 2, FEATURES + 2))
    equations[sums["fold"], sums["i"], sums["j"]] = sums["v"]
    equations[sums["fold"], sums["j"], sums["i"]] = sums["v"]

    def solved(e: np.ndarray) -> np.ndarray:
        penalty = RIDGE * max(e[-2, -2], 1) * np.eye(FEATURES + 1) * 2 / FEATURES
        penalty[-1, -1] = 1e-9
        return np.linalg.solve(e[:-1, :-1] + penalty, e[:-1, -1])

    others = np.stack([solved(equations.sum(0) - equations[k]) for k in range(FOLDS)])
    model.weights = solved(equations.sum(0))

    def binned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                s = (model.cosines(np.stack(frame["stats"])) * others[frame["fold"].to_numpy()]).sum(1)
                yield pd.DataFrame({"bin": np.round((np.clip(s, LOW, HIGH) - LOW) / BIN).astype(np.int32), "label": frame["label"]})

    bins = (
        rows.mapInPandas(binned, "bin int, label double").groupBy("bin").agg(F.sum("label").alias("hits"), F.count("*").alias("total")).orderBy("bin").toPandas()
    )
    model.edges, model.chances = pool_adjacent_violators(LOW + BIN * bins["bin"].to_numpy(), bins["hits"].to_numpy(), bins["total"].to_numpy())
    return model


def score_measured(measured: DataFrame, model: Model | None, column: str = "quality") -> DataFrame:
    """``measured`` (column ``stats``) with the probability that the text is good; 0.5 where nothing was learnt."""
    if model is None:
        return measured.withColumn(column, F.lit(0.5))

    def scored(stats: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(stats)) if len(stats) else [], dtype=float)

    scored.__annotations__ = {"stats": pd.Series, "return": pd.Series}
    return measured.withColumn(column, F.pandas_udf(scored, "double")("stats"))


def score_quality(docs: DataFrame, model: Model | None, column: str = "quality") -> DataFrame:
    """``docs`` with all their columns and the probability that the text is good.

    Every text is scored whole and on its own: equal texts have equal scores, null and empty texts the score of a text
    without words. A column named like the new one is replaced. An empty table stays empty.
    """
    name = "stats of text"
    return score_measured(docs.withColumn(name, _statistics("text")).withColumnRenamed("stats", "stats of docs").withColumnRenamed(name, "stats"), model, column).drop("stats").withColumnRenamed("stats of docs", "stats")
