"""Periodic runs of words: stretches that repeat one period three times or more.

A lot of documents is one sequence of word numbers, with a number of its own after each document. How far the words from
two places agree (LCE) is answered by a difference cover: of every 31 places six are sampled such that any two places
reach a pair of samples after the same few steps. Only sampled suffixes are sorted; what stands before a synchronised
pair is compared word by word, and what follows is a minimum over the common prefixes of neighbours in sorted order, kept
as a sparse table. Runs are enumerated on a harmonic grid: one of period p and at least 3p words has a place i of the
grid of steps p with at least p words alike from i and i + p on, so n/1 + n/2 + ... pairs of places are asked about.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A perfect difference set: every number modulo 31 is a difference of two of these (fixed values).
CYCLE, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Least length of a run in words, and least number of periods in it.
LEAST, TIMES = 24, 3
#: Grid step of periods that are shorter.
STEP = 8
#: Words of a lot (a longer document is a lot of its own) and pairs of places looked at together.
LOT, PAIRS = 1 << 16, 1 << 20


def _synchronised() -> np.ndarray:
    """[i mod 31, (j - i) mod 31] -> steps after which both places are sampled."""
    steps = np.zeros((CYCLE, CYCLE), np.int64)
    for a in COVER:
        for b in COVER:
            for i in range(CYCLE):
                if a != b:
                    steps[i, (b - a) % CYCLE] = (a - i) % CYCLE
    for i in range(CYCLE):
        steps[i, 0] = min((c - i) % CYCLE for c in COVER)
    return steps


_SYNC = _synchronised()
_SAMPLED = np.isin(np.arange(CYCLE), COVER)


class Lce:
    """How many words agree from two places on; ``words`` are numbers below 2^32, and no agreement reaches the end."""

    def __init__(self, words: np.ndarray) -> None:
        self.n = len(words)
        # past the end every place differs from every other
        tail = np.arange(2 * CYCLE, dtype=np.int64) + (int(words.max(initial=0)) + 1)
        self.words = np.concatenate([words, tail])
        places = np.flatnonzero(_SAMPLED[np.arange(self.n + CYCLE) % CYCLE])
        place_of = np.full(self.n + 2 * CYCLE, -1, np.int64)
        place_of[places] = np.arange(len(places))
        follow = place_of[places + CYCLE]
        names = [self._blocks(places)]
        ahead = [follow]
        # names of 31, 62, 124, ... words, until no two suffixes share one
        while len(places) and names[-1].max() < len(places) - 1:
            name, on = names[-1], ahead[-1]
            second = np.where(on >= 0, name[on], -1 - np.arange(len(places)))
            low = second.min(initial=0)
            pair = name * (len(places) - low + 1) + (second - low)
            names.append(np.unique(pair, return_inverse=True)[1])
            ahead.append(np.where(on >= 0, on[on], -1))
        self.rank = np.full(self.n + 2 * CYCLE, -1, np.int64)
        self.rank[places] = names[-1] if len(places) else 0
        order = np.argsort(names[-1], kind="stable")
        self.table = [self._neighbours(places, order, names, ahead)]
        width = 1
        while 2 * width <= len(self.table[0]):
            low = self.table[-1]
            self.table.append(np.minimum(low[:-width], low[width:]))
            width *= 2

    def _blocks(self, places: np.ndarray) -> np.ndarray:
        """Places of the 31 words from each sample on in their sorted order."""
        big = self.words.astype(">u4")
        rows = np.lib.stride_tricks.sliding_window_view(big, CYCLE)[places]
        keys = np.ascontiguousarray(rows).view(f"S{4 * CYCLE}").ravel()
        order = np.argsort(keys)
        rows = rows[order]
        fresh = np.zeros(len(places), np.int64)
        fresh[1:] = (rows[1:] != rows[:-1]).any(1)
        names = np.empty(len(places), np.int64)
        names[order] = np.cumsum(fresh)
        return names

    def _neighbours(self, places: np.ndarray, order: np.ndarray, names: list[np.ndarray], ahead: list[np.ndarray]) -> np.ndarray:
        """Common prefixes of suffixes that follow each other in sorted order: blocks first, then single words."""
        a, b = order[:-1], order[1:]
        common = np.zeros(len(a), np.int64)
        for k in reversed(range(len(names))):
            same = (a >= 0) & (b >= 0)
            same &= names[k][a] == names[k][b]
            common += same * (CYCLE << k)
            a, b = np.where(same, ahead[k][a], a), np.where(same, ahead[k][b], b)
        x, y = places[order[:-1]] + common, places[order[1:]] + common
        return common + self._plain(x, y, np.full(len(x), CYCLE))

    def _plain(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words alike, up to ``most``, one step for all pairs at a time."""
        alike, live = np.zeros(len(x), np.int64), np.arange(len(x))
        for step in range(int(most.max(initial=0))):
            live = live[most[live] > step]
            live = live[self.words[x[live] + step] == self.words[y[live] + step]]
            if not len(live):
                break
            alike[live] = step + 1
        return alike

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words alike from places ``i`` and ``j``, i < j."""
        steps = _SYNC[i % CYCLE, (j - i) % CYCLE]
        out = self._plain(i, j, steps)
        reach = np.flatnonzero(out == steps)
        a, b = self.rank[i[reach] + steps[reach]], self.rank[j[reach] + steps[reach]]
        a, b = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = level == k
            row = self.table[k]
            out[reach[at]] += np.minimum(row[a[at]], row[b[at] - (1 << int(k))])
        return out


def _grid(begin: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (place, period) of a document of ``n`` words at ``begin``."""
    most = n // TIMES if n >= LEAST else 0
    periods = np.arange(1, most + 1)
    steps = np.maximum(periods, STEP)
    counts = -(-(n - periods) // steps)
    upto = np.cumsum(counts)
    low = 0
    while low < most:
        # as many periods as make a bounded number of pairs
        high = max(int(np.searchsorted(upto, (upto[low - 1] if low else 0) + PAIRS, "right")), low + 1)
        p, step, count = periods[low:high], steps[low:high], counts[low:high]
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        yield begin + nth * np.repeat(step, count), np.repeat(p, count)
        low = high


def runs_of(words: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (place, end, smallest period) of the documents in a lot, by place and period.

    ``words`` holds the numbers of all documents, each followed by one number that stands nowhere else.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    lce = None
    waiting_i: list[np.ndarray] = []
    waiting_p: list[np.ndarray] = []
    held = 0

    def ask() -> None:
        nonlocal lce, held
        if not waiting_i:
            return
        i, p = np.concatenate(waiting_i), np.concatenate(waiting_p)
        waiting_i.clear()
        waiting_p.clear()
        held = 0
        same = words[i] == words[i + p]
        i, p = i[same], p[same]
        if not len(i):
            return
        if lce is None:
            lce = Lce(words)
        forward = lce(i, i + p)
        step = np.maximum(p, STEP)
        enough = forward > np.maximum(LEAST, TIMES * p) - p - step
        i, p, forward, step = i[enough], p[enough], forward[enough], step[enough]
        if not len(i):
            return
        doc = np.searchsorted(begins, i, "right") - 1
        # a run that holds the grid place before, too, is reported from there
        before = i - step
        inner = np.flatnonzero(before >= begins[doc])
        earlier = np.zeros(len(i), bool)
        earlier[inner] = lce(before[inner], before[inner] + p[inner]) >= step[inner]
        i, p, forward, step, doc = (x[~earlier] for x in (i, p, forward, step, doc))
        # it begins where words stop agreeing backwards, within a step
        low, high = np.maximum(i - step, begins[doc] - 1), i.copy()  # low is outside, high inside
        while (open_ := high - low > 1).any():
            at = np.flatnonzero(open_)
            mid = (low[at] + high[at]) // 2
            inside = lce(mid, mid + p[at]) >= i[at] - mid
            high[at[inside]] = mid[inside]
            low[at[~inside]] = mid[~inside]
        start, end = high, i + forward + p
        good = end - start >= np.maximum(LEAST, TIMES * p)
        found.append((start[good], end[good], p[good]))

    for begin, n in zip(begins.tolist(), lengths.tolist()):
        for i, p in _grid(begin, n):
            waiting_i.append(i)
            waiting_p.append(p)
            held += len(i)
            if held >= PAIRS:
                ask()
    ask()
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    start, end, p = (np.concatenate(x) for x in zip(*found))
    # of equal stretches the smallest period
    order = np.lexsort((p, end, start))
    start, end, p = start[order], end[order], p[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, p = start[first], end[first], p[first]
    order = np.lexsort((p, start))
    return start[order], end[order], p[order]


def _lot(texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """Runs and collapsed text of each document of a lot, given as words."""
    number: dict[bytes, int] = {}
    lengths = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(lengths + 1) - (lengths + 1)
    words = np.empty(int((lengths + 1).sum()), np.int64)
    for begin, t in zip(begins.tolist(), texts):
        words[begin : begin + len(t)] = [number.setdefault(w, len(number)) for w in t]
    words[begins + lengths] = len(number) + np.arange(len(texts))
    start, end, period = runs_of(words, begins, lengths)
    doc = np.searchsorted(begins, start, "right") - 1
    edges = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    for k, t in enumerate(texts):
        a, b = edges[k], edges[k + 1]
        if a == b:
            out.append(([], b" ".join(t)))
            continue
        s, e, p = start[a:b] - begins[k], end[a:b] - begins[k], period[a:b]
        cover = np.zeros(len(t) + 1, np.int64)
        np.add.at(cover, s + p, 1)
        np.add.at(cover, e, -1)
        kept = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
        out.append((list(zip(s.tolist(), (e - s).tolist(), p.tolist())), b" ".join([t[i] for i in kept.tolist()])))
    return out


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def made(rows: list[int], lot: list[list[bytes]], batch: pa.RecordBatch) -> pa.RecordBatch:
        found = _lot(lot)
        runs = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r, _ in found], kind)
        texts = pa.array([c for _, c in found], pa.binary()).cast(pa.string())
        counts = pa.array([len(t) for t in lot], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0).slice(rows[0], len(rows)), counts, runs, texts], ["row", "n_words", "runs", "collapsed"])

    for batch in batches:
        rows: list[int] = []
        lot: list[list[bytes]] = []
        held = 0
        for i in range(batch.num_rows):
            text = batch.column(1)[i]
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            if lot and held + len(words) > LOT:
                yield made(rows, lot, batch)
                rows, lot, held = [], [], 0
            rows.append(i)
            lot.append(words)
            held += len(words) + 1
        if lot:
            yield made(rows, lot, batch)


def find_runs(docs: DataFrame, text: str | Column = "text", n_words: str = "n_words", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """``docs`` without its column text, with the words of ``text``, their periodic runs, and the text without repeats.

    Words stand between ASCII white space. A run is a stretch of words with smallest period q (words q apart are the
    same) of at least 24 words and three periods that no neighbouring word continues; ``runs`` has (start, length,
    period) by start, then period, words counted from 0. ``collapsed`` joins by one space the words that no run contains
    after its first q words. Null, empty and blank texts have no words, no runs and an empty ``collapsed``. Each row is
    taken alone: rows may repeat, doc_id may be null, other columns come through whatever their names (the three new
    ones replace any of theirs). An empty table gives an empty result. Texts are taken whole; memory grows with the
    longest text.
    """
    source = F.col(text) if isinstance(text, str) else text
    others = [c for c in docs.columns if c not in ("text", n_words, runs, collapsed)]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(True).alias("none"))
    given = docs.select(row.alias("row"), source.cast("string").alias("text"))
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    made_columns = {"n_words": T.LongType(), "runs": T.ArrayType(run), "collapsed": T.StringType()}
    schema = T.StructType([given.schema["row"], *[T.StructField(c, kind) for c, kind in made_columns.items()]])
    made = given.mapInArrow(_find, schema)
    return made.select(
        *[F.col("row")[c].alias(c) for c in others], F.col("n_words").alias(n_words), F.col("runs").alias(runs), F.col("collapsed").alias(collapsed)
    )


def greatest_run(runs: Column) -> Column:
    """The run of greatest length to period, compared exactly; the first in order of those that tie; null without runs."""
    return F.aggregate(
        runs,
        F.get(runs, F.lit(0)),
        lambda best, x: F.when(x["length"] * best["period"] > best["length"] * x["period"], x).otherwise(best),
    )
