"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces, with byte fallback.

Pieces are read from a model file. One made for merges holds their order instead of probabilities; then the n-th piece
gets the log probability that Zipf's law gives to rank n. White space is written as a marker at the start of pieces, so
no piece spans the place where a marker follows something else: texts are cut there, and each distinct cut of a lot of
texts is segmented once, all of them side by side. Characters without a piece are spelled in byte pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
#: How much less likely than the least likely piece a character without a piece is, as a log.
UNKNOWN = 10.0
_CUTS = re.compile(r" *[^ ]+| +")
_LOT = 1 << 18


@dataclass
class Trie:
    """A double array: from state s a byte b leads to base[s] + b + 1 if check there is s. value: a piece's id or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(pieces: dict[bytes, int]) -> Trie:
        keys = sorted(pieces)
        size = 1024 + 4 * sum(map(len, keys))
        base, check, value = (np.full(size, -1, np.int32) for _ in range(3))
        taken = bytearray(size)
        taken[0] = 1
        lowest = 1  # no slot before it is free
        todo = [(0, 0, len(keys), 0)]  # state, keys from, to, bytes they share
        last = 0
        while todo:
            state, lo, hi, depth = todo.pop()
            if len(keys[lo]) == depth:
                value[state] = pieces[keys[lo]]
                lo += 1
            groups = []
            at = lo
            while at < hi:
                byte, begin = keys[at][depth], at
                while at < hi and keys[at][depth] == byte:
                    at += 1
                groups.append((byte + 1, begin, at))
            if not groups:
                continue
            lowest = taken.find(0, lowest)
            slot = max(lowest, groups[0][0])
            while taken[slot] or any(taken[slot - groups[0][0] + c] for c, _, _ in groups):
                slot = taken.find(0, slot + 1)
            start = slot - groups[0][0]
            base[state] = start
            for c, begin, end in groups:
                taken[start + c] = 1
                check[start + c] = state
                last = max(last, start + c)
                todo.append((start + c, begin, end, depth + 1))
        last += 258  # a step from any state stays inside
        return Trie(base[:last].copy(), check[:last].copy(), value[:last].copy())


@dataclass
class Vocabulary:
    """The trie, a log score per id, the bytes each id stands for, the ids of the 256 bytes, and of the unknown."""

    trie: Trie
    scores: np.ndarray
    spelled: list[bytes]
    byte_ids: np.ndarray
    unknown: int
    unknown_score: float
    longest: int

    @staticmethod
    def load(path: str, scores: str = "zipf") -> Vocabulary:
        """Of a SentencePiece model file. ``scores``: "zipf" by order in the file, "model" those of the file."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if scores == "zipf":
            log = -np.log(np.arange(1, len(normal) + 1)) - np.log((1 / np.arange(1, len(normal) + 1)).sum())
        else:
            log = np.array([model.get_score(i) for i in normal])
        return Vocabulary.of(
            {i: model.id_to_piece(i) for i in normal},
            dict(zip(normal, log)),
            {int(model.id_to_piece(i)[1:-1], 16): i for i in range(n) if model.is_byte(i)},
            model.unk_id(),
            n,
        )

    @staticmethod
    def of(pieces: dict[int, str], scores: dict[int, float], byte_ids: dict[int, int], unknown: int, size: int) -> Vocabulary:
        if any(MARK in p.lstrip(MARK) or " " in p for p in pieces.values()):
            raise ValueError("pieces with a marker inside are not supported")
        spelled = [b""] * size
        for i, p in pieces.items():
            spelled[i] = p.replace(MARK, " ").encode()
        for b, i in byte_ids.items():
            spelled[i] = bytes([b])
        log = np.zeros(size)
        # whole 1024ths add up exactly, so ties do not hang on the order of additions
        log[list(scores)] = np.round(np.array(list(scores.values())) * 1024) / 1024
        bytes_of = np.full(256, unknown, np.int32)
        bytes_of[list(byte_ids)] = list(byte_ids.values())
        trie = Trie.of({spelled[i]: i for i in pieces})
        return Vocabulary(trie, log, spelled, bytes_of, unknown, log[list(scores)].min() - UNKNOWN, max(len(spelled[i]) for i in pieces))

    def _edges(self, data: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, id) of every piece in ``data``; id -1 for a character that no piece is. end: of each byte's cut."""
        trie, found = self.trie, []
        first = (data & 0xC0) != 0x80
        start = np.flatnonzero(first).astype(np.int32)
        width = np.diff(np.append(start, len(data))).astype(np.int32)
        at, state, known = start, np.zeros(len(start), np.int32), np.zeros(len(data), bool)
        wide = np.zeros(len(data), np.int32)
        wide[start] = width
        for length in range(1, self.longest + 1):
            reach = at + length - 1
            alive = reach < end[at]
            at, state, reach = at[alive], state[alive], reach[alive]
            low = trie.base[state]
            ahead = low + data[reach] + 1
            alive = (low >= 0) & (trie.check[np.where(low >= 0, ahead, 0)] == state)
            at, state = at[alive], ahead[alive]
            if not len(at):
                break
            ids = trie.value[state]
            hit = ids >= 0
            found.append((at[hit], np.full(int(hit.sum()), length, np.int32), ids[hit]))
            known[at[hit & (wide[at] == length)]] = True
        lone = start[~known[start]]
        found.append((lone, wide[lone], np.full(len(lone), -1, np.int32)))
        return tuple(np.concatenate(x) for x in zip(*found))

    def segment(self, cuts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all cuts (none empty) in a row, and how many each has: the best-scoring pieces of each."""
        data = np.frombuffer(b"".join(cuts), np.uint8)
        sizes = np.fromiter(map(len, cuts), np.int64, len(cuts))
        ends = np.cumsum(sizes)
        begins = ends - sizes
        start, length, ids = self._edges(data, np.repeat(ends, sizes))
        # place k of a cut's text is node begin + its number + k, so that each cut has one node more than bytes
        cut_of = np.repeat(np.arange(len(cuts)), sizes)
        source = start + cut_of[start]
        target = source + length
        offset = start - begins[cut_of[start]] + length
        score = np.where(ids >= 0, self.scores[ids], self.unknown_score)
        order = np.lexsort((source, target, offset))
        source, target, score, offset = source[order], target[order], score[order], offset[order]
        best = np.full(len(data) + len(cuts), -np.inf)
        best[begins + np.arange(len(cuts))] = 0
        back = np.zeros(len(best), np.int64)
        borders = np.flatnonzero(np.diff(offset, prepend=-1))
        for lo, hi in zip(borders, np.append(borders[1:], len(offset))):
            total = best[source[lo:hi]] + score[lo:hi]
            group = np.flatnonzero(np.diff(target[lo:hi], prepend=-1))
            top = np.maximum.reduceat(total, group)
            node = target[lo:hi][group]
            best[node] = top
            hit = np.flatnonzero(total == np.repeat(top, np.diff(np.append(group, hi - lo))))[::-1]
            back[target[lo:hi][hit]] = lo + hit  # of equal ones the longest last piece
        # from the ends back to the beginnings, all cuts at once
        node, cut = ends + np.arange(len(cuts)), np.arange(len(cuts))
        taken_edge, taken_cut = [], []
        first = begins + np.arange(len(cuts))
        while len(node):
            edge = back[node]
            taken_edge.append(edge)
            taken_cut.append(cut)
            node = source[edge]
            more = node > first[cut]
            node, cut = node[more], cut[more]
        edge, cut = np.concatenate(taken_edge), np.concatenate(taken_cut)
        way = np.lexsort((source[edge], cut))
        edge, cut = order[edge[way]], cut[way]
        # a character without a piece becomes its bytes
        spell = np.where(ids[edge] >= 0, 1, length[edge])
        out = np.repeat(ids[edge], spell)
        inside = np.arange(len(out)) - np.repeat(np.cumsum(spell) - spell, spell)
        missing = out < 0
        out[missing] = self.byte_ids[data[(np.repeat(start[edge], spell) + inside)[missing]]]
        return out, np.bincount(np.repeat(cut, spell), minlength=len(cuts))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; of an empty one none."""
        number: dict[str, int] = {}
        rows = [
            np.array([number.setdefault(c, len(number)) for c in _CUTS.findall(" " + t.replace(MARK, " "))] if t else [], np.int64) for t in texts
        ]
        if not number:
            return [np.empty(0, np.int32) for _ in texts]
        ids, many = self.segment([c.encode("utf-8", "surrogatepass") for c in number])
        at = np.cumsum(many) - many
        out = []
        for row in rows:
            n = many[row]
            place = np.repeat(at[row] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append(ids[place])
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text that pieces spell, markers as spaces; the first marker goes, broken byte runs become U+FFFD."""
        spelled = self.spelled
        data = b"".join([spelled[i] for i in ids])
        return data[1 if data[:1] == b" " else 0 :].decode("utf-8", "replace")


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else [], pa.int32()))


def encode(docs: DataFrame, vocabulary: Vocabulary, column: str = "ids", round_trip: str | None = None) -> DataFrame:
    """``docs`` with all their columns and the ids of the whole ``text``; null and empty texts have none.

    ``round_trip`` names one more column: whether decoding the ids gives the text back (for null, the empty one).
    Columns named like the new ones are replaced; an empty table stays empty. Rows are handled in lots of some texts, so
    memory is bounded by a lot and the longest text.
    """
    new = [T.StructField(column, T.ArrayType(T.IntegerType()))]
    if round_trip:
        new.append(T.StructField(round_trip, T.BooleanType()))
    names = {f.name for f in new}
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])

    def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
            ends = np.flatnonzero(np.diff(np.cumsum(sizes) // _LOT, append=-1)) + 1
            for lo, hi in zip([0, *ends], ends):
                part = batch.slice(lo, hi - lo)
                yield part, [t or "" for t in part["text"].to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in lots(batches):
            ids = vocabulary.encode(texts)
            added = [_lists(ids)]
            if round_trip:
                added.append(pa.array([vocabulary.decode(i) == t for i, t in zip(ids, texts)], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*part.columns, *added], [*part.schema.names, *[f.name for f in new]])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *new]))


def decode(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """``rows`` with the text their ids spell; of null or no ids, the empty text.

    Encoding and decoding gives back every text but for U+2581, the marker, which comes back as a space.
    """

    @F.pandas_udf(T.StringType())
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([vocabulary.decode(r) if r is not None else "" for r in rows], dtype=object)

    return rows.withColumn(column, text(ids))
