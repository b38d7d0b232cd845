"""Overlapping context windows over token sequences, and stitching by weighted overlap-add."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Samples of the blocks that are handed on together.
OUT_SAMPLES = 1 << 20


@dataclass(frozen=True)
class Chunking:
    """Sizes in tokens; ``hop`` is the number of samples one token stands for."""

    # The published defaults.
    chunk: int = 25
    lookback: int = 50
    lookforward: int = 5
    overlap: int = 1
    hop: int = 480

    @property
    def back(self) -> int:
        """Context before a chunk's start."""
        return self.lookback + self.overlap

    @property
    def ahead(self) -> int:
        """Tokens from a chunk's start that must exist before it is ready."""
        return self.chunk + self.lookforward

    @property
    def stride(self) -> int:
        return self.chunk * self.hop

    @property
    def cut(self) -> int:
        """Samples taken from a regular chunk."""
        return (self.chunk + 2 * self.overlap) * self.hop


def is_regular(size: Chunking, ready: Column) -> Column:
    """Whether a chunk is emitted while the sequence runs; ``ready`` counts the tokens from its start."""
    return ready >= size.ahead


def is_final(size: Chunking, ready: Column, chunk: Column) -> Column:
    """Whether a chunk is the remainder of its sequence.

    It is the first one that never got ready: its predecessor was, so the remainder is longer than
    what the predecessor looked ahead, unless there is no predecessor.
    """
    least = F.when(chunk == 0, 1).otherwise(size.ahead - size.chunk)
    return (ready < size.ahead) & (ready >= least)


def in_blocks(
    df: DataFrame, key: str, seq: str, token: str, n_ref: str | None, size: Chunking, chunks_per_block: int, *keep: Column
) -> DataFrame:
    """Tokens with the blocks of chunks that need them: ``key, _ref, _block, _seq, _token`` and ``keep``.

    Block ``b`` holds the contexts of its chunks, tokens ``[b*span - back, b*span + span - chunk +
    ahead)`` counted from ``n_ref``.
    """
    ref = F.coalesce(F.col(n_ref), F.lit(0)).cast("long") if n_ref else F.lit(0).cast("long")
    span = size.chunk * chunks_per_block
    rel = F.col("_seq") - F.col("_ref")
    first = F.greatest(F.floor((rel - (span - size.chunk + size.ahead)) / span) + 1, F.lit(0).cast("long"))
    last = F.floor((rel + size.back) / span)
    rows = df.select(
        key, F.col(seq).cast("long").alias("_seq"), F.col(token).alias("_token"), ref.alias("_ref"), *keep
    )
    return rows.where(last >= first).withColumn("_block", F.explode(F.sequence(first, last)))


def chunk_windows(
    df: DataFrame,
    key: str = "utt_id",
    seq: str = "seq",
    token: str = "token",
    n_ref: str | None = None,
    size: Chunking = Chunking(),
    chunks_per_block: int = 64,
) -> DataFrame:
    """One row per chunk: its number, start ``n``, context ``[ctx_start, ctx_end)`` and tokens.

    ``seq`` runs from 0 without gaps in each key; the first ``n_ref`` tokens are given reference
    tokens. Tokens are grouped into blocks of many chunks with the context the block needs, so a
    token is shuffled little more than once and no group outgrows a block however long its
    sequence is.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col("_seq").alias("seq"), F.col("_token").alias("token"))))
    grouped = (
        in_blocks(df, key, seq, token, n_ref, size, chunks_per_block)
        .groupBy(key, "_ref", "_block")
        .agg(items.alias("_items"))
    )
    items = grouped.withColumn("_first", F.get("_items", F.lit(0))["seq"]).withColumn(
        "_seen", F.element_at("_items", -1)["seq"] + 1
    )
    from_chunk = F.col("_block") * chunks_per_block
    # chunks of the block whose start lies before the last token seen
    upto = F.least(
        from_chunk + (chunks_per_block - 1), F.floor((F.col("_seen") - F.col("_ref") - 1) / size.chunk)
    )

    def window(chunk: Column) -> Column:
        n = F.col("_ref") + chunk * size.chunk
        start = F.greatest(n - size.back, F.lit(0).cast("long"))
        end = F.least(n + size.ahead, F.col("_seen"))
        inside = F.slice("_items", (start - F.col("_first") + 1).cast("int"), (end - start).cast("int"))
        return F.struct(
            chunk.alias("chunk"),
            n.alias("n"),
            start.alias("ctx_start"),
            end.alias("ctx_end"),
            F.transform(inside, lambda t: t["token"]).alias("tokens"),
        )

    # the block's tokens are cut inside the row, so only contexts leave it
    windows = F.transform(F.sequence(from_chunk, upto), window)
    # each block starts where its first chunk looks back to and has no gaps
    begin = F.greatest(F.col("_ref") + from_chunk * size.chunk - size.back, F.lit(0).cast("long"))
    whole = (F.col("_first") == begin) & (F.size("_items") == F.col("_seen") - F.col("_first"))
    gap = F.concat(F.lit("tokens missing or doubled in "), F.col(key).cast("string"))
    checked = F.when(whole, F.lit(True)).otherwise(F.raise_error(gap).cast("boolean"))
    chunks = items.where((upto >= from_chunk) & checked).select(key, F.inline(windows))
    ready = F.col("ctx_end") - F.col("n")
    final = is_final(size, ready, F.col("chunk"))
    return chunks.where(is_regular(size, ready) | final).select(
        key, "chunk", "n", "ctx_start", "ctx_end", final.alias("is_final"), "tokens"
    )


def cut_frames(
    df: DataFrame, samples: str = "samples", size: Chunking = Chunking(), align_tail: bool = False
) -> DataFrame:
    """Cut each chunk's decoded context to the frame that is stitched.

    A regular frame starts at the chunk's first token, the final one a hop earlier (not before the
    context) and goes to the end. Frames are placed a stride apart; ``align_tail`` moves the final
    one to where its samples belong.
    """
    start = (F.col("n") - F.col("ctx_start")) * size.hop
    lead = F.least(start, F.lit(size.overlap * size.hop).cast("long"))
    begin = F.when(F.col("is_final"), start - lead).otherwise(start)
    length = F.when(F.col("is_final"), F.size(samples).cast("long")).otherwise(F.lit(size.cut).cast("long"))
    shift = F.when(F.col("is_final"), -lead).otherwise(F.lit(0).cast("long")) if align_tail else F.lit(0).cast("long")
    return df.withColumn("frame", F.slice(samples, (begin + 1).cast("int"), length.cast("int"))).withColumn(
        "at", F.col("chunk") * size.stride + shift
    )


def weights(low: int, count: int, at: int, length: int, kind: str) -> np.ndarray:
    """Weights of a frame's samples from position ``low`` on; the frame starts at ``at``."""
    t = (np.arange(low - at, low - at + count) + 1) / (length + 1)
    return 1 - t if kind == "ramp" else 0.5 - np.abs(t - 0.5)


_PIECE = ("block", "end", "wanted", "at", "len", "low", "x", "w")


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists and where each list begins and ends among them."""
    return lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()


def _summed(key: str, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per batch and block one piece in place of many: sums of weighted samples (``x``) and of weights (``w``).

    A lone piece stays as it is, as do those that lie so far apart that their sums would be longer than they are.
    """

    whole, reals = pa.int64(), pa.list_(pa.float64())
    kinds = [whole, whole, pa.bool_(), whole, whole, whole, reals, reals]

    def alike(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [batch.column(0), *[batch.column(c).cast(k) for c, k in zip(_PIECE, kinds)]]
        return pa.RecordBatch.from_arrays(columns, [key, *_PIECE])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(alike, batches):
            if not batch.num_rows:
                continue
            low, block = batch.column("low").to_numpy(), batch.column("block").to_numpy()
            values, edges = _flat(batch.column("x"))
            size = np.diff(edges)
            codes = batch.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
            order = np.lexsort((low, block, codes))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (codes[order][1:] != codes[order][:-1]) | (block[order][1:] != block[order][:-1])
            firsts = np.flatnonzero(fresh)
            counts = np.diff(np.append(firsts, len(order)))
            begin = np.minimum.reduceat(low[order], firsts)
            span = np.maximum.reduceat((low + size)[order], firsts) - begin
            many = (counts > 1) & (span <= np.add.reduceat(size[order], firsts))
            group = np.empty(len(order), np.int64)
            group[order] = np.repeat(np.arange(len(firsts)), counts)
            alone = pa.array(~many[group])
            if not many.any():
                yield batch
                continue
            yield batch.filter(alone)
            # the pieces of all groups that are merged, sample by sample
            rows = np.flatnonzero(many[group])
            to = np.cumsum(span * many) - span * many
            at, sample = np.repeat(rows, size[rows]), _places(size[rows])
            t = (low[at] - batch.column("at").to_numpy()[at] + sample + 1) / (batch.column("len").to_numpy()[at] + 1)
            w = 1 - t if kind == "ramp" else 0.5 - np.abs(t - 0.5)
            place = to[group[at]] + low[at] - begin[group[at]] + sample
            total = int((span * many).sum())
            sums = np.bincount(place, w * values[edges[at] + sample], total)
            weight = np.bincount(place, w, total)
            kept = order[firsts[many]]
            ends = pa.array(np.append(to[many], total).astype(np.int32))
            end = np.maximum.reduceat(batch.column("end").to_numpy()[order], firsts)[many]
            wanted = np.logical_or.reduceat(batch.column("wanted").to_numpy(zero_copy_only=False)[order], firsts)[many]
            none = pa.nulls(len(kept), pa.int64())
            columns = [
                batch.column(key).take(pa.array(kept)), pa.array(block[kept]), pa.array(end), pa.array(wanted), none, none, pa.array(begin[many]),
                pa.ListArray.from_arrays(ends, pa.array(sums)), pa.ListArray.from_arrays(ends, pa.array(weight)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [key, *_PIECE])

    return merge


def _places(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... in each of the lists of these lengths, one after the other."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _means(key: str, stride: int, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks from their pieces in order of key and block, by vector addition; one block is held at a time."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, int, np.ndarray, np.ndarray]]:
        here, name, total, weight, end, wanted = None, None, np.zeros(stride), np.zeros(stride), 0, False
        for batch in batches:
            values, edges = _flat(batch.column("x"))
            given, given_edges = _flat(batch.column("w"))
            summed = batch.column("w").is_valid().to_numpy(zero_copy_only=False)
            low, stops = batch.column("low").to_numpy(), batch.column("end").to_numpy()
            at, length = (batch.column(c).fill_null(0).to_numpy() for c in ("at", "len"))
            asked = batch.column("wanted").to_numpy(zero_copy_only=False)
            places = list(zip(batch.column(key).to_pylist(), batch.column("block").to_pylist()))
            for row, place in enumerate(places):
                if place != here:
                    if wanted:
                        yield name, here[1], total[: end - here[1] * stride], weight[: end - here[1] * stride]
                    here, name = place, batch.column(key).slice(row, 1)
                    total, weight, end, wanted = np.zeros(stride), np.zeros(stride), 0, False
                part = values[edges[row] : edges[row + 1]]
                to = low[row] - place[1] * stride
                if summed[row]:
                    total[to : to + len(part)] += part
                    weight[to : to + len(part)] += given[given_edges[row] : given_edges[row + 1]]
                else:
                    w = weights(low[row], len(part), at[row], length[row], kind)
                    total[to : to + len(part)] += w * part
                    weight[to : to + len(part)] += w
                end, wanted = max(end, int(stops[row])), wanted or bool(asked[row])
        if wanted:
            yield name, here[1], total[: end - here[1] * stride], weight[: end - here[1] * stride]

    def out(lot: list[tuple[pa.Array, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        total, weight = (np.concatenate([b[i] for b in lot]) for i in (2, 3))
        covered = weight > 0
        np.divide(total, weight, out=total, where=covered)
        ends = np.cumsum([0, *[len(b[2]) for b in lot]])
        samples = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(total, pa.float64(), mask=~covered))
        return pa.RecordBatch.from_arrays([pa.concat_arrays([b[0] for b in lot]), pa.array([b[1] for b in lot], pa.int64()), samples], [key, "block", "samples"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, held = [], 0
        for block in blocks(batches):
            lot.append(block)
            held += len(block[2])
            if held >= OUT_SAMPLES:
                yield out(lot)
                lot, held = [], 0
        if lot:
            yield out(lot)

    return mean


def frame_pieces(
    df: DataFrame, key: str, stride: int, frame: str = "frame", at: str = "at", keep: Sequence[str] = ()
) -> DataFrame:
    """Frames cut at the borders of blocks of ``stride`` samples: ``key, keep, block, end, piece``.

    A piece knows where its frame starts and how long it is, where it starts itself, and its
    samples. What lies before position 0 is dropped.
    """
    begin, length = F.col(at).cast("long"), F.size(frame).cast("long")
    first = F.greatest(F.floor(begin / stride), F.lit(0).cast("long"))
    last = F.floor((begin + length - 1) / stride)

    def cut(block: Column) -> Column:
        low = F.greatest(begin, block * stride)
        high = F.least(begin + length, (block + 1) * stride)
        x = F.slice(frame, (low - begin + 1).cast("int"), (high - low).cast("int")).cast("array<double>")
        piece = F.struct(begin.alias("at"), length.alias("len"), low.alias("low"), x.alias("x"))
        return F.struct(block.alias("block"), high.alias("end"), piece.alias("piece"))

    whole = df.where((length > 0) & (last >= first))
    return whole.select(key, *keep, F.inline(F.transform(F.sequence(first, last), cut)))


def _add_pieces(pieces: DataFrame, key: str, stride: int, weight: str, wanted: Column | None = None) -> DataFrame:
    """Blocks from their pieces; ``wanted`` must hold for one piece of a block at least."""
    if weight not in ("ramp", "triangle"):
        raise ValueError(f"unknown weight {weight!r}: ramp or triangle")
    kind = dict(pieces.dtypes)[key]
    flat = pieces.select(key, "block", "end", (F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))).alias("wanted"), "piece.*")
    fields = f"`{key}` {kind}, block bigint, end bigint, wanted boolean, at bigint, len bigint, low bigint, x array<double>, w array<double>"
    # pieces of one batch are added up before they move, all others as they arrive
    partial = flat.withColumn("w", F.lit(None).cast("array<double>")).mapInArrow(_summed(key, weight), fields)
    ordered = partial.repartition(key, "block").sortWithinPartitions(key, "block", "low")
    return ordered.mapInArrow(_means(key, stride, weight), f"`{key}` {kind}, block bigint, samples array<double>")


def overlap_add(
    df: DataFrame, key: str, stride: int, frame: str = "frame", at: str = "at", weight: str = "ramp"
) -> DataFrame:
    """Weighted mean of overlapping frames, one row per (key, block) of ``stride`` samples.

    ``at`` is a frame's first sample position. Only the pieces of frames are shuffled, and those that a task has for
    one block as their sum; a block adds up what arrives, so long series are spread over the cluster and a block with
    many frames is never held as a list.
    ``samples`` starts at ``block * stride``; a position no frame covers is null, or left out at
    the end of its block.
    """
    return _add_pieces(frame_pieces(df, key, stride, frame, at), key, stride, weight)


def stitch(
    df: DataFrame,
    key: str = "utt_id",
    samples: str = "samples",
    size: Chunking = Chunking(),
    weight: str = "ramp",
    align_tail: bool = False,
) -> DataFrame:
    """Decoded chunks to the emitted signal, one row per block of a stride.

    Expects the columns of ``chunk_windows`` with the decoded context in ``samples``. Every block
    is what the stream emits with the chunk of that number; a block past the final chunk's own is
    emitted with it, and what a regular chunk holds beyond its block is not emitted on its own.
    """
    frames = cut_frames(df, samples, size, align_tail)
    pieces = frame_pieces(frames, key, size.stride, keep=("chunk", "is_final"))
    return _add_pieces(pieces, key, size.stride, weight, (F.col("chunk") == F.col("block")) | F.col("is_final"))


def to_samples(blocks: DataFrame, key: str, stride: int) -> DataFrame:
    """One row per sample."""
    return blocks.select(key, "block", F.posexplode("samples").alias("_j", "value")).select(
        key, (F.col("block") * stride + F.col("_j")).alias("sample"), "value"
    )
