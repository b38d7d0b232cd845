"""Stitching of decoded chunks as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voxframe.operators.sequence import Chunking, cut_frames, frame_pieces, weights

# The state of a block whose samples are out.
_FINISHED = -1
# Numbers before the samples of a piece.
_HEAD = 6


def stream_stitch(
    chunks: DataFrame,
    key: str = "utt_id",
    samples: str = "samples",
    size: Chunking = Chunking(),
    weight: str = "ramp",
    forget_after_s: int | None = None,
) -> DataFrame:
    """The rows of ``stitch`` from a stream of decoded chunks in any order.

    A chunk that is delivered again counts once: a finished block leaves a mark. With ``forget_after_s``, for
    queries that run on, a block that gets nothing for so long is forgotten, finished or not.

    A block waits for its own chunk and for the tail of the one before; the part of a final chunk
    past its own block comes out at once. The state of a block is the one piece that came first.
    """
    if size.lookforward + size.overlap - 1 > size.chunk or 2 * size.overlap > size.chunk:
        raise ValueError("a frame may reach into the next block only")
    frames = cut_frames(chunks, samples, size)
    # Spark converts column by column for each block, so a piece is one column: whole numbers (exact in doubles) and then its samples
    head = [F.col(c).cast("double") for c in ("chunk", "is_final", "end", "piece.at", "piece.len", "piece.low")]
    parts = frame_pieces(frames, key, size.stride, keep=("chunk", "is_final")).select(
        key, "block", F.concat(F.array(*head), "piece.x").alias("piece")
    )
    kind = dict(parts.dtypes)[key]

    def keep(state: GroupState) -> None:
        if forget_after_s:
            state.setTimeoutDuration(forget_after_s * 1000)

    def collect(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ident, block = group
        if state.hasTimedOut:
            state.remove()
            return
        pieces = {}
        if state.exists:
            chunk, *rest = state.get
            if chunk == _FINISHED:
                keep(state)
                return
            pieces[chunk] = (chunk, *rest)
        for batch in batches:
            for piece in batch["piece"].array:
                chunk, final, end, at, length, low = map(int, piece[:_HEAD])
                pieces.setdefault(chunk, (chunk, bool(final), end, at, length, low, piece[_HEAD:]))
        held = list(pieces.values())
        own = [p for p in held if p[0] == block]
        before = [p for p in held if p[0] < block]
        ended = any(p[1] for p in before)
        if not ended and not (own and (before or block == 0 or not size.overlap)):
            chunk, final, end, at, length, low, x = held[0]
            state.update((chunk, final, end, at, length, low, np.asarray(x, float).tolist()))
            keep(state)
            return
        state.update((_FINISHED, True, 0, 0, 0, 0, []))
        keep(state)
        start, end = block * size.stride, max(p[2] for p in held)
        total, weight_sum = np.zeros(end - start), np.zeros(end - start)
        for _, _, _, at, length, low, x in sorted(held, key=lambda p: p[3]):
            w = weights(low, len(x), at, length, weight)
            total[low - start : low - start + len(x)] += w * np.asarray(x)
            weight_sum[low - start : low - start + len(x)] += w
        yield pd.DataFrame({key: [ident], "block": [block], "samples": [total / weight_sum]})

    return parts.groupBy(key, "block").applyInPandasWithState(
        collect,
        f"`{key}` {kind}, block long, samples array<double>",
        "chunk long, is_final boolean, end long, at long, len long, low long, x array<double>",
        "append",
        GroupStateTimeout.ProcessingTimeTimeout if forget_after_s else GroupStateTimeout.NoTimeout,
    )

