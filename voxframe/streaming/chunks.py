"""Context windows over token streams, emitted as soon as they are complete."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voxframe.operators.sequence import Chunking, in_blocks


def stream_chunk_windows(
    tokens: DataFrame,
    key: str = "utt_id",
    seq: str = "seq",
    token: str = "token",
    is_last: str = "is_last",
    n_ref: str | None = None,
    size: Chunking = Chunking(),
    chunks_per_block: int = 64,
    forget_after_s: int | None = None,
) -> DataFrame:
    """The rows of ``chunk_windows`` from a stream of tokens (integers) in any order.

    The state is kept per block of chunks and holds only the tokens its next chunk still needs; a
    token belongs to one block, or to two near their border. So a long sequence neither lives in
    one task nor grows in memory. Chunks of a block come out in order. The row marked ``is_last`` ends
    a sequence and lets its remainder out. Tokens may be delivered again: a position counts once,
    and a finished block leaves three numbers, by which it knows what comes late. With ``forget_after_s`` a block
    that gets nothing for so long is forgotten, finished or not, so that a sequence that broke off does not
    stay for ever; that is for queries that run on, as Spark keeps a query with such a clock awake.
    """
    rows = in_blocks(tokens, key, seq, token, n_ref, size, chunks_per_block, F.col(is_last).alias("_last"))
    # Spark converts column by column for each block, so a position and whether it is the last are one number
    place = (F.col("_seq") * 2 + F.coalesce(F.col("_last"), F.lit(False)).cast("long")).alias("_place")
    rows = rows.select(key, "_ref", "_block", place, "_token")
    kind = dict(rows.dtypes)[key]
    names = [key, "chunk", "n", "ctx_start", "ctx_end", "is_final", "tokens"]

    def keep(state: GroupState) -> None:
        if forget_after_s:
            state.setTimeoutDuration(forget_after_s * 1000)

    def collect(
        group: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        ident, ref_len, block = group
        if state.hasTimedOut:
            state.remove()
            return
        total, chunk, seen, seqs, values = state.get if state.exists else (-1, block * chunks_per_block, 0, [], [])
        after = (block + 1) * chunks_per_block
        if chunk >= after:  # finished: what comes late changes nothing
            keep(state)
            return
        # every position before it was there when the chunk before was made
        floor = ref_len + chunk * size.chunk - size.back if chunk > block * chunks_per_block else -1
        held = dict(zip(seqs, values))
        for batch in batches:
            places = batch["_place"].to_numpy()
            for s, t in zip((places >> 1).tolist(), batch["_token"].to_numpy().tolist()):
                if s >= floor and s not in held:
                    held[s] = t
                    seen += 1
            ends = places[places & 1 == 1]
            if len(ends):
                total = int(ends[0] >> 1) + 1

        made = []
        while chunk < after:
            n = ref_len + chunk * size.chunk
            start, end = max(n - size.back, 0), n + size.ahead
            stop = min(end, total) if total >= 0 else end
            if not all(s in held for s in range(stop - 1, start - 1, -1)):
                break
            ready = stop - n
            regular = ready >= size.ahead
            if regular or ready >= max(1, size.lookforward if chunk else 1):
                made.append((ident, chunk, n, start, stop, not regular, [held[s] for s in range(start, stop)]))
            # nothing follows a chunk that did not get ready
            chunk = chunk + 1 if regular else after

        first = ref_len + block * chunks_per_block * size.chunk
        last = first + (chunks_per_block - 1) * size.chunk + size.ahead
        expected = (min(last, total) if total >= 0 else last) - max(first - size.back, 0)
        if seen < expected and chunk < after:
            needed = ref_len + chunk * size.chunk - size.back
            held = {s: t for s, t in held.items() if s >= needed}
        else:
            chunk, held = after, {}
        state.update((total, chunk, seen, list(held), list(held.values())))
        keep(state)
        if made:
            yield pd.DataFrame(dict(zip(names, map(list, zip(*made)))))

    return rows.groupBy(key, "_ref", "_block").applyInPandasWithState(
        collect,
        f"`{key}` {kind}, chunk long, n long, ctx_start long, ctx_end long, is_final boolean, tokens array<long>",
        "total long, chunk long, seen long, seqs array<long>, held array<long>",
        "append",
        GroupStateTimeout.ProcessingTimeTimeout if forget_after_s else GroupStateTimeout.NoTimeout,
    )
