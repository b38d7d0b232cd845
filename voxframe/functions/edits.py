"""Edit distance between token lists, as small helpers for Arrow batches.

The distance runs on bit vectors: a column of the table is held as the steps up and down between
its cells, one bit each. A pair costs ``len(a) * len(b) / 64`` word operations rather than one step
per cell. ``distance`` holds a column in one Python integer; ``distances`` puts the columns of many
short texts side by side in numpy words.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Hashable, Sequence

import numpy as np


def _common_start(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _common_end(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Length of the longest common suffix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[len(a) - middle : len(a) - low] == b[len(b) - middle : len(b) - low]:
            low = middle
        else:
            high = middle - 1
    return low


def _positions(tokens: Sequence[Hashable]) -> dict[Hashable, int]:
    masks: dict[Hashable, int] = {}
    bit = 1
    for token in tokens:
        masks[token] = masks.get(token, 0) | bit
        bit <<= 1
    return masks


def distance(ref: Sequence[Hashable], hyp: Sequence[Hashable]) -> int:
    """Levenshtein distance."""
    same = _common_start(ref, hyp)
    ref, hyp = ref[same:], hyp[same:]
    same = _common_end(ref, hyp)
    ref, hyp = ref[: len(ref) - same], hyp[: len(hyp) - same]
    if len(ref) < len(hyp):
        # one step per token of the shorter side, one bit per token of the longer one
        ref, hyp = hyp, ref
    masks = _positions(ref)
    every = (1 << len(ref)) - 1
    up, down = every, 0
    for token in hyp:
        same = masks.get(token, 0)
        level = (((same & up) + up) ^ up) | same | down
        right = ((down | ~(level | up)) << 1) | 1
        up = (((level & up) << 1) | ~(level | right)) & every
        down = right & level
    return len(hyp) + up.bit_count() - (down & every).bit_count()


# Texts up to this length go side by side, where there are enough of similar length and as many as
# make about this many words of 64 bits; the table of sign positions is kept below this many words.
SIDE_BY_SIDE_LENGTH = 2048
SIDE_BY_SIDE_LEAST = 256
SIDE_BY_SIDE_WORDS = 16384
TABLE_WORDS = 4_000_000


def distances(pairs: Sequence[tuple[str, str]]) -> list[int]:
    """Levenshtein distance of each pair of texts."""
    out = [0] * len(pairs)
    short = []
    for i, (a, b) in enumerate(pairs):
        same = _common_start(a, b)
        a, b = a[same:], b[same:]
        same = _common_end(a, b)
        a, b = sorted((a[: len(a) - same], b[: len(b) - same]), key=len, reverse=True)
        if not b:
            out[i] = len(a)
        elif len(a) > SIDE_BY_SIDE_LENGTH:
            out[i] = distance(a, b)
        else:
            short.append((a, b, i))
    short.sort(key=lambda p: len(p[0]))
    while short:
        longest = len(short[-1][0])
        first = bisect_left(short, longest * 3 // 4, key=lambda p: len(p[0]))
        group = short[max(first, len(short) - max(1, SIDE_BY_SIDE_WORDS // -(-longest // 64))) :]
        del short[-len(group) :]
        plain = len(group) < SIDE_BY_SIDE_LEAST
        found = [distance(a, b) for a, b, _ in group] if plain else _side_by_side([p[:2] for p in group])
        for (_, _, i), d in zip(group, found):
            out[i] = d
    return out


def _shift(words: np.ndarray) -> None:
    """All columns one bit up, across their words."""
    out = words[:-1] >> np.uint64(63)
    words <<= np.uint64(1)
    words[1:] |= out


def _side_by_side(pairs: list[tuple[str, str]]) -> list[int]:
    """Distances of non-empty texts, the longer one of each pair first."""
    n = len(pairs)
    long, short = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    width = -(-int(long.max()) // 64)
    text = np.frombuffer("".join(a + b for a, b in pairs).encode("utf-32-le", "surrogatepass"), np.uint32)
    signs, codes = np.unique(text, return_inverse=True)
    if n > 1 and width * (len(signs) + 1) * n > TABLE_WORDS:
        return _side_by_side(pairs[: n // 2]) + _side_by_side(pairs[n // 2 :])
    starts = np.cumsum(long + short) - (long + short)

    def cells(lengths: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pair, position and sign of every character of one side."""
        pair = np.repeat(np.arange(n), lengths)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return pair, at, codes[np.repeat(first, lengths) + at]

    # words x (sign, pair): where the longer text has a sign; the last sign is none
    table = np.zeros((width, (len(signs) + 1) * n), np.uint64)
    pair, at, sign = cells(long, starts)
    np.bitwise_or.at(table, (at // 64, sign * n + pair), np.uint64(1) << (at % 64).astype(np.uint64))
    steps = np.full((int(short.max()), n), len(signs) * n + np.arange(n))
    pair, at, sign = cells(short, starts + long)
    steps[at, pair] = sign * n + pair

    bits = np.clip(long - 64 * np.arange(width)[:, None], 0, 64)
    every = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << (bits % 64).astype(np.uint64)) - np.uint64(1))
    up, down = every.copy(), np.zeros_like(every)
    same, level, right = (np.empty_like(every) for _ in range(3))
    carry = np.empty(every.shape, bool)
    out = np.zeros(n, np.int64)
    ends = {int(length): np.flatnonzero(short == length) for length in np.unique(short)}
    for done, step in enumerate(steps, 1):
        np.take(table, step, axis=1, out=same)
        np.bitwise_and(same, up, out=level)
        level += up
        np.less(level, up, out=carry)
        for w in range(1, width):
            level[w] += carry[w - 1]
            carry[w] |= carry[w - 1] & (level[w] == 0)
        level ^= up
        level |= same
        level |= down
        np.bitwise_or(level, up, out=right)
        np.invert(right, out=right)
        right |= down
        _shift(right)
        right[0] |= np.uint64(1)
        up &= level
        _shift(up)
        np.bitwise_or(level, right, out=same)
        np.invert(same, out=same)
        up |= same
        up &= every
        np.bitwise_and(right, level, out=down)
        if done in ends:
            ended = ends[done]
            rises = np.bitwise_count(up[:, ended]).sum(0, dtype=np.int64)
            falls = np.bitwise_count(down[:, ended] & every[:, ended]).sum(0, dtype=np.int64)
            out[ended] = done + rises - falls
    return out.tolist()


def _advance(masks: dict, every: int, up: int, down: int, token: Hashable) -> tuple[int, int, int, int]:
    """Next column of the table: steps down (+1/-1) and steps right (+1/-1) as bit vectors."""
    same = masks.get(token, 0)
    kept = same | down
    diagonal = (((same & up) + up) ^ up) | same
    more = down | (every & ~(diagonal | up))
    less = up & diagonal
    right = (more << 1) | 1
    return ((less << 1) | ~(kept | right)) & every, right & kept & every, more, less


# Columns whose vectors are held at once; earlier ones are computed again when the way back needs them.
BLOCK = 2048


def edit_counts(
    ref: Sequence[Hashable], hyp: Sequence[Hashable], compat: bool = False
) -> tuple[int, int, int, int]:
    """Distance, substitutions, deletions and insertions of one best alignment.

    Equal tokens are always paired; among equally good steps a substitution comes before a
    deletion and that before an insertion, seen from the end. With ``compat`` a run of deletions
    or insertions at the start counts once, and an alignment that starts with neither counts one
    extra insertion.
    """
    # equal tokens at the end are paired in any case
    same = _common_end(ref, hyp)
    i, j = len(ref) - same, len(hyp) - same
    masks = _positions(ref[:i])
    every = (1 << i) - 1

    starts = [(every, 0)]
    up, down = starts[0]
    for at in range(BLOCK, j, BLOCK):
        for token in hyp[at - BLOCK : at]:
            up, down, _, _ = _advance(masks, every, up, down, token)
        starts.append((up, down))

    subs = dels = ins = 0
    for block in range(len(starts) - 1, -1, -1):
        first = block * BLOCK
        columns = [(*starts[block], 0, 0)]
        for token in hyp[first:j]:
            columns.append(_advance(masks, every, *columns[-1][:2], token))
        while i and j > first:
            if ref[i - 1] == hyp[j - 1]:
                i, j = i - 1, j - 1
                continue
            bit = i - 1
            here, left = columns[j - first], columns[j - first - 1]
            right_step = ((here[2] >> bit) & 1) - ((here[3] >> bit) & 1)
            down_step = ((left[0] >> bit) & 1) - ((left[1] >> bit) & 1)
            if right_step + down_step == 1:
                subs, i, j = subs + 1, i - 1, j - 1
            elif (here[0] >> bit) & 1:
                dels, i = dels + 1, i - 1
            else:
                ins, j = ins + 1, j - 1
        if not i:
            break
    total = subs + dels + i + ins + j
    if not compat:
        return total, subs, dels + i, ins + j
    return total, subs, dels + (1 if i else 0), ins + (0 if i else 1)


# Bytes of the vectors that one group of pairs keeps for the way back; a longer pair takes ``edit_counts``.
GROUP_BYTES = 64_000_000


def _cost(ref: np.ndarray, hyp: np.ndarray) -> np.ndarray:
    """Bytes of the four vectors of every column."""
    return 32 * (hyp + 1) * -(-ref // 64)


def edit_counts_of(
    ref: np.ndarray, ref_ends: np.ndarray, hyp: np.ndarray, hyp_ends: np.ndarray, compat: bool = False
) -> np.ndarray:
    """``edit_counts`` of many pairs side by side, one row per pair.

    The tokens of all references stand one after the other as numbers, those of all hypotheses too; ``*_ends`` holds
    where each begins and the last ends. Columns and way back advance one step for all pairs of a group at a time.
    """
    n = len(ref_ends) - 1
    m, k = np.diff(ref_ends), np.diff(hyp_ends)
    out = np.zeros((n, 4), np.int64)
    # pairs without differences, and those with an empty side, need no table
    out[:, 0] = np.maximum(m, k)
    out[:, 2], out[:, 3] = np.where(k == 0, m, 0), np.where(m == 0, k, 0)
    alike = np.flatnonzero((m == k) & (m > 0))
    at, place = _spread(m[alike])
    differ = np.bincount(at, ref[ref_ends[alike][at] + place] != hyp[hyp_ends[alike][at] + place], len(alike)) if len(alike) else np.zeros(0)
    alike = alike[differ == 0]
    out[alike, 0] = 0
    if compat:
        plain = (m == 0) | (k == 0)
        plain[alike] = True
        out[plain, 2] = (m > 0)[plain] & (k == 0)[plain]
        out[plain, 3] = 1 - out[plain, 2]
    left = np.setdiff1d(np.flatnonzero((m > 0) & (k > 0)), alike)
    cost = _cost(m[left], k[left])
    for p in left[cost > GROUP_BYTES].tolist():
        out[p] = edit_counts(ref[ref_ends[p] : ref_ends[p + 1]].tolist(), hyp[hyp_ends[p] : hyp_ends[p + 1]].tolist(), compat)
    left = left[cost <= GROUP_BYTES]
    left = left[np.lexsort((m[left], k[left]))]
    while len(left):
        # the longest first; a group is padded to its longest sides
        longest = _cost(np.maximum.accumulate(m[left[::-1]]), np.full(len(left), k[left[-1]]))
        size = int(np.searchsorted(longest * np.arange(1, len(left) + 1), GROUP_BYTES, "right"))
        similar = int((k[left] * 2 >= k[left[-1]]).sum())
        size = max(1, min(size, similar))
        group, left = left[len(left) - size :], left[: len(left) - size]
        out[group] = _counts_side_by_side(ref, ref_ends, hyp, hyp_ends, group, compat)
    return out


def _spread(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists of these lengths one after the other: the list of each element and its place there."""
    at = np.repeat(np.arange(len(lengths)), lengths)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _counts_side_by_side(
    ref: np.ndarray, ref_ends: np.ndarray, hyp: np.ndarray, hyp_ends: np.ndarray, group: np.ndarray, compat: bool
) -> np.ndarray:
    n = len(group)
    m, k = (ends[group + 1] - ends[group] for ends in (ref_ends, hyp_ends))
    width, steps = -(-int(m.max()) // 64), int(k.max())
    r_pair, r_at = _spread(m)
    h_pair, h_at = _spread(k)
    said, heard = np.full((n, int(m.max())), -1, np.int64), np.full((n, steps), -2, np.int64)
    said[r_pair, r_at] = ref[ref_ends[group][r_pair] + r_at]
    heard[h_pair, h_at] = hyp[hyp_ends[group][h_pair] + h_at]

    # where each pair's reference has a token: a column per (pair, token), and one for tokens it has nowhere
    span = max(int(said.max()), int(heard.max())) + 1
    keys, column = np.unique(r_pair * span + said[r_pair, r_at], return_inverse=True)
    table = np.zeros((width, len(keys) + 1), np.uint64)
    np.bitwise_or.at(table, (r_at // 64, column), np.uint64(1) << (r_at % 64).astype(np.uint64))
    wanted = h_pair * span + heard[h_pair, h_at]
    found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    look = np.full((steps, n), len(keys))
    look[h_at, h_pair] = np.where(keys[found] == wanted, found, len(keys))

    bits = np.clip(m - 64 * np.arange(width)[:, None], 0, 64)
    every = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << (bits % 64).astype(np.uint64)) - np.uint64(1))
    # steps down within a column, and from it to the one on its right
    up, down, more, less = (np.zeros((steps + 1, width, n), np.uint64) for _ in range(4))
    up[0] = every
    for j in range(1, steps + 1):
        same, u, d = table[:, look[j - 1]], up[j - 1], down[j - 1]
        level = same & u
        level += u
        carry = level < u
        for w in range(1, width):
            level[w] += carry[w - 1]
            carry[w] |= carry[w - 1] & (level[w] == 0)
        level ^= u
        level |= same
        np.bitwise_and(u, level, out=less[j])
        level |= u
        np.invert(level, out=level)
        level &= every
        np.bitwise_or(level, d, out=more[j])
        right, fall = more[j].copy(), less[j].copy()
        _shift(right)
        right[0] |= np.uint64(1)
        _shift(fall)
        same |= d
        np.bitwise_and(right, same, out=down[j])
        down[j] &= every
        same |= right
        np.invert(same, out=same)
        same |= fall
        np.bitwise_and(same, every, out=up[j])

    counts = np.zeros((n, 3), np.int64)  # substitutions, deletions, insertions
    i, j, live = m.copy(), k.copy(), np.arange(n)
    one = np.uint64(1)
    while len(live):
        row, col = i[live] - 1, j[live]
        equal = said[live, row] == heard[live, col - 1]
        p, row, col = live[~equal], row[~equal], col[~equal]
        word, bit = row // 64, (row % 64).astype(np.uint64)
        at = lambda vectors, c: ((vectors[c, word, p] >> bit) & one).astype(np.int8)
        rise = at(more, col) - at(less, col) + at(up, col - 1) - at(down, col - 1)
        kind = np.where(rise == 1, 0, np.where(at(up, col) == 1, 1, 2))
        counts[p, kind] += 1
        i[p] -= kind != 2
        j[p] -= kind != 1
        even = live[equal]
        i[even] -= 1
        j[even] -= 1
        live = live[(i[live] > 0) & (j[live] > 0)]
    subs, dels, ins = counts.T
    total = subs + dels + i + ins + j
    if compat:
        return np.stack([total, subs, dels + (i > 0), ins + (i == 0)], 1)
    return np.stack([total, subs, dels + i, ins + j], 1)
