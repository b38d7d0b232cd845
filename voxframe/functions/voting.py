"""Choice of a vote reference, slots of aligned words, and the vote at each position."""

from __future__ import annotations

import difflib
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.functions.text import n_words


def _alignment(ref: list[str], tgt: list[str]) -> list[int | None]:
    """Reference position of each target word."""
    if ref == tgt:
        return list(range(len(ref)))
    places: list[int | None] = [None] * len(tgt)
    if not ref:
        return places
    for kind, r0, r1, t0, t1 in difflib.SequenceMatcher(None, ref, tgt).get_opcodes():
        if kind == "insert":
            places[t0:t1] = [min(r0, len(ref) - 1)] * (t1 - t0)
        else:
            # an equal run has as many places as words; a replaced one may run out of places
            places[t0:t1] = [min(r0 + k, r1 - 1) for k in range(t1 - t0)]
    return places


def _slots(ref: list[str], tgt: list[str], compat: bool) -> list[str | None]:
    """The word a target puts at each position of the vote."""
    places = _alignment(ref, tgt)
    if compat:
        return [tgt[p] if p is not None and p < len(tgt) else None for p in places]
    slots: list[str | None] = [None] * len(ref)
    for word, place in zip(tgt, places):
        # the reference's own word beats one that was only put nearby, else the first one counts
        if slots[place] is None or (word == ref[place] and slots[place] != word):
            slots[place] = word
    return slots


# Rows whose words are Python objects at a time.
LOT = 256


def _pairwise(ref: pa.Array, tgt: pa.Array, work: Callable[[list[str], list[str]], list], kind: pa.DataType) -> pa.Array:
    """``work`` on the words of each pair, null where a side is; words are taken out of the batch in lots."""
    made = [
        pa.array([None if a is None or b is None else work(a, b) for a, b in zip(ref.slice(at, LOT).to_pylist(), tgt.slice(at, LOT).to_pylist())], type=kind)
        for at in range(0, len(ref), LOT)
    ]
    return pa.concat_arrays(made) if made else pa.array([], type=kind)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def align_to_reference(ref: pa.Array, tgt: pa.Array) -> pa.Array:
    """Reference position of each target word, null where it has none; case counts."""
    return _pairwise(ref, tgt, _alignment, pa.list_(pa.int32()))


def aligned_slots(ref: Column, tgt: Column, compat: bool = False) -> Column:
    """Words of a target by reference position.

    ``compat`` reads the positions the other way round: slot ``p`` holds the target word whose
    number is the reference position of target word ``p``.
    """

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def slots(a: pa.Array, b: pa.Array) -> pa.Array:
        return _pairwise(a, b, lambda x, y: _slots(x, y, compat), pa.list_(pa.string()))

    return slots(ref, tgt)


def longest_first(texts: Column) -> Column:
    """Place (from 0) of the text with most words in an array; the first one on ties."""
    sizes = F.transform(texts, n_words)
    return F.array_position(sizes, F.array_max(sizes)) - 1


def vote(slots: list[Column]) -> Column:
    """Most frequent lower-cased word at each position over the slot arrays, in their order.

    Null slots abstain; on ties the word of the first system in order wins; positions without any
    word are left out.
    """
    length = reduce(F.greatest, [F.coalesce(F.size(s), F.lit(0)) for s in slots])

    def winner(pos: Column) -> Column:
        said = F.filter(F.array(*[F.lower(F.get(s, pos)) for s in slots]), lambda w: w.isNotNull())
        ballots = F.transform(
            said,
            lambda w, i: F.struct(F.size(F.filter(said, lambda x: x == w)).alias("n"), (-i).alias("rank"), w.alias("w")),
        )
        return F.array_max(ballots)["w"]

    places = F.when(length > 0, F.sequence(F.lit(0), length - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(places, winner), lambda w: w.isNotNull())
