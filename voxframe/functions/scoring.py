"""Word and character error rates as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.functions.edits import distance, distances, edit_counts_of
from voxframe.functions.text import WS, strip_ws, words

EDIT_FIELDS = ("distance", "substitutions", "deletions", "insertions")
PAIR_FIELDS = (*EDIT_FIELDS, "ref_words", "hyp_words", "char_distance")


def _spark_type(names: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(n, T.IntegerType()) for n in names])


def _rows(columns: dict[str, np.ndarray], known: np.ndarray, fields: dict[str, np.ndarray] | None = None) -> pa.Array:
    """Structs of whole numbers, null where not ``known``; ``fields`` says where single fields are known."""
    masks = fields or {}
    values = [pa.array(v.astype(np.int32), mask=~masks[n] if n in masks else None) for n, v in columns.items()]
    return pa.StructArray.from_arrays(values, list(columns), mask=pa.array(~known))


def _words(texts: pa.Array) -> pa.ListArray:
    """The words of each text between white space; none of a null text."""
    parts = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    lengths, flat = pc.list_value_length(parts).to_numpy(zero_copy_only=False), parts.flatten()
    kept = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    held = np.bincount(np.repeat(np.arange(len(texts)), lengths)[kept], minlength=len(texts))
    ends = np.concatenate([[0], np.cumsum(held)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), flat.filter(pa.array(kept)))


def _edits(ref: pa.ListArray, hyp: pa.ListArray, compat: bool) -> np.ndarray:
    """Distance, substitutions, deletions and insertions of pairs of token lists without nulls."""
    ends = [np.concatenate([[0], np.cumsum(pc.list_value_length(x).to_numpy(zero_copy_only=False))]).astype(np.int64) for x in (ref, hyp)]
    tokens = pa.concat_arrays([ref.flatten(), hyp.flatten()]).dictionary_encode(null_encoding="encode").indices
    numbers = tokens.to_numpy(zero_copy_only=False).astype(np.int64)
    return edit_counts_of(numbers[: ends[0][-1]], ends[0], numbers[ends[0][-1] :], ends[1], compat)


def edit_ops(ref: Column, hyp: Column, compat: bool = False) -> Column:
    """Distance and S/D/I counts between two arrays of tokens; null where either is null."""

    @F.arrow_udf(_spark_type(EDIT_FIELDS))
    def counts(a: pa.Array, b: pa.Array) -> pa.Array:
        known = pc.and_(a.is_valid(), b.is_valid())
        both = known.to_numpy(zero_copy_only=False)
        found = np.zeros((len(a), len(EDIT_FIELDS)), np.int64)
        found[both] = _edits(a.filter(known), b.filter(known), compat)
        return _rows(dict(zip(EDIT_FIELDS, found.T)), both)

    return counts(ref, hyp)


def pair_edits(ref: Column, hyp: Column, compat: bool = False) -> Column:
    """Word edits, word counts and character distance of two texts in one pass over the pair.

    Without a hypothesis only the reference's words are known.
    """

    @F.arrow_udf(_spark_type(PAIR_FIELDS))
    def counts(a: pa.Array, b: pa.Array) -> pa.Array:
        said, heard = _words(a), _words(b)
        known, paired = (x.to_numpy(zero_copy_only=False) for x in (a.is_valid(), pc.and_(a.is_valid(), b.is_valid())))
        found = np.zeros((len(a), len(EDIT_FIELDS)), np.int64)
        found[paired] = _edits(said.filter(pa.array(paired)), heard.filter(pa.array(paired)), compat)
        chars = np.array([d or 0 for d in _char_distances(a.to_pylist(), b.to_pylist())], np.int64)
        lengths = [pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in (said, heard)]
        columns = {**dict(zip(EDIT_FIELDS, found.T)), "ref_words": lengths[0], "hyp_words": lengths[1], "char_distance": chars}
        return _rows(columns, known, {n: paired for n in PAIR_FIELDS if n != "ref_words"})

    return counts(ref, hyp)


def _char_distances(ref: list[str | None], hyp: list[str | None]) -> list[int | None]:
    """Character distances without spaces; none where a side is missing."""
    known = [i for i, (x, y) in enumerate(zip(ref, hyp)) if x is not None and y is not None]
    out: list[int | None] = [None] * len(ref)
    found = distances([(ref[i].replace(" ", ""), hyp[i].replace(" ", "")) for i in known])
    for i, d in zip(known, found):
        out[i] = d
    return out


@F.arrow_udf(T.IntegerType())
def char_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Character edit distance of two texts, spaces left out."""
    return pa.array(_char_distances(a.to_pylist(), b.to_pylist()), type=pa.int32())


@F.arrow_udf(T.DoubleType())
def word_error_rate(a: pa.Array, b: pa.Array) -> pa.Array:
    """Edit distance of two arrays of words over the length of the first; null where that is 0."""
    return pa.array(
        [distance(x, y) / len(x) if x and y is not None else None for x, y in zip(a.to_pylist(), b.to_pylist())],
        type=pa.float64(),
    )


def rate(count: Column, total: Column) -> Column:
    """``count / total``; 0 where the total is 0."""
    return F.coalesce(count / F.nullif(total, F.lit(0)), F.lit(0.0))


def wer_stats(ref: Column, hyp: Column, edits: Column, compat: bool = False) -> Column:
    """Word statistics of a pair from its ``pair_edits``; blank sides score 1.

    ``compat`` leaves the deletions of a blank hypothesis uncounted.
    """
    n_ref = edits["ref_words"]
    blank_ref, blank_hyp = ref == "", hyp == ""
    uncounted = F.lit(0) if compat else n_ref
    return F.struct(
        F.when(blank_ref, 0).when(blank_hyp, n_ref).otherwise(edits["distance"]).alias("distance"),
        F.when(blank_ref, 0).otherwise(n_ref).alias("ref_words"),
        F.when(blank_ref, 0).otherwise(edits["hyp_words"]).alias("hyp_words"),
        F.when(blank_ref | blank_hyp, 0).otherwise(edits["substitutions"]).alias("substitutions"),
        F.when(blank_ref, 0).when(blank_hyp, uncounted).otherwise(edits["deletions"]).alias("deletions"),
        F.when(blank_ref | blank_hyp, 0).otherwise(edits["insertions"]).alias("insertions"),
        F.when(blank_ref | blank_hyp | (n_ref == 0), 1.0).otherwise(edits["distance"] / n_ref).alias("wer"),
    )


def cer_stats(ref: Column, hyp: Column, chars: Column) -> Column:
    """Character statistics of a pair; spaces do not count, except in the length a blank side reports."""
    n_ref = F.length(F.replace(ref, F.lit(" "), F.lit("")))
    n_hyp = F.length(F.replace(hyp, F.lit(" "), F.lit("")))
    blank_ref, blank_hyp = ref == "", hyp == ""
    return F.struct(
        F.when(blank_ref, 0).when(blank_hyp, F.length(ref)).otherwise(chars).alias("distance"),
        F.when(blank_ref, 0).when(blank_hyp, F.length(ref)).otherwise(n_ref).alias("ref_chars"),
        F.when(blank_ref | blank_hyp, 0).otherwise(n_hyp).alias("hyp_chars"),
        F.when(blank_ref | blank_hyp | (n_ref == 0), 1.0).otherwise(chars / n_ref).alias("cer"),
    )


def _raw_words(c: Column, compat: bool) -> Column:
    """Words of an un-normalised text; with ``compat`` a lone line break or tab is part of a word."""
    if not compat:
        return words(c)
    return F.filter(F.split(F.regexp_replace(c, f"{WS}{{2,}}", " "), " "), lambda w: w != "")


def wer_raw(ref: Column, hyp: Column, compat: bool = False) -> Column:
    """WER of stripped, un-normalised texts; null where the reference has no words."""
    return word_error_rate(*(_raw_words(strip_ws(c), compat) for c in (ref, hyp)))


def wer_raw_status(ref: Column) -> Column:
    return F.when(strip_ws(ref) != "", F.lit("scored")).otherwise(F.lit("empty_ref"))
