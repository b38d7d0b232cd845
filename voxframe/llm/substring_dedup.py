"""Substring dedup by content-defined chunks.

A gear hash rolls over the UTF-8 bytes of a text (each step shifts it left and adds a random number for the byte; here
its last 32 bytes are summed by doubling). A chunk ends after a white-space byte whose mixed hash is the largest of all
white-space bytes within REACH on either side, so a boundary hangs on the bytes around it alone: after an insertion the
very next boundaries fall as before. Inside stretches of STRETCH bytes or more without ASCII white space (Chinese or
Japanese, encoded data) every character may end a chunk in the same way; only runs that repeat within REACH bytes, where
no hash is the largest, are cut into blocks of LARGEST. Chunks are told apart by digest and length; the first of equal chunks stays, and
later copies go where consecutive ones add up to MIN_BYTES or more, so that single chance repeats are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from voxframe.llm.common import stored
from voxframe.llm.shingles import mixed

REACH, WINDOW, LARGEST = 24, 32, 1024
MIN_BYTES = 96
#: From so many bytes on without white space the ends of characters are looked at.
STRETCH = 96
GEAR = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def rolled(data: np.ndarray) -> np.ndarray:
    """The gear hash of the last WINDOW bytes at each byte."""
    h, k = GEAR[data], 1
    while k < WINDOW:
        ahead = h.copy()
        ahead[k:] += h[:-k] << np.uint64(k)
        h, k = ahead, 2 * k
    return h


def _largest(at: np.ndarray, value: np.ndarray, first: bool) -> np.ndarray:
    """Of the places ``at``, those whose value is the largest within REACH; of equal ones the ``first``, or none."""
    top = np.ones(len(at), bool)
    for k in range(1, len(at)):
        near = at[k:] - at[:-k] <= REACH
        if not near.any():
            break
        top[:-k] &= ~near | (value[:-k] > value[k:]) | (first & (value[:-k] == value[k:]))
        top[k:] &= ~near | (value[k:] > value[:-k])
    return at[top]


def _without_space(b: np.ndarray, space: np.ndarray) -> np.ndarray:
    """The last bytes of characters in long stretches, where a whole window of the hash lies in the stretch."""
    edges = np.concatenate([[-1], space, [len(b)]])
    long = np.flatnonzero(np.diff(edges) > STRETCH)
    if not len(long):
        return np.empty(0, np.int64)
    at = np.concatenate([np.arange(edges[i] + WINDOW, edges[i + 1] - 1) for i in long])
    return at[b[at + 1] & 0xC0 != 0x80]


def chunk_ends(data: bytes) -> np.ndarray:
    """Where the chunks of a text end, in bytes; the last end is that of the text."""
    if not data:
        return np.empty(0, np.int64)
    b = np.frombuffer(data, np.uint8)
    space = np.flatnonzero(_SPACE[b])
    inside = _without_space(b, space)
    hashes = rolled(b)
    tops = _largest(space, mixed(hashes[space]), True)
    if len(inside):
        tops = np.sort(np.concatenate([tops, _largest(inside, mixed(hashes[inside]), False)]))
    ends = tops + 1
    ends = ends[ends < len(b)]
    ends = np.append(ends, len(b))
    begins = np.concatenate([[0], ends[:-1]])
    wide = np.flatnonzero(ends - begins > LARGEST)
    if len(wide):
        forced = np.concatenate([np.arange(begins[i] + LARGEST, ends[i], LARGEST) for i in wide])
        for i, cut in enumerate(forced):
            while cut < len(b) and b[cut] & 0xC0 == 0x80:  # not inside a character
                cut += 1
            forced[i] = cut
        ends = np.unique(np.concatenate([ends, forced]))
    return ends


def _chunked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    digest = xxhash.xxh3_64_intdigest
    for frame in frames:
        for part in np.array_split(np.arange(len(frame)), max(1, int(frame["text"].str.len().sum() // 4_000_000))):
            rows = frame.iloc[part]
            data = [t.encode("utf-8", "surrogatepass") for t in rows["text"]]
            ends = [chunk_ends(d) for d in data]
            begins = [np.concatenate([[0], e[:-1]]).astype(np.int64) if len(e) else e for e in ends]
            many = [len(e) for e in ends]
            keys = np.fromiter((digest(d[x:y]) for d, b, e in zip(data, begins, ends) for x, y in zip(b, e)), np.uint64, sum(many))
            yield pd.DataFrame(
                {
                    "doc_id": rows["doc_id"].repeat(many),
                    "form": rows["form"].repeat(many),
                    "start": np.concatenate(begins).astype(np.int32) if many else [],
                    "size": np.concatenate([e - b for b, e in zip(begins, ends)]).astype(np.int32) if many else [],
                    "digest": keys.view(np.int64),
                }
            )


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, form, start, size, digest) of every chunk; ``form`` tells apart texts under one doc_id."""
    kind = dict(docs.dtypes)["doc_id"]
    whole = docs.where(F.length("text") > 0).select("doc_id", F.hash("text").alias("form"), "text")
    return whole.mapInPandas(_chunked, f"doc_id {kind}, form int, start int, size int, digest bigint")


def repeated_spans(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(doc_id, form, start, stop, first_doc_ids): the spans of bytes that are later copies, one row each.

    The first of equal chunks, in order of (doc_id, text, place), is none of them; ``first_doc_ids`` are the documents
    that hold the first ones of a span. ``docs`` has doc_id and text; other columns are ignored. Null and empty texts
    have no chunks; rows equal in doc_id and text are one document; rows without doc_id come first in order. An empty
    table gives no spans. One text that repeats itself counts like several that repeat each other.
    """
    every = stored(chunks(docs.select("doc_id", "text")), "chunks")
    place = F.struct("doc_id", "form", "start")
    firsts = (
        every.groupBy("digest", "size")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where(~F.col("first").eqNullSafe(F.col("last")))
        .select("digest", "size", "first")
    )
    later = (
        every.join(firsts, ["digest", "size"])
        .where(~place.eqNullSafe(F.col("first")))
        .select("doc_id", "form", "start", (F.col("start") + F.col("size")).alias("stop"), F.col("first.doc_id").alias("first_doc_id"))
        .distinct()
    )
    within = Window.partitionBy("doc_id", "form").orderBy("start")
    fresh = F.when(F.lag("stop").over(within) == F.col("start"), 0).otherwise(1)
    return (
        later.withColumn("fresh", fresh)
        .withColumn("run", F.sum("fresh").over(within))
        .groupBy("doc_id", "form", "run")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.array_sort(F.collect_set("first_doc_id")).alias("first_doc_ids"))
        .where(F.col("stop") - F.col("start") >= min_bytes)
        .drop("run")
    )


def _without(data: bytes, spans: list) -> str:
    kept, at = [], 0
    for start, stop in sorted((s["start"], s["stop"]) for s in spans):
        kept.append(data[at:start])
        at = stop
    return b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass")


@F.pandas_udf(StringType())
def _cut(text: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([_without(t.encode("utf-8", "surrogatepass"), s) for t, s in zip(text, spans)], dtype=object)


def spans_by_document(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(doc_id, form, spans, removed_bytes, first_doc_ids) of the texts that hold later copies."""
    return (
        repeated_spans(docs, min_bytes)
        .groupBy("doc_id", "form")
        .agg(
            F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"),
            F.sum(F.col("stop") - F.col("start")).alias("removed_bytes"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("first_doc_ids")))).alias("first_doc_ids"),
        )
    )


def dedup_substrings(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``docs`` with all their columns, later copies cut out of the texts; other texts, null ones too, stay as they are."""
    found = stored(spans_by_document(docs, min_bytes), "spans").select(
        F.col("doc_id").alias("_doc_id of spans"), F.col("form").alias("_form of spans"), F.col("spans").alias("_spans of spans")
    )
    same = docs["doc_id"].eqNullSafe(found["_doc_id of spans"]) & (F.hash(docs["text"]) == found["_form of spans"])
    cut = docs.join(found, same, "left")
    hit = F.col("_spans of spans").isNotNull()
    # rows without spans do not cross to Python
    done = cut.where(hit).withColumn("text", _cut("text", "_spans of spans"))
    return cut.where(~hit).unionByName(done).select(*[F.col(f"`{c}`") for c in docs.columns])
