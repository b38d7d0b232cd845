"""Fingerprints of documents by a randomised embedding of edit distance.

A walk goes through the characters of a text: at step j it notes the character under it and moves on by one or stays,
as a random table shared by all texts says for j and that character. Texts that differ by few edits fall back into
step, so their notes agree at most steps: edit distance becomes Hamming distance. The walk covers the whole text, about
two steps a character. The fingerprint samples the notes at fixed steps, equally many in each octave of steps, so that
short and long texts are covered alike, and keeps four bits of each note, as hexadecimal digits.

Likeness is the share of agreeing samples, each weighted by the steps it stands for. Groups of samples of one octave make
bands: texts that agree on a band are candidates, which likeness then confirms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import stored
from voxframe.llm.components import components
from voxframe.llm.shingles import mixed

SAMPLES, BAND, PERIOD = 64, 8, 4096
_PAD = 255
#: Texts left in a lot from which on each one is walked on its own.
_ALONE = 100
_LOT = 1 << 22
_DIGITS = np.frombuffer(b"0123456789abcdef.", np.uint8)


def _table(seed: int = 5) -> np.ndarray:
    """Whether the walk moves on, by step (modulo PERIOD) and class of character; at the end of a text it stays."""
    moves = np.random.default_rng(seed).integers(0, 2, (PERIOD, 256), dtype=np.uint8)
    moves[:, _PAD] = 0
    return moves


def _sign_of_class() -> np.ndarray:
    signs = (mixed(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(60)).astype(np.uint8)
    signs[_PAD] = 16
    return signs


def sampled_steps(octaves: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """The steps whose notes are kept, and how many steps each stands for."""
    steps, weights = [], []
    for k in range(octaves):
        size = 1 << k
        n = min(size, SAMPLES)
        jitter = (mixed(np.arange(n, dtype=np.uint64) + np.uint64(k << 32)) >> np.uint64(11)) / 2.0**53 if size > n else np.zeros(n)
        steps.append(size - 1 + ((np.arange(n) + jitter) * (size / n)).astype(np.int64))
        weights.append(np.full(n, size / n))
    return np.concatenate(steps), np.concatenate(weights)


_STEPS, _WEIGHTS = sampled_steps()


def _classes(text: str) -> bytes:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return (((codes * np.uint32(0x9E3779B1)) >> np.uint32(16)) % np.uint32(_PAD)).astype(np.uint8).tobytes()


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprint of each text; of the empty one the empty string."""
    moves, signs = _table(), _sign_of_class()
    classes = [_classes(t) for t in texts]
    data = np.frombuffer(b"".join(c + b"\xff" for c in classes), np.uint8)
    sizes = np.fromiter(map(len, classes), np.int64, len(classes))
    ends = np.cumsum(sizes + 1) - 1
    steps = _STEPS
    left, at = np.arange(len(texts)), (ends - sizes).astype(np.int32)
    rows_of_moves = moves.astype(np.int32)
    under, move = np.empty(len(at), np.uint8), np.empty(len(at), np.int32)
    notes: list[np.ndarray] = []  # per sample, of the texts still left
    who: list[np.ndarray] = []
    j = s = 0
    while len(left) > _ALONE:
        stop = int(steps[s])
        while j < stop:
            np.take(data, at, out=under, mode="clip")
            np.take(rows_of_moves[j % PERIOD], under, out=move, mode="clip")
            np.add(at, move, out=at)
            j += 1
        notes.append(data[at])
        who.append(left)
        s += 1
        going = at < ends[left]
        if not going.all():
            left, at = left[going], at[going]
            under, move = np.empty(len(at), np.uint8), np.empty(len(at), np.int32)
    table = moves.tobytes()
    alone: dict[int, bytes] = {}
    for i, place in zip(left.tolist(), at.tolist()):
        alone[i] = _walk(classes[i] + b"\xff", place - int(ends[i] - sizes[i]), j, s, steps, table)
    rows = np.full((len(texts), len(notes)), _PAD, np.uint8)
    for k, (note, of) in enumerate(zip(notes, who)):
        rows[of, k] = note
    out = []
    for i in range(len(texts)):
        note = np.concatenate([rows[i], np.frombuffer(alone[i], np.uint8)]) if i in alone else rows[i]
        out.append(_DIGITS[signs[note]].tobytes().decode().rstrip("."))
    return out


def _walk(data: bytes, at: int, j: int, s: int, steps: np.ndarray, table: bytes) -> bytes:
    """Notes of one text from sample ``s`` on, to its end."""
    end, kept = len(data) - 1, bytearray()
    while at < end:
        stop = int(steps[s])
        while j < stop:
            upto = min(stop, j - j % PERIOD + PERIOD)
            for row in range((j % PERIOD) << 8, ((upto - 1) % PERIOD + 1) << 8, 256):
                at += table[row | data[at]]
            j = upto
            if at >= end:
                j = stop
        kept.append(data[at])
        s += 1
    return bytes(kept)


def likeness(a: str, b: str) -> float:
    """The weighted share of samples that agree, of those that either text has; 1 for two empty texts."""
    n = max(len(a), len(b))
    if n == 0:
        return 1.0
    x = np.frombuffer(a.ljust(n, ".").encode(), np.uint8)
    y = np.frombuffer(b.ljust(n, ".").encode(), np.uint8)
    weight = _WEIGHTS[:n]
    return float(weight[x == y].sum() / weight.sum())


def band_keys(fingerprint: str) -> list[str]:
    """BAND samples of one octave each, where the text has them all; the samples of a band are dealt over the octave."""
    first = SAMPLES - 1  # octaves from here on have SAMPLES samples each
    keys = []
    for octave, at in enumerate(range(first, len(fingerprint), SAMPLES)):
        part = fingerprint[at : at + SAMPLES]
        for k in range(SAMPLES // BAND):
            band = part[k :: SAMPLES // BAND]
            if len(band) == BAND and "." not in band:
                keys.append(f"{octave}:{k}:{band}")
    return keys if keys else [f"short:{fingerprint}"] if fingerprint else []


def _shared(a: str, b: str) -> bool:
    return not set(band_keys(a)).isdisjoint(band_keys(b))


def _lots(texts: Iterator[str]) -> Iterator[list[str]]:
    lot, size = [], 0
    for t in texts:
        lot.append(t)
        size += len(t)
        if size >= _LOT:
            yield lot
            lot, size = [], 0
    if lot:
        yield lot


def fingerprint(docs: DataFrame, column: str = "fingerprint") -> DataFrame:
    """``docs`` with all their columns and the fingerprint of the whole ``text``; null counts as empty.

    Equal texts have equal fingerprints. A column named like the new one is replaced; an empty table stays empty.
    """

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([f for lot in _lots(t or "" for t in texts) for f in fingerprints(lot)], dtype=object)

    return docs.withColumn(column, of("text"))


def near_documents(fingerprinted: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(doc_id, class_id, n_links) of documents (doc_id, fingerprint): banding, then verification by likeness.

    Equal fingerprints are one class from the start. In each bucket of a band the least class is compared with all others,
    then, of what is left in other components, again the least, until each bucket lies in one component or has been
    compared through: no pair that shares a bucket is lost, and no round makes more pairs than there are members.
    class_id is the least doc_id reached, n_links the links of a document's fingerprint with different ones. Empty
    texts, and rows without doc_id, are linked with nothing. Rows that repeat a doc_id belong together.
    """
    kind = dict(fingerprinted.dtypes)["doc_id"]
    named = fingerprinted.where("doc_id IS NOT NULL AND fingerprint <> ''")
    classes = stored(named.groupBy("fingerprint").agg(F.min("doc_id").alias("node")), "classes")
    keys = F.pandas_udf(lambda f: f.map(band_keys), "array<string>")
    alike = F.pandas_udf(lambda a, b: pd.Series([likeness(x, y) for x, y in zip(a, b)], dtype=float), "double")
    spread = classes.select("node", F.explode(keys("fingerprint")).alias("key")).select("node", F.xxhash64("key").alias("at"))
    several = spread.groupBy("at").agg(F.count("*").alias("n")).where("n > 1").select("at")
    members = stored(spread.join(several, "at"), "members")
    links = stored(classes.sparkSession.createDataFrame([], f"a {kind}, b {kind}"), "near")
    found = links.toDF("node", "component")
    while True:
        placed = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        hubs = (
            placed.groupBy("at")
            .agg(F.min("node").alias("hub"), F.min("component").alias("low"), F.max("component").alias("high"), F.min_by("component", "node").alias("of"))
            .where("low <> high")
        )
        open_ = stored(placed.join(hubs.select("at", "hub", "of"), "at"), "open")
        if open_.isEmpty():
            break
        pairs = open_.where("component <> of").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
        left = classes.select(F.col("node").alias("a"), F.col("fingerprint").alias("x"))
        right = classes.select(F.col("node").alias("b"), F.col("fingerprint").alias("y"))
        new = pairs.join(left, "a").join(right, "b").where(alike("x", "y") >= threshold).select("a", "b")
        links = stored(links.union(new), "near")
        found = stored(components(links), "found")
        members = open_.where("node <> hub").select("node", "at")
    degrees = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    of_class = classes.join(found, "node", "left").join(degrees, "node", "left").select("fingerprint", "node", "component", "n_links")
    return fingerprinted.join(of_class, "fingerprint", "left").select(
        "doc_id",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
    )


def _bucketed(docs: DataFrame, bounds: np.ndarray) -> DataFrame:
    numbered = F.pandas_udf(lambda ids: pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="right").astype(np.int32)), "int")
    return docs.withColumn("bucket", numbered("doc_id"))


def with_next(docs: DataFrame, make, schema: str) -> DataFrame:
    """``make(rows)`` over the documents (doc_id, text) in ascending order of doc_id, in parts that each see what follows.

    ``rows`` are (doc_id, text, own) of a run of documents; where ``own`` is false, the row only follows the one before
    it. Documents are dealt into buckets by the quantiles of doc_id; each bucket also gets the first document of the next,
    the last one the first of all.
    """
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    quantiles = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 100 * parts)).first()[0]
    bounds = np.unique(np.array(quantiles or [], np.int64))
    dealt = _bucketed(docs, bounds)
    firsts = sorted((r[0], r[1]) for r in dealt.groupBy("bucket").agg(F.min("doc_id")).collect())  # one per bucket
    if not firsts:
        return docs.sparkSession.createDataFrame([], schema)
    follows = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    edge = dealt.where(F.col("doc_id").isin([f for _, f in firsts]))
    edge = edge.withColumn("bucket", F.create_map(*[F.lit(x) for kv in follows.items() for x in kv])[F.col("doc_id")].cast("int"))
    rows = dealt.withColumn("own", F.lit(True)).unionByName(edge.withColumn("own", F.lit(False)))
    order = ["bucket", F.desc("own"), "doc_id", F.xxhash64("text")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def runs() -> Iterator[tuple[int, str, bool]]:
            ended = None
            for frame in frames:
                for bucket, key, text, own in zip(frame["bucket"], frame["doc_id"], frame["text"], frame["own"]):
                    if own or ended != bucket:  # of several texts of the following doc_id the first
                        yield key, text or "", own
                    ended = None if own else bucket

        yield from make(runs())

    return rows.repartition(parts // 4, "bucket").sortWithinPartitions(*order).select("bucket", "doc_id", "text", "own").mapInPandas(run, schema)


_EDITED = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, band_edited boolean, band_next boolean"


def _edited(rows: Iterator[tuple[int, str, bool]]) -> Iterator[pd.DataFrame]:
    """Of each own row, what becomes of its text when its end is replaced by the beginning of the next document."""
    import hashlib

    columns = [c.split()[0] for c in _EDITED.split(", ")]
    lot: list[tuple[int, str, bool]] = []
    size = 0

    def done(lot: list[tuple[int, str, bool]]) -> pd.DataFrame:
        edited = []
        for (_, text, own), (_, after, _) in zip(lot, lot[1:]):
            n = len(text) // 4
            edited.append(text[: len(text) - n] + after[:n] if own else "")
        prints = fingerprints([t for _, t, _ in lot] + edited)
        own_prints, edited_prints = prints[: len(lot)], prints[len(lot) :]
        out = []
        for k, (key, text, own) in enumerate(lot[:-1]):
            if own:
                a, b, c = own_prints[k], edited_prints[k], own_prints[k + 1]
                digest = hashlib.sha256(edited[k].encode("utf-8", "surrogatepass")).hexdigest()
                out.append((key, len(text), digest, a, b, likeness(a, b), likeness(a, c), _shared(a, b), _shared(a, c)))
        return pd.DataFrame(out, columns=columns)

    for row in rows:
        lot.append(row)
        size += len(row[1])
        if size >= _LOT:
            yield done(lot)
            lot, size = [lot[-1]], len(lot[-1][1])
    if len(lot) > 1:
        yield done(lot)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they and the next document's are.

    The edited text has the last quarter of the code points (rounded down) replaced by as many, or all, of the first of
    the next document in ascending doc_id; after the last comes the first. band_edited and band_next say whether a band
    is shared. ``docs`` has doc_id and text; other columns are ignored. Null counts as empty. Of rows that repeat a
    doc_id each follows the other, in an order fixed by their texts. Rows without doc_id stand apart: nothing follows
    them, so their edited text only loses its end and the columns on the next document are null. An empty table stays empty.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    placed = with_next(docs.where("doc_id IS NOT NULL"), _edited, _EDITED)

    def apart(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text in frame["text"]:
                for made in _edited(iter([(0, text or "", True), (0, "", False)])):
                    yield made.assign(doc_id=None, near_next=None, band_next=None)

    return placed.unionByName(docs.where("doc_id IS NULL").mapInPandas(apart, _EDITED))
