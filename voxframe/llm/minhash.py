"""Near-duplicate documents by min-max hashing.

Every permutation is evaluated once per shingle and gives two signature values, its minimum and its maximum: 64
evaluations fill 128 values, banded 32 times 4 (16 bands of minima, 16 of maxima; the values of a band come from
different permutations). A pair at similarity 0.75 shares no band with a chance of 5e-6.

Equal sets are folded into one class first, so copies cost one row. In each bucket of a band the least class is
the hub, and every member is compared with the hubs of its buckets on the full sets: work in proportion to the members.
That joins groups of near copies into components. Only buckets that still hold several components are looked at again:
small ones give their pairs across components; in large ones (texts that share a frequent passage fall together) pairs
must share one of the rarest quarter of their shingles, which any pair at 0.75 does. No candidate pair is given up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import stored
from voxframe.llm.components import components
from voxframe.llm.shingles import mixed, shingle_set

PERMUTATIONS, ROWS, PERCENT = 64, 4, 75
#: Members of a bucket up to which pairs across components are taken straight; larger buckets take the other way.
FEW = 16
#: Counters by which shingles are ordered from rare to frequent.
SLOTS = 1 << 20
_STEP = 4096


def _constants(permutations: int) -> tuple[np.ndarray, np.ndarray]:
    made = mixed(np.arange(1, 2 * permutations + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return made[:permutations, None], made[permutations:, None] | np.uint64(1)


def min_max(shingles: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """The minima of all permutations, then the maxima."""
    flip, odd = _constants(permutations)
    low, high = np.full(permutations, np.iinfo(np.uint64).max, np.uint64), np.zeros(permutations, np.uint64)
    for at in range(0, len(shingles), _STEP):
        values = (shingles[None, at : at + _STEP] ^ flip) * odd
        low, high = np.minimum(low, values.min(1)), np.maximum(high, values.max(1))
    return np.concatenate([low, high])


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One key per band of ``rows`` signature values."""
    by = signature.reshape(-1, rows)
    keys = np.arange(len(by), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows):
        keys = mixed(keys + by[:, k])
    return keys.view(np.int64)


def _signed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        sets = [shingle_set(t) for t in frame["text"]]
        yield pd.DataFrame(
            {
                "doc_id": frame["doc_id"],
                "n_shingles": [len(s) for s in sets],
                "key": [_digest(s) if len(s) else None for s in sets],
                "bands": [bands(min_max(s)) if len(s) else None for s in sets],
            }
        )


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"node": frame["doc_id"], "shingles": [shingle_set(t).view(np.int64) for t in frame["text"]]})


def _alike_in_size(a: str, b: str) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose full sets are alike enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.select("a", "b").distinct().join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("x", "y"))
    return (
        both.select("a", "b", shared.alias("shared"), (F.size("x") + F.size("y")).alias("sizes"))
        .where(F.col("shared") * 100 >= (F.col("sizes") - F.col("shared")) * PERCENT)
        .select("a", "b")
    )


def _with_component(members: DataFrame, found: DataFrame) -> DataFrame:
    return members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _open(members: DataFrame) -> DataFrame:
    """Groups (column ``at``) whose members lie in several components, with their hub."""
    return (
        members.groupBy("at")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.struct("n", "node")).alias("hub"), F.count("*").alias("members"))
        .where("low <> high")
        .select("at", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"), "members")
    )


def _across(members: DataFrame) -> DataFrame:
    """Pairs of members of one group in different components."""
    a = members.select("at", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("component").alias("c_a"))
    b = members.select("at", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("c_b"))
    return a.join(b, "at").where((F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b")) & _alike_in_size("n_a", "n_b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs`` (doc_id, text; other columns are ignored).

    component_id is the least doc_id that can be reached over links, a link being two sets of 5-word shingles with
    a Jaccard similarity of 0.75 or more; kept marks the document that stands for its component. Texts without words
    (null, empty, blank) have no set, are linked with nothing and kept. Rows that repeat a doc_id count as one document
    that is linked with whatever any of its texts is linked with. Rows without a doc_id cannot be named: their
    component_id is null and they are kept. An empty table gives an empty result.
    """
    kind = dict(docs.dtypes)["doc_id"]
    docs = docs.select("doc_id", "text")
    signed = stored(docs.mapInPandas(_signed, f"doc_id {kind}, n_shingles bigint, key binary, bands array<bigint>"), "signed")
    named = signed.where("doc_id IS NOT NULL AND key IS NOT NULL")
    classes = stored(
        named.groupBy("key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes"
    )
    rows = classes.select(F.explode("bands").alias("at"), "node", "n")
    shared = rows.groupBy("at").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("members")).where("low <> high")
    members = stored(rows.join(shared.select("at", F.col("low").alias("hub")), "at"), "members")
    sized = members.select("hub", "node", "n").distinct()
    hubs = sized.where("hub = node").select("hub", F.col("n").alias("hub_n"))
    stars = stored(
        sized.where("hub <> node").join(hubs, "hub").where(_alike_in_size("n", "hub_n")).select(F.col("hub").alias("a"), F.col("node").alias("b")), "stars"
    )
    involved = members.select("node").distinct()
    sets = stored(
        docs.join(involved, docs.doc_id == involved.node, "left_semi").mapInPandas(_sets, f"node {kind}, shingles array<bigint>"), "sets"
    )
    links = _links(stars, sets)
    found = components(links)

    placed = stored(_with_component(members, found), "placed")
    left = _open(placed.drop("hub"))
    rest = stored(placed.drop("hub").join(left.select("at", "members"), "at"), "rest")
    # pairs with the bucket's hub are settled: the hub is the least member
    hubs_of = members.select("at", F.col("hub").alias("node")).distinct()
    few = rest.where(F.col("members") <= FEW).join(hubs_of, ["at", "node"], "left_anti")
    # each way's links are stored, so that no plan holds several of them
    more = stored(_links(_across(few), sets), "direct")
    many = stored(rest.where(F.col("members") > FEW).select("node", "n", "component").distinct(), "many")
    if not many.isEmpty():
        more = more.union(_by_rare_shingles(many, sets, found))
    found = components(found.union(more))

    named_classes = classes.select("key", "node").join(found, "node", "left").select("key", F.coalesce("component", "node").alias("component"))
    return (
        signed.select("doc_id", "n_shingles", "key")
        .join(named_classes, "key", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _by_rare_shingles(nodes: DataFrame, sets: DataFrame, found: DataFrame) -> DataFrame:
    """Links among ``nodes`` (node, n, component) that lie in different components.

    Shingles are ordered by how many of these sets hold them, as counted in a table of SLOTS hashed counters (any order
    that all sets share is right; a good one keeps frequent shingles last). Two sets at 0.75 share at least ceil(0.75 n) shingles of
    the larger, so their n - ceil(0.75 n) + 1 rarest ones have one in common. If the first one in common stands at
    place i of a set of n, they share n - i at most, which bounds the size of the other set: its ``reach``. Within the
    sets of a shingle, the one that reaches furthest is compared with the others first, and those larger than that
    reach are out: a frequent passage leaves only texts that hardly hold more than it, and these join one component.
    Pairs across the components that remain, within each other's reach, then follow.
    """
    held = nodes.join(sets, "node")
    slots = held.select(F.explode("shingles").alias("at")).groupBy(F.pmod("at", F.lit(SLOTS)).alias("slot")).agg(F.count("*").alias("df")).toPandas()
    often = np.zeros(SLOTS, np.int32)  # 4 MB, whatever the corpus
    often[slots["slot"].to_numpy()] = np.minimum(slots["df"], 2**31 - 1)

    def prefixes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for node, component, shingles in zip(frame["node"], frame["component"], frame["shingles"]):
                at = np.asarray(shingles, np.int64)
                df, n = often[at % SLOTS], len(at)
                place = np.arange(n + (-PERCENT * n // 100) + 1)  # n - ceil(0.75 n) + 1
                first = np.lexsort((at, df))[: len(place)]
                shared = df[first] > 1
                reach = (n - place) * (100 + PERCENT) // PERCENT - n
                yield pd.DataFrame({"node": node, "n": n, "component": component, "at": at[first][shared], "reach": reach[shared]})

    kind = dict(nodes.dtypes)["node"]
    rarest = stored(held.mapInPandas(prefixes, f"node {kind}, n bigint, component {kind}, at bigint, reach bigint"), "rarest")

    def still_open(members: DataFrame) -> DataFrame:
        hubs = rarest.groupBy("at").agg(F.min(F.struct(-F.col("reach"), "node", "n")).alias("h"))
        hubs = hubs.select("at", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"), (-F.col("h.col1")).alias("hub_reach"))
        near = members.join(hubs, "at").where((F.col("node") == F.col("hub")) | (F.col("n") <= F.col("hub_reach")))
        of_hub = F.max(F.when(F.col("node") == F.col("hub"), F.col("component"))).alias("main")
        groups = near.groupBy("at").agg(F.min("component").alias("low"), F.max("component").alias("high"), of_hub).where("low <> high")
        return near.join(groups.select("at", "main"), "at").where(F.col("node") != F.col("hub"))

    stars = still_open(rarest).where((F.col("hub_n") <= F.col("reach")) & _alike_in_size("n", "hub_n"))
    first = stored(_links(stars.select(F.col("hub").alias("a"), F.col("node").alias("b")), sets), "first")
    better = components(found.union(first))
    rest = still_open(_with_component(rarest.drop("component"), better))
    # one of a pair at least is outside the hub's component
    outside = rest.where(F.col("component") != F.col("main"))
    a = outside.select("at", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("component").alias("c_a"), F.col("reach").alias("reach_a"))
    b = rest.select("at", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("c_b"), F.col("reach").alias("reach_b"))
    in_reach = (F.col("n_a") <= F.col("reach_b")) & (F.col("n_b") <= F.col("reach_a"))
    pairs = a.join(b, "at").where((F.col("c_a") != F.col("c_b")) & in_reach & _alike_in_size("n_a", "n_b"))
    return first.union(stored(_links(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), sets), "rest"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents kept, with all their columns; of rows that repeat a doc_id all stay or go together."""
    gone = near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")
