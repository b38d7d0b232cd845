"""Ranked lexical search: the highest-scoring documents of each item, by blocks that exact bounds let skip.

The scores are sums of whole numbers over an item's terms (see ``search``), so bounds are exact, too.

1. Documents become vectors of (term, impact) over the terms of the items.
2. The documents that are best for some term in one of a few shards are scored against all items: the k-th best score is
   a threshold that the k-th result can't fall below.
3. Terms of an item whose greatest impacts together stay below its threshold can't make a result alone. The posting lists
   of the other terms are all that must be read.
4. The documents are put in order of the signs of random projections of their weighted vectors, so that similar ones
   lie together, and stored in segments of that order. In each segment the posting list of each term is cut into blocks of
   at most ``BLOCK`` documents. A block has a summary, the greatest impact for each term of the items concerned,
   coordinate by coordinate, which is stored with it.
5. The weighted sum of a summary bounds every score in its block. Blocks whose bound is below the item's threshold are
   skipped, the documents of all others are scored from their vectors.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxframe.llm.common import sent_if_small, stored

K = 10
BLOCK = 4
PLANES = 30
SHARDS = 16
#: Rows (item, term) of a slice of the items; each slice reads the documents once.
SLICE = 1 << 15
#: Numbers that a task holds in matrices and lookups at a time.
CELLS = 1 << 22
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters lower-cased, digits and bytes beyond ASCII as they are, the rest blank.
_TABLE = bytes(ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times); rows that repeat an item_id count as one item with the terms of all."""
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), F.lit(WORD), 0)
    return items.select("item_id", F.explode(words).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))


def _vectors(numbers: dict[bytes, int]):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n, terms, times, ends = [], [], [], [], [0]
            for i, text in enumerate(batch.column(1)):
                words = text.as_buffer().to_pybytes().translate(_TABLE).split() if text.is_valid else []
                if not words:
                    continue
                held = Counter(map(numbers.get, words))
                held.pop(None, None)
                at.append(i)
                n.append(len(words))
                terms.extend(held.keys())
                times.extend(held.values())
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at, pa.int64())),
                    pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
                ],
                ["doc_id", "n", "terms", "times"],
            )

    return make


class _Items:
    """A slice of the items in arrays: terms and weights per item and, the other way, items per term."""

    def __init__(self, item: np.ndarray, term: np.ndarray, weight: np.ndarray, items: int, terms: int) -> None:
        self.items, self.terms = items, terms
        by_item = np.lexsort((term, item))
        self.item, self.term, self.weight = item[by_item], term[by_item], weight[by_item]
        self.first = np.searchsorted(self.item, np.arange(items + 1))
        by_term = np.argsort(self.term, kind="stable")
        self.item_of, self.weight_of = self.item[by_term], self.weight[by_term]
        self.first_of = np.searchsorted(self.term[by_term], np.arange(terms + 1))

    def only(self, rows: np.ndarray) -> _Items:
        return _Items(self.item[rows], self.term[rows], self.weight[rows], self.items, self.terms)

    def essential(self, top: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Which (item, term) rows a document must hold one of to reach ``need``, given each term's greatest impact."""
        most = self.weight * top[self.term]
        order = np.lexsort((most, self.item))
        sums = np.cumsum(most[order])
        before = np.concatenate([[0], sums])[self.first[self.item[order]]]
        marked = np.empty(len(most), bool)
        marked[order] = sums - before >= need[self.item[order]]
        return marked


def _expanded(first: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key the numbers first[key] .. first[key + 1]: places of the keys, and the numbers."""
    count = first[keys + 1] - first[keys]
    at = np.repeat(np.arange(len(keys)), count)
    return at, np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[keys], count)


def _postings(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row in the batch, term and impact of every posting, in order of rows."""
    terms, times = batch.column("terms"), batch.column("times")
    lengths = np.diff(terms.offsets.to_numpy())
    row = np.repeat(np.arange(batch.num_rows), lengths)
    term, tf = terms.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy().astype(np.int64)
    m = batch.column("m").to_numpy()[row]
    return row, term, (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _pieces(batches: Iterator[pa.RecordBatch], reads: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Batches cut such that what is looked up at ``reads`` per posting stays within CELLS."""
    for batch in batches:
        terms = batch.column("terms")
        upto = np.concatenate([[0], np.cumsum(reads[terms.flatten().to_numpy()])])
        ends = terms.offsets.to_numpy() - terms.offsets[0].as_py()
        piece = np.cumsum(upto[ends[1:]] - upto[ends[:-1]]) // CELLS
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            if high > low:
                yield batch.slice(low, high - low)


def _best(items: _Items, k: int):
    """Per batch and item the k best scores above 0."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, 8 * np.diff(items.first_of) + 1):
            row, term, impact = _postings(batch)
            at, entry = _expanded(items.first_of, term)
            cell = row[at] * items.items + items.item_of[entry]
            # whole numbers far below 2^53
            scores = np.bincount(cell, items.weight_of[entry] * impact[at], batch.num_rows * items.items).reshape(-1, items.items)
            some = min(k, len(scores))
            best = np.partition(scores, len(scores) - some, axis=0)[len(scores) - some :]
            item, score = np.repeat(np.arange(items.items)[None], some, 0).ravel(), best.ravel().astype(np.int64)
            keep = score > 0
            yield pa.RecordBatch.from_arrays([pa.array(item[keep].astype(np.int32)), pa.array(score[keep])], ["item", "score"])

    return make


def _coded(weight: np.ndarray):
    """Adds ``code``, the sides of random planes on which a document's weighted vector lies."""
    planes = np.random.default_rng(20).choice(np.array([-1.0, 1.0], np.float32), (len(weight), PLANES))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, np.full(len(weight), PLANES)):
            row, term, impact = _postings(batch)
            lean = np.zeros((batch.num_rows, PLANES))
            if len(row):
                held, begin = np.unique(row, return_index=True)
                lean[held] = np.add.reduceat(planes[term] * (weight[term] * impact)[:, None].astype(np.float32), begin, axis=0)
            code = (lean > 0) @ (1 << np.arange(PLANES - 1, -1, -1))
            impacts = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)), pa.array(impact.astype(np.int32)))
            columns = [batch.column("row"), batch.column("doc_id"), pa.array(code.astype(np.int64)), _flat(batch.column("terms")), impacts]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "code", "terms", "impacts"])

    return make


def _flat(lists: pa.ListArray) -> pa.ListArray:
    """The same lists, without what lies before and after a slice of them."""
    return pa.ListArray.from_arrays(pa.array(lists.offsets.to_numpy() - lists.offsets[0].as_py(), pa.int32()), lists.flatten())


def _one(values: np.ndarray | pa.Array) -> pa.ListArray:
    """A column of one row that holds all values."""
    values = values if isinstance(values, pa.Array) else pa.array(values.astype(np.int32))
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


SEGMENT = ("ends", "terms", "impacts", "heads", "member_ends", "members", "summary_ends", "summary_terms", "summary_most")


def _segments(items: _Items, essential: np.ndarray):
    """A row per stretch of similar documents: their vectors, and the blocks of the lists of essential terms with their summaries."""
    lists = items.only(essential)
    heads = np.flatnonzero(np.diff(lists.first_of))
    # the terms of the items for which a list is read
    concerned = {}
    for head in heads.tolist():
        _, at = _expanded(items.first, lists.item_of[lists.first_of[head] : lists.first_of[head + 1]])
        concerned[head] = np.unique(items.term[at])
    listed = np.zeros(items.terms, bool)
    listed[heads] = True
    rows_at_once = max(BLOCK, min(4096, CELLS // max(items.terms, 1)))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(low, rows_at_once)
                ends = batch.column("terms").offsets.to_numpy() - batch.column("terms").offsets[0].as_py()
                row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
                term, impact = batch.column("terms").flatten().to_numpy(), batch.column("impacts").flatten().to_numpy()
                dense = np.zeros((batch.num_rows, items.terms), np.int32)
                dense[row, term] = impact
                own = listed[term]
                order = np.lexsort((row[own], term[own]))
                head_of, doc_of = term[own][order], row[own][order]
                first = np.flatnonzero(np.diff(head_of, prepend=-1))
                block_heads, members, summary_terms, summary_most, member_ends, summary_ends = [], [], [], [], [0], [0]
                for a, b in zip(first.tolist(), [*first[1:].tolist(), len(head_of)]):
                    head = int(head_of[a])
                    terms = concerned[head]
                    starts = np.arange(0, b - a, BLOCK)
                    most = np.maximum.reduceat(dense[np.ix_(doc_of[a:b], terms)], starts, axis=0)
                    block, at = np.nonzero(most)
                    block_heads.append(np.full(len(starts), head))
                    members.append(doc_of[a:b])
                    member_ends.extend((member_ends[-1] + np.append(starts[1:], b - a)).tolist())
                    summary_terms.append(terms[at])
                    summary_most.append(most[block, at])
                    summary_ends.extend((summary_ends[-1] + np.searchsorted(block, np.arange(1, len(starts) + 1))).tolist())
                joined = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int32)
                columns = [ends, term, impact, joined(block_heads), np.array(member_ends), joined(members), np.array(summary_ends), joined(summary_terms), joined(summary_most)]
                yield pa.RecordBatch.from_arrays([_one(batch.column("row")), _one(batch.column("doc_id")), *map(_one, columns)], ["rows", "doc_ids", *SEGMENT])

    return make


def _looked_up(items: _Items, of: np.ndarray, item: np.ndarray, ends: np.ndarray, terms: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For pairs (of, item): the sum over the item's terms of weight times value of the term in list ``of`` (0 where it isn't)."""
    keys = np.repeat(np.arange(len(ends) - 1), np.diff(ends)) * items.terms + terms
    order = np.argsort(keys, kind="stable")
    keys, values = np.append(keys[order], -1), np.append(values[order], 0)
    out = np.zeros(len(of), np.int64)
    load = np.cumsum(np.diff(items.first)[item]) // (CELLS // 4)
    cuts = [0, *(np.flatnonzero(np.diff(load)) + 1).tolist(), len(of)]
    for low, high in zip(cuts, cuts[1:]):
        if high > low:
            pair, at = _expanded(items.first, item[low:high])
            wanted = of[low:high][pair] * items.terms + items.term[at]
            place = np.searchsorted(keys[:-1], wanted)
            found = keys[place] == wanted
            # whole numbers far below 2^53
            out[low:high] = np.bincount(pair[found], items.weight[at[found]] * values[place[found]], high - low)
    return out


def _bounds(items: _Items, lists: _Items, segment: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a block and an item for which its list is read, with the bound of the scores."""
    block, entry = _expanded(lists.first_of, segment["heads"])
    item = lists.item_of[entry]
    return block, item, _looked_up(items, block, item, segment["summary_ends"], segment["summary_terms"], segment["summary_most"])


def _read(batch: pa.RecordBatch, i: int) -> dict[str, np.ndarray]:
    return {name: batch.column(name)[i].values.to_numpy(zero_copy_only=False).astype(np.int64) for name in SEGMENT}


def _scored(items: _Items, essential: np.ndarray, need: np.ndarray):
    """Scores, of the needed height, of the documents in blocks that are not skipped."""
    lists = items.only(essential)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                segment = _read(batch, i)
                block, item, bound = _bounds(items, lists, segment)
                kept = bound >= need[item]
                at, member = _expanded(segment["member_ends"], block[kept])
                # a document may stand in several lists
                pairs = np.unique(segment["members"][member] * items.items + item[kept][at])
                doc, item = pairs // items.items, pairs % items.items
                score = _looked_up(items, doc, item, segment["ends"], segment["terms"], segment["impacts"])
                high = score >= need[item]
                doc, item, score = (pa.array(x[high]) for x in (doc, item, score))
                columns = [item.cast(pa.int32()), batch.column("rows")[i].values.take(doc), batch.column("doc_ids")[i].values.take(doc), score]
                yield pa.RecordBatch.from_arrays(columns, ["item", "row", "doc_id", "score"])

    return make


def _bounded(items: _Items, essential: np.ndarray, need: np.ndarray):
    """Every block and item with bound, need, and whether the block is looked into."""
    lists = items.only(essential)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                segment = _read(batch, i)
                block, item, bound = _bounds(items, lists, segment)
                size = np.diff(segment["member_ends"])[block]
                columns = [item.astype(np.int32), segment["heads"][block].astype(np.int32), size, bound, need[item], bound >= need[item]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["item", "head", "documents", "bound", "need", "kept"])

    return make


def _slice(docs: DataFrame, item_rows: DataFrame, k: int, bounds: bool = False) -> DataFrame | None:
    """(item, row, doc_id, score) of a bounded number of items, not below the k-th best; or all blocks with their bounds."""
    kind = dict(docs.dtypes)["doc_id"]
    asked = item_rows.select("item", "term", "times").toPandas()  # at most some SLICE rows
    if asked.empty:
        return None
    names, term = np.unique(asked["term"].to_numpy().astype(str), return_inverse=True)
    numbers = {name.encode("utf-8", "surrogatepass"): i for i, name in enumerate(names.tolist())}
    made = docs.mapInArrow(_vectors(numbers), f"doc_id {kind}, n bigint, terms array<int>, times array<bigint>")
    vectors = stored(made.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n_docs, n_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return None
    vectors = vectors.select("row", "doc_id", "terms", "times", F.expr(f"25L + (75L * n * {n_docs}L) div {n_terms}L").alias("m"))

    postings = vectors.select("row", "m", F.explode(F.arrays_zip("terms", "times")).alias("p")).select("row", "m", "p.terms", "p.times")
    impact = F.expr("(1000000000L * times) div (1000L * times + 8L * m)")
    shard = F.pmod(F.xxhash64("row"), F.lit(SHARDS))
    # at most SHARDS rows per term of the slice
    champions = stored(
        postings.select(F.col("terms").alias("term"), shard.alias("shard"), "row", impact.alias("impact"))
        .groupBy("term", "shard")
        .agg(F.count("*").alias("df"), F.max("impact").alias("top"), F.max_by("row", "impact").alias("row")),
        "champions",
    )
    weigh = F.floor(F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1)) * 1000).cast("bigint")
    held = champions.groupBy("term").agg(F.sum("df").alias("df"), F.max("top").alias("top")).withColumn("weight", weigh).toPandas()
    weight, top = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    for target, column in ((weight, "weight"), (top, "top")):
        target[held["term"].to_numpy(np.int64)] = held[column]
    n_items = int(asked["item"].max()) + 1
    items = _Items(asked["item"].to_numpy(np.int64), term.astype(np.int64), asked["times"].to_numpy(np.int64) * weight[term], n_items, len(names))

    some = champions.select("row").distinct()
    scored = vectors.join(sent_if_small(some, some.count()), "row", "left_semi").mapInArrow(_best(items, k), "item int, score bigint")
    nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
    found = scored.withColumn("nth", nth).where(F.col("nth") == k).select("item", "score").toPandas()
    need = np.ones(n_items, np.int64)
    need[found["item"].to_numpy(np.int64)] = found["score"]

    essential = items.essential(top, need)
    coded = vectors.mapInArrow(_coded(weight), f"row bigint, doc_id {kind}, code bigint, terms array<int>, impacts array<int>")
    similar = stored(coded, "coded").repartitionByRange("code", "row").sortWithinPartitions("code", "row").drop("code")
    arrays = ", ".join(f"{name} array<int>" for name in SEGMENT)
    index = stored(similar.mapInArrow(_segments(items, essential), f"rows array<bigint>, doc_ids array<{kind}>, {arrays}"), "index")
    if bounds:
        return index.mapInArrow(_bounded(items, essential, need), "item int, head int, documents bigint, bound bigint, need bigint, kept boolean")
    return index.mapInArrow(_scored(items, essential, need), f"item int, row bigint, doc_id {kind}, score bigint")


def _numbered(items: DataFrame) -> list[DataFrame]:
    """Slices of (item, item_id, term, times) of bounded size, items numbered from 0 in each."""
    rows = stored(item_terms(items), "items")
    n = max(1, -(-rows.count() // SLICE))
    ids = rows.select("item_id").distinct().withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(n)))
    number = (F.row_number().over(Window.partitionBy("part").orderBy("item_id")) - 1).cast("int")
    ids = stored(ids.withColumn("item", number), "ids")
    same = rows.item_id.eqNullSafe(ids.item_id)
    return [rows.join(ids.where(F.col("part") == p), same).select("item", ids.item_id, "term", "times") for p in range(n)]


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the ``k`` documents that score highest above 0.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are ignored, whatever their names. Terms are runs
    of letters, digits and all that is not ASCII, A-Z lower-cased. With N documents that have a term, L terms in them, n in one, df
    documents with a term and tf its count in a document, a term weighs floor(1000 ln((2N + 2) / (2 df + 1))), a document has
    m = 25 + 75 n N div L, and its score sums weight * (10^9 tf div (1000 tf + 8 m)) over the item's terms, repeats included.
    Equal scores rank by ascending doc_id, rows without doc_id last. Each row of ``docs`` is a document, also where a doc_id
    repeats; rows that repeat an item_id are one item with the terms of all. Null and empty texts have no terms: such
    documents are not counted, such items and empty tables give no rows.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    parts = _parts(docs, items, k)
    kinds = f"item_id {dict(items.dtypes)['item_id']}, rank int, doc_id {dict(docs.dtypes)['doc_id']}, score bigint"
    if not parts:
        return docs.sparkSession.createDataFrame([], kinds)
    results = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return results.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def block_bounds(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, head, documents, bound, need, kept) for every block of every list that ``search`` reads."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return reduce(DataFrame.unionByName, _parts(docs, items, k, bounds=True)).drop("item")


def _parts(docs: DataFrame, items: DataFrame, k: int, bounds: bool = False) -> list[DataFrame]:
    parts = []
    for rows in _numbered(items):
        found = _slice(docs, rows, k, bounds)
        if found is not None:
            names = rows.select("item", "item_id").distinct()
            parts.append(found.join(sent_if_small(names, SLICE), "item"))
    return parts
