"""Benchmark decontamination: short test items found inside long documents, with DataFrame operations only.

Items are partitioned by size: those with 2^c .. 2^(c+1)-1 distinct shingles share a sketch length. An item's sketch
is its bottom-k MinHash, the k smallest hashes of its shingles, with k = (u - ceil(t * u)) + 1 for the largest size u
of the partition. A document that holds a share t of the item misses at most size - ceil(t * size) < k of its
shingles, so at least one of any k is in the document: no containment of t or more is lost, however long the document.
Documents whose shingles hit a sketch are candidates; the exact shares of shingles, as strings, decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import let, plain_words, sent_if_small, stored

SHINGLE = 5
PERCENT = 75


def _grams(words: Column, length: int, make) -> Column:
    """``make(words, i)`` for each start i of ``length`` words in a row; empty where there are fewer."""
    last = F.size(words) - length
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: make(words, i)))


def _hashed(words: Column, length: int) -> Column:
    return _grams(words, length, lambda w, i: F.xxhash64(*[F.get(w, i + k) for k in range(length)]))


def _spelled(words: Column, length: int) -> Column:
    return _grams(words, length, lambda w, i: F.array_join(F.slice(w, i + 1, length), " "))


def _all_lengths(words: Column, lengths: list[int], kind) -> Column:
    kind_of = [F.coalesce(kind(words, n), F.array().cast("array<bigint>" if kind is _hashed else "array<string>")) for n in lengths]
    return F.array_distinct(F.concat(*kind_of))


def item_shingles(items: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Per item: length of its shingles (fewer words than ``shingle``: the whole item is one), hashes, spellings."""
    words = F.col("words")
    length = F.least(F.size(words), F.lit(shingle))
    pick = lambda kind: F.coalesce(*[F.when(length == n, kind(words, n)) for n in range(1, shingle + 1)])
    return (
        items.select("item_id", plain_words(F.col("text")).alias("words"))
        .where(F.size("words") > 0)
        .select(
            "item_id",
            length.alias("length"),
            F.array_distinct(pick(_hashed)).alias("hashes"),
            F.array_distinct(pick(_spelled)).alias("spelled"),
        )
    )


def sketches(shingled: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The bottom-k MinHash of each item, a row per hash; k is that of the item's size partition."""
    size = F.size("hashes")
    largest = F.pow(F.lit(2), F.length(F.bin(size))).cast("int") - 1
    k = largest - F.ceil(largest * percent / 100).cast("int") + 1
    return shingled.select("item_id", F.explode(F.slice(F.sort_array("hashes"), F.lit(1), k)).alias("hash"))


def find_contaminated(
    docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """Rows (doc_id, item_id, n_shared, n_item, containment) of items that a document holds to ``percent`` or more.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are ignored, whatever their names. Null
    and empty texts hold nothing and are held by nothing. An item of fewer words than a shingle is one shingle of its
    own length. Rows that repeat a doc_id (null included) count as one document, rows that repeat an item_id as one
    item with all their shingles; items without words and empty tables give no rows.
    """
    docs = docs.select("doc_id", "text")
    shingled = stored(item_shingles(items, shingle), "items")
    lengths = sorted(r[0] for r in shingled.select("length").distinct().collect())  # at most ``shingle`` values
    if not lengths:
        return docs.sparkSession.createDataFrame(
            [], f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(items.dtypes)['item_id']}, n_shared bigint, n_item bigint, containment double"
        )
    per_item = (
        shingled.groupBy("item_id")
        .agg(F.array_distinct(F.flatten(F.collect_set("hashes"))).alias("hashes"), F.array_distinct(F.flatten(F.collect_set("spelled"))).alias("spelled"))
    )
    sketch = stored(sketches(per_item, percent), "sketches")
    probes = docs.select(
        "doc_id", F.explode(let(plain_words(F.col("text")), lambda w: _all_lengths(w, lengths, _hashed))).alias("hash")
    )
    candidates = stored(probes.join(sent_if_small(sketch, sketch.count()), "hash").select("doc_id").distinct(), "candidates")

    spelled = stored(per_item.select("item_id", F.size("spelled").cast("long").alias("n_item"), F.explode("spelled").alias("gram")), "grams")
    same = docs.doc_id.eqNullSafe(candidates.doc_id)
    held = docs.join(candidates, same, "left_semi").select(
        "doc_id", F.explode(let(plain_words(F.col("text")), lambda w: _all_lengths(w, lengths, _spelled))).alias("gram")
    )
    return (
        held.join(sent_if_small(spelled, spelled.count()), "gram")
        .select("doc_id", "item_id", "n_item", "gram")
        .distinct()
        .groupBy("doc_id", "item_id", "n_item")
        .agg(F.count("*").alias("n_shared"))
        .where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
        .select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))
    )


def decontaminate(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents that hold no item, with all their columns; rows with a contaminated doc_id go."""
    found = stored(find_contaminated(docs, items, shingle, percent).select("doc_id").distinct(), "contaminated")
    return docs.join(found, docs.doc_id.eqNullSafe(found.doc_id), "left_anti")
