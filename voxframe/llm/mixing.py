"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words. A document's expected copies are its source's rate times a preference for its length
class, at most ``EPOCHS``; the rate is such that the expected words of all its documents are the target. Whole copies are
certain. For the rest a document has the inclusion probability that is the fraction of its expected copies: documents
are ranked by the odds of a random number over the odds of that probability, and the first are taken until the words that
the certain copies leave are filled. So the sample's size is fixed, counted in words. Documents that are large beside their
source's target are drawn first; the rate of the others then follows from the words that are left. At last one document
more, that whose size comes closest, closes the gap of each source.

Per source and length class there is one row of counts, from which targets and rates follow; ranks are running sums over
a range partitioning by source and odds, so a source with a third of all rows is spread over the cluster. Which
documents are in is decided per source by the greatest odds taken, so texts never move.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.llm.common import sent_if_small, stored

EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: A length class counts as large where this many documents at its upper end are more than the target.
LARGE = 16
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, source, any others) with ``size``, words between ASCII white space, and ``luck``.

    ``luck`` is a random number between 0 and 1 made from doc_id, or from the text where there is none; both replace
    columns of that name. A null text has no words.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce("text", F.lit("")))))
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED} "), name)), 1, 12), 16, 10).cast("bigint")
    return docs.withColumns(
        {
            "size": F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint"),
            "luck": (digits + 0.5) / float(1 << 48),
        }
    )


def _key(source: Column) -> Column:
    """A name that null has, too."""
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source.cast("string")))


def _length_class(size: Column) -> Column:
    """Number of binary digits: sizes of a class differ by less than a factor of two; 0 has a class of its own."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0)


def _preference(length: Column) -> Column:
    """Longer documents are preferred by the fourth root of their class's size."""
    return F.sqrt(F.sqrt(F.expr("shiftleft(1L, `class`)").cast("double")))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(key, source_size, target) from (key, source, source_size), a row per source.

    Sources in order of their names, null last, weigh ``weights`` in turn and share the sum of all sizes; none gets more
    than ``epochs`` times its size. What is left over by those is shared by weight among the others: with the sources in order of
    limit by weight, those at their limit come first. One row per source passes a window.
    """
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weigh = F.get(F.array(*[F.lit(w) for w in weights]), (n % len(weights)).cast("int")).cast("bigint")
    every = Window.partitionBy()
    by_limit = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(by_limit), F.lit(0))
    shared = sizes.withColumn("weight", weigh).withColumn("most", F.col("source_size") * epochs)
    shared = shared.withColumns({"words": F.sum("source_size").over(every), "weighs": F.sum("weight").over(every)})
    left, rest = F.col("words") - before("most"), F.col("weighs") - before("weight")
    shared = shared.withColumn("full", F.col("most").cast("double") * rest <= F.col("weight").cast("double") * left)
    left = F.col("words") - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(every), F.lit(0))
    rest = F.col("weighs") - F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))).over(every), F.lit(0))
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise((left * F.col("weight")).cast("double") / rest)
    return shared.select("key", "source_size", target.alias("target"))


def _expected(classes: DataFrame, goals: DataFrame, epochs: int) -> DataFrame:
    """(key, class, words, copies, goal): expected copies per document, so that the words are the ``goal`` of the key."""
    by_class = Window.partitionBy("key").orderBy("class")
    upto = by_class.rowsBetween(Window.unboundedPreceding, 0)
    every = by_class.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rated = (
        classes.select("key", "class", "words")
        .join(goals, "key")
        .withColumn("liking", _preference(F.col("class")))
        .withColumn("above", F.sum("words").over(every) - F.sum("words").over(upto))
        .withColumn("rate", (F.col("goal") - F.col("above") * epochs) / F.sum(F.col("liking") * F.col("words")).over(upto))
        .withColumn("rate", F.when(F.col("rate") * F.col("liking") < epochs, F.struct("class", "rate")))
        # the rate is that of the longest class below the limit
        .withColumn("rate", F.last("rate", ignorenulls=True).over(every))
    )
    full = F.col("rate").isNull() | (F.col("class") > F.col("rate.class"))
    copies = F.when(full, F.lit(float(epochs))).otherwise(F.col("rate.rate") * F.col("liking"))
    return rated.select("key", "class", "words", copies.alias("copies"), "goal")


def _odds() -> Column:
    """Odds of the random number over the odds of inclusion."""
    return F.when(F.col("chance") > 0, (F.col("luck") / (1 - F.col("luck"))) / (F.col("chance") / (1 - F.col("chance"))))


def _running(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words of a source up to each row within a sorted partition."""
    last, total = None, 0
    for frame in frames:
        if frame.empty:
            continue
        sums = frame.groupby("key", sort=False)["words"].cumsum()
        sums = sums + (frame["key"] == last) * total
        last, total = frame["key"].iloc[-1], int(sums.iloc[-1])
        yield frame.assign(upto=sums)


def _cuts(units: DataFrame, budgets: DataFrame) -> DataFrame:
    """(key, cut, drawn): the greatest odds taken by rank, and the words taken with them.

    ``units`` are (key, odds, words), ``budgets`` (key, budget).
    """
    placed = stored(
        units.repartitionByRange("key", "odds")
        .sortWithinPartitions("key", "odds")
        .mapInPandas(_running, "key string, odds double, words bigint, upto bigint")
        .withColumn("part", F.spark_partition_id()),
        "ranked",
    )
    # a row per partition, and one more per source
    parts = placed.groupBy("key", "part").agg(F.sum("words").alias("held"))
    offsets = parts.select("key", "part", (F.sum("held").over(Window.partitionBy("key").orderBy("part")) - F.col("held")).alias("offset"))
    offsets = stored(offsets.join(budgets, "key"), "offsets")
    ranked = placed.join(sent_if_small(offsets, offsets.count()), ["key", "part"]).withColumn("upto", F.col("offset") + F.col("upto"))
    return ranked.where("upto <= budget").groupBy("key").agg(F.max("odds").alias("cut"), F.max("upto").alias("drawn"))


def _draw(narrow: DataFrame, classes: DataFrame, goals: DataFrame, epochs: int) -> tuple[DataFrame, DataFrame]:
    """What decides for the documents of ``classes``: (key, class, whole, chance, cut); words spent: (key, spent)."""
    expected = _expected(classes, goals, epochs).withColumn("whole", F.floor("copies"))
    expected = stored(expected.withColumn("chance", F.col("copies") - F.col("whole")), "expected")
    certain = expected.groupBy("key", "goal").agg(F.sum(F.col("whole") * F.col("words")).alias("certain"))
    units = narrow.join(sent_if_small(expected.select("key", "class", "chance"), expected.count()), ["key", "class"]).withColumn("odds", _odds())
    units = units.where("odds IS NOT NULL").groupBy("key", "odds").agg(F.sum("size").alias("words"))
    cuts = stored(_cuts(units, certain.select("key", (F.round("goal").cast("bigint") - F.col("certain")).alias("budget"))), "cut")
    decided = expected.select("key", "class", "whole", "chance").join(cuts.drop("drawn"), "key", "left")
    spent = certain.join(cuts, "key", "left").select("key", (F.col("certain") + F.coalesce("drawn", F.lit(0))).alias("spent"))
    return decided, spent


def mix(measured: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``measured`` (doc_id, source, size, luck, any others) with ``source_size``, ``target``, ``copies`` and ``taken``.

    ``taken`` is copies times size: the words of the document in the mix. The words a source falls short of its target by
    after the draws are met as nearly as one document more can. Sources are told apart by name; null is one of its own. Documents without words
    have no copies. Rows that share luck and length class in a source (those that repeat a doc_id and a text) are taken
    together, each as often. The result depends on the rows alone, not on their order or partitioning. The new columns
    replace any of that name; others come through. An empty table gives an empty result.
    """
    new = ("source_size", "target", "copies", "taken")
    others = [c for c in measured.columns if c not in new]
    rows = measured.select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), _key(F.col("source")).alias("key"), _length_class(F.col("size")).alias("class"), F.col("luck"), F.col("size")
    )
    narrow = rows.select("key", F.col("row.source").cast("string").alias("source"), "class", "luck", "size")
    counted = stored(narrow.groupBy("key", "source", "class").agg(F.sum("size").alias("words")), "classes")
    targets = source_targets(counted.groupBy("key", "source").agg(F.sum("words").alias("source_size")), weights, epochs)
    targets = stored(targets, "targets")
    classes = counted.where("class > 0").select("key", "class", "words")

    aims = targets.select("key", F.col("target").alias("goal"))
    split = stored(_expected(classes, aims, epochs).withColumn("large", F.expr("shiftleft(1L, `class`)") * LARGE > F.col("goal")), "split")
    of_large = split.where("large").groupBy("key").agg(F.sum(F.col("copies") * F.col("words")).alias("goal"))
    first, spent = _draw(narrow, split.where("large"), of_large, epochs)
    spent = stored(spent, "spent")
    left = F.greatest(F.col("goal") - F.coalesce("spent", F.lit(0)), F.lit(0.0)).alias("goal")
    second, _ = _draw(narrow, split.where("NOT large"), aims.join(spent, "key", "left").select("key", left), epochs)
    decided = stored(first.unionByName(second), "decided")

    copies = F.coalesce(F.col("whole") + F.coalesce(_odds() <= F.col("cut"), F.lit(False)).cast("bigint"), F.lit(0).cast("bigint"))
    small = sent_if_small(decided, decided.count())
    closing = stored(_closing(narrow.join(small, ["key", "class"]).withColumn("copies", copies), targets, epochs), "closing")
    last = F.coalesce((F.col("last.class") == F.col("class")) & (F.col("last.luck") == F.col("luck")), F.lit(False))
    aimed = targets.join(closing, "key", "left")
    return (
        rows.join(sent_if_small(aimed, targets.count()), "key")
        .join(small, ["key", "class"], "left")
        .withColumn("copies", copies + last.cast("bigint"))
        .select(*[F.col("row")[c].alias(c) for c in others], "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def _closing(drawn: DataFrame, targets: DataFrame, epochs: int) -> DataFrame:
    """(key, last): luck and class of the document that brings its source closest to the target with one copy more."""
    gaps = targets.join(drawn.groupBy("key").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")), "key", "left")
    gaps = stored(gaps.select("key", (F.round("target").cast("bigint") - F.coalesce("taken", F.lit(0))).alias("gap")), "gaps")
    open_ = drawn.where((F.col("copies") < epochs) & (F.col("size") > 0)).join(sent_if_small(gaps, gaps.count()), "key").where("size < 2 * gap")
    units = open_.groupBy("key", "gap", "class", "luck").agg(F.sum("size").alias("words")).where("words < 2 * gap")
    return units.groupBy("key").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("words")).alias("off"), "luck", "class")).alias("last"))


def repeated(mixed: DataFrame) -> DataFrame:
    """Each row as often as the mix takes it."""
    many = F.when(F.col("copies") > 0, F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    return mixed.select(*[F.col(f"`{c}`") for c in mixed.columns], F.explode(many).alias("copy"))
