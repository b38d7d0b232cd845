"""Repeated runs of lines, found by a suffix array over line ids and deleted where they come again.

The lines of a document are a sequence of ids; blank lines are left out of it. The suffixes of all sequences are ranked
by prefix doubling: a suffix's rank for its first 2h lines follows from the pair of its rank for h lines and the rank h
lines on. Each round counts the distinct pairs (partial sums first, so a line that a third of the corpus shares is one
row), sorts these by range, and turns running counts into ranks: the rank is the suffix array place where the suffixes
with that prefix begin. Suffixes of one rank after depth h are an interval of the array whose longest common prefix
is at least h. A suffix that is alone keeps its place and goes on only as a neighbour.

Doubling goes on until every suffix is alone or equal to the others of its interval up to its end; documents without an
interval that goes on leave the rounds. At each depth from ``min_lines`` on, the later suffixes of an interval begin a
repeated run of that many lines. Spans that meet or overlap make up the maximal runs, which are cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.llm.common import stored

MIN_LINES = 2
#: One line alone counts as a run if it has so many characters.
MIN_CHARS = 200
NOT_BLANK = r"[^\x20\x09-\x0D]"
_DOC = ["doc_id", "form"]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_ids(docs: DataFrame) -> DataFrame:
    """A row per line that is not blank: doc_id, form (tells apart texts under one doc_id), seq, id (two hashes), chars, n_lines.

    Rows equal in doc_id and text are one sequence.
    """
    spoken = F.filter(_lines(F.col("text")), lambda x: x.rlike(NOT_BLANK))
    hashed = F.transform(spoken, lambda x: F.struct(F.xxhash64(x).alias("k1"), F.xxhash64(F.lit(1), x).alias("k2"), F.length(x).alias("chars")))
    # hashes, not texts, are shuffled
    return (
        docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("form"), hashed.alias("hashed"))
        .groupBy(*_DOC)
        .agg(F.first("hashed").alias("hashed"))
        .select("doc_id", "form", F.size("hashed").alias("n_lines"), F.posexplode("hashed").alias("seq", "line"))
        .select("doc_id", "form", "n_lines", "seq", "line.k1", "line.k2", "line.chars")
    )


def _running(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Within a sorted partition, how many suffixes of the same base come before each key; ``upto`` counts those of all."""
    total, last, begun = 0, None, 0
    for frame in frames:
        if frame.empty:
            continue
        base, counts = frame["base"].to_numpy(), frame["members"].to_numpy()
        upto = total + np.cumsum(counts)
        opens = np.concatenate([[base[0] != last], base[1:] != base[:-1]])
        first = np.maximum.accumulate(np.where(opens, upto - counts, begun))
        yield frame.assign(before=upto - counts - first, upto=upto)
        total, last, begun = int(upto[-1]), base[-1], int(first[-1])


def _ranked(rows: DataFrame) -> DataFrame:
    """``rank`` in place of (base, k1, k2): where the suffixes with that key begin in the interval at ``base``; ``members``, how many there are."""
    keys = rows.groupBy("base", "k1", "k2").agg(F.count("*").alias("members"))
    placed = stored(
        keys.repartitionByRange("base", "k1", "k2")
        .sortWithinPartitions("base", "k1", "k2")
        .mapInPandas(_running, "base bigint, k1 bigint, k2 bigint, members bigint, before bigint, upto bigint")
        .withColumn("part", F.spark_partition_id()),
        "ranks",
    )
    # one row per partition: only its last interval can go on in the next one
    ends = placed.groupBy("part").agg(F.max_by("base", "upto").alias("base"), F.max_by(F.col("before") + F.col("members"), "upto").alias("held"))
    carried = ends.select(
        F.lead("part").over(Window.orderBy("part")).alias("part"),
        "base",
        F.sum("held").over(Window.partitionBy("base").orderBy("part")).alias("carried"),
    ).where("part IS NOT NULL")
    ranks = placed.join(F.broadcast(carried), ["part", "base"], "left").select(
        "base", "k1", "k2", "members", (F.col("base") + F.col("before") + F.coalesce("carried", F.lit(0))).alias("rank")
    )
    return rows.join(ranks, ["base", "k1", "k2"]).drop("base", "k1", "k2")


def _goes_on(h: int) -> Column:
    """Whether a suffix ties after ``h`` lines and has more of them: a tie at the end of a sequence is settled."""
    return (F.col("members") > 1) & (F.col("seq") + h < F.col("n_lines"))


def _paired(suffixes: DataFrame, h: int, shift: int) -> DataFrame:
    """Suffixes ranked for ``h`` lines, stored with ``ahead``, the rank ``shift`` lines on (0 where the sequence ends), and whether
    their document has one that goes on (``open``).
    """
    document = Window.partitionBy(*_DOC)
    ahead = F.coalesce(F.lead("rank", shift).over(document.orderBy("seq")), F.lit(0))
    return stored(suffixes.select("*", ahead.alias("ahead"), F.max(_goes_on(h)).over(document).alias("open")), "suffixes")


def _first_ranks(docs: DataFrame, shift: int) -> DataFrame:
    return _paired(_ranked(stored(line_ids(docs).withColumn("base", F.lit(1).cast("long")), "lines")), 1, shift)


def _deeper(paired: DataFrame, h: int, shift: int) -> DataFrame:
    """Of paired suffixes those ranked for ``h`` lines now, paired for ``shift`` more. Alone is alone; where the sequence ends, the end sorts first."""
    columns = ["doc_id", "form", "n_lines", "seq", "rank", "members"]
    tied = F.col("members") > 1
    again = paired.where(tied).select("doc_id", "form", "n_lines", "seq", F.col("rank").alias("base"), F.col("ahead").alias("k1"), F.lit(0).cast("long").alias("k2"))
    return _paired(paired.where(~tied).select(columns).unionByName(_ranked(again).select(columns)), h, shift)


def suffix_array(docs: DataFrame, depth: int | None = None) -> tuple[DataFrame, int]:
    """(doc_id, form, seq, n_lines, rank, members) and the depth reached.

    Equal ranks share their first ``depth`` lines, or all lines to the end of the sequence. Without ``depth`` doubling
    goes on until every suffix is alone or ties only with suffixes equal to their end.
    """

    def step(h: int) -> int:
        return h if depth is None or depth <= h else min(h, depth - h)

    suffixes, h = _first_ranks(docs, step(1)), 1
    while depth is None or h < depth:
        if depth is None and suffixes.where("open").isEmpty():
            break
        h += step(h)
        suffixes = _deeper(suffixes, h, step(h))
    return suffixes.drop("ahead", "open"), h


def _later(suffixes: DataFrame, long: Column, covers: int) -> DataFrame:
    """(doc_id, form, seq, upto): stretches covered by intervals of which the suffix is not the first."""
    tied = suffixes.where((F.col("members") > 1) & long).select("doc_id", "form", "seq", "rank")
    first = tied.groupBy("rank").agg(F.min(F.struct("doc_id", "form", "seq")).alias("first"))
    here = F.struct("doc_id", "form", "seq")
    return (
        tied.join(first, "rank")
        .where(~here.eqNullSafe(F.col("first")))
        .select("doc_id", "form", "seq", (F.col("seq") + covers).alias("upto"))
    )


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> tuple[DataFrame, int]:
    """(doc_id, form, start, n_lines), maximal stretches of lines that come again, and the depth at which ties ended.

    Lines that are not blank are numbered from 0. Stretches that touch count as one. Documents none of whose suffixes
    goes on are left out of the next round: what ties deeper with another suffix has gone on before.
    """

    def step(h: int) -> int:
        return min(h, min_lines - h) if h < min_lines else h

    suffixes, h = _first_ranks(docs, step(1)), 1
    # spans are stored at each depth, so that no plan grows with the number of rounds
    spans = [stored(_later(suffixes, F.lit(True) if min_lines == 1 else F.col("chars") >= min_chars, 1), "spans")]
    while not (rest := suffixes.where("open")).isEmpty():
        h += step(h)
        suffixes = _deeper(rest, h, step(h))
        if h >= min_lines:
            spans.append(stored(_later(suffixes, F.col("seq") + h <= F.col("n_lines"), h), "spans"))
    found = reduce(DataFrame.union, spans)
    document = Window.partitionBy(*_DOC).orderBy("seq")
    before = F.max("upto").over(document.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("seq") > F.col("before"), F.lit(True)).cast("int")
    numbered = found.withColumn("before", before).withColumn("run", F.sum(opens).over(document.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy(*_DOC, "run").agg(F.min("seq").alias("start"), F.max("upto").alias("upto"))
    return runs.select(*_DOC, "start", (F.col("upto") - F.col("start")).alias("n_lines")), h


def repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, form, seqs): per text the numbers, among its lines that are not blank, of lines that come again."""
    runs, _ = repeated_runs(docs, min_lines, min_chars)
    lines = F.sequence("start", F.col("start") + F.col("n_lines") - 1)
    return runs.groupBy(*_DOC).agg(F.flatten(F.collect_list(lines)).alias("seqs"))


def dedup_lines(
    docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, before: str = "lines_before", removed: str = "lines_removed"
) -> DataFrame:
    """``docs`` (doc_id, text, any other columns) with later copies of repeated line runs cut from the texts.

    A run is ``min_lines`` or more consecutive lines, or one line of ``min_chars`` or more characters, that stands at
    two places or more; of these the first in order of (doc_id, text, line) stays. Copies may overlap: of a line that
    follows itself many times one stays. Blank lines are neither part of a run nor deleted. Adds the columns ``before``
    and ``removed``, numbers of lines, in place of any of that name. Null and empty texts have no runs and stay as they are; rows equal in doc_id and text are one
    document and cut alike; rows without doc_id come first in order. An empty table gives an empty result.
    """
    found = stored(repeated_lines(docs.select("doc_id", "text"), min_lines, min_chars), "repeated")
    rows = docs.select(
        F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("form"), F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    ).alias("rows")
    # the spans grow with the corpus: one plan at every size
    same = F.col("rows.doc_id").eqNullSafe(F.col("found.doc_id")) & (F.col("rows.form") == F.col("found.form"))
    joined = rows.join(found.hint("merge").alias("found"), same, "left").select("rows.text", "row", "seqs")
    cut = F.expr(
        r"""transform(array(split(text, '\n', -1)), lines ->
              transform(array(filter(sequence(0, size(lines) - 1), i -> lines[i] RLIKE '[^\\x20\\x09-\\x0D]')), spoken ->
                array_join(transform(array_except(sequence(0, size(lines) - 1), transform(seqs, s -> spoken[s])), i -> lines[i]), '\n'))[0])[0]"""
    )
    text = F.when(F.col("seqs").isNull(), F.col("text")).otherwise(cut).alias("text")
    return joined.select(
        *[text if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in (before, removed)],
        F.size(_lines(F.col("text"))).cast("long").alias(before),
        F.coalesce(F.size("seqs"), F.lit(0)).cast("long").alias(removed),
    )
