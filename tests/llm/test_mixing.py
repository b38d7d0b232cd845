import collections
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import rows_of
from voxframe.llm import mixing as M

SCHEMA = "doc_id bigint, text string, source string"


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Shares by weight; whoever is above the limit is set to it and the excess shared again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        above = {s for s in rest if share[s] > most * sizes[s]}
        if not above:
            return {**share, **{s: most * sizes[s] for s in full}}
        full |= above


def corpus(seed, n=600, sources=("a", "b", "c", "d", "é", "", None)):
    rng = random.Random(seed)
    at = [rng.choices(sources, [30, 1, 5, 9, 2, 4, 3][: len(sources)])[0] for _ in range(n)]
    return [(k, " ".join(["w"] * int(rng.paretovariate(0.9) * 9)), s) for k, s in enumerate(at)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_are_met(make, seed):
    rows = corpus(seed)
    got = M.mix(M.measure(make(rows, schema=SCHEMA))).collect()
    sizes = collections.Counter()
    for _, text, s in rows:
        sizes[s] += len(text.split())
    want = plain_targets(sizes)
    taken = collections.Counter()
    for r in got:
        assert r.size == len(rows[r.doc_id][1].split()) and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(rows)
    for s, words in want.items():
        largest = max(len(t.split()) for _, t, x in rows if x == s)
        # a source of which one document holds most words can only be met as its size allows
        assert abs(taken[s] - words) <= (0.01 * words + 1 if largest < 0.25 * sizes[s] else largest / 2)


def test_result_depends_on_rows_alone(make, spark):
    rows = corpus(7)
    docs = make(rows, schema=SCHEMA)
    first = rows_of(M.mix(M.measure(docs)), "doc_id", "copies")
    assert rows_of(M.mix(M.measure(docs.repartition(7, F.rand(3)))), "doc_id", "copies") == first
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert rows_of(M.mix(M.measure(docs)), "doc_id", "copies") == first
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_inclusion_follows_the_chances(make):
    """Of documents of one class, the share taken is that of the chance; longer classes are taken more often."""
    rows = [(k, " ".join(["w"] * (20 if k % 2 else 200)), "ab"[k % 10 == 0]) for k in range(4000)]
    got = M.mix(M.measure(make(rows, schema=SCHEMA))).where("source = 'a'").groupBy("size").agg(F.avg("copies").alias("copies")).collect()
    copies = {r["size"]: r["copies"] for r in got}
    # classes of 5 and 8 binary digits: the fourth root of their sizes' ratio
    assert abs(copies[200] / copies[20] - (2**8 / 2**5) ** 0.25) < 0.05


def test_whole_copies_and_repeats(make):
    rows = [(k, "w " * 10, "a") for k in range(10)] + [(100 + k, "w " * 100, "b") for k in range(10)]
    mixed = M.mix(M.measure(make(rows, schema=SCHEMA)))
    # a is full at three times its size, b gets what is left
    assert mixed.groupBy("source").agg(F.sum("taken").alias("t")).orderBy("source").collect()[0].t == 300
    assert rows_of(mixed.where("source = 'a'"), "copies") == [(3,)] * 10
    assert M.repeated(mixed).count() == mixed.agg(F.sum("copies")).first()[0]


def test_nulls_empty_repeats_and_clashing_columns(make):
    rows = [(1, None, "a"), (2, "", "a"), (None, "x y", None), (None, "x z", None), (3, "p q r", "a"), (3, "p q r", "a"), (4, "é " * 50_000, "b")]
    docs = make(rows, extra=True, schema=SCHEMA).withColumn("taken", F.lit("theirs")).withColumn("key", F.lit("k"))
    mixed = M.mix(M.measure(docs))
    assert mixed.count() == len(rows) and set(docs.columns) | {"size", "luck", "source_size", "target", "copies"} == set(mixed.columns)
    by_id = collections.defaultdict(list)
    for r in mixed.collect():
        by_id[r.doc_id].append((r["size"], r.copies))
    assert by_id[1] == by_id[2] == [(0, 0)] and by_id[4][0][0] == 50_000
    assert by_id[3][0] == by_id[3][1]
    assert [r.k for r in mixed.select(F.col("key").alias("k")).collect()] == ["k"] * len(rows)
    assert M.mix(M.measure(make([], schema=SCHEMA))).count() == 0
    assert rows_of(M.mix(M.measure(make([(1, None, None), (2, " ", "a")], schema=SCHEMA))), "doc_id", "target", "taken") == [(1, 0.0, 0), (2, 0.0, 0)]
