import random

import numpy as np
import pytest

from tests.llm.conftest import rows_of
from voxframe.llm import quality as Q
from voxframe.llm import toxicity as T


def auc(labels, scores):
    order = np.argsort(np.argsort(scores)) + 1
    pos = np.asarray(labels) == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def prose(rng, n):
    return ["".join(rng.choice(["ka", "lo", "mi", "re", "tu", "sen", "dor"]) for _ in range(rng.randint(1, 3))) for _ in range(n)]


def toxic_texts(rng, n, insults):
    out = []
    for k in range(n):
        w = prose(rng, rng.randint(8, 60))
        if k % 3 == 0:
            for _ in range(1 + len(w) // 30):
                w.insert(rng.randint(0, len(w)), rng.choice(insults))
        out.append((k, " ".join(w), int(k % 3 == 0)))
    return out


def test_toxicity_learns_and_knows_misspellings(spark):
    rng = random.Random(1)
    train, held = toxic_texts(rng, 400, ["blockhead", "numskull"]), toxic_texts(rng, 200, ["blockheed", "numbskull", "Blokhead!"])
    docs = spark.createDataFrame([(k, t) for k, t, _ in train], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in train] + [(None, 1), (1, None), (9999, 1)], "doc_id bigint, label int")
    model = T.train(docs, labels)
    scores = model.scores([t for _, t, _ in held])
    assert auc([y for *_, y in held], scores) > 0.95
    assert ((scores >= 0) & (scores <= 1)).all()


def test_toxicity_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k, "some words " * (1 + k)) for k in range(60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id bigint, label int")
    seen = []
    fit = T.fit
    try:
        T.fit = lambda texts, y, w: seen.extend([texts, y, w]) or fit(texts, y, w)
        T.train(docs, labels, rows=10, chars=300)
    finally:
        T.fit = fit
    assert len(seen[0]) <= 20 and all(len(t) <= 300 for t in seen[0])
    assert (seen[2] * (seen[1] == 1)).sum() == pytest.approx(30)


def test_toxicity_scores_of_odd_texts_and_tables(spark, make):
    rng = random.Random(2)
    train = toxic_texts(rng, 120, ["blockhead"])
    model = T.fit([t for _, t, _ in train], np.array([y for *_, y in train]), np.ones(120))
    rows = [(1, None), (2, ""), (3, "!? ..."), (4, "a blockhead"), (4, "a blockhead"), (None, "a blockhead"), (5, "lo mi re " * 60_000)]
    got = T.score_toxicity(make(rows, extra=True), model, "score")
    assert got.columns == make(rows, extra=True).columns
    by = {r.doc_id: r.score for r in got.collect()}
    assert by[1] == by[2] == by[3] == pytest.approx(1 / 3, abs=1e-9)
    assert by[4] == by[None] > 0.5 and by[5] < 0.3
    assert [r[0] for r in rows_of(got.where("doc_id = 5"), "node")] == ["a5"]
    assert T.score_toxicity(make([]), model).count() == 0


def test_toxicity_batches_do_not_change_scores():
    rng = random.Random(3)
    train = toxic_texts(rng, 60, ["blockhead"])
    texts = [t for _, t, _ in train] + ["", "x", "é" * 30]
    model = T.fit(texts[:60], np.array([y for *_, y in train]), np.ones(60))
    alone = np.array([model.scores([t])[0] for t in texts])
    assert np.allclose(alone, model.scores(texts))


def test_toxicity_of_one_class_or_none(spark, make):
    nothing = spark.createDataFrame([], "doc_id bigint, label int")
    model = T.train(make([(1, "a")]), nothing)
    assert model.scores(["a", ""]).tolist() == pytest.approx([0, 0], abs=1e-5)
    only = T.train(make([(1, "a")]), spark.createDataFrame([(1, 1)], "doc_id bigint, label int"))
    assert only.scores(["a", ""]).tolist() == pytest.approx([1, 1], abs=1e-5)


def quality_rows(rng, n):
    out = []
    for k in range(n):
        w = prose(rng, rng.randint(20, 80))
        good = k % 4 != 0
        if not good:
            w = [x.upper() + "!!" for x in w] if k % 8 else [x + "%%%" for x in w]
        out.append((k, " ".join(w), int(good)))
    return out


def test_quality_held_out(spark):
    rng = random.Random(4)
    rows = quality_rows(rng, 500)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id bigint, text string")
    measured = Q.measure(docs)
    model = Q.train(measured, spark.createDataFrame([(k, y) for k, _, y in rows if k % 5], "doc_id bigint, label int"))
    got = {r.doc_id: r.quality for r in Q.score_measured(measured, model).collect()}
    held = [(y, got[k]) for k, _, y in rows if k % 5 == 0]
    assert auc([y for y, _ in held], [s for _, s in held]) > 0.97
    assert all(0 <= s <= 1 for s in got.values())
    assert abs(np.mean(list(got.values())) - 0.75) < 0.05


def test_quality_normal_equations_equal_plain_ridge(spark):
    """What partitions sum is what one matrix product gives."""
    rng = random.Random(5)
    rows = quality_rows(rng, 80)
    measured = Q.measure(spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id bigint, text string").repartition(5))
    model = Q.train(measured, spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id bigint, label int"))
    z = model.cosines(np.stack([Q.statistics(t) for _, t, _ in rows]))
    y = np.array([y for *_, y in rows])
    penalty = Q.RIDGE * len(rows) * np.eye(Q.FEATURES + 1) * 2 / Q.FEATURES
    penalty[-1, -1] = 1e-9
    assert np.allclose(z @ np.linalg.solve(z.T @ z + penalty, z.T @ y), z @ model.weights, atol=1e-6)


def test_cosines_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(0)
    n = len(Q.STATISTICS)
    model = Q.Model(np.zeros(n), np.ones(n), rng.normal(0, 1 / Q.WIDTH, (n, 20_000)), rng.uniform(0, 2 * np.pi, 20_000), None, None, None)
    x = rng.normal(0, 1, (6, n))
    z = model.cosines(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * Q.WIDTH**2))
    assert np.allclose(z @ z.T, kernel, atol=0.05)


def test_pool_adjacent_violators_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(30):
        totals = rng.integers(1, 9, 7)
        hits = np.array([rng.integers(0, t + 1) for t in totals])
        edges, values = Q.pool_adjacent_violators(np.arange(7.0), hits, totals)
        shares = hits / totals
        # the max-min formula of isotonic regression
        want = [
            max(min((hits[i:j].sum() / totals[i:j].sum()) for j in range(k + 1, 8)) for i in range(k + 1)) for k in range(7)
        ]
        assert (np.diff(values) > 0).all() and set(np.round(values, 9)) == set(np.round(want, 9)) and len(shares) == 7


def test_quality_of_odd_texts_and_tables(spark, make):
    assert Q.train(Q.measure(make([(1, "a")])), spark.createDataFrame([], "doc_id bigint, label int")) is None
    rows = [(1, None), (2, ""), (3, " \n"), (4, "word"), (4, "word"), (5, "many words " * 50_000)]
    docs = make(rows)
    model = Q.train(Q.measure(docs), spark.createDataFrame([(1, 0), (2, 1), (4, 1), (5, 1), (None, 1), (3, None)], "doc_id bigint, label int"))
    got = Q.score_quality(docs.selectExpr("*", "'s' AS stats"), model)
    assert got.columns == ["doc_id", "text", "stats", "quality"]
    by = {r.doc_id: (r.stats, r.quality) for r in got.collect()}
    assert by[1] == by[2] and all(0 <= q <= 1 and s == "s" for s, q in by.values())
    assert Q.score_quality(make([]), model).count() == 0
    assert [r.quality for r in Q.score_quality(docs, None).collect()] == [0.5] * 6
