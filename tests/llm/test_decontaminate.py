import random
import re

from tests.llm.conftest import rows_of
from voxframe.llm import decontaminate as D


def brute(docs, items, percent=75):
    def words(t):
        return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]

    out = []
    for k, t in docs:
        w = words(t)
        for i, item in items:
            v = words(item)
            n = min(5, len(v))
            if n:
                held = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
                grams = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)}
                if 100 * len(grams & held) >= percent * len(grams):
                    out.append((k, i, len(grams & held), len(grams)))
    return sorted(out, key=repr)


def test_against_brute_force(make, spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([2, 4, 5, 9, 30, 70])))) for i in range(20)]
    docs = []
    for k in range(60):
        parts = rng.choices(vocabulary, k=rng.randint(0, 300))
        if k % 2:
            inside = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, 4)):
                inside[rng.randrange(len(inside))] = "zz"
            at = rng.randint(0, len(parts))
            parts[at:at] = inside
        docs.append((k, ", ".join(parts).title()))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = D.find_contaminated(make(docs, extra=False), bench)
    assert rows_of(got, "doc_id", "item_id", "n_shared", "n_item") == brute(docs, items)
    assert len(brute(docs, items)) > 10


def test_nulls_empty_repeats_and_clashing_columns(make, spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    docs = [(1, f"before {item} after"), (1, "nothing"), (2, None), (3, ""), (None, item.upper()), (4, "clean text of seven words that stays")]
    bench = spark.createDataFrame([(0, item, "x"), (0, item, "y"), (1, None, ""), (2, "", ""), (3, "?!", "")], "item_id bigint, text string, gram string")
    got = rows_of(D.find_contaminated(make(docs, extra=False), bench), "doc_id", "item_id", "containment")
    assert got == [(1, 0, 1.0), (None, 0, 1.0)]
    kept = D.decontaminate(make(docs, extra=True).drop("item_id"), bench)
    assert rows_of(kept, "doc_id", "hash") == [(2, "e2"), (3, "e3"), (4, "e4")]


def test_empty_tables(make, spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert D.find_contaminated(make([(1, "a b c d e")]), none).count() == 0
    assert D.decontaminate(make([(1, "a b c d e")]), none).count() == 1
    assert D.decontaminate(make([]), spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")).count() == 0


def test_sketch_of_each_size_partition_meets_every_containment(spark):
    """Whatever quarter of an item is missing, one hash of its sketch is left."""
    for size in (1, 2, 3, 4, 7, 8, 15, 16, 31, 32, 100):
        item = spark.createDataFrame([(0, list(range(size)))], "item_id bigint, hashes array<bigint>")
        k = D.sketches(item).count()
        most_missing = size - -(-75 * size // 100)
        assert k == size or k > most_missing


def test_no_python_in_the_plan(make, spark):
    bench = spark.createDataFrame([(0, "alpha beta gamma delta epsilon zeta")], "item_id bigint, text string")
    plan = D.find_contaminated(make([(1, "x")]), bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan
