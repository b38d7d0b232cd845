import random

import numpy as np

from tests.llm.conftest import rows_of
from voxframe.llm import minhash as M
from voxframe.llm.components import components
from voxframe.llm.shingles import shingle_set


def brute(rows):
    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets = {k: grams(t) for k, t in rows}
    least = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    m = min(least[a], least[b])
                    changed |= least[a] != m or least[b] != m
                    least[a] = least[b] = m
    return sorted(((k, len(sets[k]), least[k], least[k] == k) for k in sets), key=repr)


def words(rng, n):
    return [f"w{rng.randint(0, 9999)}" for _ in range(n)]


def test_near_copies_against_brute_force(make):
    rng = random.Random(1)
    rows, base = [], [words(rng, rng.randint(30, 120)) for _ in range(8)]
    for k in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 999)}"
        rows.append((k, " ".join(w)))
    rows += [(90, "A few words"), (91, "a FEW words"), (92, "one"), (93, ""), (94, None), (95, "  \t"), (96, "Ä few"), (97, "ä few")]
    assert rows_of(M.near_duplicates(make(rows)), "doc_id", "n_shingles", "component_id", "kept") == brute(rows)


def test_texts_that_hardly_hold_more_than_a_frequent_passage(make):
    """All fall into the same buckets; links among them hang on a few words, and the last step must find them."""
    rng = random.Random(2)
    passage = words(rng, 60)
    rows = []
    for k in range(70):
        own = words(rng, rng.randint(0, 45))
        cut = rng.randint(0, len(own))
        rows.append((k, " ".join(own[:cut] + passage + own[cut:])))
    assert rows_of(M.near_duplicates(make(rows)), "doc_id", "n_shingles", "component_id", "kept") == brute(rows)


def test_repeated_rows_rows_without_id_and_clashing_columns(make):
    same = "one two three four five six seven"
    rows = [(3, same), (3, same), (7, same), (None, same), (None, None), (9, "other words here")]
    got = rows_of(M.near_duplicates(make(rows, extra=True)), "doc_id", "component_id", "kept")
    assert got == sorted([(3, 3, True), (3, 3, True), (7, 3, False), (None, None, True), (None, None, True), (9, 9, True)], key=repr)
    kept = M.drop_near_duplicates(make(rows, extra=True))
    assert rows_of(kept, "doc_id", "node", "n") == sorted(
        [(3, "a3", "g3"), (3, "a3", "g3"), (None, "aNone", "gNone"), (None, "aNone", "gNone"), (9, "a9", "g9")], key=repr
    )


def test_empty_table(make):
    assert M.near_duplicates(make([])).count() == 0
    assert M.drop_near_duplicates(make([])).columns == ["doc_id", "text"]


def test_min_max_estimates_jaccard():
    rng = np.random.default_rng(0)
    universe = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    a, b = np.unique(universe[:3000]), np.unique(universe[600:3600])
    x, y = (M.min_max(s, 512) for s in (a, b))
    assert abs((x == y).mean() - 2400 / 3600) < 0.05


def test_long_text_set():
    text = " ".join(f"w{i}" for i in range(50_000))
    assert len(shingle_set(text)) == 49_996


def test_components_of_a_chain_a_star_and_a_loop(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(6, 30)] + [(200, 200)] + [(29, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert got == {**{i: 100 for i in range(101, 161)}, **{k: 5 for k in range(6, 30)}}


def test_settled_links_need_no_round_and_small_buckets_no_rare_shingles(spark, make, monkeypatch):
    def unneeded(*_, **__):
        raise AssertionError("not needed")

    monkeypatch.setattr("voxframe.llm.components._star", unneeded)
    monkeypatch.setattr(M, "_by_rare_shingles", unneeded)
    links = [(k, 1) for k in range(2, 9)] + [(20, 30), (30, 20), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert got == {**{k: 1 for k in range(2, 9)}, 30: 20}
    rng = random.Random(3)
    rows = []
    for k in range(0, 12, 3):
        base = words(rng, 80)
        rows += [(k, " ".join(base)), (k + 1, " ".join([*base, "one"])), (k + 2, " ".join([*base, "two"]))]
    assert rows_of(M.near_duplicates(make(rows)), "doc_id", "n_shingles", "component_id", "kept") == brute(rows)
