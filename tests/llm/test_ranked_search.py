import collections
import math
import random
import re

import pytest

from tests.llm.conftest import rows_of
from voxframe.llm import ranked_search as S

ITEMS = "item_id bigint, text string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def brute(docs, items, k=10):
    """All (item, score, doc_id) above 0, best first, cut to k per item."""
    held = [(d, collections.Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(w for _, c in held for w in c)
    asked = collections.defaultdict(collections.Counter)
    for i, t in items:
        asked[i].update(terms(t))
    out = []
    for i, words in asked.items():
        scores = []
        for d, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            score = 0
            for w, times in words.items():
                if c[w]:
                    score += times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(i, nth + 1, None if none else d, -score) for nth, (score, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def topics(seed, n_docs, n_items):
    """Documents of a few topics with a common vocabulary; some items quote a document."""
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(30)]
    own = [[f"t{k}x{i}" for i in range(200)] for k in range(8)]

    def text(n):
        words = own[rng.randrange(8)]
        return " ".join(rng.choice(common) if rng.random() < 0.5 else words[min(int(rng.paretovariate(0.8)), 199)] for _ in range(n))

    docs = [(k, text(int(rng.paretovariate(1) * 8) % 400)) for k in range(n_docs)]
    items = [(i, text(25) if i % 2 else (rng.choice(docs)[1] + " " + text(9))[:300].title()) for i in range(n_items)]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(make, spark, seed):
    docs, items = topics(seed, 1200, 30)
    got = S.search(make(docs), spark.createDataFrame(items, ITEMS))
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == brute(docs, items)


def test_blocks_are_skipped_by_bounds_that_hold(make, spark):
    docs, items = topics(4, 1500, 24)
    bench = spark.createDataFrame(items, ITEMS)
    blocks = S.block_bounds(make(docs), bench).collect()
    assert 0 < sum(not b.kept for b in blocks)
    # no block is skipped that reaches the threshold, and no threshold is above the last result
    last = {}
    for i, _, _, score in brute(docs, items):
        last[i] = min(score, last.get(i, score))
    assert all(b.kept == (b.bound >= b.need) and b.need <= last[b.item_id] for b in blocks)


def test_ties_repeats_and_groups_of_copies(make, spark):
    """Many copies tie for the last place: the least ids win, whatever block they lie in."""
    docs = [(k, "alpha beta gamma") for k in range(400)] + [(k, f"alpha other{k} words") for k in range(400, 500)] + [(7, "alpha beta gamma")]
    items = [(1, "alpha beta"), (2, "other450 alpha alpha"), (2, "words"), (3, "absent")]
    got = S.search(make(docs), spark.createDataFrame(items, ITEMS))
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == brute(docs, items)
    assert got.where("item_id = 1 AND doc_id = 7").count() == 2


def test_nulls_empty_and_clashing_columns(make, spark):
    docs = [(1, None), (2, ""), (3, "?! ."), (None, "alpha beta"), (4, "Alpha É x1"), (5, "beta " * 40_000 + "alpha"), (6, "gamma delta")]
    items = [(1, "ALPHA beta É"), (2, None), (3, ""), (None, "x1 delta"), (5, "gamma")]
    bench = spark.createDataFrame([(*i, "x", 1) for i in items], ITEMS + ", row string, rank int")
    got = S.search(make(docs, extra=True), bench)
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == brute(docs, items)
    none = spark.createDataFrame([], ITEMS)
    assert S.search(make(docs), none).count() == 0
    assert S.search(make([]), bench).count() == 0
    assert S.search(make([(1, "?")]), bench).count() == 0


def test_slices_of_items(make, spark, monkeypatch):
    docs, items = topics(6, 300, 12)
    monkeypatch.setattr(S, "SLICE", 60)
    got = S.search(make(docs), spark.createDataFrame(items, ITEMS), 3)
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == brute(docs, items, 3)
