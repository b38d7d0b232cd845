import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import rows_of
from voxframe.llm import queries
from voxframe.llm import runs as R


def brute(words):
    """Runs as (start, length, smallest period), period by period and word by word."""
    n, found = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(24, 3 * p):
                found.setdefault((i, j + p), p)
            i = j + 1 if j == i else j
    return sorted((s, e - s, p) for (s, e), p in found.items())


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic(rng):
    words = [f"w{rng.randint(0, rng.choice([1, 2, 5, 50]))}" for _ in range(rng.randint(0, 150))]
    for _ in range(rng.randint(0, 3)):
        if words:
            at, p = rng.randrange(len(words)), rng.randint(1, 30)
            words[at:at] = (words[at : at + p] * rng.randint(2, 9))[: rng.randint(1, 120)]
    return words


def test_against_brute_force(make):
    rng = random.Random(3)
    texts = [periodic(rng) for _ in range(300)]
    texts += [list(t) for t in texts[:20]]
    docs = make([(k, "  ".join(t) + "\n") for k, t in enumerate(texts)])
    seen = 0
    for r in R.find_runs(docs).collect():
        want = brute(texts[r.doc_id])
        seen += len(want)
        assert [tuple(x) for x in r.runs] == sorted(want, key=lambda x: (x[0], x[2]))
        assert r.collapsed == collapsed(texts[r.doc_id], want)
        assert r.n_words == len(texts[r.doc_id])
    assert seen > 100


def test_common_prefixes_of_two_places():
    rng = random.Random(5)
    for _ in range(60):
        words = np.array([rng.randint(0, rng.choice([0, 1, 3])) for _ in range(rng.randint(1, 300))] + [9])
        lce = R.Lce(words)
        pairs = sorted({tuple(sorted(rng.sample(range(len(words)), 2))) for _ in range(200)}) if len(words) > 1 else []
        i, j = (np.array(x) for x in zip(*pairs))
        for a, b, got in zip(i, j, lce(i, j)):
            k = 0
            while b + k < len(words) and words[a + k] == words[b + k]:
                k += 1
            assert k == got


def test_every_difference_has_a_synchronised_pair():
    for i in range(R.CYCLE):
        for d in range(R.CYCLE):
            steps = R._SYNC[i, d]
            assert (i + steps) % R.CYCLE in R.COVER and (i + d + steps) % R.CYCLE in R.COVER


def test_long_texts_alone_and_in_lots(make):
    rng = random.Random(9)
    long = [f"w{int(min(rng.paretovariate(0.7), 1e5))}" for _ in range(70_000)]
    long[1000:61000] = long[1000:7000] * 10
    docs = make([(1, " ".join(long)), (2, "x " * 30_000), (3, " ".join(long[:30_000])), (4, "a b c")])
    got = {r.doc_id: r for r in R.find_runs(docs).collect()}
    assert any(s <= 1000 and s + n >= 61_000 and p == 6000 for s, n, p in got[1].runs)
    assert [tuple(x) for x in got[2].runs] == [(0, 30_000, 1)] and got[2].collapsed == "x"
    assert any(s <= 1000 and s + n == 30_000 and p == 6000 for s, n, p in got[3].runs)
    assert got[4].collapsed == "a b c"


def test_nulls_blank_repeats_and_clashing_columns(make):
    run = "one two three " * 8
    docs = make([(1, run), (1, run), (None, run), (2, None), (3, ""), (4, " \n\t "), (5, "é " * 24)], extra=True)
    found = R.find_runs(docs.withColumn("runs", F.lit("theirs")))
    assert found.columns == [c for c in docs.columns if c != "text"] + ["n_words", "runs", "collapsed"]
    want = [(1, 24, "one two three"), (1, 24, "one two three"), (2, 0, ""), (3, 0, ""), (4, 0, ""), (5, 24, "é"), (None, 24, "one two three")]
    assert rows_of(found, "doc_id", "n_words", "collapsed") == sorted(want, key=repr)
    assert rows_of(found.where("doc_id = 2"), "hash") == [("e2",)]
    assert R.find_runs(make([])).count() == 0


def test_greatest_run_is_compared_exactly(spark):
    rows = [([(0, 30, 9), (40, 40, 12), (90, 24, 7)],), ([(5, 24, 8), (50, 48, 16), (2, 27, 9)],), ([],)]
    df = spark.createDataFrame(rows, "runs array<struct<start:bigint,length:bigint,period:bigint>>")
    got = [r.best and tuple(r.best) for r in df.select(R.greatest_run(F.col("runs")).alias("best")).collect()]
    assert got == [(90, 24, 7), (5, 24, 8), None]


def test_planted_period(make):
    import zlib

    texts = {k: " ".join(f"{k}_{i}" for i in range(k % 7 * 20)) for k in range(60)}
    docs = make(list(texts.items()))
    planted = 0
    for r in docs.select("doc_id", queries.with_planted_period(docs).alias("made")).collect():
        words = texts[r.doc_id].split()
        h, n = zlib.crc32(str(r.doc_id).encode()), len(texts[r.doc_id].split())
        if h % 10 == 0 and n:
            g = h // 10
            a, planted = g % n, planted + 1
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        assert r.made.split() == words
    assert planted
