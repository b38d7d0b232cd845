import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxframe.functions import edits as E
from voxframe.functions import scoring as S
from voxframe.functions.text import words
from voxframe.operators.pairing import pair_left
from voxframe.operators.scores import coverage, raw_wer, score_systems, system_summary


def table_counts(ref, hyp, compat):
    """Plain table with the way back, a cell at a time."""
    m, n = len(ref), len(hyp)
    d = [[i + j if not i * j else 0 for j in range(n + 1)] for i in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            best = min(d[i - 1][j - 1], d[i - 1][j], d[i][j - 1]) + 1
            d[i][j] = d[i - 1][j - 1] if ref[i - 1] == hyp[j - 1] else best
    i, j, s, x, y = m, n, 0, 0, 0
    while i and j:
        if ref[i - 1] == hyp[j - 1]:
            i, j = i - 1, j - 1
        elif d[i][j] == d[i - 1][j - 1] + 1:
            s, i, j = s + 1, i - 1, j - 1
        elif d[i][j] == d[i - 1][j] + 1:
            x, i = x + 1, i - 1
        else:
            y, j = y + 1, j - 1
    if compat:
        return d[m][n], s, x + bool(i), y + (not i)
    return d[m][n], s, x + i, y + j


tokens = st.lists(st.sampled_from("abcd"), max_size=14)


@settings(max_examples=600, deadline=None)
@given(tokens, tokens, st.booleans(), st.sampled_from([2, 5, 2048]))
def test_edit_counts_equal_the_plain_table(ref, hyp, compat, block):
    kept, E.BLOCK = E.BLOCK, block
    try:
        assert E.edit_counts(ref, hyp, compat) == table_counts(ref, hyp, compat)
    finally:
        E.BLOCK = kept
    d, s, x, y = E.edit_counts(ref, hyp)
    assert d == s + x + y == E.distance(ref, hyp) == E.distance(hyp, ref)
    assert abs(len(ref) - len(hyp)) <= d <= max(len(ref), len(hyp))


texts = st.text("abé日😀", max_size=150)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(texts, texts), max_size=12), st.sampled_from([1, 64, 8192]), st.sampled_from([40, 2048]))
def test_distances_side_by_side(pairs, words_at_once, longest):
    kept = E.SIDE_BY_SIDE_WORDS, E.SIDE_BY_SIDE_LENGTH, E.TABLE_WORDS, E.SIDE_BY_SIDE_LEAST
    E.SIDE_BY_SIDE_WORDS, E.SIDE_BY_SIDE_LENGTH, E.TABLE_WORDS, E.SIDE_BY_SIDE_LEAST = words_at_once, longest, 200, 2
    try:
        assert E.distances(pairs) == [table_counts(a, b, False)[0] for a, b in pairs]
    finally:
        E.SIDE_BY_SIDE_WORDS, E.SIDE_BY_SIDE_LENGTH, E.TABLE_WORDS, E.SIDE_BY_SIDE_LEAST = kept


def test_long_lists_across_blocks():
    rng = random.Random(5)
    ref = [rng.randrange(40) for _ in range(700)]
    hyp = [t for t in ref if rng.random() > 0.1] + [rng.randrange(40) for _ in range(50)]
    kept, E.BLOCK = E.BLOCK, 64
    try:
        assert E.edit_counts(ref, hyp) == table_counts(ref, hyp, False)
    finally:
        E.BLOCK = kept


def test_hand_derived_pairs(spark):
    pairs = [("a b c d", "a x c"), ("a b", "a b"), ("", "a"), ("a b", ""), (None, "a")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, r string, h string").orderBy("i")

    def stats(compat):
        edits = S.pair_edits(F.col("r"), F.col("h"), compat)
        rows = df.withColumn("e", edits).select(S.wer_stats(F.col("r"), F.col("h"), F.col("e"), compat).alias("w"))
        return [
            (r.w.distance, r.w.ref_words, r.w.substitutions, r.w.deletions, r.w.insertions, r.w.wer)
            for r in rows.collect()[:4]
        ]

    assert stats(False) == [(2, 4, 1, 1, 0, 0.5), (0, 2, 0, 0, 0, 0.0), (0, 0, 0, 0, 0, 1.0), (2, 2, 0, 2, 0, 1.0)]
    assert stats(True) == [(2, 4, 1, 1, 1, 0.5), (0, 2, 0, 0, 1, 0.0), (0, 0, 0, 0, 0, 1.0), (2, 2, 0, 0, 0, 1.0)]


def test_cer(spark):
    df = spark.createDataFrame([(0, "ab c", "abd"), (1, "a b", ""), (2, "", "x"), (3, "é日", "e日")], "i int, r string, h string")
    rows = df.orderBy("i").withColumn("d", S.char_distance("r", "h")).select(
        S.cer_stats(F.col("r"), F.col("h"), F.col("d")).alias("c")
    )
    got = [tuple(r.c) for r in rows.collect()]
    assert got == [(1, 3, 3, pytest.approx(1 / 3)), (3, 3, 0, 1.0), (0, 0, 0, 1.0), (1, 2, 2, 0.5)]


def test_edit_ops_on_arrays(spark):
    df = spark.createDataFrame([("a b c", "a c d")], "r string, h string")
    got = df.select(S.edit_ops(words(F.col("r")), words(F.col("h"))).alias("e")).first().e
    assert tuple(got) == table_counts("abc", "acd", False)


SYSTEMS = {"one": "h1", "two": "h2", "three": "h3"}


def test_systems_with_missing_hypotheses(spark):
    df = spark.createDataFrame(
        [("u1", "A, b c d!", "a b c d", "a x", None), ("u2", "e f", "e", "", None)],
        "utt_id string, ref string, h1 string, h2 string, h3 string",
    )
    rows = {r.system: r for r in system_summary(score_systems(df, SYSTEMS), [*SYSTEMS, "four"]).collect()}
    assert (rows["one"].n_files, rows["one"].n_scored, rows["one"].wer) == (2, 2, 25.0)
    assert rows["one"].del_rate == 25.0 and rows["one"].sub_rate == 0.0
    assert rows["two"].wer == pytest.approx((0.75 + 1.0) / 2 * 100)
    assert (rows["three"].n_scored, rows["three"].n_missing, rows["three"].wer) == (0, 2, None)
    assert (rows["four"].n_files, rows["four"].wer) == (0, None)
    compat = {r.system: r for r in system_summary(score_systems(df, SYSTEMS, compat=True), list(SYSTEMS)).collect()}
    assert (compat["three"].n_scored, compat["three"].wer, compat["three"].cer, compat["three"].del_rate) == (2, 100.0, 100.0, 0.0)


def test_language_column_and_compound_key(spark):
    df = spark.createDataFrame(
        [(1, "a", "إلى", "الي", "ar"), (1, "b", "It's", "its", "en")], "k int, l string, ref string, h string, lang string"
    )
    got = score_systems(df, {"s": "h"}, F.col("lang"), ["k", "l"]).select("k", "l", "wer").collect()
    assert sorted(tuple(r) for r in got) == [(1, "a", 0.0), (1, "b", 0.0)]


def test_folder_comparison(spark):
    refs = spark.createDataFrame([("a", "x y"), ("b", "z"), ("c", "")], "utt_id string, ref_text string")
    hyps = spark.createDataFrame([("a", "x"), ("c", "q"), ("d", "w")], "utt_id string, hyp_text string")
    scored = raw_wer(pair_left(refs, hyps))
    rows = {r.utt_id: (r.wer, r.status) for r in scored.collect()}
    assert rows == {"a": (0.5, "scored"), "b": (None, "no_hypothesis"), "c": (None, "empty_ref")}
    found = coverage(scored).first()
    assert (found.n_refs, found.n_matched, found.n_unmatched, found.mean_wer) == (3, 2, 1, 0.5)
    assert found.pct_unmatched == pytest.approx(100 / 3)
    with pytest.raises(Exception, match="no matching pairs"):
        coverage(raw_wer(pair_left(refs, hyps.where("utt_id = 'd'")))).collect()


def test_raw_words(spark):
    df = spark.createDataFrame([(" one two\nthree ", "one two three", "one  two \n three")], "r string, h string, g string")
    r, h, g = (F.col(c) for c in "rhg")
    got = df.select(S.wer_raw(r, h), S.wer_raw(r, h, True), S.wer_raw(h, g, True), S.wer_raw(h, g)).first()
    assert tuple(got) == (0.0, 1.0, 0.0, 0.0)


@pytest.mark.parametrize("group_bytes", [2_000, 100_000, 64_000_000])
def test_many_pairs_side_by_side(monkeypatch, group_bytes):
    """Pairs of all lengths in groups of all sizes count as each does alone."""
    monkeypatch.setattr(E, "GROUP_BYTES", group_bytes)
    rng = random.Random(group_bytes)
    pairs = []
    for _ in range(400):
        a = [rng.randint(0, rng.choice([1, 3, 20])) for _ in range(rng.choice([0, 1, 5, 60, 64, 65, 130]))]
        b = list(a) if rng.random() < 0.6 else [rng.randint(0, 20) for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 8) if b else 0):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = [99] * rng.randint(0, 2)
        pairs.append((a, b))
    ends = [np.cumsum([0, *map(len, side)]) for side in zip(*pairs)]
    flat = [np.array([x for t in side for x in t], np.int64) for side in zip(*pairs)]
    for compat in (False, True):
        got = E.edit_counts_of(flat[0], ends[0], flat[1], ends[1], compat)
        assert [tuple(x) for x in got.tolist()] == [E.edit_counts(a, b, compat) for a, b in pairs]


def test_words_of_texts_are_those_between_white_space():
    import pyarrow as pa

    from voxframe.functions.scoring import _words

    texts = ["", " ", "a", " a  b\n", None, *[f"x{chr(c)}y{chr(c)}" for c in (*range(1, 0x3100), 0xFEFF, 0x1F600)]]
    assert _words(pa.array(texts)).to_pylist() == [(t or "").split() for t in texts]


def test_edit_ops_of_nulls_and_empty_lists(spark):
    rows = [(["a", "b"], ["b"]), (None, ["a"]), (["a"], None), ([], ["x"]), (["x", None], ["x", None]), ([], [])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>").select(S.edit_ops(F.col("a"), F.col("b")).alias("e"))
    assert [r.e and tuple(r.e) for r in df.collect()] == [(1, 0, 1, 0), None, None, (1, 0, 0, 1), (0, 0, 0, 0), (0, 0, 0, 0)]
