import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from voxframe.functions.text import words
from voxframe.functions.voting import _alignment, align_to_reference, vote
from voxframe.operators.consensus import drop_blank, join_tokens, longest_transcript, merge_transcripts, vote_tokens


def voted(texts, compat):
    """The vote a text at a time, with the aligned places given."""
    texts = [t.strip() for t in texts if t and t.strip()]
    if len(texts) < 2:
        return texts[0] if texts else ""
    split = [t.split() for t in texts]
    base = max(range(len(split)), key=lambda i: len(split[i]))
    out = []
    places = [list(range(len(w))) if i == base else _alignment(split[base], w) for i, w in enumerate(split)]
    for pos in range(max(len(p) for p in places) if compat else len(split[base])):
        said = []
        for i, (ws, at) in enumerate(zip(split, places)):
            if compat:
                if pos < len(at) and at[pos] is not None and at[pos] < len(ws):
                    said.append(ws[at[pos]].lower())
                continue
            mine = [w for w, p in zip(ws, at) if p == pos]
            if mine:
                same = [w for w in mine if w == split[base][pos]]
                said.append((same or mine)[0].lower())
        if said:
            out.append(Counter(said).most_common(1)[0][0])
    return " ".join(out)


def test_alignment(spark):
    cases = [
        ("a b c", "a b c", [0, 1, 2]),
        ("a b c d", "a c d", [0, 2, 3]),
        ("a b c", "a x y c", [0, 1, 1, 2]),
        ("a b", "a b z", [0, 1, 1]),
        ("a b", "z a b", [0, 0, 1]),
        ("A b", "a b", [0, 1]),
        ("a b", "", []),
        ("", "a b", [None, None]),
    ]
    df = spark.createDataFrame([(i, r, t) for i, (r, t, _) in enumerate(cases)], "i int, r string, t string")
    got = df.orderBy("i").select(align_to_reference(words(F.col("r")), words(F.col("t"))).alias("a")).collect()
    assert [r.a for r in got] == [c[2] for c in cases]


def test_vote_ties_and_abstentions(spark):
    df = spark.sql("SELECT array('The','x',NULL) a, array('the','y','z') b, array('a','w') c")
    assert df.select(vote([F.col(c) for c in "abc"]).alias("v")).first().v == ["the", "x", "z"]
    empty = spark.sql("SELECT CAST(NULL AS array<string>) a, CAST(array() AS array<string>) b")
    assert empty.select(vote([F.col("a"), F.col("b")]).alias("v")).first().v == []


@pytest.mark.parametrize("compat", [False, True])
def test_merge_equals_the_plain_vote(spark, compat):
    rng = random.Random(3)
    base = [rng.choice("the cat sat on a mat and Ran far".split()) for _ in range(240)]
    rows = [
        ("the cat", "The bat", "a cat"),
        (None, " ", "Only One "),
        (None, None, ""),
        ("x", "x", "x"),
        (" ".join(base), " ".join(base[:-9]), " ".join(w for i, w in enumerate(base) if i % 6)),
    ]
    for _ in range(60):
        n = rng.randrange(1, 14)
        ws = [rng.choice("the cat sat on a mat".split()) for _ in range(n)]
        made = []
        for _ in range(3):
            said = [w if rng.random() > 0.3 else rng.choice(["Dog", "the", ""]) for w in ws]
            made.append(" ".join(said) if rng.random() > 0.1 else None)
        rows.append(tuple(made))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, c string")
    got = {r.i: r.merged for r in merge_transcripts(df, ["a", "b", "c"], compat=compat).collect()}
    assert got == {i: voted(r, compat) for i, r in enumerate(rows)}
    assert got[0] == "the cat"


def test_long_form_vote(spark):
    said = {1: "the cat sat", 2: "The bat sat down", 3: "a bat"}
    rows = [("u", rank, pos, w) for rank, t in said.items() for pos, w in enumerate(t.split())]
    df = spark.createDataFrame(rows, "utt_id string, rank int, pos int, word string")
    assert join_tokens(vote_tokens(df)).first().text == "the bat sat down"


def test_longest_transcript(spark):
    rows = [("u", 1, "a b"), ("u", 0, " c d "), ("u", 2, " "), ("v", 5, None), ("v", 4, "x")]
    df = spark.createDataFrame(rows, "utt_id string, rank int, text string")
    got = longest_transcript(drop_blank(df)).collect()
    assert sorted(tuple(r) for r in got) == [("u", 0, "c d"), ("v", 4, "x")]


def test_words_leave_a_batch_in_lots():
    """Never more than a lot of rows as Python objects; nulls and the order of rows stay."""
    import pyarrow as pa

    from voxframe.functions import voting

    rows = [None if i % 50 == 7 else [f"w{i}", "x"] for i in range(3 * voting.LOT + 5)]
    column, lots = pa.array(rows, pa.list_(pa.string())), []

    class Seen:
        def __len__(self):
            return len(column)

        def slice(self, at, size):
            lots.append(size)
            return column.slice(at, size)

    made = voting._pairwise(Seen(), Seen(), lambda a, b: [len(a), len(b)], pa.list_(pa.int32()))
    assert made.to_pylist() == [None if r is None else [2, 2] for r in rows]
    assert lots and max(lots) == voting.LOT
    assert voting._pairwise(column[:0], column[:0], list, pa.list_(pa.int32())).to_pylist() == []
