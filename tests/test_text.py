import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxframe.functions import text as X


def values(spark, fn, *texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, t string").select("i", fn(F.col("t")).alias("o"))
    return [r.o for r in df.orderBy("i").collect()]


CASES = [
    (X.normalize_generic, "Don't  STOP_me, é!", "dont stop_me é"),
    (X.normalize_generic, None, ""),
    (X.normalize_generic, " \t\n", ""),
    (X.normalize_ar, "إِلى ٱلمدرسةِ، 12 ok", "الي ٱلمدرسه،"),
    (X.normalize_ar, None, ""),
    (X.normalize_ar, "ـ ١٢؟", "ـ ١٢؟"),
    (X.normalize_ws, "  A\tb \n C ", "a b c"),
    (X.normalize_ws, None, None),
    (X.normalize_extreme, "It's, OK: a_b", "its ok a_b"),
    (X.normalize_extreme, None, None),
    (X.restore_sentence_case, "HELLO <COMMA> WORLD <PERIOD> SO I SEE <NOISE>", "Hello, world. So I see "),
    (X.restore_sentence_case, "and i <COMMA> i' m <QUESTIONMARK> yes<COMMA>", "And i, I' m? Yes<comma>"),
    (X.restore_sentence_case, "", ""),
    (X.restore_sentence_case, "...42 éa <EXCLAMATIONPOINT> ßx", "...42 Éa! SSx"),
    (X.restore_sentence_case, "ΟΔΟΣ Ⓐ <PERIOD> ΝΑΙ", "Οδος ⓐ. Ναι"),
    (X.strip_time_tags, "[ 0m0s285ms - 0m7s935ms ] yes [hmm] [laugh]", "yes [laugh]"),
    (X.strip_time_tags, "a [1m2s3ms]\n b [shh] []", "a b []"),
    (X.strip_time_tags, None, ""),
    (X.buckwalter_to_arabic, "AlErbyp |Q", "العربية |Q"),
    (X.squeeze, " a  b  c\x1fd ", "a b c d"),
    (X.words, " a  b\n", ["a", "b"]),
    (X.words, "", []),
]


def test_hand_derived_cases(spark):
    for fn in dict.fromkeys(c[0] for c in CASES):
        mine = [c for c in CASES if c[0] is fn]
        assert values(spark, fn, *[c[1] for c in mine]) == [c[2] for c in mine], fn.__name__


# letters and spaces that both Unicode tables know and that change case one to one
ALPHABET = "abzABZ019_éÉñßøŁжЖ日本ً١٢٠ا'\"?!.,;:<>|-~ \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0       　​́²½"


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=30), min_size=20, max_size=60))
def test_same_as_python_text_rules(spark, texts):
    assert values(spark, X.normalize_generic, *texts) == [
        re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", t.lower())).strip() for t in texts
    ]
    assert values(spark, X.normalize_ws, *texts) == [" ".join(t.lower().split()) for t in texts]
    assert values(spark, X.words, *texts) == [t.split() for t in texts]
    assert values(spark, X.strip_ws, *texts) == [t.strip() for t in texts]


def test_word_class_on_all_assigned_letters_and_spaces(spark):
    codes = [c for c in range(0x3000) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    got = values(spark, lambda c: F.regexp_replace(c, X.NOT_WORD_OR_SPACE, ""), *[chr(c) for c in codes])
    want = [re.sub(r"[^\w\s]", "", chr(c)) for c in codes]
    # letters younger than the JVM's tables are the only ones it may drop
    assert [c for c, g, w in zip(codes, got, want) if g != w and not (g == "" and w)] == []
    assert sum(g != w for g, w in zip(got, want)) < 100
    spaces = values(spark, X.squeeze, *[f"a{chr(c)}b" for c in codes])
    assert [c for c, s in zip(codes, spaces) if (s == "a b") != bool(re.fullmatch(r"\s", chr(c)))] == []


def test_profiles(spark):
    text = "HELLO  <COMMA> YOU <PERIOD>"
    assert values(spark, lambda c: X.clean_profile(c, "both"), text) == ["hello , you."]
    assert values(spark, lambda c: X.clean_profile(c, "extreme"), text) == ["hello comma you period"]
    with pytest.raises(ValueError, match="unknown profile"):
        X.clean_profile(F.lit("x"), "none")


REPLIES = [
    # reply, base, lang, truncated, default, compat
    ("x <corrected> good text </corrected> y", "good test", "en", False, "good text", "good text"),
    ("<corrected>good text", "good test", "en", False, "good text", "good text"),
    ("<corrected>good te", "good test", "en", True, "good test", "good test"),
    ("good text</corrected>", "good test", "en", False, "good text", "good text</corrected>"),
    ("a plain longer reply", "good test", "en", False, "a plain longer reply", "a plain longer reply"),
    ("short one", "good test", "en", False, "good test", "good test"),
    ("I am Sorry, no can do", "good test", "en", False, "good test", "good test"),
    ("<corrected>g</corrected>", "good test", "en", False, "good test", "good test"),
    ("<مصحح>نص جيد</مصحح>", "نص", "ar", False, "نص جيد", "نص جيد"),
    ("<مصحح>نص\nجيد</مصحح>", "نص", "en", False, "<مصحح>نص\nجيد</مصحح>", "<مصحح>نص\nجيد</مصحح>"),
    (None, "good test", "en", False, "good test", "good test"),
    ("", "good test", "en", False, "good test", "good test"),
]


def test_extract_tagged(spark):
    rows = [(i, *r[:4]) for i, r in enumerate(REPLIES)]
    df = spark.createDataFrame(rows, "i int, reply string, base string, lang string, cut boolean").orderBy("i")
    cols = [F.col(c) for c in ("reply", "base", "lang", "cut")]
    got = df.select(X.extract_tagged(*cols).alias("d"), X.extract_tagged(*cols, compat=True).alias("c")).collect()
    assert [tuple(r) for r in got] == [r[4:] for r in REPLIES]


def test_prompts(spark):
    df = spark.createDataFrame([("en", "a", None), ("fr", "b", "c")], "lang string, x string, y string")
    made = X.prompt_by_language({"en": "{x}-{y}{z}"}, "{y}{x}!", F.col("lang"), {"x": F.col("x"), "y": F.col("y")})
    assert [r.p for r in df.select(made.alias("p")).collect()] == ["a-{z}", "cb!"]
