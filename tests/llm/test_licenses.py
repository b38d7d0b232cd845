import random

from tests.llm.conftest import rows_of
from voxframe.llm import licenses as L


def scan(make, texts):
    out = L.scan_licenses(make(list(enumerate(texts)), extra=True))
    return [tuple(r) for r in out.select("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").orderBy("doc_id").collect()]


def test_base_places_and_labels(make):
    got = scan(
        make,
        [
            "Released under the MIT License.",
            "mit license mit license MIT-LICENSE",
            "GNU General Public License, version 3.",
            None,
            "",
            "No words about it, émit license",
            "Licensed under the Apache License, Version 2.0. All rights reserved.",
        ],
    )
    assert got[0] == (5, 1, 3, 3, "mit", "mit", 1.0)
    assert got[1][:5] == (6, 3, 0, 4, "mit")
    assert got[2] == (6, 1, 1, 1, "gpl", "gpl,gpl-3.0", 1.0)
    assert got[3] == got[4] == (0, 0, None, None, "", "", 0.0)
    assert got[5] == (6, 0, None, None, "", "", 0.0)
    assert got[6] == (11, 1, 3, 3, "apache", "all-rights-reserved,apache,apache-2.0", 1.0)


def test_contained_and_weaker_detections_go(make):
    out = L.scan_licenses(make([(1, "This is licensed under CC BY-NC 4.0 and also distributed under terms")])).first()
    # the family inside the versioned match is suppressed, the bare phrase elsewhere stays
    assert [d.label for d in out.detections] == ["cc-by-nc-4.0", "unspecified"]
    assert out.labels == "cc-by-nc-4.0,unspecified"


def test_base_places_against_brute_force(make):
    rng = random.Random(6)
    words = ["MIT", "license", "apache", "general", "public", "x", "Ünder", "é", "7"]
    texts = [rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(80)]
    for text, got in zip(texts, scan(make, texts)):
        seq = "".join(c if ord(c) > 127 or c.isalnum() else " " for c in text)
        seq = "".join(c.lower() if "A" <= c <= "Z" else c for c in seq).split()
        places = {n: [i for i in range(len(seq)) if seq[i : i + len(p.split())] == p.split()] for n, p in L.BASE.items()}
        every = sorted(i for at in places.values() for i in at)
        labels = ",".join(sorted(n for n, at in places.items() if at))
        assert got[:5] == (len(seq), len(every), every[0] if every else None, every[-1] if every else None, labels)
        assert set(labels.split(",")) - {""} <= set(got[5].split(","))


def gate(text):
    low = text.lower()
    return any(w in low for w in L.GATE) or ("under" in low and any(w in low for w in L.UNDER))


def test_hundreds_of_rules_each_behind_the_gate():
    import re

    made = L.rules()
    assert len(made) > 300 and len({p for p, *_ in made}) == len(made)
    for pattern, _, _, keyword in made:
        assert re.compile(pattern)
        assert gate(keyword) or keyword == "under" and gate(pattern)


def test_many_detections_repeated_rows_and_empty_table(make):
    text = "mit license " * 3000
    got = rows_of(L.scan_licenses(make([(1, text), (1, text)])), "n_base", "first_word", "last_word", "labels")
    assert got == [(3000, 0, 5998, "mit")] * 2
    assert L.scan_licenses(make([])).count() == 0


def test_no_python_and_no_exchange_in_the_plan(make):
    plan = L.scan_licenses(make([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def sentences(pattern):
    """Texts that match ``pattern``: each choice of each of its alternatives once, the others as short as they can be and as long."""
    from re import _parser

    def made(parsed, pick):
        out = ""
        for op, arg in parsed:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "IN":
                out += made([pick(arg)], pick)
            elif name == "BRANCH":
                out += made(pick(arg[1]), pick)
            elif name == "SUBPATTERN":
                out += made(arg[3], pick)
            else:
                assert name == "MAX_REPEAT" and arg[:2] == (0, 1)
                out += made(pick([[], arg[2]]), pick)
        return out

    parsed = _parser.parse(pattern)
    most = 80
    return {made(parsed, lambda of, k=k, d=d: of[(k if len(of) > 2 else d) % len(of)]) for k in range(most) for d in (0, 1)}


def test_gate_lets_a_sentence_per_alternative_of_every_rule_through():
    import re

    verbs = set()
    for pattern, _, _, keyword in L.rules():
        for norm in sentences(pattern):
            assert re.search(pattern, norm)
            verbs |= set(norm.split()) & {"licensed", "released", "distributed", "available", "published"}
            for text in (norm, norm.replace("  ", "\n"), norm.upper().replace("  ", " (_* ")):
                assert keyword not in norm or gate(text), text
    assert len(verbs) == 5


def test_every_sentence_of_a_rule_holds_what_its_family_needs():
    groups = L.gated()
    assert sorted(r[4] for _, made in groups for r in made) == list(range(len(L.rules()))) and len(groups) > 50
    for needed, made in groups:
        for pattern, _, _, keyword, _ in made:
            for norm in sentences(pattern):
                assert keyword not in norm or any(w in norm for w in needed), (needed, norm)
    assert L.literals("unlicen[cs]e") == [" unlice"] and L.literals("a b|non ?free") == [" a  b ", " non"]


def test_gate_of_the_plan_is_that_of_the_words(make):
    from pyspark.sql import functions as F

    texts = ["LICENSE", "x", "under", "Released later: UNDER", "reserve", "Copyrighted", "spd x", "available", ""]
    got = {r.text: r.g for r in make(list(enumerate(texts))).select("text", L._may_match(F.lower("text")).alias("g")).collect()}
    assert got == {t: gate(t) for t in texts}


def test_texts_that_hold_no_other_word_of_the_gate(make):
    texts = ["Code released under the GPL v3.", "Available under MIT", "PUBLISHED\n* under: the Apache", "It was released -- under some conditions", "It is available, under the bed"]
    assert [r[5:] for r in scan(make, texts)] == [("gpl-3.0", 1.0), ("mit", 0.8), ("apache", 0.8), ("unspecified", 0.4), ("", 0.0)]
