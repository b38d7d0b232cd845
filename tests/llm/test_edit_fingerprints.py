import hashlib
import random

import pytest

from tests.llm.conftest import rows_of
from voxframe.llm import edit_fingerprints as E


def plain(text):
    """The fingerprint by its definition."""
    moves, signs, steps = E._table(), E._sign_of_class(), set(E._STEPS.tolist())
    classes, at, j, out = E._classes(text), 0, 0, ""
    while at < len(classes):
        if j in steps:
            out += "0123456789abcdef"[signs[classes[at]]]
        at += int(moves[j % E.PERIOD][classes[at]])
        j += 1
    return out


def prose(rng, n):
    return "".join(rng.choice("abcdefghij é日\n") for _ in range(n))


def test_fingerprints_by_definition():
    rng = random.Random(1)
    texts = ["", "a", "ab", "😀"] + [prose(rng, rng.randint(1, 3000)) for _ in range(150)]
    assert E.fingerprints(texts) == [plain(t) for t in texts]
    assert [E.fingerprints([t])[0] for t in texts] == E.fingerprints(texts)


def test_likeness_falls_with_edit_distance():
    rng = random.Random(2)
    near, far = [], []
    for _ in range(60):
        text = prose(rng, 2000)
        few = list(text)
        for _ in range(5):
            few[rng.randrange(len(few))] = "z"
        a, b, c = E.fingerprints([text, "".join(few), prose(rng, 2000)])
        near.append(E.likeness(a, b))
        far.append(E.likeness(a, c))
    assert min(near) > max(far) and sum(near) / 60 > 0.6 and sum(far) / 60 < 0.2
    assert E.likeness("", "") == 1.0 and E.likeness("", "a") == 0.0 and E.likeness("ab1", "ab1") == 1.0


def brute(rows):
    named = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    out = []
    for k, (key, text) in enumerate(named):
        text, after = text or "", named[(k + 1) % len(named)][1] or ""
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        a, b, c = E.fingerprints([text, edited, after])
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, round(E.likeness(a, b), 9), round(E.likeness(a, c), 9)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("many", [1, 2, 40, 300])
def test_edited_texts_against_brute_force(make, many):
    rng = random.Random(many)
    rows = [(k * 3 - 50, prose(rng, rng.choice([0, 1, 3, 5, 60, 400]))) for k in range(many)]
    rng.shuffle(rows)
    if many > 2:
        rows[0] = (rows[0][0], None)
    got = E.edited_fingerprints(make(rows, extra=True).repartition(3))
    rounded = sorted(((*tuple(r)[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in got.collect()), key=repr)
    assert rounded == brute(rows)


def test_repeated_rows_rows_without_id_and_no_rows(make):
    rows = [(1, "first text"), (1, "first text"), (2, "another one here"), (None, "stands apart")]
    got = E.edited_fingerprints(make(rows)).collect()
    assert len(got) == 4
    apart = next(r for r in got if r.doc_id is None)
    assert apart.near_next is None and apart.edited_sha256 == hashlib.sha256(b"stands ap").hexdigest()
    assert len({r.fingerprint for r in got if r.doc_id == 1}) == 1
    assert E.edited_fingerprints(make([])).count() == 0


def test_long_text():
    a, b = E.fingerprints(["word " * 40_000, "word " * 39_999 + "other"])
    assert len(a) < 1400 and E.likeness(a, b) > 0.9


def test_near_documents(make):
    rng = random.Random(7)
    base = [prose(rng, 800) for _ in range(5)]
    rows = []
    for k in range(40):
        text = base[k % 5]
        at = rng.randint(600, 790)
        rows.append((k, text if k < 10 else text[:at] + "Z" + text[at + 1 :]))
    rows += [(100, prose(rng, 800)), (101, ""), (102, None), (None, base[0])]
    found = E.near_documents(E.fingerprint(make(rows)), 0.7)
    classes = {r.doc_id: r.class_id for r in found.collect()}
    assert all(classes[k] == k % 5 for k in range(40))
    assert classes[100] == 100 and classes[101] == 101 and classes[102] == 102 and classes[None] is None
    assert E.near_documents(E.fingerprint(make([]))).count() == 0


def test_clashing_columns(make):
    out = E.fingerprint(make([(1, "abc")], extra=True), "score")
    assert rows_of(out, "doc_id", "node", "score") == [(1, "a1", E.fingerprints(["abc"])[0])]
