import random

import numpy as np

from tests.llm.conftest import rows_of
from voxframe.llm import substring_dedup as S


def plain_ends(data):
    """Chunk ends by the definition, byte by byte."""
    rolled, h = [], 0
    for i, b in enumerate(data):
        h = sum(int(S.GEAR[data[i - k]]) << k for k in range(min(i + 1, S.WINDOW))) % 2**64
        rolled.append(h)
    value = S.mixed(np.array(rolled, np.uint64)).tolist() if rolled else []
    spaces = [i for i, b in enumerate(data) if b in b"\t\n\v\f\r "]
    ends = []
    for i in spaces:
        near = [j for j in spaces if j != i and abs(j - i) <= S.REACH]
        if all(value[i] > value[j] or value[i] == value[j] and i < j for j in near):
            ends.append(i + 1)
    ends = [e for e in ends if e < len(data)] + ([len(data)] if data else [])
    out, at = [], 0
    for e in ends:
        cuts = range(at + S.LARGEST, e, S.LARGEST) if e - at > S.LARGEST else []
        for c in cuts:
            while c < len(data) and data[c] & 0xC0 == 0x80:
                c += 1
            out.append(c)
        out.append(e)
        at = e
    return sorted(set(out))


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghié") for _ in range(rng.randint(1, 9))) for _ in range(n))


def test_chunk_ends_by_definition():
    rng = random.Random(1)
    for text in [prose(rng, n) for n in (1, 2, 10, 60, 200)] + ["", "é" * 3000, "la " * 900, "a" * 5000]:
        data = text.encode()
        assert S.chunk_ends(data).tolist() == plain_ends(data)


def test_boundaries_come_back_after_an_insertion():
    rng = random.Random(2)
    before, passage = prose(rng, 30), prose(rng, 80)
    a, b = (x.encode() for x in (before + " " + passage, before + " inserted " + passage))
    chunks = [[d[i:j] for i, j in zip([0, *e], e)] for d, e in ((x, S.chunk_ends(x).tolist()) for x in (a, b))]
    assert len(set(chunks[0]) & set(chunks[1])) >= 0.8 * len(set(chunks[0]))


def brute_spans(rows, min_bytes=S.MIN_BYTES):
    seen, spans = {}, {}
    for key, text in sorted(rows):
        data = (text or "").encode()
        at, runs = 0, []
        for end in S.chunk_ends(data).tolist():
            if seen.setdefault(data[at:end], (key, at)) != (key, at):
                if runs and runs[-1][1] == at:
                    runs[-1][1] = end
                else:
                    runs.append([at, end])
            at = end
        kept = [tuple(r) for r in runs if r[1] - r[0] >= min_bytes]
        if kept:
            spans[key] = kept
    return spans


def test_spans_against_brute_force(make):
    rng = random.Random(3)
    passages = [prose(rng, 60) for _ in range(5)]
    rows = []
    for k in range(50):
        parts = [prose(rng, rng.randint(0, 50))]
        if k % 3:
            parts += [rng.choice(passages), prose(rng, rng.randint(0, 50))]
        rows.append((k, " ".join(parts)))
    want = brute_spans(rows)
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in S.spans_by_document(make(rows)).collect()}
    assert got == want and len(want) >= 20
    texts = dict(rows)
    for r in S.dedup_substrings(make(rows, extra=True)).collect():
        data, at, kept = texts[r.doc_id].encode(), 0, b""
        for i, j in want.get(r.doc_id, []):
            kept, at = kept + data[at:i], j
        assert r.text == (kept + data[at:]).decode() and r.form == f"c{r.doc_id}"


def test_nulls_empty_repeats_and_rows_without_id(make):
    rng = random.Random(4)
    text = prose(rng, 100)
    rows = [(1, text), (1, text), (2, text), (None, text), (3, None), (4, "")]
    got = rows_of(S.dedup_substrings(make(rows)), "doc_id", "text")
    assert got == sorted([(1, ""), (1, ""), (2, ""), (None, text), (3, None), (4, "")], key=repr)
    found = {r.doc_id: r.first_doc_ids for r in S.spans_by_document(make(rows)).collect()}
    assert set(found) == {1, 2}


def test_empty_table(make):
    assert S.spans_by_document(make([])).count() == 0 and S.dedup_substrings(make([])).count() == 0


def test_repeated_passage_at_two_offsets_without_spaces(make):
    rng = random.Random(5)

    def han(n):
        return "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(n))

    def code(n):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789+/") for _ in range(n))

    rows, passages = [], {}
    for k, (some, n) in enumerate([(han, 250), (han, 2000), (code, 700), (code, 6000)]):
        passage = passages[k] = some(n)
        rows += [(2 * k, some(701) + passage + some(900)), (2 * k + 1, some(1400) + passage + some(333))]
    rows += [(8, "short words " + passages[0] + " and more words")]
    got = {r.doc_id: r.removed_bytes for r in S.spans_by_document(make(rows)).collect()}
    assert set(got) == {1, 3, 5, 7, 8}
    for key, k in ((1, 0), (3, 1), (5, 2), (7, 3), (8, 0)):
        size = len(passages[k].encode())
        assert size - 400 <= got[key] <= size
    texts = dict(rows)
    for key, cut in rows_of(S.dedup_substrings(make(rows)), "doc_id", "text"):
        assert len(texts[key].encode()) - len(cut.encode()) == got.get(key, 0)


def test_ends_without_spaces_are_character_ends_and_come_back_after_an_insertion():
    rng = random.Random(6)
    text = "".join(rng.choice("語日本é😀a") for _ in range(4000))
    a, b = (x.encode() for x in (text, text[:50] + "字" + text[50:]))
    chunks = [[d[i:j] for i, j in zip([0, *e], e)] for d, e in ((x, S.chunk_ends(x).tolist()) for x in (a, b))]
    assert all(c.decode() for own in chunks for c in own) and max(map(len, chunks[0])) <= S.LARGEST
    assert len(set(chunks[0]) - set(chunks[1])) <= 4 and b"".join(chunks[1]) == b
