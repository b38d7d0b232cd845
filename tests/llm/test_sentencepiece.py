import random
import struct

import pytest

from tests.llm.conftest import rows_of
from voxframe.llm import sentencepiece as S

tokenizers = pytest.importorskip("public_tokenizers")
library = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def vocabulary():
    return S.Vocabulary.load(tokenizers.path("piece_bpe_32k.model"))


def varint(x):
    out = b""
    while x > 127:
        out += bytes([x & 127 | 128])
        x >>= 7
    return out + bytes([x])


def field(number, kind, value):
    if kind == 2:
        return varint(number << 3 | 2) + varint(len(value)) + value
    return varint(number << 3 | kind) + (varint(value) if kind == 0 else value)


@pytest.fixture(scope="module")
def unigram(vocabulary):
    """The library's own unigram model of the same pieces and scores."""
    model = library.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    proto = b""
    for i in range(model.vocab_size()):
        kind = 2 if model.is_unknown(i) else 3 if model.is_control(i) else 6 if model.is_byte(i) else 1
        piece = field(1, 2, model.id_to_piece(i).encode()) + field(2, 5, struct.pack("<f", vocabulary.scores[i])) + field(3, 0, kind)
        proto += field(1, 2, piece)
    proto += field(2, 2, field(3, 0, 1) + field(35, 0, 1))
    proto += field(3, 2, field(1, 2, b"identity") + field(3, 0, 1) + field(4, 0, 0) + field(5, 0, 1))
    return library.SentencePieceProcessor(model_proto=proto)


def texts():
    rng = random.Random(1)
    signs = ["the ", "token", " of", "ization", "  ", "\n", "é", "日本", "😀", "%%", "ß", "\t", "\x00", "xyz", "1", "."]
    made = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    return made + ["", " ", "   ", "a", "\n\n", "word " * 50, "x" * 300]


def test_ids_are_those_of_the_library(vocabulary, unigram):
    for text, ids in zip(texts(), vocabulary.encode(texts())):
        assert ids.tolist() == unigram.encode(text), text


def test_decoding_gives_the_text_back(vocabulary, unigram):
    for text, ids in zip(texts(), vocabulary.encode(texts())):
        assert vocabulary.decode(ids) == text == unigram.decode(ids.tolist())
    assert vocabulary.decode([vocabulary.byte_ids[0xE6]]) == "�"


def test_best_score_by_brute_force():
    pieces = {3: "▁a", 4: "b", 5: "ab", 6: "▁", 7: "a", 8: "bb", 9: "▁ab", 10: "é"}
    scores = {3: -1.0, 4: -2.0, 5: -2.5, 6: -1.5, 7: -1.75, 8: -3.0, 9: -4.0, 10: -2.0}
    v = S.Vocabulary.of(pieces, scores, {b: 20 + b for b in range(256)}, 0, 300)
    by_text = {p.replace("▁", " "): (s, i) for i, (p, s) in ((i, (pieces[i], scores[i])) for i in pieces)}

    def best(text):
        if not text:
            return 0.0
        found = [by_text[text[:n]][0] + best(text[n:]) for n in range(1, len(text) + 1) if text[:n] in by_text]
        if text[0] not in by_text:
            found.append(min(scores.values()) - S.UNKNOWN + best(text[1:]))
        return max(found)

    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("ab éx") for _ in range(rng.randint(1, 9)))
        got = v.encode([text])[0].tolist()
        total = sum(scores[i] if i in scores else 0 for i in got) + (min(scores.values()) - S.UNKNOWN) * sum(c == "x" for c in text)
        assert total == pytest.approx(best(" " + text))
        assert v.decode(got) == text


def test_trie_holds_exactly_the_pieces():
    pieces = {b"a": 1, b"ab": 2, b"abc": 3, b"b": 4, b"\xff\x00": 5, b"zz": 6}
    trie = S.Trie.of(pieces)

    def find(key):
        state = 0
        for b in key:
            low = trie.base[state]
            if low < 0 or trie.check[low + b + 1] != state:
                return -1
            state = low + b + 1
        return trie.value[state]

    for key in [*pieces, b"", b"ac", b"z", b"\xff", b"abcd", b"c"]:
        assert find(key) == pieces.get(key, -1)


def test_table_with_nulls_and_clashing_columns(make, vocabulary):
    rows = [(1, "a text"), (2, None), (3, ""), (1, "a text"), (None, "▁mark"), (4, "long " * 30_000)]
    out = S.decode(S.encode(make(rows, extra=True), vocabulary, "score"), vocabulary, "score", "n")
    got = rows_of(out.where("doc_id IS NULL OR doc_id < 4"), "doc_id", "n", "node")
    assert got == sorted([(1, "a text", "a1"), (1, "a text", "a1"), (2, "", "a2"), (3, "", "a3"), (None, " mark", "aNone")], key=repr)
    assert out.where("doc_id = 4 AND n = text").count() == 1
    assert S.encode(make([]), vocabulary).count() == 0
