import random
import struct
import zlib

import numpy as np
import pytest

from tests.llm.conftest import rows_of
from voxframe.llm import token_files as X

tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def path():
    return tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_cached_pre_tokens_give_the_ids_of_the_library(path, library):
    rng = random.Random(1)
    signs = ["a", "Bc", " ", "  ", "\n", "\t", "'s", "'", "'ll", "1", "é", "日", "<|endoftext|>", ".", "\x1c", "\x85", " ", "\xa0", "²", "́", "_", "😀"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 15))) for _ in range(4000)] + ["", "x" * 500]
    encoder = X.Encoder(path, 0)
    for lot in (texts[:2000], texts[2000:], texts):
        for text, ids in zip(lot, encoder.encode(lot)):
            assert np.frombuffer(ids, "<u2").tolist() == [*library.encode(text, add_special_tokens=False).ids, 0]


def test_frames():
    framed = X.frame(b"payload") + X.frame(b"")
    assert X.unframe(framed) == (b"payload", 23) and X.unframe(framed, 23) == (b"", 39)
    assert X.unframe(framed[:22]) is None and X.unframe(framed, 39) is None
    assert struct.unpack("<Q", framed[:8]) == (7,)
    crc = zlib.crc32(b"payload")
    assert struct.unpack("<I", framed[19:23])[0] == (((crc >> 15) | (crc << 17)) + 0xA282EAD8) % 2**32
    for at in range(23):
        broken = bytearray(framed)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            X.unframe(bytes(broken))


def test_files_hold_all_documents_in_order(make, path, library, tmp_path):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["some", "words", "längst", "7"]) for _ in range(rng.randint(0, 30)))) for k in range(300)]
    rng.shuffle(rows)
    rows += [(500, None), (501, ""), (502, "long " * 60_000)]
    manifest = X.write_tokens(make(rows, extra=True).repartition(5), path, str(tmp_path / "t"), shards=4)
    assert sorted(r.shard for r in manifest.collect()) == [0, 1, 2, 3]
    got = {r.doc_id: (r.start, bytes(r.tokens)) for r in X.read_tokens(manifest).collect()}
    start = 0
    for key, text in sorted(rows):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert got[key] == (start, np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert manifest.agg({"tokens": "sum"}).first()[0] == start


def test_index_gives_the_same_records_in_a_dealt_order(make, path, tmp_path):
    manifest = X.write_tokens(make([(k, f"text {k}") for k in range(100)]), path, str(tmp_path / "t"), shards=3)
    want = rows_of(X.read_tokens(manifest), "doc_id", "tokens")
    orders = []
    for seed in (1, 2, 1):
        shuffled = X.read_shuffled(manifest, seed)
        assert rows_of(shuffled, "doc_id", "tokens") == want
        orders.append([r.doc_id for r in shuffled.collect()])
    assert orders[0] == orders[2] != orders[1] and orders[0] != sorted(orders[0])


def test_repeated_rows_rows_without_id_and_no_rows(make, path, tmp_path):
    rows = [(5, "b"), (5, "b"), (5, "a"), (None, "n"), (1, "x")]
    manifest = X.write_tokens(make(rows), path, str(tmp_path / "t"), shards=3)
    got = [(r.doc_id, r.start) for r in X.read_tokens(manifest).orderBy("start").collect()]
    assert got == [(None, 0), (1, 2), (5, 4), (5, 6), (5, 8)]
    empty = X.write_tokens(make([]), path, str(tmp_path / "e"))
    assert empty.count() == 0 and X.read_tokens(empty).count() == 0 and X.read_shuffled(empty, 1).count() == 0


def test_a_broken_file_is_noticed(make, path, tmp_path):
    manifest = X.write_tokens(make([(k, "some text") for k in range(10)]), path, str(tmp_path / "t"), shards=1)
    file = next((tmp_path / "t").glob("*.records"))
    data = bytearray(file.read_bytes())
    data[40] ^= 255
    file.write_bytes(bytes(data))
    with pytest.raises(Exception, match="broken record"):
        X.read_tokens(manifest).collect()


def test_both_patterns_cut_latin_texts_alike():
    import random
    import re

    import regex

    latin, every = re.compile(X.LATIN_PRE_TOKEN).findall, regex.compile(X.PRE_TOKEN).findall
    around = ("a{}b", " {}1", "{}{}", "x {} y", "\n{}\n", "'{}s 's", "{} ", " {}")
    texts = [ctx.replace("{}", chr(c)) for c in range(256) for ctx in around]
    rng = random.Random(1)
    texts += ["".join(chr(rng.choice([rng.randrange(256), 32, 39, 97, 0x2009, 0x3A9])) for _ in range(200)) for _ in range(300)]
    cut = X.cutter()
    for text in texts:
        assert cut(text) == every(text)
        if max(text) < "\u0100":
            assert latin(text) == every(text)
