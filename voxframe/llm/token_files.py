"""Token ids in files of length-delimited binary records, with an offset index beside each.

A record is its payload's length (unsigned 64 bits, little-endian), the masked checksum of those eight bytes, the
payload, and the masked checksum of the payload. A checksum is CRC-32, rotated right by 15 bits plus a constant, as data
that hold checksums of their own should not be summed plainly. The payload is a byte (1: has an id), the document's
id (signed 64 bits) and its token ids, in 16 bits each where the vocabulary allows, else 32. The index has a pair of unsigned
64-bit numbers per record: offset and length of the whole frame.

Documents are range-partitioned by id, so that the files in order of their numbers hold ascending ids. A task writes one
file under a name of its own attempt; only attempts that end give a row of the manifest, so a lost executor leaves at most
a file that nobody reads.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections import ChainMap
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxframe.llm.common import stored

MANIFEST = "shard int, path string, records bigint, tokens bigint, bytes bigint, width int"
_HEAD, _LENGTH, _SUM = "<?q", "<Q", "<I"
_LOT, _CHUNK = 1 << 20, 1 << 22
# Cuts that a process remembers, and the longest of them: about 150 MB.
_CACHE, _LONG = 600_000, 64
# Fixed value: how byte-level BPE cuts a text before it merges.
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same for texts of Latin-1 alone, with its letters, numbers and white space spelled out.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN_PRE_TOKEN = rf"'(?:[sdmt]|ll|ve|re)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack(_LENGTH, len(payload))
    return b"".join([length, struct.pack(_SUM, masked(length)), payload, struct.pack(_SUM, masked(payload))])


def unframe(data: bytes, at: int = 0) -> tuple[bytes, int] | None:
    """The payload at ``at`` and where the next frame starts; None if the frame is not all there."""
    if len(data) < at + 12:
        return None
    length = data[at : at + 8]
    if struct.unpack_from(_SUM, data, at + 8)[0] != masked(length):
        raise ValueError("broken record length")
    end = at + 12 + struct.unpack(_LENGTH, length)[0]
    if len(data) < end + 4:
        return None
    payload = data[at + 12 : end]
    if struct.unpack_from(_SUM, data, end)[0] != masked(payload):
        raise ValueError("broken record")
    return payload, end + 4


def _files(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if re.match(r"\w[\w+.-]*:", path) else f"file://{path}")


def cutter() -> Callable[[str], list[str]]:
    """Cuts a text into pre-tokens; texts of Latin-1 alone by a pattern that takes half the time."""
    latin, every = re.compile(LATIN_PRE_TOKEN).findall, regex.compile(PRE_TOKEN).findall

    def cut(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return every(text)
        return latin(text)

    return cut


class Encoder:
    """Ids of whole texts by a file of the tokenizers library, without its special tokens, an end id after each.

    Under byte-level BPE the library merges within pre-tokens only, so a text is cut into these and each distinct one
    is encoded once per process, as long as the cache holds it. Texts that hold an added token, and those of other kinds
    of tokenizers, are encoded in one piece.
    """

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        before = made["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        self.cut = cutter() if plain and not made["normalizer"] else None
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.end = np.array([end], self.kind).tobytes()
        self.known: dict[str, bytes] = {}

    @staticmethod
    def of_process(path: str, end: int) -> Encoder:
        """The one that earlier tasks in this process have made, with the cuts it knows."""
        import tokenizers

        held = tokenizers.__dict__.setdefault("encoders of this process", {})
        if (path, end) not in held:
            held[path, end] = Encoder(path, end)
        return held[path, end]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > _CACHE:
            self.known.clear()
        cuts = [self.cut(t) if self.cut and not any(a in t for a in self.added) else [t] for t in texts]
        new = list(set(chain.from_iterable(cuts)) - self.known.keys())
        whole = {}
        for c, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            (self.known if len(c) <= _LONG else whole)[c] = array(self.code, e.ids).tobytes()
        ids = ChainMap(self.known, whole).__getitem__ if whole else self.known.__getitem__
        return [b"".join(map(ids, row)) + self.end for row in cuts]


def _writer(tokenizer: str, folder: str, end: int) -> Callable:
    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder.of_process(tokenizer, end)
        context = TaskContext.get()
        shard = context.partitionId()
        name = f"{folder}/tokens-{shard:06d}-{uuid.uuid4().hex}"
        files = records = tokens = offset = 0

        def lots() -> Iterator[tuple[list, list[str]]]:
            ids: list = []
            texts: list[str] = []
            size = 0
            for rows in frames:
                for key, text in zip(rows["doc_id"], rows["text"]):
                    ids.append(None if pd.isna(key) else int(key))
                    texts.append(text or "")
                    size += len(texts[-1])
                    if size >= _LOT:
                        yield ids, texts
                        ids, texts, size = [], [], 0
            if ids:
                yield ids, texts

        out = index = None
        for ids, texts in lots():
            if out is None:
                files, where = _files(name)
                files.create_dir(where.rsplit("/", 1)[0], recursive=True)
                out, index = files.open_output_stream(f"{where}.records"), files.open_output_stream(f"{where}.index")
            for key, payload in zip(ids, encoder.encode(texts)):
                framed = frame(struct.pack(_HEAD, key is not None, key or 0) + payload)
                out.write(framed)
                index.write(struct.pack("<QQ", offset, len(framed)))
                offset += len(framed)
                records += 1
                tokens += len(payload) // encoder.kind.itemsize
        if out is not None:
            out.close()
            index.close()
            yield pd.DataFrame({"shard": [shard], "path": [name], "records": [records], "tokens": [tokens], "bytes": [offset], "width": [encoder.kind.itemsize]})

    return write


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end: int = 0, shards: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text; other columns ignored) into ``folder``; the manifest, a row per file.

    ``folder`` is one that all executors reach, ``tokenizer`` a file present on each. Null and empty texts are records
    of the end id alone. Rows without doc_id come first; rows that repeat a doc_id follow each other, in an order fixed
    by their texts. No documents give no files and an empty manifest.
    """
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", F.xxhash64("text")]
    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange(shards, *order).sortWithinPartitions(*order)
    return stored(ordered.mapInPandas(_writer(tokenizer, folder, end), MANIFEST), "manifest")


def _parsed(payload: bytes, width: int) -> tuple[int | None, np.ndarray]:
    has, key = struct.unpack_from(_HEAD, payload)
    return key if has else None, np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(_HEAD)).astype("<u4")


def _records(path: str) -> Iterator[bytes]:
    """The payloads of a file, read in chunks."""
    files, where = _files(path)
    with files.open_input_stream(f"{where}.records") as stream:
        held, at = b"", 0
        while True:
            found = unframe(held, at)
            if found:
                payload, at = found
                yield payload
                continue
            more = stream.read(max(_CHUNK, len(held) - at))
            if not more:
                break
            held, at = held[at:] + more, 0
        if at != len(held):
            raise ValueError(f"{path} ends inside a record")


def _frames(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    kept: list[tuple] = []
    size = 0
    for row in rows:
        kept.append(row)
        size += len(row[-1])
        if size >= _CHUNK:
            yield pd.DataFrame(kept, columns=["shard", "doc_id", "before", "tokens"]).astype({"doc_id": "Int64"})
            kept, size = [], 0
    if kept:
        yield pd.DataFrame(kept, columns=["shard", "doc_id", "before", "tokens"]).astype({"doc_id": "Int64"})


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(shard, doc_id, start, tokens) of every record, checked: ids as little-endian unsigned 32-bit numbers.

    ``start`` counts the ids of all documents before it, in the order of the files.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for frame in frames:
                for file in frame.itertuples():
                    before = 0
                    for payload in _records(file.path):
                        key, ids = _parsed(payload, file.width)
                        yield file.shard, key, before, ids.tobytes()
                        before += len(ids)

        yield from _frames(rows())

    spark = manifest.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a row per file
    starts = manifest.select("shard", (F.sum("tokens").over(Window.orderBy("shard")) - F.col("tokens")).alias("offset"))
    records = manifest.repartition(tasks).mapInPandas(read, "shard int, doc_id bigint, before bigint, tokens binary")
    return records.join(F.broadcast(starts), "shard").select("shard", "doc_id", (F.col("offset") + F.col("before")).alias("start"), "tokens")


def read_shuffled(manifest: DataFrame, seed: int) -> DataFrame:
    """(shard, doc_id, tokens) of every record in an order dealt by ``seed``, by way of the index files."""

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file in frame.itertuples():
                files, where = _files(file.path)
                with files.open_input_stream(f"{where}.index") as stream:
                    while chunk := stream.read(_CHUNK):
                        pairs = np.frombuffer(chunk, "<u8").reshape(-1, 2).astype(np.int64)
                        yield pd.DataFrame({"shard": file.shard, "path": file.path, "width": file.width, "offset": pairs[:, 0], "length": pairs[:, 1]})

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            open_files: dict[str, object] = {}
            for frame in frames:
                for r in frame.itertuples():
                    if r.path not in open_files:
                        if len(open_files) >= 64:
                            open_files.pop(next(iter(open_files))).close()
                        files, where = _files(r.path)
                        open_files[r.path] = files.open_input_file(f"{where}.records")
                    payload, _ = unframe(open_files[r.path].read_at(r.length, r.offset))
                    key, ids = _parsed(payload, r.width)
                    yield r.shard, key, 0, ids.tobytes()

        yield from _frames(rows())

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = F.xxhash64(F.lit(seed), "shard", "offset")
    index = manifest.repartition(tasks).mapInPandas(places, "shard int, path string, width int, offset bigint, length bigint")
    order = index.repartition(tasks, dealt).sortWithinPartitions(dealt)
    return order.mapInPandas(read, "shard int, doc_id bigint, before bigint, tokens binary").drop("before")
