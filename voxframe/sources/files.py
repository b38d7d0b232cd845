"""Folders of audio, text and label files as tables keyed by file name."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyarrow import NativeFile
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.functions.paths import parent, relative_to, stem, with_suffix
from voxframe.functions.text import strip_ws
from voxframe.operators.ordering import first_n
from voxframe.operators.pairing import last_wins, pair_strict
from voxframe.session import input_bytes
from voxframe.sources.listing import read_file, store_of

# Audio suffixes that are picked up.
AUDIO_SUFFIXES = ("wav", "mp3", "flac", "m4a", "ogg")

# Parts a chapter's lines are divided into where they meet its one row.
SALTS = 32

# What a task that handles whole files takes: files of about so many bytes, in so many scan tasks or so many rows at most.
TASK_BYTES, TASK_SCANS, TASK_FILES = 64 * 1024 * 1024, 32, 1024

# A listed line file is read in parts of so many bytes; lines are handed on from so many files at once.
LINE_BYTES, LINE_FILES = 4 * 1024 * 1024, 256

# Suffixes by which Spark's text reader unpacks a file.
PACKED = ("gz", "bz2", "deflate", "lz4", "snappy", "zst")


def audio_options(exts: Sequence[str] = AUDIO_SUFFIXES) -> dict[str, object]:
    """Reader options for all files below a folder with one of the suffixes."""
    return {"recursiveFileLookup": True, "pathGlobFilter": f"*.{{{','.join(exts)}}}"}


def audio_rows(files: DataFrame, root: str, *more: Column) -> DataFrame:
    """Rows of a binary file scan with their keys, and ``more`` columns of the scan."""
    plain = F.regexp_replace(F.col("path"), r"^file:/*(?=/)", "")
    return files.select(
        stem(F.col("path")).alias("utt_id"),
        "path",
        relative_to(plain, root.rstrip("/")).alias("rel_path"),
        "length",
        "modificationTime",
        "content",
        *more,
    )


def packed(files: DataFrame) -> DataFrame:
    """A scan of whole files in fewer tasks where the files are small; large ones stay as Spark divides them.

    Spark counts 4 MB for opening a file, so 32 small ones make a task, which takes less time than to start it and its models.
    """
    scans = files._jdf.queryExecution().toRdd().getNumPartitions()
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.coalesce(max(cores, -(-scans // TASK_SCANS), -(-input_bytes(files) // TASK_BYTES)))


def file_tasks(rows: DataFrame, length: str = "length") -> int:
    """Tasks for files that are listed with their lengths: none holds more rows or bytes as the list grows."""
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(length), F.lit(0))).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return max(1, min(cores, n), -(-n // TASK_FILES), -(-size // TASK_BYTES))


def load_audio(spark: SparkSession, paths: Sequence[str], root: str) -> DataFrame:
    """The named files with their bytes; signs that patterns use stand for themselves."""
    plain = [re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in paths]
    return audio_rows(spark.read.format("binaryFile").load(plain), root)


def open_files(rows: DataFrame, path: str = "path", per_frame: int = 16, tasks: int | None = None) -> DataFrame:
    """``rows`` with the bytes of the file each names as ``content``, opened by the task that holds the row.

    The rows are dealt to ``tasks`` tasks, by default to as many as the paths alone fill.
    Local paths and those of the file systems that Arrow knows (hdfs, s3, gs) can be opened.
    """

    def opened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for frame in frames:
            for at in range(0, len(frame), per_frame):
                part = frame.iloc[at : at + per_frame]
                yield part.assign(content=[read_file(p, known) for p in part[path]])

    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    # few paths can mean many bytes: they are dealt out before they are opened
    dealt = rows.repartition(tasks, path) if tasks else rows.hint("rebalance", path)
    return dealt.mapInPandas(opened, f"{kinds}, content binary")


def scan_audio(spark: SparkSession, path: str, exts: Sequence[str] = AUDIO_SUFFIXES) -> DataFrame:
    """All audio files below a folder: key, path, relative path, length, time and bytes.

    Bytes are read only where ``content`` is selected.
    """
    return audio_rows(spark.read.format("binaryFile").options(**audio_options(exts)).load(path), path)


def first_audio(spark: SparkSession, path: str, chosen: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` of the ``chosen`` files (rows of ``scan_audio``) with their bytes.

    The ``n`` paths come to the driver, so that no other file is read.
    """
    paths = [r.path for r in first_n(chosen.select("path", *order), n, *order).collect()]
    if not paths:
        return scan_audio(spark, path).limit(0)
    return load_audio(spark, paths, path)


def scan_texts(
    spark: SparkSession, path: str, glob: str = "*.txt", recursive: bool = False, encoding: str = "UTF-8"
) -> DataFrame:
    """One row per text file: its stem and its whole stripped content."""
    reader = spark.read.option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    suffix = re.search(r"\.(\w+)$", glob)
    if suffix and suffix[1] not in PACKED and encoding == "UTF-8":
        # the reader of whole texts copies Hadoop's settings for each file, which takes longer than the file
        files = packed(reader.format("binaryFile").load(path)).withColumn("value", F.col("content").cast("string"))
    else:
        files = reader.option("encoding", encoding).text(path, wholetext=True)
    return files.select(
        stem(F.col("_metadata.file_name")).alias("utt_id"), strip_ws(F.col("value")).alias("text")
    )


def parse_utterance_lines(lines: DataFrame, order: Sequence[str] = ("line_no",)) -> DataFrame:
    """Lines ``<utt_id> <text>`` with the ``path`` of their file, one file per chapter folder.

    Lines without text are dropped, folders with several such files skipped; of lines with the
    same id in a folder the last one in ``order`` counts.
    """
    parts = F.split(F.regexp_replace("value", r"\r$", ""), " ", 2)
    parsed = lines.select(parent(F.col("path")).alias("chapter"), "path", *order, parts.alias("_p"))
    single = (
        parsed.groupBy("chapter").agg(F.min("path").alias("_low"), F.max("path").alias("_high"))
        .where(F.col("_low") == F.col("_high"))
        .select("chapter")
    )
    utt_id, text = F.get("_p", F.lit(0)), strip_ws(F.get("_p", F.lit(1)))
    kept = parsed.where(F.size("_p") == 2).select("chapter", utt_id.alias("utt_id"), text.alias("text"), *order)
    last = last_wins(kept, ["chapter", "utt_id"], order)
    # a large chapter's lines are matched in several tasks
    salt = F.pmod(F.xxhash64("utt_id"), F.lit(SALTS)).cast("int")
    salted = single.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    matched = last.withColumn("_salt", salt).join(salted, ["chapter", "_salt"], "left_semi")
    return matched.select("chapter", "utt_id", "text")


def scan_utterance_lines(spark: SparkSession, path: str, glob: str = "*.trans.txt") -> DataFrame:
    """Utterance lines of all transcript files below a folder."""
    lines = (
        spark.read.option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("path"),
            # a large file may be read in several parts
            F.col("_metadata.file_block_start").alias("part"),
            F.monotonically_increasing_id().alias("line_no"),
            "value",
        )
    )
    return parse_utterance_lines(lines, ("part", "line_no"))


def _whole_lines(file: NativeFile, start: int, end: int) -> bytes:
    """The lines that begin in a range of a file, cut at line feeds."""
    size = file.size()

    def begin(at: int) -> int:
        """Where the first line from a place on begins, if not at 0."""
        at -= 1
        while at < size and (block := file.read_at(64 * 1024, at)):
            if (found := block.find(b"\n")) >= 0:
                return at + found + 1
            at += len(block)
        return size

    first, last = begin(start) if start else 0, begin(end) if end < size else size
    lines = file.read_at(last - first, first)
    return lines.removeprefix(b"\xef\xbb\xbf") if not start else lines


def read_lines(files: DataFrame, part_bytes: int = LINE_BYTES) -> DataFrame:
    """Lines of listed text files (``path, length``) as Spark's text reader finds them: path, part, line_no, value.

    A large file is read in parts by several tasks; ``line_no`` counts within a part. Bytes that are no UTF-8 are replaced.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(part_bytes).cast("long"))
    parts = files.select("path", "length", F.explode(starts).alias("part"))
    parts = parts.select("path", "part", F.least(F.lit(part_bytes), F.col("length") - F.col("part")).alias("length"))

    def taken(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for frame in frames:
            begun, bodies, held = 0, [], 0
            for at, (path, part) in enumerate(zip(frame["path"], frame["part"]), 1):
                store, where = store_of(path, known)
                with store.open_input_file(where) as file:
                    bodies.append(_whole_lines(file, part, part + part_bytes))
                held += len(bodies[-1])
                if held >= part_bytes or len(bodies) == LINE_FILES or at == len(frame):
                    yield frame.iloc[begun:at].assign(body=bodies)
                    begun, bodies, held = at, [], 0

    dealt = parts.repartition(file_tasks(parts), "path", "part")
    found = dealt.mapInPandas(taken, "path string, part long, length long, body binary").where("octet_length(body) > 0")
    text = F.regexp_replace(F.col("body").cast("string"), r"(\r\n|\r|\n)\z", "")
    return found.select("path", "part", F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("line_no", "value"))


def scan_labels(spark: SparkSession, files: DataFrame, path: str, glob: str = "*.lab") -> DataFrame:
    """Each file with the label text of its stem; running it fails where a label file is missing."""
    labels = scan_texts(spark, path, glob).withColumnRenamed("text", "label_text")
    return pair_strict(files, labels, "utt_id")


def label_text(content: Column) -> Column:
    """The whole stripped text of a file's bytes."""
    return strip_ws(F.decode(content, "UTF-8"))


def scan_texts_by_path(spark: SparkSession, path: str, exts: Sequence[str] = ("txt",)) -> DataFrame:
    """One row per text file below a folder: its path there without suffix as ``utt_id``, its whole stripped content."""
    files = scan_audio(spark, path, exts)
    return files.select(with_suffix(F.col("rel_path"), "").alias("utt_id"), label_text(F.col("content")).alias("text"))
