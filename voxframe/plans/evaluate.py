"""Evaluation jobs: several systems against ground truth, and one folder against another."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.functions.paths import parent, stem, with_suffix
from voxframe.functions.text import buckwalter_to_arabic
from voxframe.operators.inference import Predictor
from voxframe.operators.ordering import first_n
from voxframe.operators.pairing import pair_inner, pair_left, pair_strict
from voxframe.operators.scores import coverage, raw_wer, score_systems, system_summary
from voxframe.plans.annotate import annotate
from voxframe.session import cut_lineage, stored
from voxframe.sources.files import (
    audio_options,
    audio_rows,
    file_tasks,
    first_audio,
    label_text,
    open_files,
    packed,
    parse_utterance_lines,
    read_lines,
    scan_audio,
    scan_texts,
    scan_texts_by_path,
    scan_utterance_lines,
)
from voxframe.sources.listing import list_files, listable
from voxframe.sources.sinks import write_report


# A system's name and the transcript it is scored on; the judge is scored on the polished text.
RECORD_SYSTEMS = {"first": "first", "second": "second", "judge": "final", "third": "third"}

# Label files handed on at once, which are short.
LABELS_AT_ONCE = 256


def hypotheses(records: DataFrame, key: str = "utt_id", record: str = "record") -> DataFrame:
    """The transcripts of annotated records as columns, with the language."""
    said = F.col(f"{record}.transcriptions")
    columns = dict.fromkeys(RECORD_SYSTEMS.values())
    return records.select(key, said["detected_language"].alias("lang"), *[said[c].alias(c) for c in columns])


def evaluate_records(
    records: DataFrame,
    refs: DataFrame,
    lang: str,
    systems: Mapping[str, str] = RECORD_SYSTEMS,
    first: int | None = None,
    key: str = "utt_id",
    compat: bool = False,
) -> Report:
    """Annotated records against references (``ref``), transliterated ones for Arabic."""
    hyps = hypotheses(records, key)
    if lang == "ar":
        return evaluate_transliterated(refs, hyps, systems, first, key, compat)
    return evaluate_lines(refs.withColumnRenamed("ref", "text"), hyps, systems, first, lang, key, compat)


@dataclass(frozen=True)
class Report:
    scores: DataFrame
    summary: DataFrame
    details: DataFrame

    def write(self, path: str) -> None:
        write_report(self.summary, self.details, path)


def _report(pairs: DataFrame, ref: str, systems: Mapping[str, str], lang: str, key: str, compat: bool) -> Report:
    scores = score_systems(pairs, systems, lang, key, ref, compat)
    details = pairs.select(key, F.col("ref"), *[F.col(c).alias(name) for name, c in systems.items()])
    return Report(scores, system_summary(scores, list(systems)), details)


def evaluate_transliterated(
    refs: DataFrame,
    hyps: DataFrame,
    systems: Mapping[str, str],
    first: int | None = None,
    key: str = "utt_id",
    compat: bool = False,
) -> Report:
    """Arabic references in Latin transliteration (``ref``); every recording must have a reference.

    ``systems`` maps a system to its column in ``hyps``; ``first`` keeps the first recordings by key.
    """
    wanted = first_n(hyps, first, key) if first else hyps
    pairs = pair_strict(wanted, refs, key).withColumn("_arabic", buckwalter_to_arabic(F.col("ref")))
    return _report(pairs, "_arabic", systems, "ar", key, compat)


def evaluate_lines(
    lines: DataFrame,
    hyps: DataFrame,
    systems: Mapping[str, str],
    first: int | None = None,
    lang: str = "en",
    key: str = "utt_id",
    compat: bool = False,
) -> Report:
    """References from utterance lines (``text``); recordings without one are dropped."""
    pairs = pair_inner(hyps, lines.select(key, F.col("text").alias("ref")), key)
    if first:
        pairs = first_n(pairs, first, key)
    return _report(pairs, "ref", systems, lang, key, compat)


def evaluate_folder(
    spark: SparkSession,
    audio: str,
    labels: str,
    models: Mapping[str, Callable[[], Predictor]],
    first: int | None = None,
    compat: bool = False,
    **options,
) -> Report:
    """Annotate a folder of wav files (or its first ones by name) and score them against label files.

    Labels are transliterated Arabic; a file without label fails the job. A recording and its label have the same path
    below their folders but for the suffix, so two folders may use one name; ``utt_id`` of the report is that path.
    """
    name = with_suffix(F.col("rel_path"), "").alias("utt_id")
    # labels are checked before any model runs, and the models run once for all parts of the report
    if listable(spark, audio) and listable(spark, labels):
        files = list_files(spark, audio, ("wav",))
        wanted = (first_n(files, first, "rel_path") if first else files).select(name, "path", "rel_path", "length")
        found = list_files(spark, labels, ("lab",)).select(name, F.col("path").alias("_label"), F.col("length").alias("_size"))
        # narrow rows, too many to be broadcast; the tasks that need the bytes of a file read them
        pairs = cut_lineage(pair_strict(wanted, found.hint("merge"), "utt_id"))
        said = open_files(pairs.select("utt_id", "_label"), "_label", LABELS_AT_ONCE, file_tasks(pairs, "_size"))
        refs = cut_lineage(said.select("utt_id", label_text(F.col("content")).alias("ref")))
        recordings = pairs.select("utt_id", "path", "rel_path").repartition(file_tasks(pairs), "path")
    else:
        # a store that only Spark's readers know is listed by them, on the driver
        files = scan_audio(spark, audio, ("wav",))
        wanted = first_audio(spark, audio, files, first, "rel_path") if first else packed(files)
        texts = scan_texts_by_path(spark, labels, ("lab",)).withColumnRenamed("text", "ref")
        refs = cut_lineage(pair_strict(wanted.select(name), texts, "utt_id"))
        recordings = wanted.select(name, "rel_path", "content")
    options = {"language": "ar", "compat": compat, **options}
    records = cut_lineage(annotate(recordings, models, **options))
    return evaluate_records(records, refs, "ar", compat=compat)


def evaluate_chapters(
    spark: SparkSession,
    root: str,
    models: Mapping[str, Callable[[], Predictor]],
    first: int | None = None,
    compat: bool = False,
    **options,
) -> Report:
    """Annotate the flac files of chapter folders that have a line in their chapter, and score them.

    An utterance is known by its chapter and id, so two chapters may use one id; ``utt_id`` of the report is the path
    of the file without suffix. ``first`` takes the first by that path.
    """
    kept, chapter = ["chapter", "utt_id"], parent(F.col("path")).alias("chapter")
    if listable(spark, root):
        listed = list_files(spark, root, ("flac", "trans.txt"))
        spoken = F.endswith(F.col("path"), F.lit(".flac"))
        files = listed.where(spoken).select(stem(F.col("path")).alias("utt_id"), "path", "rel_path", "length", chapter)
        # lines are read once, and stored as large as they are: joins that broadcast go by the stored size
        read = stored(read_lines(listed.where(~spoken)), "lines", compression="none")
        lines = parse_utterance_lines(read, ("part", "line_no"))
    else:
        # patterns are listed by Spark's readers, on the driver
        lines = scan_utterance_lines(spark, root)
        found = spark.read.format("binaryFile").options(**audio_options(("flac",))).load(root)
        files = audio_rows(found, root, parent(F.col("_metadata.file_path")).alias("chapter")).drop("content")
    lines = lines.select(*kept, F.col("text").alias("ref"))
    named = files.hint("merge").join(lines, kept).withColumn("name", with_suffix(F.col("rel_path"), ""))
    # narrow rows; the bytes of the wanted files are read by the tasks that annotate them
    wanted = cut_lineage(named.select("name", "path", "rel_path", "length", "ref"))
    chosen = first_n(wanted, first, "name") if first else wanted
    recordings = chosen.select(F.col("name").alias("utt_id"), "path", "rel_path").repartition(file_tasks(chosen), "path")
    options = {"language": "en", "compat": compat, **options}
    records = cut_lineage(annotate(recordings, models, **options))
    return evaluate_records(records, wanted.select(F.col("name").alias("utt_id"), "ref"), "en", compat=compat)


def compare_texts(refs: DataFrame, hyps: DataFrame, key: str = "utt_id", compat: bool = False) -> DataFrame:
    """Raw WER per reference of two ``(key, text)`` tables."""
    paired = pair_left(
        refs.select(key, F.col("text").alias("ref_text")), hyps.select(key, F.col("text").alias("hyp_text")), key
    )
    return raw_wer(paired, compat=compat)


def compare_folders(spark: SparkSession, refs: str, hyps: str, compat: bool = False) -> DataFrame:
    """Mean raw WER of the text files both folders have, and the share that misses; fails without any."""
    return coverage(compare_texts(scan_texts(spark, refs), scan_texts(spark, hyps), compat=compat))
