"""Named queries over the test tables. Every one reads its tables whole."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxframe.functions import paths as P
from voxframe.functions import text as X
from voxframe.functions import tokens as K
from voxframe.functions.scoring import cer_stats, char_distance, edit_ops
from voxframe.functions.voting import align_to_reference
from voxframe.operators import consensus as C
from voxframe.operators import records as R
from voxframe.operators.inference import Attempt, infer_stage
from voxframe.operators.ordering import first_n, number_rows, order_by_key, skip_n
from voxframe.operators.pairing import (
    assert_complete,
    audit,
    audit_ranges,
    audit_summary,
    common_names,
    last_wins,
    pair_left,
    pair_reporting,
    pair_strict,
    skip_done,
)
from voxframe.operators.scores import coverage, score_pairs, score_systems, system_summary, to_long
from voxframe.operators.sequence import Chunking, chunk_windows, overlap_add, to_samples
from voxframe.operators.similarity import mean_similarity, pair_similarity
from voxframe.plans import annotate as A
from voxframe.plans.corpus import clean_corpus, clean_transcripts, prepare_table
from voxframe.plans.evaluate import (
    compare_folders,
    compare_texts,
    evaluate_chapters,
    evaluate_folder,
    evaluate_lines,
    evaluate_records,
    evaluate_transliterated,
)
from voxframe.plans.folders import errors_of, process_audio
from voxframe.plans.sequences import chunk_and_stitch
from voxframe.session import MIN_BYTES_PER_TASK, input_bytes, scratch_path, spread, stored
from voxframe.sources.catalog import active_entries, scan_catalog, scan_dataset, scan_embeddings, with_roles
from voxframe.sources.commits import read_output
from voxframe.sources.files import parse_utterance_lines, scan_audio, scan_texts, scan_utterance_lines
from voxframe.sources.sinks import add_progress, progress, write_records, write_report, write_texts
from voxframe.streaming.chunks import stream_chunk_windows
from voxframe.streaming.stitching import stream_stitch
from voxframe.streaming.resume import resume_run, stream_to_table, with_end_mark

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents, over all cores."""
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def r6(c: Column) -> Column:
    return F.round(c, 6)


# --- transcripts by rule -------------------------------------------------------------------------

SYSTEMS = {"asr_a": "asr_a", "asr_b": "asr_b", "asr_c": "asr_c", "judge": "judge"}


def dropped(ws: Column) -> Column:
    """Every 7th word is missing."""
    return F.array_join(F.filter(ws, lambda w, i: (i + 1) % 7 != 0), " ")


def replaced(ws: Column, sign: str) -> Column:
    """Every 5th word is another one of the same length."""
    return F.array_join(
        F.transform(ws, lambda w, i: F.when((i + 1) % 5 == 0, F.repeat(F.lit(sign), F.length(w))).otherwise(w)), " "
    )


def inserted(ws: Column, sign: str) -> Column:
    """A new word follows every 9th one."""
    return F.array_join(
        F.transform(ws, lambda w, i: F.when((i + 1) % 9 == 0, F.concat(w, F.lit(" " + sign * 2))).otherwise(w)), " "
    )


def mixed(ws: Column, sign: str) -> Column:
    """Every 7th word is missing, every other 5th one replaced."""
    kept = F.filter(
        F.transform(
            ws,
            lambda w, i: F.when((i + 1) % 7 == 0, F.lit(None).cast("string"))
            .when((i + 1) % 5 == 0, F.repeat(F.lit(sign), F.length(w)))
            .otherwise(w),
        ),
        lambda w: w.isNotNull(),
    )
    return F.array_join(kept, " ")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return table(spark, sf, "conversations").withColumn("utt_id", key)


def transcripts(spark: SparkSession, sf: str, normal: Callable[[Column], Column] = X.normalize_generic, sign: str = "ж") -> DataFrame:
    """Turns with four transcripts each; the third system has none for turns of the role ``system``."""
    ws = F.col("_ws")
    return spread(turns(spark, sf), "utt_id").withColumn("_ws", X.words(normal(F.col("text")))).select(
        "utt_id",
        "conv_id",
        "turn",
        "role",
        F.col("text").alias("ref"),
        dropped(ws).alias("asr_a"),
        replaced(ws, sign).alias("asr_b"),
        F.when(F.col("role") != "system", inserted(ws, sign)).alias("asr_c"),
        mixed(ws, sign).alias("judge"),
    )


def rounded(summary: DataFrame) -> DataFrame:
    return summary.select(
        "system", "n_files", "n_scored", "n_missing", *[r6(F.col(m)).alias(m) for m in ("wer", "cer", "sub_rate", "del_rate", "ins_rate")]
    )


# --- text functions ------------------------------------------------------------------------------


@query
def normalize_generic(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select("doc_id", X.normalize_generic(F.col("text")).alias("clean"))


@query
def normalize_ws(spark: SparkSession, sf: str) -> DataFrame:
    return clean_transcripts(table(spark, sf, "documents"), "normalize_text").select("doc_id", F.col("text").alias("clean"))


@query
def normalize_extreme(spark: SparkSession, sf: str) -> DataFrame:
    return clean_transcripts(table(spark, sf, "documents"), "extreme").select("doc_id", F.col("text").alias("clean"))


def tagged_text(c: Column) -> Column:
    """Upper-case text with spoken punctuation and silent tags in place of signs."""
    text = F.upper(c)
    for sign, tag in ((",", " <COMMA>"), (".", " <PERIOD>"), ("?", " <QUESTIONMARK>"), ("!", " <EXCLAMATIONPOINT>"), ("\n", " <SIL> I ")):
        text = F.replace(text, F.lit(sign), F.lit(tag))
    return text


@query
def restore_sentence_case(spark: SparkSession, sf: str) -> DataFrame:
    tagged = turns(spark, sf).withColumn("text", tagged_text(F.col("text")))
    return clean_transcripts(tagged, "capitalize_remove_punctuation").select("utt_id", F.col("text").alias("clean"))


@query
def clean_profile_both(spark: SparkSession, sf: str) -> DataFrame:
    tagged = turns(spark, sf).withColumn("text", tagged_text(F.col("text")))
    return clean_transcripts(tagged, "both").select("utt_id", F.col("text").alias("clean"))


@query
def buckwalter(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select("doc_id", X.buckwalter_to_arabic(F.col("text")).alias("arabic"))


@query
def normalize_ar(spark: SparkSession, sf: str) -> DataFrame:
    arabic = X.buckwalter_to_arabic(F.col("text"))
    return texts(spark, sf).select("doc_id", X.normalize_ar(arabic).alias("clean"))


@query
def strip_time_tags(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("turn").cast("string")
    stamped = F.concat(
        F.lit("[ 0m"), t, F.lit("s285ms - 0m"), t, F.lit("s935ms ] "), F.replace("text", F.lit(". "), F.lit(". [1m2s3ms] [hmm] [laugh] "))
    )
    return turns(spark, sf).select("utt_id", X.strip_time_tags(stamped).alias("clean"))


@query
def squeeze_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select("doc_id", K.squeeze_tokens(F.col("text")).alias("phones"))


@query
def word_counts(spark: SparkSession, sf: str) -> DataFrame:
    ws = X.words(F.col("text"))
    return texts(spark, sf).select(
        "doc_id", F.size(ws).cast("long").alias("n_words"), F.array_max(F.transform(ws, F.length)).cast("long").alias("longest")
    )


@query
def extract_tagged(spark: SparkSession, sf: str) -> DataFrame:
    """Replies of every kind: closed, open, cut off, dangling, bare, refused, too short."""
    kind = (F.col("conv_id") + F.col("turn")) % 7
    text = F.col("text")
    reply = (
        F.when(kind == 0, F.concat(F.lit("so: <corrected> "), text, F.lit(" </corrected> done")))
        .when(kind <= 2, F.concat(F.lit("<corrected>"), text))
        .when(kind == 3, F.concat(text, F.lit("</corrected>")))
        .when(kind == 4, text)
        .when(kind == 5, F.concat(F.lit("Sorry, "), text))
        .otherwise(F.lit("<corrected>x</corrected>"))
    )
    base = F.concat(F.lit("base "), text)
    value = X.extract_tagged(reply, base, F.lit("en"), kind == 2)
    return turns(spark, sf).select("utt_id", value.alias("merged"))


@query
def request_prompts(spark: SparkSession, sf: str) -> DataFrame:
    made = A.request(
        {"en": "Text: {text}\nSource: {source}\n", "": "[{lang}] {text}"},
        F.col("lang"),
        {name: F.col(name) for name in ("text", "source", "lang")},
    )
    return table(spark, sf, "documents").select("doc_id", made.alias("prompt"))


@query
def speech_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as token text and back; vectors of label 0 have no token."""
    ids = F.when(F.col("label") != 0, F.transform("embedding", lambda x: F.floor(F.abs(x) * 1000).cast("int")))
    text = K.speech_tokens(F.coalesce(ids, F.array().cast("array<int>")))
    back = K.speech_ids(F.col("codes"))
    return (
        table(spark, sf, "embeddings")
        .select("vec_id", text.alias("codes"))
        .select(
            "vec_id",
            "codes",
            F.size(F.coalesce(back, F.array().cast("array<int>"))).cast("long").alias("n_ids"),
            F.aggregate(F.coalesce(back, F.array().cast("array<int>")), F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_ids"),
            K.speech_ids_error(F.col("codes")).alias("error"),
        )
    )


@query
def file_keys(spark: SparkSession, sf: str) -> DataFrame:
    file = F.concat(F.regexp_replace("url", "^https?://", "/"), F.lit(".v1.wav"))
    return table(spark, sf, "pages").select(
        "page_id",
        P.stem(file).alias("stem"),
        P.with_suffix(file, ".json").alias("json_path"),
        P.parent(file).alias("folder"),
        P.relative_to(file, "/").alias("rel_path"),
    )


# --- scores --------------------------------------------------------------------------------------


@query
def wide_to_long(spark: SparkSession, sf: str) -> DataFrame:
    """One row per document and system, also where a system has nothing."""
    wide = documents_by_id(spark, sf).withColumn("short", F.lower("source")).withColumn("none", F.lit(None).cast("string"))
    return to_long(wide, {"a": "text", "b": "short", "c": "none"}, ["utt_id", "lang"])


@query
def system_scores(spark: SparkSession, sf: str) -> DataFrame:
    scores = score_systems(transcripts(spark, sf), SYSTEMS, "en")
    return rounded(system_summary(scores, [*SYSTEMS, "unused"]))


@query
def system_scores_compat(spark: SparkSession, sf: str) -> DataFrame:
    """Missing transcripts scored as blank ones."""
    scores = score_systems(transcripts(spark, sf), SYSTEMS, "en", compat=True)
    return rounded(system_summary(scores, list(SYSTEMS))).select("system", "n_files", "n_scored", "n_missing", "wer", "cer")


@query
def utterance_scores(spark: SparkSession, sf: str) -> DataFrame:
    scores = score_systems(transcripts(spark, sf), SYSTEMS, "en")
    return scores.select(
        "utt_id",
        "system",
        *[F.col(c).cast("long").alias(c) for c in ("distance", "ref_words", "hyp_words", "substitutions", "deletions", "insertions")],
        *[r6(F.col(m)).alias(m) for m in ("wer", "cer", "sub_rate", "del_rate", "ins_rate")],
    )


@query
def evaluate_arabic(spark: SparkSession, sf: str) -> DataFrame:
    """Transliterated references against Arabic transcripts."""

    def normal(c: Column) -> Column:
        return X.normalize_ar(X.buckwalter_to_arabic(c))

    made = transcripts(spark, sf, normal, "پ")
    refs = turns(spark, sf).select("utt_id", F.col("text").alias("ref"))
    return rounded(evaluate_transliterated(refs, made.drop("ref"), SYSTEMS).summary)


def put_files(rows: DataFrame, root: str) -> None:
    """Write a file per row (``path`` below the root, ``body``), each by the task that holds the row."""

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        files, top = FileSystem.from_uri(root if "://" in root else f"file://{root.removeprefix('file:')}")
        last = None
        for frame in frames:
            for path, body in zip(frame["path"], frame["body"]):
                folder = f"{top}/{path}".rsplit("/", 1)[0]
                if folder != last:
                    files.create_dir(folder, recursive=True)
                    last = folder
                with files.open_output_stream(f"{top}/{path}") as out:
                    out.write(body.encode())
            yield pd.DataFrame({"n": [len(frame)]})

    rows.select("path", "body").mapInPandas(put, "n int").write.format("noop").mode("overwrite").save()


def told(answer: Callable[[str], dict]) -> Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]:
    """A stub model that answers from what a recording says."""

    def make() -> Callable[[pd.DataFrame], pd.DataFrame]:
        return lambda batch: pd.DataFrame([answer(bytes(c).decode()) for c in batch["content"]])

    return make


def asked(answer: Callable[[str], dict]) -> Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]:
    return lambda: lambda batch: pd.DataFrame([answer(r) for r in batch["request"]])


#: The first and third system hear all, the second misses every 7th word, the judge finds nothing, the polish changes nothing.
JOB_MODELS = {
    "measure": told(lambda said: {"duration": 1.0, "snr": 0.0}),
    **{tagger: told(lambda said: {"label": "no_sounds", "confidence": 0.0}) for tagger in A.TAGGERS},
    "first": told(lambda said: {"text": said, "segments": []}),
    "second": told(lambda said: {"text": " ".join(w for i, w in enumerate(said.split(), 1) if i % 7)}),
    "third": told(lambda said: {"text": said}),
    "judge": asked(lambda request: {"text": "-", "truncated": False}),
    "polish": asked(lambda request: {"text": request.partition("\n")[2]}),
    "speakers": told(lambda said: {"segments": []}),
    "gender": told(lambda said: {"label": "f"}),
}


@query
def evaluate_folder_job(spark: SparkSession, sf: str) -> DataFrame:
    """Recordings and label files in folders that use the same names, through annotation to the scores of each system."""
    sounds, labels = scratch_path(spark, "wavs"), scratch_path(spark, "labels")
    said = turns(spark, sf).withColumn("name", F.concat_ws("/", F.col("conv_id") % 3, "conv_id", F.concat(F.lit("u"), "turn")))
    arabic = F.array_join(X.words(X.normalize_ar(X.buckwalter_to_arabic(F.col("text")))), " ")
    put_files(said.select(F.concat("name", F.lit(".wav")).alias("path"), arabic.alias("body")), sounds)
    put_files(said.select(F.concat("name", F.lit(".lab")).alias("path"), F.col("text").alias("body")), labels)
    return rounded(evaluate_folder(spark, sounds, labels, JOB_MODELS, pause_s=0.0).summary)


@query
def evaluate_chapters_job(spark: SparkSession, sf: str) -> DataFrame:
    """Chapter folders with a line file and recordings, all of them with the same ids, through annotation to scores."""
    root = scratch_path(spark, "chapters")
    said = turns(spark, sf).select(F.col("conv_id").cast("string").alias("chapter"), "turn", "text")
    heard = F.array_join(X.words(X.normalize_generic(F.col("text"))), " ")
    put_files(said.select(F.concat("chapter", F.lit("/u"), "turn", F.lit(".flac")).alias("path"), heard.alias("body")), root)
    line = F.concat(F.lit("u"), "turn", F.lit(" "), F.regexp_replace("text", r"[\r\n]", " "))
    lines = said.groupBy("chapter").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("body"))
    put_files(lines.select(F.concat("chapter", F.lit("/c.trans.txt")).alias("path"), "body"), root)
    return rounded(evaluate_chapters(spark, root, JOB_MODELS, pause_s=0.0).summary)


@query
def compare_folders_job(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of texts against one that lacks every fourth of them, and of the others every 7th word."""
    refs, hyps = scratch_path(spark, "refs"), scratch_path(spark, "hyps")
    said = turns(spark, sf).withColumn("path", F.concat("utt_id", F.lit(".txt")))
    put_files(said.select("path", F.col("text").alias("body")), refs)
    put_files(said.where("turn % 4 <> 3").select("path", dropped(X.words(F.col("text"))).alias("body")), hyps)
    return compare_folders(spark, refs, hyps).select(
        "n_refs", "n_matched", "n_unmatched", r6("mean_wer").alias("mean_wer"), r6("pct_unmatched").alias("pct_unmatched")
    )


@query
def evaluate_first_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The first 100 utterances by id against their line files."""
    hyps = transcripts(spark, sf).drop("ref")
    return rounded(evaluate_lines(utterance_table(spark, sf), hyps, SYSTEMS, first=100).summary)


def adjacent_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn with the next one of its conversation, both normalised."""
    said = turns(spark, sf).select("conv_id", "turn", "utt_id", X.normalize_generic(F.col("text")).alias("ref"))
    following = said.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ref").alias("hyp"))
    return said.join(following, ["conv_id", "turn"])


@query
def wer_adjacent_turns(spark: SparkSession, sf: str) -> DataFrame:
    scores = score_pairs(spread(adjacent_turns(spark, sf), "utt_id"))
    return scores.select(
        "utt_id",
        *[F.col(c).cast("long").alias(c) for c in ("distance", "ref_words", "hyp_words")],
        (F.col("substitutions") + F.col("deletions") + F.col("insertions")).cast("long").alias("n_edits"),
        (F.col("deletions") - F.col("insertions")).cast("long").alias("net_deleted"),
        r6("wer").alias("wer"),
    )


@query
def edit_ops_adjacent_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by kind of edit, and by the historical way of counting."""
    ref, hyp = X.words(F.col("ref")), X.words(F.col("hyp"))
    counted = spread(adjacent_turns(spark, sf), "utt_id").select(
        "utt_id", edit_ops(ref, hyp).alias("e"), edit_ops(ref, hyp, compat=True).alias("c")
    )
    return counted.select(
        "utt_id",
        *[F.col(f"e.{c}").cast("long").alias(c) for c in ("distance", "substitutions", "deletions", "insertions")],
        F.col("c.deletions").cast("long").alias("compat_deletions"),
        F.col("c.insertions").cast("long").alias("compat_insertions"),
    )


@query
def cer_adjacent_turns(spark: SparkSession, sf: str) -> DataFrame:
    pairs = spread(adjacent_turns(spark, sf), "utt_id").withColumn("_d", char_distance("ref", "hyp"))
    cer = cer_stats(F.col("ref"), F.col("hyp"), F.col("_d"))
    return pairs.select("utt_id", cer.alias("c")).select(
        "utt_id",
        F.col("c.distance").cast("long").alias("distance"),
        F.col("c.ref_chars").cast("long").alias("ref_chars"),
        F.col("c.hyp_chars").cast("long").alias("hyp_chars"),
        r6(F.col("c.cer")).alias("cer"),
    )


@query
def pair_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Raw WER of whole documents against copies without every 7th word; unlabelled ones have no copy."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("utt_id"), "text")
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("utt_id"))
    copies = docs.join(labelled, "utt_id", "left_semi").withColumn("text", dropped(X.words(F.col("text"))))
    found = coverage(compare_texts(spread(docs, "utt_id"), copies))
    return found.select(
        "n_refs", "n_matched", "n_unmatched", r6("mean_wer").alias("mean_wer"), r6("pct_unmatched").alias("pct_unmatched")
    )


# --- joins and audits ----------------------------------------------------------------------------


def documents_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").withColumnRenamed("doc_id", "utt_id")


def labels_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").withColumnRenamed("doc_id", "utt_id")


@query
def left_pairing(spark: SparkSession, sf: str) -> DataFrame:
    both = pair_left(documents_by_id(spark, sf).select("utt_id", "lang"), labels_by_id(spark, sf))
    return both.select("utt_id", "lang", "quality", F.col("matched").cast("int").alias("matched"))


@query
def strict_pairing(spark: SparkSession, sf: str) -> DataFrame:
    both = pair_strict(labels_by_id(spark, sf), documents_by_id(spark, sf).select("utt_id", "lang", "n_chars"))
    return both.select("utt_id", "quality", "toxic", "lang", "n_chars")


@query
def text_code_pairing(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their codes (vectors), and those skipped for want of any."""
    docs = documents_by_id(spark, sf).select("utt_id", "lang")
    codes = table(spark, sf, "embeddings").select(F.col("vec_id").alias("utt_id"), F.size("embedding").alias("n_codes"))
    paired, skipped = pair_reporting(docs, codes)
    return paired.select("utt_id", "lang", F.col("n_codes").cast("long").alias("n_codes")).unionByName(
        skipped.select("utt_id", "lang", F.lit(None).cast("long").alias("n_codes"))
    )


@query
def common_keys(spark: SparkSession, sf: str) -> DataFrame:
    return common_names(documents_by_id(spark, sf), labels_by_id(spark, sf), "utt_id")


@query
def skip_finished(spark: SparkSession, sf: str) -> DataFrame:
    return skip_done(documents_by_id(spark, sf), labels_by_id(spark, sf)).select("utt_id", "lang", "source")


@query
def audit_missing(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("utt_id"))
    return audit(labels_by_id(spark, sf), vectors)


@query
def audit_counts(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("utt_id"))
    return audit_summary(labels_by_id(spark, sf), vectors)


@query
def completeness(spark: SparkSession, sf: str) -> DataFrame:
    """The documents in order of id against those that come out of a shuffle by another key, cleaned."""
    docs = documents_by_id(spark, sf)
    dealt = table(spark, sf, "documents").repartition("source", "lang").select(F.col("doc_id").alias("utt_id"), "text")
    return assert_complete(docs, clean_transcripts(dealt, "extreme").where(F.col("text").isNotNull()))


@query
def gaps_of_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Two tables that differ: what of the labelled documents has no long text, and the other way round."""
    long = documents_by_id(spark, sf).where(F.length("text") > 1000).select("utt_id")
    return audit(labels_by_id(spark, sf).select("utt_id"), long)


@query
def audit_differing(spark: SparkSession, sf: str) -> DataFrame:
    """The documents against a copy of which three keys differ: only their ranges are compared key by key."""
    docs = documents_by_id(spark, sf).select("utt_id")
    last = docs.agg(F.max("utt_id").alias("utt_id"))
    copy = docs.where("utt_id <> 17").join(last, "utt_id", "left_anti")
    return audit_ranges(docs, copy.unionByName(last.select((-F.col("utt_id")).alias("utt_id"))))


@query
def last_event_wins(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", r6("value").alias("value"))
    return last_wins(events, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


# --- order ---------------------------------------------------------------------------------------


def string_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("utt_id"), "lang", "source")


@query
def sorted_keys(spark: SparkSession, sf: str) -> DataFrame:
    return order_by_key(string_keys(spark, sf), "utt_id")


@query
def first_n_sorted(spark: SparkSession, sf: str) -> DataFrame:
    return first_n(string_keys(spark, sf), 100, "utt_id")


@query
def skip_n_sorted(spark: SparkSession, sf: str) -> DataFrame:
    return skip_n(string_keys(spark, sf), 100, ["utt_id"])


@query
def running_number(spark: SparkSession, sf: str) -> DataFrame:
    return number_rows(string_keys(spark, sf), ["utt_id"], ["lang"], "utt_no")


# --- similarity ----------------------------------------------------------------------------------


def following_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity of each vector and the next one."""
    path = f"{sf}/embeddings.parquet"
    a = scan_embeddings(spark, path, "vec_id")
    return pair_similarity(a, a.withColumn("name", F.col("name") - 1))


@query
def embedding_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return following_vectors(spark, sf).select("name", r6("similarity").alias("similarity"))


@query
def embedding_mean(spark: SparkSession, sf: str) -> DataFrame:
    found = mean_similarity(following_vectors(spark, sf))
    return found.select("n_pairs", "n_scored", r6("mean_similarity").alias("mean_similarity"))


# --- consensus -----------------------------------------------------------------------------------


def voter_words(ws: Column, place: int) -> Column:
    """A voter misses the word at every 4th position, each voter at another one."""
    return F.transform(ws, lambda w, i: F.when(i % 4 == place, F.concat(F.lit(f"v{place}"), w)).otherwise(w))


def long_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Words of three voters by position."""
    ws = turns(spark, sf).select("utt_id", X.words(F.col("text")).alias("ws"))
    voters = F.array(*[F.struct(F.lit(i).alias("rank"), voter_words(F.col("ws"), i).alias("ws")) for i in range(3)])
    return (
        ws.select("utt_id", F.inline(voters))
        .select("utt_id", "rank", F.posexplode("ws").alias("pos", "word"))
    )


@query
def consensus_vote(spark: SparkSession, sf: str) -> DataFrame:
    return C.join_tokens(C.vote_tokens(long_tokens(spark, sf))).select("utt_id", F.col("text").alias("merged"))


@query
def consensus_tie_votes(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring turns as voters on the same position: most words are tied."""
    ws = turns(spark, sf).select("conv_id", F.col("turn").alias("rank"), F.posexplode(X.words(F.col("text"))).alias("pos", "word"))
    return C.vote_tokens(ws, "conv_id").select("conv_id", F.col("pos").cast("long").alias("pos"), "word")


@query
def longest_transcript(spark: SparkSession, sf: str) -> DataFrame:
    said = turns(spark, sf).select("conv_id", F.col("turn").alias("rank"), "text")
    return C.longest_transcript(C.drop_blank(said), "conv_id").select("conv_id", "rank", "text")


def numbered_words(spark: SparkSession, sf: str, heavy: bool = False) -> DataFrame:
    """Words of each turn, told apart by their position; ``heavy`` where they are aligned row by row."""
    ws = F.transform(X.words(F.col("text")), lambda w, i: F.concat_ws("_", w, i.cast("string")))
    return spread(turns(spark, sf), "utt_id", heavy=heavy).select("utt_id", ws.alias("ws"))


@query
def merge_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """Three voters with errors at different places, the third without every 7th word."""
    ws = F.col("ws")
    third = F.filter(voter_words(ws, 2), lambda w, i: (i + 1) % 7 != 0)
    voters = numbered_words(spark, sf).select(
        "utt_id",
        F.array_join(voter_words(ws, 0), " ").alias("one"),
        F.array_join(voter_words(ws, 1), " ").alias("two"),
        F.array_join(third, " ").alias("three"),
    )
    return C.merge_transcripts(voters, ["one", "two", "three"]).select("utt_id", "merged")


@query
def merge_rule_made(spark: SparkSession, sf: str) -> DataFrame:
    """The rule-made transcripts, with their repeated words, merged."""
    merged = C.merge_transcripts(transcripts(spark, sf), ["asr_a", "asr_b", "asr_c", "judge"])
    return merged.select("utt_id", "merged")


@query
def align_words(spark: SparkSession, sf: str) -> DataFrame:
    """Places of the words of three rule-made targets in their reference."""
    ws = F.col("ws")
    targets = {
        "dropped": F.filter(ws, lambda w, i: (i + 1) % 7 != 0),
        "replaced": F.transform(ws, lambda w, i: F.when((i + 1) % 5 == 0, F.lit("ж")).otherwise(w)),
        "inserted": F.flatten(
            F.transform(ws, lambda w, i: F.when((i + 1) % 9 == 0, F.array(w, F.lit("ж"))).otherwise(F.array(w)))
        ),
    }
    placed = numbered_words(spark, sf, heavy=True).select(
        "utt_id", *[align_to_reference(ws, t).alias(name) for name, t in targets.items()]
    )
    each = F.inline(F.array(*[F.struct(F.lit(name).alias("target"), F.col(name).alias("places")) for name in targets]))
    return placed.select("utt_id", each).select("utt_id", "target", F.posexplode("places").alias("pos", "ref_pos")).select(
        "utt_id", "target", F.col("pos").cast("long").alias("pos"), F.col("ref_pos").cast("long").alias("ref_pos")
    )


# --- records -------------------------------------------------------------------------------------


def spoken(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as recordings: two segments of timed words and speech segments per sentence."""
    ws = F.col("_ws")
    half = F.floor(F.size(ws) / 2).cast("int")

    def timed(words: Column, first: Column) -> Column:
        return F.transform(
            words,
            lambda w, i: F.struct(
                F.concat(F.lit(" "), w).alias("word"),
                ((first + i) / 2).alias("start"),
                ((first + i + 1) / 2).alias("end"),
                F.when((first + i) % 3 != 0, F.lit(0.5)).alias("probability"),
            ),
        )

    segments = F.array(
        F.struct(timed(F.slice(ws, F.lit(1), half), F.lit(0)).alias("words")),
        F.struct(timed(F.slice(ws, half + 1, F.size(ws)), half).alias("words")),
    )
    speech = F.transform(
        F.split("text", r"\n"),
        lambda s, i: F.concat_ws(
            " ",
            i.cast("double").cast("string"),
            (i + 1).cast("double").cast("string"),
            F.concat(F.lit("spk_"), ((i + F.col("turn")) % 3).cast("string")),
        ),
    )
    return spread(turns(spark, sf), "utt_id").withColumn("_ws", X.words(F.col("text"))).withColumn("segments", segments).withColumn(
        "speech_segments", speech
    ).withColumn("duration", F.size("_ws") / 2 * F.when(F.col("turn") % 5 == 4, 0).otherwise(1))


@query
def word_timings(spark: SparkSession, sf: str) -> DataFrame:
    timed = spoken(spark, sf).select("utt_id", F.posexplode(K.word_timings(F.col("segments"))).alias("pos", "w"))
    return timed.select("utt_id", F.col("pos").cast("long").alias("pos"), "w.word", "w.start", "w.end", "w.probability")


@query
def speaker_count(spark: SparkSession, sf: str) -> DataFrame:
    segs = K.parse_segments(F.col("speech_segments"))
    return spoken(spark, sf).select(
        "utt_id",
        F.size(segs).cast("long").alias("n_segments"),
        K.n_speakers(segs).cast("long").alias("n_speakers"),
        F.aggregate(segs, F.lit(0.0), lambda a, s: a + s["end"] - s["start"]).alias("spoken"),
    )


@query
def speaking_rate(spark: SparkSession, sf: str) -> DataFrame:
    speed = K.speaking_rate(X.n_words(F.col("text")), F.col("duration"))
    return spoken(spark, sf).select("utt_id", speed.alias("s")).select(
        "utt_id", r6("s.word_per_sec").alias("word_per_sec"), r6("s.word_per_min").alias("word_per_min")
    )


@query
def language_argmax(spark: SparkSession, sf: str) -> DataFrame:
    """Most frequent language of each source, through a map of shares."""
    counts = table(spark, sf, "documents").groupBy("source", "lang").count()
    shares = counts.groupBy("source").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "count")))).alias("n"), F.sum("count").alias("total")
    )
    probs = F.transform_values("n", lambda _, n: n / F.col("total"))
    return shares.select("source", probs.alias("probs")).select(
        "source", K.argmax_map(F.col("probs")).alias("lang"), r6(F.element_at("probs", K.argmax_map(F.col("probs")))).alias("share")
    )


@query
def labelled_variant(spark: SparkSession, sf: str) -> DataFrame:
    both = pair_left(documents_by_id(spark, sf), labels_by_id(spark, sf))
    label = F.when(F.col("toxic") == 1, "laugh").otherwise("no_sounds")
    sure = F.col("n_chars") % 10 / 10
    chosen = R.labelled_variant(F.concat(F.lit("[laugh] "), F.col("text")), F.col("text"), label, sure)
    return both.select("utt_id", chosen.alias("variant"))


@query
def language_route(spark: SparkSession, sf: str) -> DataFrame:
    return documents_by_id(spark, sf).select(
        "utt_id",
        R.third_system_wanted(F.col("lang")).cast("int").alias("wanted"),
        R.route_third_system(F.col("text"), F.col("lang")).alias("third"),
        R.skip_note(F.col("lang")).alias("status"),
    )


@query
def fallback_chain(spark: SparkSession, sf: str) -> DataFrame:
    both = pair_left(documents_by_id(spark, sf), labels_by_id(spark, sf))
    judged = F.when(F.col("quality") == 1, F.col("text")).when(F.col("quality") == 0, F.lit(" \t"))
    value = R.first_usable(judged, F.when(F.col("lang") == "en", F.col("source")), F.lit("none"))
    return both.select("utt_id", value.alias("chosen"))


@query
def nonblank_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", r"\n")).alias("line", "text"))
    return C.drop_blank(lines).select("doc_id", F.col("line").cast("long").alias("line"), "text")


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as records, with the models' answers made by rule."""
    text = F.col("text")
    kind = (F.col("conv_id") + F.col("turn")) % 4
    label = F.when(kind == 1, "laugh").otherwise("no_sounds")
    sure = F.when(F.col("turn") % 2 == 0, 0.9).otherwise(0.5)
    lang = F.when(kind < 3, F.lit("en")).otherwise(F.lit("ar"))
    answered = spoken(spark, sf).select(
        "utt_id",
        F.concat_ws("/", "role", F.concat("utt_id", F.lit(".wav"))).alias("rel_path"),
        F.create_map(lang, F.lit(0.75), F.lit("fr"), F.lit(0.25)).alias("language_probs"),
        F.lower(text).alias("first"),
        F.concat(F.lit("[0m1s2ms] "), text).alias("second"),
        F.concat(F.lit("[laugh] "), text).alias("second_labelled"),
        text.alias("third"),
        label.alias("non_speech_label"),
        sure.alias("non_speech_confidence"),
        F.when(kind == 0, F.concat(F.lit("<corrected>"), F.upper(text), F.lit("</corrected>"))).alias("reply"),
        F.lit(False).alias("truncated"),
        F.when(kind != 2, F.concat(text, F.lit(" ok"))).alias("polished"),
        F.lit("quiet").alias("noise_label"),
        F.lit(0.25).alias("noise_confidence"),
        "segments",
        F.lit(12.5).alias("snr"),
        "speech_segments",
        F.when(F.col("turn") % 2 == 0, "f").otherwise("m").alias("gender"),
        "duration",
    )
    settled = A.with_final(A.with_merged(A.with_second(A.with_language(answered))))
    return A.to_record(settled, ("non_speech", "noise")).select("utt_id", "rel_path", "record")


def flat_record(df: DataFrame) -> DataFrame:
    info, said = "speaker_info", "transcriptions"
    return df.select(
        "utt_id",
        "rel_path",
        F.col(f"{said}.detected_language").alias("lang"),
        F.col(f"{said}.first").alias("first"),
        F.col(f"{said}.second").alias("second"),
        F.col(f"{said}.third").alias("third"),
        F.col(f"{said}.third_status").alias("third_status"),
        F.col(f"{said}.merged").alias("merged"),
        F.col(f"{said}.second_with_label").alias("with_label"),
        F.col(f"{said}.final").alias("final"),
        F.col("audio_classification.non_speech.label").alias("label"),
        F.col("audio_classification.noise.confidence").alias("noise_confidence"),
        F.size("alignment").cast("long").alias("n_aligned"),
        F.col("snr").alias("snr"),
        F.col(f"{info}.num_speakers").cast("long").alias("num_speakers"),
        F.col(f"{info}.gender").alias("gender"),
        F.col(f"{info}.duration").alias("duration"),
        r6(f"{info}.word_per_sec").alias("word_per_sec"),
    )


@query
def annotated_record(spark: SparkSession, sf: str) -> DataFrame:
    return flat_record(records(spark, sf).select("utt_id", "rel_path", "record.*"))


def row_model(answer: Callable[[int, int, str, str], dict]) -> Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]:
    """A stub model that answers row by row from conversation, turn, text and request."""

    def make() -> Callable[[pd.DataFrame], pd.DataFrame]:
        def predict(batch: pd.DataFrame) -> pd.DataFrame:
            rows = []
            for row in batch.to_dict("records"):
                head, _, text = (bytes(row["content"]).decode() if "content" in row else "0-0|").partition("|")
                conv, turn = map(int, head.split("-"))
                rows.append(answer(conv, turn, text, row.get("request", "")))
            return pd.DataFrame(rows)

        return predict

    return make


def judge_reply(conv: int, turn: int, text: str, asked: str) -> dict:
    """Marked requests come back in capitals or fail, English ones as they are, others too short."""
    base = asked.partition("Text: ")[2].partition("\nReference 1: ")
    kind = base[2].partition("\nReference 2: ")[0][-1:]
    if kind == "2":
        raise RuntimeError("no judgement")
    return {"text": f"{base[0].upper() if kind == '0' else base[0]}</corrected>" if base[1] else "-", "truncated": False}


def polish_reply(conv: int, turn: int, text: str, asked: str) -> dict:
    merged = asked.partition("\n")[2]
    if "zz" in merged:
        raise RuntimeError("no polish")
    return {"text": f"{merged} ok"}


def timed_segments(text: str) -> list[dict]:
    timed = [{"word": f" {w}", "start": i / 2, "end": (i + 1) / 2, "probability": None} for i, w in enumerate(text.split())]
    return [{"words": timed}, {"words": None}]


MODELS = {
    "measure": row_model(lambda c, t, x, r: {"duration": 0.0 if t % 5 == 4 else len(x.split()) / 2, "snr": 12.5}),
    "language": row_model(lambda c, t, x, r: {"probs": {"en" if (c + t) % 4 < 3 else "ar": 0.75, "fr": 0.25}}),
    "non_speech": row_model(
        lambda c, t, x, r: {"label": "laugh" if (c + t) % 4 == 1 else "no_sounds", "confidence": 0.5 if t % 2 else 0.9}
    ),
    "noise": row_model(lambda c, t, x, r: {"label": "quiet", "confidence": 0.25}),
    "emotion": row_model(lambda c, t, x, r: {"label": "calm", "confidence": 0.5}),
    "first": row_model(lambda c, t, x, r: {"text": f"{x.lower()} {(c + t) % 4}", "segments": timed_segments(x)}),
    "second": row_model(lambda c, t, x, r: {"text": f"[laugh] {x}" if "[laugh]" in r else f"[0m1s2ms] {x}"}),
    "third": row_model(lambda c, t, x, r: {"text": x}),
    "judge": row_model(judge_reply),
    "polish": row_model(polish_reply),
    "speakers": row_model(
        lambda c, t, x, r: {"segments": [f"{i}.0 {i + 1}.0 spk_{(i + t) % 3}" for i in range(x.count("\n") + 1)]}
    ),
    "gender": row_model(lambda c, t, x, r: {"label": "m" if t % 2 else "f"}),
}


@query
def annotate_recordings(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as recordings through the whole annotation job with stub models."""
    sound = F.encode(F.concat(F.col("utt_id"), F.lit("|"), F.col("text")), "UTF-8")
    recordings = spread(turns(spark, sf), "utt_id").select(
        "utt_id", F.concat_ws("/", "role", F.concat("utt_id", F.lit(".wav"))).alias("rel_path"), sound.alias("content")
    )
    made = A.annotate(recordings, MODELS, pause_s=0.0)
    return flat_record(made.select("utt_id", "rel_path", "record.*"))


@query
def evaluate_annotations(spark: SparkSession, sf: str) -> DataFrame:
    """The transcripts of annotated records against their turns."""
    refs = turns(spark, sf).select("utt_id", F.col("text").alias("ref"))
    return rounded(evaluate_records(records(spark, sf), refs, "en").summary)


@query
def record_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Records written as JSON below their folders and read back."""
    made = records(spark, sf).select("utt_id", "rel_path", "record.*")
    out = scratch_path(spark, "records")
    write_records(made, out)
    return flat_record(spark.read.schema(made.schema).json(out))


@query
def report_sink(spark: SparkSession, sf: str) -> DataFrame:
    """A run report written and read back: averages, and the number of transcripts."""
    hyps = transcripts(spark, sf)
    summary = rounded(system_summary(score_systems(hyps, SYSTEMS, "en"), list(SYSTEMS)))
    details = hyps.select("utt_id", "ref", *SYSTEMS)
    out = scratch_path(spark, "report")
    write_report(summary, details, out)
    stored = spark.read.schema(details.schema).json(f"{out}/details")
    files = to_long(stored, SYSTEMS, ["utt_id"]).groupBy("system").agg(F.count(F.lit(1)).alias("num_files"))
    return spark.read.schema(summary.schema).json(f"{out}/summary").join(files, "system")


@query
def catalog_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Sources and languages of the documents as a catalog of datasets, one array file each."""
    entries = (
        table(spark, sf, "documents").groupBy("source", "lang").agg(F.max("doc_id").alias("m"))
        .select(
            F.col("source").alias("path"),
            F.col("lang").alias("name"),
            F.when(F.col("m") % 3 == 0, True).when(F.col("m") % 3 == 1, False).alias("skip"),
            F.when(F.col("m") % 2 == 0, "doc_id").alias("id_col"),
            F.when(F.col("m") % 5 == 0, "text_normalized").alias("text_col"),
            F.when(F.col("m") % 5 < 3, "body").alias("text_column_name"),
            F.lit(None).cast("string").alias("audio_col"),
            F.when(F.col("m") % 7 == 0, "sound").alias("audio_column_name"),
            F.lit(None).cast("array<string>").alias("splits"),
        )
    )
    out = scratch_path(spark, "catalog")
    entry = F.struct(*[c for c in entries.columns if c not in ("audio_col", "splits")])
    entries.select(F.to_json(F.array(entry)).alias("value")).write.option("maxRecordsPerFile", 1).text(out)
    return with_roles(active_entries(scan_catalog(spark, out))).select("path", "name", "id_col", "text_col", "audio_col")


def utterance_table(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as lines of chapter files; the last turns of a conversation stand in a second file."""
    folder = F.concat(F.lit("/corpus/"), F.col("conv_id").cast("string"))
    file = F.when(F.col("turn") < 7, "/a.trans.txt").otherwise("/b.trans.txt")
    body = F.when(F.col("turn") % 4 == 3, F.col("utt_id")).otherwise(F.concat_ws(" ", "utt_id", F.replace("text", F.lit("\n"), F.lit(" "))))
    first = turns(spark, sf).select(F.concat(folder, file).alias("path"), F.col("turn").alias("line_no"), body.alias("value"))
    # every first turn again, further down and in lower case: the later line counts
    again = turns(spark, sf).where("turn = 0").select(
        F.concat(folder, F.lit("/a.trans.txt")).alias("path"),
        F.lit(1000).cast("long").alias("line_no"),
        F.concat_ws(" ", "utt_id", F.lower(F.replace("text", F.lit("\n"), F.lit(" ")))).alias("value"),
    )
    return parse_utterance_lines(first.unionByName(again))


@query
def utterance_lines(spark: SparkSession, sf: str) -> DataFrame:
    return utterance_table(spark, sf)


@query
def chapter_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line files in chapter folders that use the same ids, written and read back."""
    root = scratch_path(spark, "chapters")
    name = F.concat(F.lit("u"), "turn", F.lit("-"), F.floor(F.col("conv_id") / 7))
    body = F.concat_ws(" ", name, F.regexp_replace("text", r"[\r\n]", " "))
    lines = table(spark, sf, "conversations").select((F.col("conv_id") % 7).alias("chapter"), body.alias("value"))
    lines.coalesce(1).write.partitionBy("chapter").text(root)
    found = scan_utterance_lines(spark, root, "*.txt")
    return found.select(F.substring_index("chapter", "/", -1).alias("chapter"), "utt_id", "text")


@query
def text_files(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark texts as one file each, scanned as whole files."""
    out = scratch_path(spark, "texts")
    rows = table(spark, sf, "benchmark").select(F.concat(F.lit("  "), F.col("text"), F.lit(" \n")).alias("value"))
    rows.write.option("maxRecordsPerFile", 1).text(out)
    found = scan_texts(spark, out)
    return found.groupBy("text").agg(F.countDistinct("utt_id").alias("n_files"))


@query
def file_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark texts as one file each in folders, listed without reading them."""
    out = scratch_path(spark, "files")
    rows = table(spark, sf, "benchmark").select((F.col("item_id") % 5).alias("folder"), F.col("text").alias("value"))
    rows.write.partitionBy("folder").option("maxRecordsPerFile", 1).text(out)
    found = scan_audio(spark, out, ["txt"])
    return found.groupBy(P.parent(F.col("rel_path")).alias("folder"), "length").agg(F.countDistinct("utt_id").alias("n_files"))


# --- models, corpora, resuming -------------------------------------------------------------------


def word_tagger(limit: int) -> Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]:
    """A stub model: number of words, refusing texts of more than ``limit`` characters."""

    def make() -> Callable[[pd.DataFrame], pd.DataFrame]:
        def predict(batch: pd.DataFrame) -> pd.DataFrame:
            if (batch["text"].str.len() > limit).any():
                raise ValueError("too long")
            return pd.DataFrame({"n_spoken": batch["text"].str.split().str.len().astype("int64")})

        return predict

    return make


@query
def infer_stub(spark: SparkSession, sf: str) -> DataFrame:
    """Long texts are refused, tried again by a more patient model, and else get the default."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    ladder = (Attempt("full"), Attempt("patient", make=word_tagger(2000)))
    made = infer_stage(docs, word_tagger(1000), ["text"], "n_spoken long", 32, ladder, {"n_spoken": -1})
    return made.select("doc_id", "n_spoken", "attempt", "status", "error")


def clock(rows: pd.DataFrame) -> pd.DataFrame:
    """A stub model that writes down which lane calls it, and when."""
    from pyspark import TaskContext

    return pd.DataFrame({"lane": TaskContext.get().partitionId(), "called": time.time(), "size": rows["text"].str.len()})


@query
def paced_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark texts through a paced model in two lanes: calls of a lane that came too soon, and callers beyond the bound."""
    items = table(spark, sf, "benchmark").select("item_id", "text")
    made = infer_stage(items, lambda: clock, ["text"], "lane int, called double, size long", 8, min_interval_s=0.05, lanes=2)
    # one look at the clock: the model runs once
    out = scratch_path(spark, "calls")
    made.select("lane", "called", "size", "error").write.parquet(out)
    calls = spark.read.parquet(out).groupBy("lane", "called").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("size"), F.count("error").alias("failed"))
    since = F.col("called") - F.lag("called").over(Window.partitionBy("lane").orderBy("called"))
    timed = calls.withColumn("soon", (since < 0.05).cast("int"))
    return timed.agg(
        F.sum("rows").alias("n_rows"),
        F.sum("size").alias("n_chars"),
        F.coalesce(F.sum("soon"), F.lit(0)).cast("long").alias("n_too_soon"),
        F.greatest(F.countDistinct("lane") - 2, F.lit(0)).cast("long").alias("n_too_many"),
        F.sum("failed").alias("n_failed"),
    )


def byte_counter(limit: int) -> Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]:
    def make() -> Callable[[pd.DataFrame], pd.DataFrame]:
        def predict(batch: pd.DataFrame) -> pd.DataFrame:
            sizes = [len(c) for c in batch["content"]]
            if max(sizes) > limit:
                raise ValueError("too large")
            return pd.DataFrame({"n_bytes": sizes})

        return predict

    return make


@query
def folder_run(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of files through a model in two runs; the second does what the first could not."""
    files, out, kept = (scratch_path(spark, n) for n in ("audio", "made", "failed"))
    table(spark, sf, "benchmark").select("text").write.option("maxRecordsPerFile", 1).text(files)
    process_audio(spark, files, out, byte_counter(150), "n_bytes long", exts=["txt"])
    # the second run overwrites the errors of the first
    spark.read.parquet(errors_of(out)).select("error").write.parquet(kept)
    process_audio(spark, files, out, byte_counter(10**9), "n_bytes long", exts=["txt"])
    made = spark.read.parquet(out).select("n_bytes", F.lit(None).cast("string").alias("error"))
    failed = spark.read.parquet(kept).select(F.lit(None).cast("long").alias("n_bytes"), "error")
    return made.union(failed).groupBy("n_bytes", "error").agg(F.count(F.lit(1)).alias("n_files"))


@query
def folder_collision(spark: SparkSession, sf: str) -> DataFrame:
    """Files of the same names in several folders, some of which fail at first: none is lost."""
    files, out = scratch_path(spark, "folders"), scratch_path(spark, "made")
    rows = table(spark, sf, "benchmark").select((F.col("item_id") % 5).alias("folder"), F.col("text").alias("value"))
    # one task names its files alike in every folder
    rows.coalesce(1).write.partitionBy("folder").option("maxRecordsPerFile", 1).text(files)
    for limit in (150, 10**9):
        counts = process_audio(spark, files, out, byte_counter(limit), "n_bytes long", exts=["txt"])
    made = spark.read.parquet(out).groupBy(P.parent(F.col("rel_path")).alias("folder")).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("n_bytes").alias("n_bytes")
    )
    audited = counts.select(F.lit("missing").alias("folder"), F.col("n_missing").alias("n_files"), F.lit(0).cast("long").alias("n_bytes"))
    return made.union(audited)


def corpus_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as a dataset: language is the split, character codes are the audio."""
    samples = F.transform(F.split("source", ""), lambda ch: F.ascii(ch).cast("float"))
    audio = F.struct(samples.alias("array"), F.lit(16000).alias("sampling_rate"))
    return table(spark, sf, "documents").select(F.col("lang").alias("split"), F.col("doc_id").alias("segment_id"), "text", audio.alias("audio"))


def sample_codec() -> Callable[[pd.DataFrame], pd.DataFrame]:
    def encode(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"codes": [np.asarray(a["array"], np.float32).astype(np.int32) % 32 for a in batch["audio"]]})

    return encode


@query
def prepare_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """A dataset prepared in two runs, the second over everything again: each row once in each output."""
    root, out = scratch_path(spark, "dataset"), scratch_path(spark, "prepared")
    write_texts(corpus_rows(spark, sf), f"{root}/docs/all", by="split")
    df = scan_dataset(spark, root, "docs", "all", "segment_id", "text", "audio")
    prepare_table(df.where("split = 'en'"), out, sample_codec)
    done = prepare_table(df, out, sample_codec)
    codes = spark.read.parquet(f"{out}/codes").groupBy("split").agg(
        F.count(F.lit(1)).alias("n_codes"), F.sum(F.aggregate("codes", F.lit(0).cast("long"), lambda a, c: a + c)).alias("sum_codes")
    )
    texts = spark.read.parquet(f"{out}/text").groupBy("split").agg(F.sum(F.length("text").cast("long")).alias("n_chars"))
    wavs = spark.read.parquet(f"{out}/wavs").groupBy("split").agg(F.sum(F.size("audio.array").cast("long")).alias("n_samples"))
    return done.join(codes, "split").join(texts, "split").join(wavs, "split").select(
        "split", "n_done", "last_key", "n_codes", "sum_codes", "n_chars", "n_samples"
    )


@query
def prepare_broken_off(spark: SparkSession, sf: str) -> DataFrame:
    """Every id twice, sound as long as the text, and a first run that breaks off between the second and third output.

    The first of two rows counts, what the broken run left does not, and progress adds up over the runs that ended.
    """
    root, out = scratch_path(spark, "dataset"), scratch_path(spark, "prepared")
    places = F.when(F.length("text") > 0, F.sequence(F.lit(0), F.length("text") - 1)).otherwise(F.array().cast("array<int>"))
    sound = F.struct(F.transform(places, lambda i: (i % 97).cast("float")).alias("array"), F.lit(16000).alias("sampling_rate"))
    copies = F.explode(F.array(F.lit(""), F.lit(" again"))).alias("copy")
    # a row group of texts becomes many times as much sound: rows are dealt out before it is made
    docs = corpus_rows(spark, sf).select("split", "segment_id", "text")
    tasks = max(spark.sparkContext.defaultParallelism, input_bytes(docs) // MIN_BYTES_PER_TASK + 1)
    rows = docs.repartition(tasks, "segment_id").select("split", "segment_id", F.col("text").alias("said"), sound.alias("audio"))
    twice = rows.select("*", copies).select("split", "segment_id", F.concat("said", "copy").alias("text"), "audio", "copy")
    twice.sortWithinPartitions("split", "segment_id", "copy").drop("copy").write.partitionBy("split").parquet(f"{root}/docs/all")
    df = scan_dataset(spark, root, "docs", "all", "segment_id", "text", "audio")

    def break_off(name: str) -> None:
        if name == "text":
            raise InterruptedError(name)

    try:
        prepare_table(df, out, sample_codec, before=break_off)
    except InterruptedError:
        pass
    prepare_table(df.where("split = 'en'"), out, sample_codec)
    done = prepare_table(df, out, sample_codec)
    key = "split string, id long"
    codes = read_output(spark, out, "codes", f"{key}, codes array<int>").groupBy("split").agg(
        F.count(F.lit(1)).alias("n_codes"), F.sum(F.aggregate("codes", F.lit(0).cast("long"), lambda a, c: a + c)).alias("sum_codes")
    )
    texts = read_output(spark, out, "text", f"{key}, text string").groupBy("split").agg(F.sum(F.length("text").cast("long")).alias("n_chars"))
    heard = read_output(spark, out, "wavs", f"{key}, audio struct<array:array<float>,sampling_rate:int>")
    wavs = heard.groupBy("split").agg(F.sum(F.size("audio.array").cast("long")).alias("n_samples"))
    return done.join(codes, "split").join(texts, "split").join(wavs, "split").select(
        "split", "n_done", "last_key", "n_codes", "sum_codes", "n_chars", "n_samples"
    )


@query
def clean_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """The languages as datasets of a catalog, one of them to be skipped, cleaned by two runs between which half the rows arrive."""
    root, out, catalog = (scratch_path(spark, n) for n in ("datasets", "cleaned", "catalog"))
    docs = table(spark, sf, "documents").select(F.col("source").alias("split"), F.col("doc_id").alias("id"), F.col("text").alias("body"), F.col("lang").alias("name"))
    entry = F.struct(
        F.lit("docs").alias("path"), F.concat(F.lit("name="), "name").alias("name"), (F.col("name") == "fr").alias("skip"), F.lit("body").alias("text_column_name")
    )
    docs.select("name").distinct().select(F.to_json(F.collect_list(entry)).alias("value")).write.text(catalog)
    for half in (0, 1):
        docs.where(F.col("id") % 2 == half).write.mode("append").partitionBy("name", "split").parquet(f"{root}/docs")
        clean_corpus(spark, catalog, root, out, "extreme")
    cleaned = spark.read.schema("id long, text string").option("recursiveFileLookup", True).parquet(out)
    return cleaned.select(F.col("id").alias("doc_id"), F.col("text").alias("clean"))


@query
def resume_clean(spark: SparkSession, sf: str) -> DataFrame:
    """A corpus that arrives in two lots, cleaned by two runs of the same stream."""
    source, out, state = (scratch_path(spark, n) for n in ("arriving", "cleaned", "progress"))
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    schema = "doc_id long, lang string, text string"
    for lot in (F.col("lang") == "en", F.col("lang") != "en"):
        docs.where(lot).write.mode("append").parquet(source)
        resume_run(
            spark, source, schema, lambda batch: clean_transcripts(batch, "extreme"), out, state, "doc_id", "doc_id long"
        )
    return spark.read.schema(schema).parquet(out).select("doc_id", F.col("text").alias("clean"))


@query
def progress_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Progress of one run added to that of the run before."""
    docs = table(spark, sf, "documents")
    before = progress(docs.where("lang <> 'en'"), "source", "doc_id")
    return add_progress(before, progress(docs.where("lang = 'en'"), "source", "doc_id"), "source")


# --- sequences -----------------------------------------------------------------------------------


def event_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Events as token sequences per user; the first few tokens of a user are reference tokens."""
    events = table(spark, sf, "events").select("user_id", "ts", "event_id")
    numbered = number_rows(events, ["ts", "event_id"], ["user_id"], "seq", start=0)
    return numbered.select("user_id", "seq", F.col("event_id").alias("token"), (F.col("user_id") % 7).alias("n_ref"))


def flat_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "user_id",
        "chunk",
        "n",
        "ctx_start",
        "ctx_end",
        F.col("is_final").cast("int").alias("is_final"),
        F.array_join(F.transform("tokens", lambda t: t.cast("string")), " ").alias("tokens"),
    )


@query
def chunk_windows_batch(spark: SparkSession, sf: str) -> DataFrame:
    return flat_chunks(chunk_windows(event_tokens(spark, sf), "user_id", n_ref="n_ref"))


@query
def chunk_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same chunks from a file stream of the tokens."""
    source, out, state = (scratch_path(spark, n) for n in ("tokens", "chunks", "state"))
    tokens = with_end_mark(event_tokens(spark, sf), "user_id", "seq")
    tokens.repartition(3, "user_id", "seq").write.parquet(source)
    stream = spark.readStream.schema(tokens.schema).option("maxFilesPerTrigger", 1).parquet(source)
    return flat_chunks(stream_to_table(stream_chunk_windows(stream, "user_id", n_ref="n_ref"), out, state))


@query
def chunk_stream_redelivered(spark: SparkSession, sf: str) -> DataFrame:
    """The same chunks from a source that delivers a part of the tokens twice, and some of them after all others."""
    source, out, state = (scratch_path(spark, n) for n in ("tokens", "chunks", "state"))
    # numbered once; each lot is written by as many tasks as there are cores and arrives as one batch
    tokens = stored(with_end_mark(event_tokens(spark, sf), "user_id", "seq"), "numbered")
    files = spark.sparkContext.defaultParallelism
    for lot in ("seq % 3 = 0", "seq % 2 = 0", "true", "seq % 5 = 0"):
        tokens.where(lot).repartition(files).write.mode("append").parquet(source)
    stream = spark.readStream.schema(tokens.schema).option("maxFilesPerTrigger", files).parquet(source)
    return flat_chunks(stream_to_table(stream_chunk_windows(stream, "user_id", n_ref="n_ref"), out, state))


def vector_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of a label as consecutive frames."""
    vectors = table(spark, sf, "embeddings").select("label", "vec_id", "embedding")
    numbered = number_rows(vectors, ["vec_id"], ["label"], "no", start=0)
    return numbered.select("label", (F.col("no") * 48).alias("at"), F.col("embedding").alias("frame"))


@query
def overlap_add_ramp(spark: SparkSession, sf: str) -> DataFrame:
    blocks = overlap_add(vector_frames(spark, sf), "label", 48)
    return to_samples(blocks, "label", 48).select("label", "sample", r6("value").alias("value"))


@query
def overlap_add_hot(spark: SparkSession, sf: str) -> DataFrame:
    """Every event a frame, all of them over the same few samples."""
    value = F.col("value")
    frames = table(spark, sf, "events").select(
        F.lit("all").alias("label"), (F.col("event_id") % 2 * 4).alias("at"), F.array(*[value * (j + 1) for j in range(8)]).alias("frame")
    )
    return to_samples(overlap_add(frames, "label", 48), "label", 48).select("label", "sample", F.round("value", 3).alias("value"))


@query
def overlap_add_triangle(spark: SparkSession, sf: str) -> DataFrame:
    blocks = overlap_add(vector_frames(spark, sf), "label", 48, weight="triangle")
    return to_samples(blocks, "label", 48).select("label", "sample", r6("value").alias("value"))


HOP = 4


def spoken_samples(ts: Column) -> Column:
    """A few samples per token, whatever its context."""
    return F.flatten(
        F.transform(ts, lambda t: F.transform(F.sequence(F.lit(0), F.lit(HOP - 1)), lambda j: (t % 1000 + j / 10).cast("double")))
    )


def flat_samples(blocks: DataFrame) -> DataFrame:
    return to_samples(blocks, "user_id", Chunking(hop=HOP).stride).select("user_id", "sample", r6("value").alias("value"))


@query
def stitched_signal(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks decoded to a few samples per token and stitched, the remainder where it belongs."""
    size = Chunking(hop=HOP)
    tokens = event_tokens(spark, sf)
    return flat_samples(chunk_and_stitch(tokens, spoken_samples, "user_id", n_ref="n_ref", size=size, align_tail=True))


@query
def stitched_layout(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the remainder at its historical place, a token late."""
    size = Chunking(hop=HOP)
    return flat_samples(chunk_and_stitch(event_tokens(spark, sf), spoken_samples, "user_id", n_ref="n_ref", size=size))


@query
def stitch_stream(spark: SparkSession, sf: str) -> DataFrame:
    """From a stream of tokens over a table of decoded chunks to a stream of blocks."""
    size = Chunking(hop=HOP)
    source, chunks, chunk_state, blocks, block_state = (
        scratch_path(spark, n) for n in ("tokens", "decoded", "chunk-state", "blocks", "block-state")
    )
    tokens = with_end_mark(event_tokens(spark, sf), "user_id", "seq")
    tokens.repartition(2, "user_id", "seq").write.parquet(source)
    arriving = spark.readStream.schema(tokens.schema).option("maxFilesPerTrigger", 1).parquet(source)
    cut = stream_chunk_windows(arriving, "user_id", n_ref="n_ref", size=size)
    decoded = stream_to_table(cut.withColumn("samples", spoken_samples(F.col("tokens"))), chunks, chunk_state)
    heard = spark.readStream.schema(decoded.schema).parquet(chunks)
    return flat_samples(stream_to_table(stream_stitch(heard, "user_id", size=size), blocks, block_state))
