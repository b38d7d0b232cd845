"""Jobs over folders: transcribe, embed, resample or synthesise what an output does not hold yet."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.functions.tokens import synthesis_prompt
from voxframe.operators.inference import FULL, Attempt, Predictor, infer_stage
from voxframe.operators.ordering import skip_n
from voxframe.operators.pairing import audit_summary, pair_reporting, skip_done
from voxframe.session import scratch_path
from voxframe.sources.files import AUDIO_SUFFIXES, audio_options, audio_rows, open_files, scan_audio
from voxframe.sources.sinks import read_done, write_texts
from voxframe.streaming.resume import run_new_files


def errors_of(out: str) -> str:
    """Where the rows go that a model failed on, beside its output."""
    return f"{out.rstrip('/')}_errors"


def finished(spark: SparkSession, out: str, key_schema: str) -> DataFrame:
    """Keys that have output."""
    return read_done(spark, out, key_schema)


def run_missing(
    df: DataFrame,
    out: str,
    make_predictor: Callable[[], Predictor],
    inputs: Sequence[str],
    out_schema: str,
    key: Sequence[str] = ("utt_id",),
    by: str | None = None,
    batch_size: int = 16,
    attempts: Sequence[Attempt] = (FULL,),
    min_interval_s: float = 0.0,
    label: Sequence[str] = (),
    fetch: Callable[[DataFrame], DataFrame] | None = None,
    errors: str = "overwrite",
) -> DataFrame:
    """Run a model on the rows without output; append key, ``label`` columns and results.

    Rows it fails on go with their error to ``errors_of(out)`` and are tried again by the next run, so a run
    over everything that is left overwrites them, one over new rows only (``errors="append"``) adds to them.
    ``fetch`` adds inputs that only the rows left need, such as the bytes of their files. Returns the finished keys.
    """
    spark, kinds = df.sparkSession, dict(df.dtypes)
    key_schema = ", ".join(f"`{k}` {kinds[k]}" for k in key)
    given = df if fetch else df.select(*key, *label, *inputs)
    todo = skip_done(given, finished(spark, out, key_schema), key)
    rows = (fetch(todo) if fetch else todo).select(*key, *label, *inputs)
    made = infer_stage(rows, make_predictor, inputs, out_schema, batch_size, attempts, min_interval_s=min_interval_s)
    # the model runs once for both tables
    once = scratch_path(spark, "made")
    write_texts(made.drop(*inputs, "attempt", "status"), once)
    results = spark.read.parquet(once)
    write_texts(results.where("error IS NULL").drop("error"), out, by=by)
    write_texts(results.where("error IS NOT NULL").select(*key, *label, "error"), errors_of(out), mode=errors)
    return finished(spark, out, key_schema)


def process_audio(
    spark: SparkSession,
    audio: str,
    out: str,
    make_predictor: Callable[[], Predictor],
    out_schema: str,
    skip_first: int = 0,
    exts: Sequence[str] = AUDIO_SUFFIXES,
    batch_size: int = 8,
    min_interval_s: float = 0.0,
) -> DataFrame:
    """Run a model over the ``content`` of audio files; returns the audit of inputs and outputs.

    A file is known by its relative path; ``utt_id``, its stem, is a label that files of several folders may share.
    The folder is listed without bytes, the paths are compared with those of the output, and only files that are left are
    opened, by the tasks that run the model. ``skip_first`` leaves out the first files by name.
    """
    files = scan_audio(spark, audio, exts).select("utt_id", "path", "rel_path")
    done = run_missing(
        skip_n(files, skip_first, ["path"]),
        out,
        make_predictor,
        ["content"],
        out_schema,
        ("rel_path",),
        batch_size=batch_size,
        min_interval_s=min_interval_s,
        label=("utt_id",),
        fetch=open_files,
    )
    return audit_summary(files, done, "rel_path")


def process_new_audio(
    spark: SparkSession,
    audio: str,
    out: str,
    checkpoint: str,
    make_predictor: Callable[[], Predictor],
    out_schema: str,
    exts: Sequence[str] = AUDIO_SUFFIXES,
    files_per_batch: int = 10_000,
    batch_size: int = 8,
) -> None:
    """``process_audio`` for the files no earlier run has seen; others are not read.

    Files the model fails on keep their error until ``process_audio`` tries them again.
    """
    run_new_files(
        spark,
        audio,
        "path string, modificationTime timestamp, length long, content binary",
        lambda batch: run_missing(
            audio_rows(batch, audio),
            out,
            make_predictor,
            ["content"],
            out_schema,
            ("rel_path",),
            batch_size=batch_size,
            label=("utt_id",),
            errors="append",
        ),
        checkpoint,
        "binaryFile",
        {**audio_options(exts), "maxFilesPerTrigger": files_per_batch},
    )


def transcribe_folder(
    spark: SparkSession, audio: str, out: str, make_recogniser: Callable[[], Predictor], skip_first: int = 0
) -> DataFrame:
    """Texts of wav files."""
    return process_audio(spark, audio, out, make_recogniser, "text string", skip_first, ("wav",))


def embed_folder(spark: SparkSession, audio: str, out: str, make_encoder: Callable[[], Predictor]) -> DataFrame:
    """Speaker embeddings of wav files, as ``scan_embeddings(out, "utt_id")`` reads them."""
    return process_audio(spark, audio, out, make_encoder, "embedding array<float>", exts=("wav",))


def resample_folder(spark: SparkSession, audio: str, out: str, make_resampler: Callable[[], Predictor]) -> DataFrame:
    """Waveforms of wav files at another rate."""
    schema = "audio struct<array:array<float>,sampling_rate:int>"
    return process_audio(spark, audio, out, make_resampler, schema, exts=("wav",))


def synthesise(
    texts: DataFrame,
    codes: DataFrame,
    out: str,
    make_voice: Callable[[], Predictor],
    skip_first: int = 0,
    phones: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Speech for each text in the voice of its codes; returns finished keys and texts without codes.

    The voice gets the request and the reference ``codes`` and returns ``samples``. The text is its
    own reference text. ``skip_first`` leaves out the first texts by key.
    """
    wanted = skip_n(texts, skip_first, ["utt_id"])
    paired, without = pair_reporting(wanted, codes.where("codes IS NOT NULL").select("utt_id", "codes"))
    asked = paired.withColumn("request", synthesis_prompt(F.col(phones), F.col(phones), F.col("codes")))
    done = run_missing(asked, out, make_voice, ["request", "codes"], "samples array<float>")
    return done, without
