"""Corpus jobs: cleaning by profile, preparation into text, audio and codes, completeness audit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.functions.paths import with_suffix
from voxframe.functions.text import clean_profile
from voxframe.operators.inference import Predictor, infer_stage
from voxframe.operators.pairing import audit, audit_summary
from voxframe.plans.folders import errors_of
from voxframe.session import spread
from voxframe.sources.addresses import missing
from voxframe.sources.catalog import active_entries, scan_catalog, scan_dataset, with_roles
from voxframe.sources.commits import LOG, append_run, ended_runs, read_output, total_progress, write_together
from voxframe.sources.files import scan_audio
from voxframe.sources.sinks import progress, read_done, write_missing, write_texts


def clean_transcripts(df: DataFrame, profile: str, text: str = "text") -> DataFrame:
    """The table with its texts cleaned under a named profile."""
    return spread(df).withColumn(text, clean_profile(F.col(text), profile))


def datasets(spark: SparkSession, catalog: str, root: str) -> list[tuple[str, DataFrame]]:
    """The datasets of a catalog that are not to be skipped, with their output folder below a root.

    A catalog names a handful of datasets; it is the only table read on the driver.
    """
    entries = with_roles(active_entries(scan_catalog(spark, catalog))).collect()
    return [
        (
            f"{e['path']}/{e['name']}",
            scan_dataset(spark, root, e["path"], e["name"], e["id_col"], e["text_col"], e["audio_col"], e["splits"]),
        )
        for e in entries
    ]


def clean_corpus(
    spark: SparkSession, catalog: str, root: str, out: str, profile: str = "capitalize_remove_punctuation"
) -> None:
    """Clean texts of all active datasets, by split; rows cleaned before are left alone, where they lie."""
    for folder, df in datasets(spark, catalog, root):
        texts = df.select("split", "id", "text")
        kinds = dict(texts.dtypes)
        write_missing(
            texts,
            f"{out}/{folder}/clean_text",
            ["split", "id"],
            f"split {kinds['split']}, id {kinds['id']}",
            "split",
            lambda rows: rows.withColumn("text", clean_profile(F.col("text"), profile)),
        )


def prepare_table(
    df: DataFrame,
    out: str,
    make_codec: Callable[[], Predictor],
    batch_size: int = 8,
    before: Callable[[str], None] | None = None,
) -> DataFrame:
    """Write text, audio and codes of a dataset, each only where missing; returns the progress of all runs.

    ``df`` is a scan of Parquet files. ``make_codec`` builds a predictor from ``audio`` to ``codes array<int>``; rows it
    fails on keep their error and are tried again by the next run. Progress counts rows with codes. What is missing is
    decided on keys and addresses; the codec's results are first written beside the audio they come from, so ``audio``
    is read once. The outputs of a run count together when all have ended (``read_output`` reads those). Of an id
    that repeats in a split the first row counts. ``before`` hears the name of each output as its turn comes.
    """
    spark, kinds = df.sparkSession, dict(df.dtypes)
    keys, error = ["split", "id"], "error string"
    key_schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    runs = ended_runs(spark, out)
    done = {name: read_output(spark, out, name, key_schema, runs=runs) for name in ("text", "codes")}
    left = missing(df, keys, done)

    def encoded(rows: DataFrame) -> DataFrame:
        return infer_stage(rows, make_codec, ["audio"], "codes array<int>", batch_size).drop("attempt", "status")

    def wavs(run: str) -> None:
        for part in left.parts(["split", "id", "audio"], "text"):
            append_run(encoded(part), out, "wavs", run, "split")

    def codes(run: str) -> None:
        repeated = f"{out}/{LOG}/again"
        for part in left.parts(["split", "id", "audio"], "codes", having=["text"]):
            append_run(encoded(part).drop("audio"), repeated, "codes", run)
        columns = f"{key_schema}, codes array<int>, {error}, run string"
        made = [read_done(spark, path, columns).where(F.col("run") == run).drop("run") for path in (f"{out}/wavs", f"{repeated}/codes")]
        results = made[0].unionByName(made[1])
        append_run(results.where("error IS NULL").drop("error"), out, "codes", run, "split")
        write_texts(results.where("error IS NOT NULL").select(*keys, "error"), errors_of(f"{out}/codes"), mode="overwrite")

    def texts(run: str) -> None:
        for part in left.parts(["split", "id", "text"], "text"):
            append_run(part, out, "text", run, "split")

    def added(run: str) -> DataFrame:
        return progress(read_done(spark, f"{out}/codes", f"{key_schema}, run string").where(F.col("run") == run))

    write_together(spark, out, {"wavs": wavs, "codes": codes, "text": texts}, added, len(runs), before)
    return total_progress(spark, out, "split", "id", kinds)


def prepare_corpus(
    spark: SparkSession, catalog: str, root: str, out: str, make_codec: Callable[[], Predictor]
) -> dict[str, DataFrame]:
    """All active datasets of a catalog; progress by dataset folder."""
    return {
        folder: prepare_table(df, f"{out}/{folder}", make_codec) for folder, df in datasets(spark, catalog, root)
    }


def audit_folders(spark: SparkSession, audio: str, texts: str) -> tuple[DataFrame, DataFrame]:
    """Counts, and the keys that miss, of a folder of audio and the folder of its transcripts.

    The key is the path below the folder without suffix, so files of one name in two folders are two.
    """
    name = with_suffix(F.col("rel_path"), "").alias("utt_id")
    have, made = scan_audio(spark, audio).select(name), scan_audio(spark, texts, ("txt",)).select(name)
    return audit_summary(have, made), audit(have, made)
