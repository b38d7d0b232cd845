"""The named queries of these operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.llm import decontaminate, edit_fingerprints, licenses, line_dedup, minhash, mixing, quality, ranked_search, runs, sentencepiece, substring_dedup, token_files, toxicity
from voxframe.llm.common import let, stored, table
from voxframe.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def remainder(parts: int) -> Column:
    """Which part of the labelled rows a document falls into."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))


def labelled(spark: SparkSession, sf: str, name: str, fold: Column) -> DataFrame:
    return table(spark, sf, "labels").where(fold).select("doc_id", F.col(name).alias("label"))


def judged(scores: DataFrame, held_out: Column) -> DataFrame:
    return scores.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def toxicity_model(spark: SparkSession, sf: str) -> toxicity.Model:
    return toxicity.train(table(spark, sf, "documents"), labelled(spark, sf, "toxic", remainder(4) != 2))


@query
def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    scores = toxicity.score_toxicity(table(spark, sf, "documents").select("doc_id", "text"), toxicity_model(spark, sf), "score")
    return judged(scores, remainder(4) == 2)


@query
def op3_quality(spark: SparkSession, sf: str) -> DataFrame:
    measured = quality.measure(table(spark, sf, "documents"))
    model = quality.train(measured, labelled(spark, sf, "quality", remainder(5) != 0))
    return judged(quality.score_measured(measured, model, "score"), remainder(5) == 0)


def piece_vocabulary() -> sentencepiece.Vocabulary:
    import public_tokenizers

    return sentencepiece.Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))


@query
def op4_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    encoded = sentencepiece.encode(docs, piece_vocabulary(), "ids", "round_trip")
    return encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


@query
def op5_token_files(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    folder = scratch_path(spark, "tokens")
    manifest = token_files.write_tokens(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return token_files.read_tokens(manifest).select(
        "doc_id", "start", (F.length("tokens") / 4).cast("long").alias("n_tokens"), F.crc32("tokens").alias("ids_crc32")
    )


@query
def op6_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    seen = licenses.scan_licenses(table(spark, sf, "documents"))
    return seen.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query
def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.find_contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op8_edit_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return edit_fingerprints.edited_fingerprints(table(spark, sf, "documents"))


@query
def op10_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf, "documents"))


@query
def op2_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf, "documents")).select("doc_id", "lines_before", "lines_removed", "text")


@query
def op9_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.spans_by_document(table(spark, sf, "documents")).drop("form")


@query
def op11_mixing(spark: SparkSession, sf: str) -> DataFrame:
    measured = mixing.measure(table(spark, sf, "documents").select("doc_id", "source", "text")).drop("text")
    # sizes and numbers, not texts, are read again
    return mixing.mix(stored(measured, "measured")).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query
def op12_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return ranked_search.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def with_planted_period(docs: DataFrame) -> Column:
    """The text of every tenth document by hash, from some word on, as repeats of a few of its words; others as they are."""
    spoken = F.array_remove(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = F.floor((n - a) / (g % 8 + 3)) + 1
        at = lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), at), " ")).otherwise("")

    return F.when(h % 10 == 0, let(spoken, repeated)).otherwise(F.col("text"))


@query
def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = runs.find_runs(docs, with_planted_period(docs)).withColumn("best", runs.greatest_run(F.col("runs")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.concat(listed, F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
