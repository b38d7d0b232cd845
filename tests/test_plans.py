"""What the physical plans look like: columns read, shuffles, and how hot keys are spread."""

import re

import pytest
from pyspark.sql import functions as F

from voxframe.functions.text import normalize_generic
from voxframe.operators.consensus import longest_transcript, vote_tokens
from voxframe.operators.ordering import number_rows
from voxframe.operators.pairing import audit_summary, last_wins, pair_left, skip_done
from voxframe.operators.scores import score_systems, system_summary
from voxframe.operators.sequence import chunk_windows, overlap_add
from voxframe.session import HEAVY_BYTES_PER_TASK, MIN_BYTES_PER_TASK, input_bytes, spread
from voxframe.sources.files import parse_utterance_lines, scan_audio
from voxframe.sources.sinks import write_texts
from voxframe.streaming.resume import with_end_mark


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange (?:hash|range|SinglePartition|RoundRobin)", plan_of(df)))


@pytest.fixture()
def uncoalesced(spark):
    """Small shuffles are merged into one task; the spread is seen without that."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("plans")
    ten = F.sequence(F.lit(0), F.lit(9))
    words = F.array_join(F.transform(ten, lambda i: F.concat(F.lit("w"), (i + F.col("id")).cast("string"))), " ")
    pairs = spark.range(2000).select(F.col("id").cast("string").alias("utt_id"), words.alias("ref"), words.alias("h"))
    pairs.withColumn("other", F.rand(1)).write.parquet(str(root / "pairs"))
    spark.range(9000).select(
        F.when(F.col("id") < 6000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 30)).alias("utt_id"),
        F.when(F.col("id") < 6000, F.col("id")).otherwise(F.floor((F.col("id") - 6000) / 30)).alias("seq"),
        F.col("id").alias("token"),
    ).write.parquet(str(root / "tokens"))
    return {name: spark.read.parquet(str(root / name)) for name in ("pairs", "tokens")}


def test_text_functions_need_no_shuffle_and_read_their_columns_only(tables):
    df = tables["pairs"].where("utt_id > '5'").select("utt_id", normalize_generic(F.col("ref")).alias("clean"))
    plan = plan_of(df)
    assert shuffles(df) == 0
    assert "other" not in plan and "PushedFilters: [IsNotNull(utt_id), GreaterThan(utt_id,5)]" in plan


def test_scores_shuffle_only_their_averages(tables):
    scores = score_systems(tables["pairs"], {"a": "h"})
    summary = system_summary(scores, ["a"])
    assert "other" not in plan_of(summary)
    # small input: once over the cores, and the partial averages
    assert shuffles(summary) <= 3
    assert "partial_avg" in plan_of(summary)


def test_large_inputs_keep_their_splits(spark, tables):
    cores = spark.sparkContext.defaultParallelism
    assert "REPARTITION_BY_NUM" in plan_of(spread(tables["pairs"], "utt_id"))
    # a plan that reads more than every core's share is left alone
    large = spark.range(cores * MIN_BYTES_PER_TASK)
    assert spread(large) is large


def test_chunks_take_one_shuffle_and_spread_a_hot_sequence(tables, uncoalesced):
    chunks = chunk_windows(tables["tokens"], chunks_per_block=8)
    assert shuffles(chunks) == 1
    tasks = chunks.where("utt_id = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 3
    assert max(t["count"] for t in tasks) < 6000 / 25 / 2


def test_hot_series_is_stitched_in_many_tasks(spark, uncoalesced):
    frames = spark.range(600).select(F.lit("s").alias("k"), (F.col("id") * 4).alias("at"), F.array(*[F.lit(1.0)] * 6).alias("frame"))
    blocks = overlap_add(frames, "k", 4)
    assert shuffles(blocks) == 1
    tasks = blocks.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 3 and max(t["count"] for t in tasks) < 300


def test_the_greatest_row_is_found_by_hash_aggregates(tables):
    last = last_wins(tables["tokens"], "utt_id", ["seq", "token"])
    voted = vote_tokens(tables["tokens"].select("utt_id", F.col("seq").alias("pos"), F.lit("w").alias("word"), F.lit(1).alias("rank")))
    longest = longest_transcript(tables["pairs"].select("utt_id", F.col("ref").alias("text"), F.length("ref").alias("rank")))
    for df in (last, voted, longest):
        assert "SortAggregate" not in plan_of(df) and "HashAggregate" in plan_of(df)
    assert "partial_max" in plan_of(last)


def test_numbers_are_given_to_keys_alone(spark, tables):
    """What is written and ranged holds keys and numbers; other columns meet them in one join."""
    numbered = number_rows(tables["pairs"].select("utt_id", "ref", "h"), ["utt_id"], name="no")
    plan = plan_of(numbered)
    assert "ExistingRDD" not in plan and "rangepartitioning" not in plan
    assert "numbers-" in plan and re.search(r"ReadSchema: struct<utt_id:string,_own:bigint,_id:bigint>", plan)
    assert numbered.select("no").distinct().count() == 2000


def test_aggregations_are_partial(tables):
    counts = audit_summary(tables["pairs"], tables["tokens"])
    assert "partial_max" in plan_of(counts)


def test_audio_listing_reads_no_bytes(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(b"x")
    listing = scan_audio(spark, str(tmp_path)).select("utt_id", "length")
    schema = re.search(r"ReadSchema: (\S+)", plan_of(listing)).group(1)
    assert "content" not in schema and "path" in schema


@pytest.fixture()
def small_targets(spark):
    """Thresholds of adaptive execution that small tables reach."""
    conf = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    for name, value in conf.items():
        spark.conf.set(name, value)
    yield
    for name in conf:
        spark.conf.unset(name)


def hot_rows(spark, name):
    """Seven rows in ten belong to one key."""
    payload = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.sha2(F.concat_ws("-", F.col("id"), i), 256)), "")
    key = F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 20))
    return spark.range(0, 4000, 1, 8).select(key.alias(name), F.col("id"), payload.alias("text"))


def test_a_large_folder_is_written_by_several_tasks(spark, tmp_path, small_targets):
    write_texts(hot_rows(spark, "split"), str(tmp_path / "out"), by="split")
    files = {d.name: len(list(d.glob("*.parquet"))) for d in (tmp_path / "out").iterdir() if d.is_dir()}
    assert files["split=hot"] > 4
    # eight tasks wrote rows of every folder before they were brought together
    assert max(n for d, n in files.items() if d != "split=hot") <= 4


def test_a_hot_join_key_is_split(spark, tmp_path, small_targets):
    hot_rows(spark, "utt_id").write.parquet(str(tmp_path / "left"))
    left = spark.read.parquet(str(tmp_path / "left"))
    left.select("utt_id").distinct().withColumn("label", F.lit("x")).write.parquet(str(tmp_path / "right"))
    right = spark.read.parquet(str(tmp_path / "right"))
    for joined in (pair_left(left, right), skip_done(left, right.where("utt_id <> 'hot'"))):
        assert len(joined.collect()) >= 2800
        assert "skew=true" in plan_of(joined)


def test_a_hot_chapter_is_matched_in_several_tasks(spark, uncoalesced):
    lines = spark.range(3000).select(
        F.when(F.col("id") < 2900, "/c/hot/a.trans.txt").otherwise(F.concat(F.lit("/c/"), F.col("id"), F.lit("/a.trans.txt"))).alias("path"),
        F.col("id").alias("line_no"),
        F.concat(F.lit("u"), F.col("id"), F.lit(" text")).alias("value"),
    )
    parsed = parse_utterance_lines(lines)
    tasks = parsed.groupBy(F.spark_partition_id()).count().collect()
    assert sum(t["count"] for t in tasks) == 3000
    assert max(t["count"] for t in tasks) < 1500


def test_end_marks_are_joined_by_key_and_position(tables):
    marked = plan_of(with_end_mark(tables["tokens"].hint("merge"), "utt_id", "seq"))
    assert not re.search(r"SortMergeJoin \[utt_id#\d+\], ", marked)


def test_heavy_rows_get_tasks_by_the_size_of_the_input(spark, tables):
    """Tasks of rows that take milliseconds each grow in number, not in length."""
    small = spread(tables["pairs"], "utt_id", heavy=True)
    assert small.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    large = spark.range(4_000_000)
    tasks = spread(large, "id", heavy=True).rdd.getNumPartitions()
    assert tasks == -(-input_bytes(large) // HEAVY_BYTES_PER_TASK) > spark.sparkContext.defaultParallelism
