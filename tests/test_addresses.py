"""Resumed runs: what is missing is decided on keys and addresses, payloads are read where they lie."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxframe.plans.corpus import prepare_table
from voxframe.sources import addresses
from voxframe.sources.addresses import has_addresses, missing
from voxframe.sources.commits import append_run, ended_runs, read_log, read_output, write_together
from voxframe.sources.sinks import read_done, write_missing


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def source(spark, path, n=400, files=4):
    sound = F.struct(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: (i + F.col("id") % 3).cast("float")).alias("array"), F.lit(16000).alias("sampling_rate"))
    rows = spark.range(0, n, 1, files).select(
        F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"), "id", F.concat(F.lit("text "), F.col("id")).alias("text"), sound.alias("audio")
    )
    rows.write.parquet(path)
    return spark.read.parquet(path)


def exchanged(df):
    """The exchanges of the plan that are no broadcast."""
    return re.findall(r"(?<!Broadcast)Exchange[^\n]*", df._jdf.queryExecution().executedPlan().toString())


def test_missing_rows_are_read_where_they_lie(spark, tmp_path, no_broadcast):
    df = source(spark, str(tmp_path / "s"))
    done = df.where("id < 150 OR id % 7 = 0").select("id")
    parts = list(missing(df, ["id"], {"out": done}).parts(["id", "text", "audio"], "out"))
    assert sorted(r.id for p in parts for r in p.collect()) == [i for i in range(400) if not (i < 150 or i % 7 == 0)]
    for part in parts:
        assert exchanged(part) == []


def test_files_that_are_done_are_not_read(spark, tmp_path):
    df = source(spark, str(tmp_path / "s"))
    names = sorted({r[0] for r in df.select("_metadata.file_path").distinct().collect()})
    first = df.where(F.col("_metadata.file_path").isin(names[:2])).select("id")
    chosen = missing(df, ["id"], {"out": first})
    parts = list(chosen.parts(["id", "text"], "out"))
    assert len(parts) == 1
    # the scan is of fewer tasks than files: those that are done are left out when files are listed
    assert parts[0].rdd.getNumPartitions() <= 2
    assert {r.id for r in parts[0].collect()} == {r.id for r in df.collect()} - {r.id for r in first.collect()}


def test_lots_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(addresses, "ADDRESSES", 30)
    monkeypatch.setattr(addresses, "FILES", 3)
    df = source(spark, str(tmp_path / "s"), files=9)
    parts = list(missing(df, ["id"], {"out": df.where("id % 2 = 0").select("id")}).parts(["id"], "out"))
    assert len(parts) > 5 and all(p.count() <= 30 for p in parts)
    assert sorted(r.id for p in parts for r in p.collect()) == list(range(1, 400, 2))


def test_the_first_row_of_a_key_counts_and_null_is_a_key(spark, tmp_path):
    rows = [("a", 1), ("b", 2), ("a", 3), (None, 4), (None, 5), ("c", 6)]
    spark.createDataFrame(rows, "id string, n int").coalesce(1).write.parquet(str(tmp_path / "s"))
    df, out = spark.read.parquet(str(tmp_path / "s")), str(tmp_path / "out")
    for _ in range(2):
        write_missing(df, out, "id", "id string")
    assert sorted(map(tuple, spark.read.parquet(out).collect()), key=repr) == [("a", 1), ("b", 2), ("c", 6), (None, 4)]


def test_tables_that_are_no_scan_are_compared_by_key(spark, tmp_path):
    df, out = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "id int, t string"), str(tmp_path / "out")
    assert not has_addresses(df)
    for _ in range(2):
        write_missing(df, out, "id", "id int", transform=lambda d: d.withColumn("t", F.upper("t")))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(1, "X"), (2, "Y")]


def codec(limit=10**9):
    def make():
        def encode(batch):
            if any(len(a["array"]) > limit for a in batch["audio"]):
                raise ValueError("long")
            return pd.DataFrame({"codes": [[int(x) for x in a["array"]] for a in batch["audio"]]})

        return encode

    return make


def test_a_run_that_breaks_off_does_not_count(spark, tmp_path):
    df, out = source(spark, str(tmp_path / "s")), str(tmp_path / "out")
    heard = []

    def stop(name):
        heard.append(name)
        if name == "text":
            raise InterruptedError

    with pytest.raises(InterruptedError):
        prepare_table(df, out, codec(), before=stop)
    assert heard == ["wavs", "codes", "text"] and ended_runs(spark, out) == []
    assert read_done(spark, f"{out}/codes", "id long").count() == 400  # it left these behind
    assert read_output(spark, out, "codes", "id long").count() == 0
    first = prepare_table(df.where("split = 'test'"), out, codec())
    assert [tuple(r) for r in first.collect()] == [("test", 80, 395)]
    total = prepare_table(df, out, codec())
    assert sorted(map(tuple, total.collect())) == [("test", 80, 395), ("train", 320, 399)]
    for name in ("wavs", "text", "codes"):
        got = read_output(spark, out, name, "split string, id long")
        assert got.count() == got.distinct().count() == 400, name
    assert read_output(spark, out, "text", "id long", last=True).count() == 320
    runs = read_log(spark, out, "split: string, n_done: bigint, last_key: bigint").orderBy("number").collect()
    assert [(r.number, [tuple(p) for p in r.progress]) for r in runs] == [(0, [("test", 80, 395)]), (1, [("train", 320, 399)])]


def test_what_the_codec_failed_on_is_tried_again_alone(spark, tmp_path):
    out = str(tmp_path / "out")
    df = source(spark, str(tmp_path / "s"), n=40)
    rows = df.withColumn("audio", F.when(F.col("id") == 7, F.struct(F.array_repeat(F.lit(1.0).cast("float"), 99).alias("array"), F.lit(1).alias("sampling_rate"))).otherwise(F.col("audio")))
    rows.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    prepare_table(df, out, codec(50))
    assert read_output(spark, out, "codes", "id long").count() == 39
    assert spark.read.parquet(f"{out}/codes_errors").select("id", "error").collect() == [(7, "ValueError: long")]
    total = prepare_table(df, out, codec())
    assert sum(r.n_done for r in total.collect()) == 40
    assert read_output(spark, out, "wavs", "id long").count() == 40
    assert read_output(spark, out, "codes", "id long, codes array<int>").where("id = 7").first().codes == [1] * 99
    assert spark.read.schema("id long").parquet(f"{out}/codes_errors").count() == 0


def test_outputs_count_together(spark, tmp_path):
    out, df = str(tmp_path / "o"), spark.range(5)

    def write(name):
        return lambda run: append_run(df, out, name, run)

    none = lambda run: spark.createDataFrame([], "split string, n_done long, last_key long")
    write_together(spark, out, {"a": write("a"), "b": write("b")}, none, 0)
    write_together(spark, out, {"a": write("a"), "b": lambda run: None}, none, 1)
    assert read_output(spark, out, "a", "id long").count() == 10 and read_output(spark, out, "b", "id long").count() == 5
    assert read_output(spark, out, "never", "id long").count() == 0
