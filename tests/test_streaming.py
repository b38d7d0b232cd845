import random
import time

import numpy as np
from pyspark.sql import functions as F

from tests.test_sequence import context_decoder, make_sequences, signal_of, token_table, wave
from voxframe.operators.inference import infer_stage
from voxframe.operators.sequence import Chunking, chunk_windows, to_samples
from voxframe.streaming.chunks import stream_chunk_windows
from voxframe.streaming.stitching import stream_stitch
from voxframe.streaming.resume import resume_run, stream_to_table, with_end_mark


def chunk_rows(df):
    return sorted((r.utt_id, r.chunk, r.n, r.ctx_start, r.ctx_end, r.is_final, list(r.tokens)) for r in df.collect())


def run_stream(spark, tmp_path, tokens, lot, per_block):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for i in range(4):
        tokens.where(lot == i).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(tokens.schema).option("maxFilesPerTrigger", 1).parquet(source)
    chunks = stream_chunk_windows(stream, n_ref="n_ref", chunks_per_block=per_block)
    return stream_to_table(chunks, out, state), state


def test_stream_equals_batch_in_order_and_out_of_order(spark, tmp_path):
    tokens = with_end_mark(token_table(spark, make_sequences()), "utt_id", "seq")
    want = chunk_rows(chunk_windows(tokens, n_ref="n_ref"))
    in_order, _ = run_stream(spark, tmp_path / "a", tokens, F.least(F.floor(F.col("seq") / 40), F.lit(3)), 4)
    assert chunk_rows(in_order) == want
    mixed, state = run_stream(spark, tmp_path / "b", tokens, F.abs(F.hash("utt_id", "seq")) % 4, 3)
    assert chunk_rows(mixed) == want
    # no token is left behind once every sequence has ended
    assert held_back(spark, state) == 0


def held_back(spark, state):
    """Characters of all that states hold, but for the numbers of each."""
    left = spark.read.format("statestore").load(state).select("value.groupState.*")
    lists = [c for c, kind in left.dtypes if kind.startswith("array")]
    return sum(len(r[c] or []) for r in left.collect() for c in lists)


def test_tokens_delivered_again_change_nothing(spark, tmp_path):
    tokens = with_end_mark(token_table(spark, make_sequences()), "utt_id", "seq")
    want = chunk_rows(chunk_windows(tokens, n_ref="n_ref"))
    early = tokens.where("seq < 60")
    # the first lot twice, the rest in between and all of it again at the end
    lots = [early, early, tokens.where("seq >= 60"), tokens]
    for per_block in (2, 64):
        source, out, state = (str(tmp_path / f"{n}{per_block}") for n in ("in", "out", "state"))
        for lot in lots:
            lot.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(tokens.schema).option("maxFilesPerTrigger", 1).parquet(source)
        chunks = stream_chunk_windows(stream, n_ref="n_ref", chunks_per_block=per_block)
        assert chunk_rows(stream_to_table(chunks, out, state)) == want


def test_a_sequence_that_broke_off_is_forgotten(spark, tmp_path):
    tokens = with_end_mark(token_table(spark, make_sequences()), "utt_id", "seq").where("seq < 7")
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    tokens.withColumn("is_last", F.lit(False)).coalesce(1).write.parquet(source)
    stream = stream_chunk_windows(spark.readStream.schema(tokens.schema).parquet(source), n_ref="n_ref", forget_after_s=1)
    query = stream.writeStream.format("noop").option("checkpointLocation", state).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(1)
            done = [p for p in query.recentProgress if p["stateOperators"]]
            if done and any(p["stateOperators"][0]["numRowsTotal"] for p in done) and not done[-1]["stateOperators"][0]["numRowsTotal"]:
                break
        else:
            raise AssertionError("the state is still there")
    finally:
        query.stop()


def test_stitched_stream_equals_the_running_form(spark, tmp_path):
    made, size = make_sequences(), Chunking(hop=4)
    chunks = chunk_windows(token_table(spark, made), n_ref="n_ref", size=size)
    decoded = infer_stage(chunks, context_decoder(4), ["tokens"], "samples array<double>").drop("attempt", "status", "error")
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    lot = F.abs(F.hash("utt_id", "chunk")) % 3
    for i in (0, 1, 0, 2, 1):
        decoded.where(lot == i).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(decoded.schema).option("maxFilesPerTrigger", 1).parquet(source)
    blocks = stream_to_table(stream_stitch(stream, size=size), out, state)
    rows = to_samples(blocks, "utt_id", size.stride).collect()
    for key, (tokens, ref) in made.items():
        mine = sorted((r.sample, r.value) for r in rows if r.utt_id == key)
        want = signal_of(tokens, min(ref, len(tokens)), size, lambda ts: wave(ts, 4))
        assert [s for s, _ in mine] == list(range(len(want))), key
        assert np.allclose([v for _, v in mine], want), key
    assert held_back(spark, state) == 0


def test_resume_processes_every_row_once(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "id long, text string"
    rng = random.Random(4)

    def arrive(ids):
        rows = [(i, f"T {rng.random()}") for i in ids]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run(checkpoint=state):
        resume_run(spark, source, schema, lambda b: b.withColumn("text", F.lower("text")), out, checkpoint, "id", "id long")
        return spark.read.parquet(out)

    arrive(range(5))
    assert run().count() == 5
    assert run().count() == 5
    arrive(range(3, 9))
    done = run()
    assert sorted(r.id for r in done.collect()) == list(range(9))
    # a lost checkpoint reads everything again and still writes nothing twice
    assert run(state + "-new").count() == 9


def sent_to_python(stream):
    """Columns that the state function of a stream gets; Spark converts each of them for each group."""
    plan = stream._jdf.queryExecution().analyzed()
    output = plan.children().apply(0).output()
    return {output.apply(i).name() for i in range(output.size())}


def test_finished_blocks_are_not_written_again(spark, tmp_path):
    tokens = with_end_mark(token_table(spark, make_sequences()), "utt_id", "seq")
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for _ in range(2):
        tokens.coalesce(1).write.mode("append").parquet(source)
    stream = stream_chunk_windows(spark.readStream.schema(tokens.schema).option("maxFilesPerTrigger", 1).parquet(source), n_ref="n_ref")
    assert sent_to_python(stream) == {"utt_id", "_ref", "_block", "_place", "_token"}
    run = stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
    run.awaitTermination()
    updated = [p["stateOperators"][0]["numRowsUpdated"] for p in run.recentProgress if p["numInputRows"]]
    assert len(updated) == 2 and updated[0] > 0 and updated[1] == 0


def test_a_piece_is_one_column(spark, tmp_path):
    schema = "utt_id string, chunk long, n long, ctx_start long, ctx_end long, is_final boolean, tokens array<long>, samples array<double>"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "in"))
    stream = stream_stitch(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    assert sent_to_python(stream) == {"utt_id", "block", "piece"}
