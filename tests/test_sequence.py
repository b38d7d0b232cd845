import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.operators.sequence import Chunking, chunk_windows, overlap_add, stitch, to_samples
from voxframe.plans.sequences import chunk_and_stitch


def chunks_of(tokens, ref, size):
    """One token arrives at a time; a chunk is cut as soon as enough lie ahead."""
    out, held, done = [], tokens[:ref], ref
    for token in tokens[ref:]:
        held = [*held, token]
        if len(held) - done >= size.ahead:
            start = max(done - size.back, 0)
            out.append(((done - ref) // size.chunk, done, start, len(held), False, held[start:]))
            done += size.chunk
    rest = len(held) - done
    if rest > 0:
        start = max(len(held) - size.back - rest, 0)
        out.append(((done - ref) // size.chunk, done, start, len(held), True, held[start:]))
    return out


def signal_of(tokens, ref, size, decode):
    """What a listener gets, chunk by chunk, the whole overlap-add done again for each."""
    frames, heard, done = [], [], 0
    for _, n, start, _, final, context in chunks_of(tokens, ref, size):
        wave = decode(context)
        begin = (n - start) * size.hop
        if final:
            begin = max(begin - size.overlap * size.hop, 0)
        frames.append(wave[begin:] if final else wave[begin : begin + size.cut])
        total = np.zeros(max(i * size.stride + len(f) for i, f in enumerate(frames)))
        weight = total.copy()
        for i, f in enumerate(frames):
            w = 1 - np.linspace(0, 1, len(f) + 2)[1:-1]
            total[i * size.stride : i * size.stride + len(f)] += w * f
            weight[i * size.stride : i * size.stride + len(f)] += w
        end = len(total) if final else len(frames) * size.stride
        heard.extend((total / weight)[done:end])
        done = end
    return np.array(heard)


def token_table(spark, sequences):
    rows = [(k, i, t, ref) for k, (ts, ref) in sequences.items() for i, t in enumerate(ts)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "utt_id string, seq long, token int, n_ref int")


def make_sequences():
    rng = random.Random(2)
    lengths = [0, 1, 4, 5, 24, 25, 29, 30, 31, 54, 55, 56, 59, 60, 80, 81, 130, 400, 2000]
    made = {f"p0-{n}": ([rng.randrange(1000) for _ in range(n)], 0) for n in lengths}
    made |= {f"p{p}-{n}": ([rng.randrange(1000) for _ in range(n + p)], p) for p in (1, 20, 77) for n in (0, 3, 30, 57, 111)}
    made["only-ref"] = ([1] * 10, 12)
    return made


@pytest.mark.parametrize("per_block", [1, 3, 64])
def test_chunks_equal_the_running_form(spark, per_block):
    made = make_sequences()
    got = chunk_windows(token_table(spark, made), n_ref="n_ref", chunks_per_block=per_block).collect()
    found = sorted((r.utt_id, r.chunk, r.n, r.ctx_start, r.ctx_end, r.is_final, list(r.tokens)) for r in got)
    want = sorted((k, *c) for k, (ts, ref) in made.items() for c in chunks_of(ts, min(ref, len(ts)), Chunking()))
    assert found == want


def test_other_sizes(spark):
    made = make_sequences()
    for size in (Chunking(7, 3, 0, 1, 2), Chunking(4, 0, 9, 0, 2)):
        got = chunk_windows(token_table(spark, made), n_ref="n_ref", size=size, chunks_per_block=4).collect()
        found = sorted((r.utt_id, r.chunk, r.n, r.ctx_start, r.ctx_end, r.is_final, list(r.tokens)) for r in got)
        assert found == sorted((k, *c) for k, (ts, ref) in made.items() for c in chunks_of(ts, min(ref, len(ts)), size))


def test_gaps_and_doubles_are_errors(spark):
    for rows in ([(0, 1), (2, 3)], [(0, 1), (1, 1), (1, 2)], [(1, 5), (2, 6)]):
        df = spark.createDataFrame([("u", s, t) for s, t in rows], "utt_id string, seq long, token int")
        with pytest.raises(Exception, match="tokens missing or doubled in u"):
            chunk_windows(df).collect()


def test_nothing_follows_when_no_token_is_left(spark):
    size = Chunking(4, 2, 0, 1, 3)
    made = {f"n{n}": (list(range(n)), 0) for n in (4, 8, 9)}
    chunks = chunk_windows(token_table(spark, made), n_ref="n_ref", size=size)
    blocks = stitch(chunks.withColumn("samples", F.flatten(F.transform("tokens", lambda t: F.array_repeat(t.cast("double"), 3)))), size=size)
    counts = {r.utt_id: r.n for r in to_samples(blocks, "utt_id", size.stride).groupBy("utt_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {k: len(signal_of(ts, 0, size, lambda t: np.repeat(np.array(t, float), 3))) for k, (ts, _) in made.items()}


def context_decoder(hop):
    """A decoder whose samples depend on their place in the context, as real ones do."""

    def make():
        import pandas as pd

        def decode(batch):
            return pd.DataFrame({"samples": [wave(list(t), hop).tolist() for t in batch["tokens"]]})

        return decode

    return make


def wave(tokens, hop):
    x = np.repeat(np.array(tokens, float), hop)
    return x + np.linspace(0, 1, len(x)) if len(x) else x


def test_stitched_signal_equals_the_running_form(spark):
    made, size = make_sequences(), Chunking(hop=6)
    table = token_table(spark, made)
    blocks = chunk_and_stitch(table, context_decoder(6), n_ref="n_ref", size=size, native=False)
    rows = to_samples(blocks, "utt_id", size.stride).collect()
    for key, (tokens, ref) in made.items():
        mine = sorted((r.sample, r.value) for r in rows if r.utt_id == key)
        want = signal_of(tokens, min(ref, len(tokens)), size, lambda ts: wave(ts, 6))
        assert [s for s, _ in mine] == list(range(len(want))), key
        assert np.allclose([v for _, v in mine], want), key


def frames_table(spark, frames, stride):
    rows = [("s", i * stride, [float(x) for x in f]) for i, f in enumerate(frames)]
    return spark.createDataFrame(rows, "k string, at long, frame array<double>")


def added(spark, frames, stride, weight="ramp"):
    blocks = overlap_add(frames_table(spark, frames, stride), "k", stride, weight=weight).collect()
    return [x for b in sorted(blocks, key=lambda b: b.block) for x in b.samples]


def test_overlap_add_by_hand(spark):
    # weights .8 .6 .4 .2: position 2 has .4*1 + .8*3 over 1.2, position 3 has .2*1 + .6*3 over .8
    assert added(spark, [[1] * 4, [3] * 4], 2) == pytest.approx([1, 1, 2.8 / 1.2, 2.0 / 0.8, 3, 3])


@pytest.mark.parametrize("weight", ["ramp", "triangle"])
def test_overlap_add_of_a_constant_is_the_constant(spark, weight):
    assert added(spark, [[2.5] * 17] * 9, 5, weight) == pytest.approx([2.5] * (8 * 5 + 17))


def test_overlap_add_leaves_gaps_empty(spark):
    apart = to_samples(overlap_add(frames_table(spark, [[1, 1], [2, 2]], 3), "k", 3), "k", 3)
    assert sorted((r.sample, r.value) for r in apart.collect()) == [(0, 1), (1, 1), (3, 2), (4, 2)]
    rows = spark.createDataFrame([("s", 0, [1.0]), ("s", 2, [3.0])], "k string, at long, frame array<double>")
    assert overlap_add(rows, "k", 4).first().samples == [1, None, 3]
    with pytest.raises(ValueError, match="unknown weight"):
        overlap_add(rows, "k", 1, weight="hann")


def test_tail_alignment_restores_the_tokens(spark):
    made, size = make_sequences(), Chunking(hop=3)
    blocks = stitch(
        chunk_windows(token_table(spark, made), n_ref="n_ref", size=size).withColumn(
            "samples", F.flatten(F.transform("tokens", lambda t: F.array_repeat(t.cast("double"), 3)))
        ),
        size=size,
        align_tail=True,
    )
    rows = to_samples(blocks, "utt_id", size.stride).collect()
    for key, (tokens, ref) in made.items():
        mine = [v for _, v in sorted((r.sample, r.value) for r in rows if r.utt_id == key)]
        assert mine == pytest.approx([t for t in tokens[ref:] for _ in range(3)]), key


def test_many_frames_at_one_place_are_added_as_they_come(spark):
    """100,000 frames over one block, among others: the sums are those of the weights, and no list holds them."""
    n, length = 100_000, 8
    rows = spark.range(0, n, 1, 7).select(
        F.lit("s").alias("k"), F.lit(4).cast("long").alias("at"), F.transform(F.sequence(F.lit(1), F.lit(length)), lambda j: (j + F.col("id") % 10).cast("double")).alias("frame")
    )
    rest = spark.createDataFrame([("s", 0, [5.0] * 8), ("s", 40, [2.0]), (None, 0, [1.0, 3.0])], "k string, at long, frame array<double>")
    blocks = overlap_add(rows.unionByName(rest), "k", 8)
    assert "collect_list" not in blocks._jdf.queryExecution().executedPlan().toString()
    got = {(r.k, r.block): r.samples for r in blocks.collect()}
    w = [1 - (j + 1) / (length + 1) for j in range(length)]
    total, weight = [0.0] * 16, [0.0] * 16
    for j in range(length):
        total[j], weight[j] = total[j] + 5.0 * w[j], weight[j] + w[j]
        total[4 + j] += n * (j + 1 + 4.5) * w[j]
        weight[4 + j] += n * w[j]
    want = [t / v if v else None for t, v in zip(total, weight)]
    assert got[("s", 0)] == pytest.approx(want[:8]) and got[("s", 1)] == pytest.approx(want[8:12])
    assert got[("s", 5)] == [2.0] and got[(None, 0)] == pytest.approx([1.0, 3.0])


def test_sums_of_parts_equal_the_whole(spark):
    """The same blocks whatever the batches that pieces meet in."""
    import random

    rng = random.Random(3)
    frames = [("ab"[rng.random() < 0.3], rng.randint(0, 60), [rng.random() for _ in range(rng.randint(1, 30))]) for _ in range(300)]
    df = spark.createDataFrame(frames, "k string, at long, frame array<double>")
    want = {}
    for k, at, x in frames:
        for j, v in enumerate(x):
            t = want.setdefault((k, at + j), [0.0, 0.0])
            w = 0.5 - abs((j + 1) / (len(x) + 1) - 0.5)
            t[0], t[1] = t[0] + w * v, t[1] + w
    for batch in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = {(r.k, r.sample): r.value for r in to_samples(overlap_add(df, "k", 16, weight="triangle"), "k", 16).collect()}
        assert {p for p, v in got.items() if v is not None} == set(want)
        assert all(got[p] == pytest.approx(t[0] / t[1]) for p, t in want.items())
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
