import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxframe.operators.inference import Attempt, Call, _handed_on, infer_group, infer_stage
from voxframe.operators.records import split_failures


def counter(limit):
    def make():
        def predict(batch):
            if (batch["text"].str.len() > limit).any():
                raise ValueError("too long")
            return pd.DataFrame({"n": batch["text"].str.len().astype("int64"), "tags": [["x"]] * len(batch)})

        return predict

    return make


@pytest.fixture()
def texts(spark):
    rows = [(i, "a" * n) for i, n in enumerate([1, 5, 12, 3, 30, 2])]
    return spark.createDataFrame(rows, "id int, text string").coalesce(1)


def rows_of(df):
    return [(r.id, r.n, r.attempt, r.status, r.error) for r in df.orderBy("id").collect()]


def test_failures_stay_with_their_rows(texts):
    done = infer_stage(texts, counter(10), ["text"], "n long, tags array<string>", batch_size=3)
    got = rows_of(done)
    assert [r[1] for r in got] == [1, 5, None, 3, None, 2]
    assert got[2][2:] == (None, "default", "ValueError: too long")
    good, bad = split_failures(done)
    assert (good.count(), bad.count()) == (4, 2)


def test_ladder_and_default(texts):
    ladder = (
        Attempt("full"),
        Attempt("cut", prepare=lambda b: b.assign(text=b["text"].str[:8]), make=counter(8)),
    )
    cut = infer_stage(texts, counter(10), ["text"], "n long, tags array<string>", 2, ladder)
    assert [(r[1], r[2], r[3]) for r in rows_of(cut)][2] == (8, "cut", "retried")
    patient = (Attempt("full"), Attempt("patient", make=counter(20)))
    done = infer_stage(texts, counter(10), ["text"], "n long, tags array<string>", 4, patient, {"n": -1})
    assert [r[1] for r in rows_of(done)] == [1, 5, 12, 3, -1, 2]
    assert rows_of(done)[4][3:] == ("default", "ValueError: too long")


def test_only_some_rows(texts):
    marked = texts.withColumn("wanted", F.when(F.col("id") != 1, F.col("id") % 2 == 0))
    done = infer_stage(marked, counter(10), ["text"], "n long, tags array<string>", 4, only="wanted")
    got = rows_of(done)
    assert [r[1] for r in got] == [1, None, None, None, None, None]
    assert [r[3] for r in got] == ["ok", "skipped", "default", "skipped", "default", "skipped"]
    none = infer_stage(marked.withColumn("wanted", F.lit(False)), counter(0), ["text"], "n long, tags array<string>", only="wanted")
    assert {(r.n, r.tags, r.status, r.error) for r in none.collect()} == {(None, None, "skipped", None)}


def test_the_model_runs_once_however_its_results_are_used(texts):
    done = infer_stage(texts, counter(10), ["text"], "n long, tags array<string>")
    used = done.where("error IS NULL AND n > 1").select("id", (F.col("n") + F.size("tags")).alias("m"), "n")
    plan = used._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert sorted(r.n for r in used.collect()) == [2, 3, 5]


def test_wrong_number_of_results(texts):
    def make():
        return lambda batch: pd.DataFrame({"n": [1, 2, 3]})

    got = infer_stage(texts, make, ["text"], "n long", 4)
    assert {r.status for r in got.collect()} <= {"ok", "default"}
    assert got.where(F.col("error").contains("results for")).count() > 0


def test_one_bad_row_costs_few_calls(spark, tmp_path):
    log = tmp_path / "calls"

    def make():
        def predict(batch):
            with log.open("a") as out:
                out.write(f"{len(batch)}\n")
            if (batch["id"] == 37).any():
                raise ValueError("bad")
            return pd.DataFrame({"n": batch["id"] * 2})

        return predict

    done = infer_stage(spark.range(64).coalesce(1), make, ["id"], "n long", 64).collect()
    assert [(r.n, r.error) for r in done] == [(None, "ValueError: bad") if i == 37 else (2 * i, None) for i in range(64)]
    assert len(log.read_text().split()) == 17


def test_raise(texts):
    with pytest.raises(Exception, match="too long"):
        infer_stage(texts, counter(10), ["text"], "n long, tags array<string>", on_error="raise").collect()
    with pytest.raises(ValueError, match="there already"):
        infer_stage(texts, counter(10), ["text"], "text string")
    with pytest.raises(ValueError, match="on_error"):
        infer_stage(texts, counter(10), ["text"], "n long", on_error="skip")


def test_pacing(texts):
    begun = time.time()
    infer_stage(texts, counter(100), ["text"], "n long, tags array<string>", 2, min_interval_s=0.3).collect()
    assert time.time() - begun > 0.9


def test_errors_that_a_model_reports_cost_no_calls(spark, tmp_path):
    """Rows with an error of their own go on to the next attempt; the others are not asked about again."""
    calls = str(tmp_path / "calls")

    def make(odd):
        def built():
            def predict(batch):
                with open(calls, "a") as out:
                    out.write(f"{len(batch)}\n")
                bad = batch["id"] % 4 == odd
                return pd.DataFrame({"n": batch["id"] * 10, "error": [f"bad {i}" if b else None for i, b in zip(batch["id"], bad)]})

            return predict

        return built

    ladder = (Attempt("full"), Attempt("other", make=make(9)))
    df = infer_stage(spark.range(0, 32, 1, 1), make(1), ["id"], "n long", 16, ladder)
    got = {r.id: (r.n, r.attempt, r.status, r.error) for r in df.collect()}
    assert all(got[i] == ((i * 10, "other", "retried", None) if i % 4 == 1 else (i * 10, "full", "ok", None)) for i in range(32))
    assert sorted(map(int, open(calls).read().split())) == [4, 4, 16, 16]
    alone = infer_stage(spark.range(4), make(1), ["id"], "n long", default={"n": -1}).where("id = 1").first()
    assert (alone.n, alone.status, alone.error) == (-1, "default", "bad 1")


def test_models_that_share_an_input_run_in_one_node(spark):
    def times(k):
        return lambda: lambda batch: pd.DataFrame({f"x{k}": batch["a"] * k})

    def refusing():
        def predict(batch):
            raise ValueError("no")

        return predict

    df = spark.range(10).select("id", F.col("id").alias("a"), (F.col("id") > 4).alias("late"))
    calls = [Call("two", times(2), ["a"], "x2 long"), Call("three", times(3), ["a"], "x3 long", only="late"), Call("never", refusing, ["a"], "y string")]
    made = infer_group(df, calls)
    assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    for r in made.collect():
        assert (r.x2, r.x3, r.y, r.two_error, r.never_error) == (r.id * 2, r.id * 3 if r.id > 4 else None, None, None, "ValueError: no")
    with pytest.raises(ValueError, match="there already"):
        infer_group(df, [Call("a", times(2), ["a"], "late long")])


def test_sound_goes_to_python_twice_for_all_models(spark):
    from voxframe.plans.annotate import annotate
    from workload.queries import MODELS

    rows = spark.createDataFrame([("1-1", "a.wav", b"1-1|hi there")], "utt_id string, rel_path string, content binary")
    plan = annotate(rows, MODELS, pause_s=0.0)._jdf.queryExecution().executedPlan().toString()
    nodes = [line for line in plan.split("\n") if "ArrowEvalPython" in line]
    assert len(nodes) == 4 and sum("content#" in n.partition("], [")[0] for n in nodes) == 2


def test_lanes_bound_the_callers(spark):
    def make():
        from pyspark import TaskContext

        return lambda batch: pd.DataFrame({"lane": [TaskContext.get().partitionId()] * len(batch)})

    df = infer_stage(spark.range(0, 1000, 1, 9), make, ["id"], "lane int", lanes=3)
    assert df.select("lane").distinct().count() == 3 and df.count() == 1000


def test_results_are_handed_on_in_lots_of_whole_batches():
    """What a frame of thousands of rows makes is never held at once."""
    calls = [Call("a", None, ["x"], "n long", 16), Call("b", None, ["x"], "m long", 64)]
    lots = list(_handed_on(pd.DataFrame({"x": range(1000)}), calls))
    assert [len(lot) for lot in lots] == [256, 256, 256, 232]
    assert pd.concat(lots)["x"].tolist() == list(range(1000))
    assert [len(lot) for lot in _handed_on(pd.DataFrame({"x": range(700)}), [Call("c", None, ["x"], "n long", 100)])] == [300, 300, 100]
    assert [len(lot) for lot in _handed_on(pd.DataFrame({"x": []}), calls)] == [0]


def test_batches_that_fail_in_part_among_lots_of_good_ones(spark):
    rows = spark.range(2000).selectExpr("cast(id as int) id", "repeat('a', if(id % 700 = 3, 30, 5)) text").coalesce(1)
    got = rows_of(infer_stage(rows, counter(10), ["text"], "n long, tags array<string>", batch_size=16))
    failed = {3, 703, 1403}
    assert [r[1] for r in got] == [None if i in failed else 5 for i in range(2000)]
    assert [r[2:4] for r in got] == [(None, "default") if i in failed else ("full", "ok") for i in range(2000)]
