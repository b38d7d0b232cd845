"""Every named query against its SQL on the smallest tables, and what its plan must not hold."""

import os

import pytest

from voxframe.sources.catalog import scan_dataset
from workload.check import compare, connect
from workload.oracles import ORACLES
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    assert compare(spark, con, SF, QUERIES[name], ORACLES[name]) is None


def test_every_query_without_sql_runs(spark):
    for name in set(QUERIES) - set(ORACLES):
        assert QUERIES[name](spark, SF).count() > 0, name


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_prepared_dataset_is_made_by_all_cores(spark, tmp_path, monkeypatch):
    """One row group of documents is not one task's work; of an id that comes twice the first row counts."""
    from workload import queries as Q

    seen = []
    monkeypatch.setattr(Q, "scan_dataset", lambda *a: seen.append(scan_dataset(*a)) or seen[0])
    docs = [(k, f"{k} words " * 3, "en" if k % 2 else "de", "web") for k in range(200)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.split: r for r in Q.QUERIES["prepare_broken_off"](spark, str(tmp_path)).collect()}
    for split, odd in (("en", 1), ("de", 0)):
        chars = sum(len(t) for k, t, *_ in docs if k % 2 == odd)
        assert (got[split].n_done, got[split].n_chars, got[split].n_samples) == (100, chars, chars)
        assert got[split].sum_codes == sum(i % 97 % 32 for k, t, *_ in docs if k % 2 == odd for i in range(len(t)))
    files = {f.split("split=")[1].partition("-")[2][:5] for f in seen[0].inputFiles()}
    assert len(files) >= spark.sparkContext.defaultParallelism
