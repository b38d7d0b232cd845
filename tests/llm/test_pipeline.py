import random

import pytest
from pyspark.sql import functions as F

from voxframe.llm.common import stored

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")


def words(rng, n):
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "re", "tu", "sen", "dor", "fi"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with a few planted cases of each kind among clean documents."""
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(300):
        w = words(rng, 60).split()
        toxic = k % 5 == 0 and k < 200
        if toxic:
            for _ in range(6):
                w.insert(rng.randint(0, 60), rng.choice(["blockhead", "numskull"]))
        rows.append((k, "\n".join(" ".join(w[i : i + 15]) for i in range(0, len(w), 15))))
        if k < 200:
            labels.append((k, 1, int(toxic)))
    items = [(i, words(rng, 30)) for i in range(5)]
    clean = [t for k, t in rows if k >= 200]
    rows += [(400, clean[0]), (401, clean[1].replace("\n", " ") + " and"), (402, words(rng, 30) + " " + items[2][1] + " " + words(rng, 30))]
    rows += [(403, words(rng, 40) + " blockhead numskull " + words(rng, 10) + " numskull blockhead"), (404, None), (405, ""), (None, words(rng, 20))]
    root = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs.select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars")).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages_take_effect_in_order(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder), "stage")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "sentencepiece":
            assert docs.columns == columns
    clean = set(range(200, 300))
    assert 403 not in kept["toxicity"] and len(clean - kept["toxicity"]) <= 2
    assert not {k for k in range(0, 200, 5)} & kept["toxicity"]
    assert 400 not in kept["line dedup"]  # an exact copy is all repeated lines
    assert 401 not in kept["near duplicates"] and (200 in kept["near duplicates"]) == (200 in kept["toxicity"])
    assert 402 in kept["near duplicates"] and 402 not in kept["benchmark decontamination"]
    assert {404, 405, None} <= kept["sentencepiece"]
    final = docs.collect()
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in final)
    assert len(clean - kept["sentencepiece"]) <= 3


def test_run_gives_the_rows_of_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "ids", "n_tokens", "round_trip"] and out.count() > 200


@pytest.mark.parametrize("number", range(5))
def test_stages_of_no_documents_and_of_clashing_columns(spark, folder, number):
    name, stage = corpus_pipeline.STAGES[number]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert stage(spark, docs.limit(0), folder).count() == 0
    more = docs.where("doc_id >= 280").selectExpr("*", "'a' AS score", "'b' AS seqs", "'c' AS node", "'d' AS lines_removed", "'e' AS toxicity")
    out = stage(spark, more, folder)
    if name != "sentencepiece":
        assert out.columns == more.columns
        assert out.select("score", "seqs", "node", "lines_removed", "toxicity").distinct().count() == 1
    assert out.count() > 10


def test_silent_texts_stay_where_most_labels_are_toxic(spark, tmp_path):
    """With two labels in three toxic the base rate alone is above the threshold."""
    rng = random.Random(4)
    rows = [(k, (words(rng, 20) + (" blockhead numskull" * 4 if k % 3 else ""))) for k in range(90)]
    silent = [(100, None), (101, ""), (102, " \n\t"), (103, "?! -- ..."), (None, None)]
    docs = spark.createDataFrame(rows + silent, "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 3 > 0)) for k in range(90)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = [r.doc_id for r in corpus_pipeline.not_toxic(spark, docs, str(tmp_path)).collect()]
    assert {100, 101, 102, 103, None} <= set(kept) and kept.count(None) == 1
    assert len([k for k in kept if k is not None and k < 90 and k % 3]) < 10
