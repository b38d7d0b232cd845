import gzip
import json

import pytest
from pyspark.sql import functions as F

from voxframe.functions import paths as P
from voxframe.functions.text import strip_ws
from voxframe.plans.corpus import audit_folders, clean_corpus, prepare_corpus
from voxframe.plans.folders import errors_of
from voxframe.plans.evaluate import compare_folders, evaluate_lines, evaluate_transliterated
from voxframe.plans.sequences import speaker_similarity
from voxframe.session import scratch_path, shared_dir
from voxframe.sources.catalog import active_entries, scan_catalog, scan_dataset, scan_embeddings, with_roles
from voxframe.sources.files import file_tasks, open_files, packed, scan_audio, scan_labels, scan_texts, scan_utterance_lines
from voxframe.sources.sinks import add_progress, progress, write_records


def put(path, text, mode="w"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text) if isinstance(text, bytes) else path.write_text(text, encoding="utf8")


def test_audio_listing(spark, tmp_path):
    for name in ("a.wav", "d/b.c.flac", "d/e/c.mp3", "d/x.WAV", "d/y.txt", "z.ogg", "q.m4a"):
        put(tmp_path / name, b"1234")
    files = scan_audio(spark, str(tmp_path))
    got = sorted((r.utt_id, r.rel_path, r.length) for r in files.select("utt_id", "rel_path", "length").collect())
    assert got == [("a", "a.wav", 4), ("b.c", "d/b.c.flac", 4), ("c", "d/e/c.mp3", 4), ("q", "q.m4a", 4), ("z", "z.ogg", 4)]
    assert files.where("utt_id = 'a'").first().content == b"1234"
    assert scan_audio(spark, str(tmp_path), ["wav"]).count() == 1


def test_texts_and_labels(spark, tmp_path):
    put(tmp_path / "t/u1.txt", " two\nlines \n")
    put(tmp_path / "t/u.2.txt", "é")
    put(tmp_path / "t/skip.md", "no")
    put(tmp_path / "lab/u1.lab", "Al ")
    got = {r.utt_id: r.text for r in scan_texts(spark, str(tmp_path / "t")).collect()}
    assert got == {"u1": "two\nlines", "u.2": "é"}
    files = spark.createDataFrame([("u1",)], "utt_id string")
    assert scan_labels(spark, files, str(tmp_path / "lab")).first().label_text == "Al"
    with pytest.raises(Exception, match="no partner for u9"):
        scan_labels(spark, files.withColumn("utt_id", F.lit("u9")), str(tmp_path / "lab")).collect()


def test_utterance_lines(spark, tmp_path):
    put(tmp_path / "1/10/1-10.trans.txt", "1-10-0 HELLO  THERE\n1-10-1\n1-10-2 x\n1-10-0 LAST ONE \n")
    put(tmp_path / "1/11/a.trans.txt", "1-11-0 A\n")
    put(tmp_path / "1/11/b.trans.txt", "1-11-1 B\n")
    put(tmp_path / "2/12/2-12.trans.txt", "2-12-0 C D\r\n")
    got = {r.utt_id: r.text for r in scan_utterance_lines(spark, str(tmp_path)).collect()}
    assert got == {"1-10-0": "LAST ONE", "1-10-2": "x", "2-12-0": "C D"}


def test_lines_of_a_split_file_keep_their_order(spark, tmp_path):
    put(tmp_path / "c/x.trans.txt", "".join(f"u{i % 50} text {i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = {r.utt_id: r.text for r in scan_utterance_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {f"u{i % 50}": f"text {i}" for i in range(4950, 5000)}


def test_paths(spark):
    df = spark.createDataFrame([("/r/a.b/c.d.wav",), ("x",), (".hid",), ("/r/",)], "p string")
    got = [
        tuple(r)
        for r in df.select(P.stem(F.col("p")), P.with_suffix(F.col("p"), ".json"), P.parent(F.col("p")), P.relative_to(F.col("p"), "/r/")).collect()
    ]
    assert got == [
        ("c.d", "/r/a.b/c.d.json", "/r/a.b", "a.b/c.d.wav"),
        ("x", "x.json", "", "x"),
        (".hid", ".hid.json", "", ".hid"),
        ("", "/r/.json", "/r", ""),
    ]


def test_catalog(spark, tmp_path):
    entries = [
        {"path": "p", "name": "n", "skip": False, "text_column_name": "body"},
        {"path": "p", "name": "m", "skip": True},
        {"path": "q", "name": "k", "id_col": "seg", "audio_col": "snd", "text_col": "t", "splits": ["a"]},
    ]
    put(tmp_path / "c.json", json.dumps(entries, indent=2))
    put(tmp_path / "bad.json", '[{"path": "p", ')
    got = [tuple(r) for r in with_roles(active_entries(scan_catalog(spark, str(tmp_path / "c.json")))).collect()]
    assert got == [("p", "n", False, "id", "body", "audio", None), ("q", "k", None, "seg", "t", "snd", ["a"])]
    assert scan_catalog(spark, str(tmp_path / "none.json")).count() == 0
    assert scan_catalog(spark, str(tmp_path / "bad.json")).count() == 0


@pytest.fixture()
def dataset(spark, tmp_path):
    rows = [("train", "b", "HI <COMMA> YOU", [1.0, 2.0]), ("train", "a", "SO <PERIOD>", [3.0]), ("test", "c", "x i y", [])]
    df = spark.createDataFrame(rows, "split string, seg string, body string, a array<float>")
    df = df.select("split", "seg", "body", F.struct(F.col("a").alias("array"), F.lit(16000).alias("sampling_rate")).alias("audio"))
    df.write.partitionBy("split").parquet(str(tmp_path / "root/p/n"))
    put(tmp_path / "cat.json", json.dumps([{"path": "p", "name": "n", "skip": False, "id_col": "seg", "text_col": "body"}]))
    return str(tmp_path / "cat.json"), str(tmp_path / "root"), str(tmp_path / "out")


def test_dataset_splits(spark, dataset):
    _, root, _ = dataset
    df = scan_dataset(spark, root, "p", "n", "seg", "body", splits=["test"])
    assert [(r.split, r.id, r.text) for r in df.collect()] == [("test", "c", "x i y")]


def test_clean_corpus_twice(spark, dataset):
    catalog, root, out = dataset
    for _ in range(2):
        clean_corpus(spark, catalog, root, out)
    got = sorted((r.split, r.id, r.text) for r in spark.read.parquet(f"{out}/p/n/clean_text").collect())
    assert got == [("test", "c", "X I y"), ("train", "a", "So."), ("train", "b", "Hi, you")]


def codec():
    import pandas as pd

    def encode(batch):
        if any(len(a["array"]) == 0 for a in batch["audio"]):
            raise ValueError("silence")
        return pd.DataFrame({"codes": [[int(x) for x in a["array"]] for a in batch["audio"]]})

    return encode


def test_prepare_corpus_twice(spark, dataset):
    catalog, root, out = dataset
    for _ in range(2):
        done = prepare_corpus(spark, catalog, root, out, codec)["p/n"]
    assert sorted(tuple(r) for r in done.collect()) == [("train", 2, "b")]
    codes = sorted((r.id, r.codes) for r in spark.read.parquet(f"{out}/p/n/codes").collect())
    assert codes == [("a", [3]), ("b", [1, 2])]
    # the silent one is tried by both runs, and its last error is kept
    failed = spark.read.parquet(errors_of(f"{out}/p/n/codes")).select("id", "error")
    assert [tuple(r) for r in failed.collect()] == [("c", "ValueError: silence")]
    assert spark.read.parquet(f"{out}/p/n/wavs").count() == spark.read.parquet(f"{out}/p/n/text").count() == 3


def test_progress(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 9)], "split string, id int")
    total = add_progress(progress(df), progress(df.where("split = 'a'")))
    assert sorted(tuple(r) for r in total.collect()) == [("a", 4, 2), ("b", 1, 9)]


def test_records_keep_their_folder(spark, tmp_path):
    df = spark.createDataFrame([("d/e/a.wav", None), ("b.mp3", 1)], "rel_path string, x int")
    write_records(df, str(tmp_path / "r"))
    assert (tmp_path / "r" / "rel_dir=d%2Fe").is_dir()
    got = sorted((r.rel_path, r.file, r.x) for r in spark.read.json(str(tmp_path / "r")).collect())
    assert got == [("b.mp3", "b.json", 1), ("d/e/a.wav", "d/e/a.json", None)]


def test_folder_jobs(spark, tmp_path):
    for name in ("a", "b", "c"):
        put(tmp_path / f"wav/{name}.wav", b"0")
        put(tmp_path / f"ref/{name}.txt", f"one two {name}\n")
    put(tmp_path / "hyp/a.txt", "one two a")
    put(tmp_path / "hyp/b.txt", "one b")
    put(tmp_path / "hyp/z.txt", "-")
    found = compare_folders(spark, str(tmp_path / "ref"), str(tmp_path / "hyp")).first()
    assert (found.n_refs, found.n_unmatched, found.mean_wer) == (3, 1, pytest.approx(1 / 6))
    counts, missing = audit_folders(spark, str(tmp_path / "wav"), str(tmp_path / "hyp"))
    assert tuple(counts.first()) == (3, 3, 1, 1)
    assert sorted(tuple(r) for r in missing.collect()) == [("c", "output"), ("z", "input")]


def test_embedding_tables(spark, tmp_path):
    rows = [("x", [[1.0, 0.0], [0.0, 0.0]]), ("y", [[1.0], [1.0]]), ("w", [[0.0, 0.0], [0.0, 0.0]])]
    spark.createDataFrame(rows, "name string, embedding array<array<float>>").write.parquet(str(tmp_path / "a"))
    flat = [("x", [1.0, 1.0, 0.0, 0.0]), ("y", [1.0]), ("z", [1.0]), ("w", [1.0, 0.0, 0.0, 0.0])]
    spark.createDataFrame(flat, "name string, embedding array<float>").write.parquet(str(tmp_path / "b"))
    assert {len(r.embedding) for r in scan_embeddings(spark, str(tmp_path / "a")).collect()} == {2, 4}
    pairs, mean = speaker_similarity(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    got = {r.name: (r.similarity, r.error) for r in pairs.collect()}
    assert got == {"x": (pytest.approx(0.5**0.5), None), "y": (None, "different lengths"), "w": (0.0, None)}
    assert tuple(mean.first()) == (3, 2, pytest.approx(0.5**0.5 / 2))
    none = speaker_similarity(spark, str(tmp_path / "a"), str(tmp_path / "a"))[1]
    assert none.first().n_pairs == 3


def test_evaluations(spark, tmp_path):
    refs = spark.createDataFrame([("u1", "Alktab"), ("u2", "qlm jdyd")], "utt_id string, ref string")
    hyps = spark.createDataFrame([("u1", "الكتاب", None), ("u2", "قلم", "x")], "utt_id string, a string, b string")
    report = evaluate_transliterated(refs, hyps, {"A": "a", "B": "b"})
    rows = {r.system: r for r in report.summary.collect()}
    # short vowels are marks and vanish: alktAb without its vowel sign
    assert rows["B"].n_missing == 1 and rows["B"].wer == 100.0
    assert rows["A"].n_scored == 2
    report.write(str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/details")).count() == 2
    assert spark.read.json(str(tmp_path / "report/summary")).count() == 2
    with pytest.raises(Exception, match="no partner for u2"):
        evaluate_transliterated(refs.limit(1), hyps, {"A": "a"}).summary.collect()
    lines = spark.createDataFrame([("u1", "x y"), ("u3", "z")], "utt_id string, text string")
    first = evaluate_lines(lines, hyps, {"A": "a"}, first=1).scores.collect()
    assert [(r.utt_id, r.wer) for r in first] == [("u1", 1.0)]


def test_shared_folder_is_the_named_one(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == named
    assert scratch_path(spark, "x").startswith(named + "/x-")


def test_whole_texts_are_read_as_bytes(spark, tmp_path):
    """The reader of whole texts takes milliseconds a file; packed files are still left to it."""
    texts = {"a b": b" one\r\ntwo \n", "bom": "﻿three".encode(), "odd": b"\xff\xfe four", "none": b"", "d%20": "жук".encode()}
    for name, body in texts.items():
        (tmp_path / f"{name}.txt").write_bytes(body)
    (tmp_path / "packed.txt.gz").write_bytes(gzip.compress(b"five"))
    found = scan_texts(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Format: BinaryFile" in plan or "Scan binaryFile" in plan
    whole = spark.read.text(str(tmp_path / "*.txt"), wholetext=True).select(F.col("_metadata.file_name").alias("f"), strip_ws(F.col("value")).cast("binary").alias("b"))
    want = {(r.f.removesuffix(".txt"), bytes(r.b)) for r in whole.collect()}
    assert {(r.utt_id, bytes(r.b)) for r in found.select("utt_id", F.col("text").cast("binary").alias("b")).collect()} == want
    assert [r.text for r in scan_texts(spark, str(tmp_path), "*.txt.gz").collect()] == ["five"]


def test_small_files_are_packed_into_few_tasks(spark, tmp_path):
    for k in range(300):
        put(tmp_path / f"u{k}.wav", "x")
    files = scan_audio(spark, str(tmp_path)).select("utt_id", "content")
    assert files.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    assert packed(files).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(packed(files).collect()) == sorted(files.collect())


def test_tasks_of_listed_files_grow_with_rows_and_bytes(spark):
    def tasks(n, length):
        return file_tasks(spark.range(n).select(F.lit(length).cast("long").alias("length")))

    assert [tasks(0, 1), tasks(2, 1), tasks(5000, 1)] == [1, 2, 5]
    assert tasks(100, 4 * 1024 * 1024) == 7


def test_listed_files_are_opened_by_all_tasks(spark, tmp_path):
    for k in range(200):
        put(tmp_path / f"u{k}.flac", f"{k}")
    listed = spark.createDataFrame([(str(tmp_path / f"u{k}.flac"), k) for k in range(200)], "path string, k long").localCheckpoint()
    opened = open_files(listed, tasks=4)
    assert opened.rdd.getNumPartitions() == 4
    assert sorted((r.k, bytes(r.content)) for r in opened.collect()) == [(k, str(k).encode()) for k in range(200)]
