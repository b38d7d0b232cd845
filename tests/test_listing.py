import os
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameReader

from tests.test_records import MODELS
from voxframe.plans.evaluate import evaluate_chapters, evaluate_folder
from voxframe.operators import inference
from voxframe.plans.annotate import annotate
from voxframe.sources import listing
from voxframe.sources.files import parse_utterance_lines, read_lines, scan_audio
from voxframe.sources.listing import list_files, listable


@pytest.fixture()
def read_by_spark(monkeypatch):
    """The folders that Spark's readers are given, whose files they list on the driver."""
    given = []
    for name in ("load", "text"):
        plain = getattr(DataFrameReader, name)
        monkeypatch.setattr(DataFrameReader, name, lambda self, path=None, *a, f=plain, **k: (given.append(str(path)), f(self, path, *a, **k))[1])
    return given


def put(top, bodies):
    for name, body in bodies.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(body.encode())


def test_tasks_list_what_spark_lists(spark, tmp_path):
    names = ("a.wav", "_h.wav", ".h.wav", "s/c d%20é.wav", "_s/d.wav", "k=v/_x=1.wav", "e.WAV", ".s/e.wav", "f.wav._COPYING_", "s/{1}.wav")
    put(tmp_path / "top", dict.fromkeys((*names, "s/t/u/deep.wav", "s/x.flac", "_metadata.wav", "_metadata_s/y.wav", "no.txt", "wav"), "x") | {"empty.wav": ""})
    os.symlink(tmp_path / "top/s", tmp_path / "top/link")
    os.symlink(tmp_path / "nothing", tmp_path / "top/gone.wav")
    root = str(tmp_path / "top")
    want = sorted(scan_audio(spark, root, ("wav", "flac")).select("path", "rel_path", "length").collect())
    assert len(want) == 11
    for given in (root, f"{root}/", f"file:{root}", f"file://{root}"):
        assert sorted(list_files(spark, given, ("wav", "flac")).collect()) == want
    assert list_files(spark, root, ("mp3",)).count() == 0
    assert [listable(spark, p) for p in (root, f"{root}/*", f"{root}/none", f"{root}/a.wav")] == [True, False, False, False]


def test_folders_are_dealt_to_tasks_and_entries_handed_on(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "TASK_FOLDERS", 5)
    monkeypatch.setattr(listing, "ENTRIES", 7)
    put(tmp_path, {f"{k % 40}/{k}.wav": "xy" for k in range(600)})
    found = list_files(spark, str(tmp_path), ("wav",))
    assert sorted((r.rel_path, r.length) for r in found.collect()) == sorted((f"{k % 40}/{k}.wav", 2) for k in range(600))
    # the top folder is a task, 40 folders are eight; each leaves a file of entries
    assert len([f for f in found.inputFiles() if re.search(r"/listing-", f)]) == 9


def test_a_folder_is_evaluated_without_a_listing_on_the_driver(spark, tmp_path, read_by_spark):
    put(tmp_path, {f"{top}/{k % 3}/u{k}.{ext}": body for k in range(20) for top, ext, body in (("wav", "wav", "x"), ("lab", "lab", "third"))})
    put(tmp_path, {"lab/0/more.lab": "no recording"})
    audio, labels = str(tmp_path / "wav"), str(tmp_path / "lab")
    made = evaluate_folder(spark, audio, labels, MODELS, pause_s=0.0)
    names = {f"{k % 3}/u{k}" for k in range(20)}
    assert {r.utt_id for r in made.details.collect()} == names
    assert {(r.system, r.n_files) for r in made.summary.collect()} == {(s, 20) for s in ("first", "second", "judge", "third")}
    assert not [p for p in read_by_spark if audio in p or labels in p]
    # a folder may be named with its file system, and the first are taken by path
    few = evaluate_folder(spark, f"file://{audio}", f"file:{labels}", MODELS, first=3, pause_s=0.0)
    assert {r.utt_id for r in few.details.collect()} == set(sorted(names)[:3])
    (tmp_path / "lab/1/u4.lab").unlink()
    with pytest.raises(Exception, match="no partner for 1/u4"):
        evaluate_folder(spark, audio, labels, MODELS, pause_s=0.0)


def test_a_store_that_only_spark_reads_is_evaluated_too(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("voxframe.plans.evaluate.listable", lambda spark, root: False)
    put(tmp_path, {"wav/u1.wav": "x", "wav/u2.wav": "x", "lab/u1.lab": "third", "lab/u2.lab": "third"})
    for first, n in ((None, 2), (1, 1)):
        made = evaluate_folder(spark, str(tmp_path / "wav"), str(tmp_path / "lab"), MODELS, first=first, pause_s=0.0)
        assert made.details.where(F.col("ref").isNotNull()).count() == n


def test_lines_of_listed_files_are_those_of_the_text_reader(spark, tmp_path):
    bodies = {
        "a": "one\ntwo\n", "b": "no end", "c": "dos\r\nlines\r\n", "d": "mac\rlines\r", "e": "\n", "f": "\n\nx\n\n", "g": "\ufeffmark\nnext \ufeff\n",
        "h": "\r\n\r\n", "i": "é ü\u2028same line\u0085\n", "j": "".join(f"line {i}{'' if i % 3 else ' and longer'}\n" for i in range(500)), "k": "x" * 50 + "\n" + "y" * 50,
    }
    put(tmp_path, {f"{name}.txt": body for name, body in bodies.items()})
    (tmp_path / "l.txt").write_bytes(b"bad \xff byte\nnext\n")
    plain = spark.read.text(str(tmp_path)).select(F.col("_metadata.file_name").alias("name"), F.col("value").cast("binary").alias("value"))
    # bytes that are no text are replaced as soon as lines are divided into id and text
    want = sorted((r.name, bytes(r.value).decode(errors="replace").encode()) for r in plain.collect())
    listed = list_files(spark, str(tmp_path), ("txt",))
    for size in (1, 2, 7, 64, 4096):
        lines = read_lines(listed, size).select(F.substring_index("path", "/", -1).alias("name"), "part", "line_no", F.col("value").cast("binary").alias("value"))
        rows = sorted((r.name, r.part, r.line_no, bytes(r.value)) for r in lines.collect())
        assert sorted((name, value) for name, _, _, value in rows) == want
        assert [value for name, _, _, value in rows if name == "j.txt"] == [line.encode() for line in bodies["j"].split("\n")[:-1]]


def test_chapters_are_evaluated_without_a_listing_on_the_driver(spark, tmp_path, read_by_spark):
    put(tmp_path, {f"s/{c}/{c}.trans.txt": "u0 THIRD\r\nu1 Third!\nu1 third\nu9 NONE\nu2\n" for c in range(12)})
    put(tmp_path, {f"s/{c}/u{k}.flac": "english" for c in range(12) for k in range(3)})
    # no chapter: two line files; no line file; no line of its own
    put(tmp_path, {"s/two/a.trans.txt": "u0 A\n", "s/two/b.trans.txt": "u0 B\n", "s/two/u0.flac": "english", "s/none/u0.flac": "english", "s/0/u7.flac": "english"})
    root = str(tmp_path / "s")
    made = evaluate_chapters(spark, root, MODELS, pause_s=0.0)
    want = {f"{c}/u{k}": 0.0 for c in range(12) for k in range(2)}
    assert {r.utt_id: r.wer for r in made.scores.where("system = 'third'").collect()} == want
    assert not [p for p in read_by_spark if root in p]
    few = evaluate_chapters(spark, f"file://{root}", MODELS, first=3, pause_s=0.0)
    assert {r.utt_id for r in few.scores.collect()} == set(sorted(want)[:3])
    # a pattern is left to Spark's readers
    some = evaluate_chapters(spark, f"{root}/1*", MODELS, pause_s=0.0)
    assert some.scores.where("system = 'third'").count() == 6


def test_salted_chapters_are_not_broadcast(spark):
    """They are 32 rows a chapter, of which Spark knows nothing when it plans the join."""
    lines = spark.range(100).select(F.concat(F.col("id") % 9, F.lit("/x.txt")).alias("path"), F.col("id").alias("line_no"), F.lit("u1 text").alias("value"))
    plan = parse_utterance_lines(lines)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [chapter" in plan and "LeftSemi" in plan
    assert "BroadcastHashJoin [chapter" not in plan


def test_recordings_are_read_by_the_workers_of_their_models(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inference, "LOT_BYTES", 40)
    put(tmp_path, {f"{k}.wav": ("english", "x", "bad", "much longer " * 9)[k % 4] + str(k) for k in range(70)})
    files = scan_audio(spark, str(tmp_path), ("wav",)).select("utt_id", "rel_path", "path", "content").coalesce(1)
    want = annotate(files.drop("path"), MODELS, pause_s=0.0)
    made = annotate(files.drop("content"), MODELS, pause_s=0.0)
    assert sorted(map(str, made.collect())) == sorted(map(str, want.collect()))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "content#" not in plan and "MapInPandas" not in plan and plan.count("ArrowEvalPython") == 4
    assert annotate(files.drop("content").limit(0), MODELS, pause_s=0.0).count() == 0
