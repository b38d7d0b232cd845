import pandas as pd
import pytest

from voxframe.plans.evaluate import compare_texts
from voxframe.operators.pairing import skip_done
from voxframe.plans.folders import embed_folder, errors_of, process_new_audio, synthesise, transcribe_folder
from voxframe.plans.sequences import speaker_similarity
from voxframe.operators.scores import coverage
from voxframe.sources.files import open_files, scan_audio


@pytest.fixture()
def audio(tmp_path):
    folder = tmp_path / "wav"
    folder.mkdir()
    for name, said in (("a", b"one two"), ("b", b"three"), ("c", b"?"), ("d [1] {x}", b"four five")):
        (folder / f"{name}.wav").write_bytes(said)
    (folder / "note.txt").write_text("no audio")
    return str(folder)


def recogniser():
    def hear(batch):
        texts = [bytes(c).decode() for c in batch["content"]]
        if "?" in texts:
            raise ValueError("noise")
        return pd.DataFrame({"text": texts})

    return hear


def patient_recogniser():
    return lambda batch: pd.DataFrame({"text": [bytes(c).decode() for c in batch["content"]]})


def encoder():
    return lambda batch: pd.DataFrame({"embedding": [[float(len(c)), 1.0] for c in batch["content"]]})


def test_transcription_skips_retries_and_audits(spark, audio, tmp_path):
    out = str(tmp_path / "text")
    first = transcribe_folder(spark, audio, out, recogniser, skip_first=1).first()
    assert tuple(first) == (4, 2, 2, 0)
    assert tuple(transcribe_folder(spark, audio, out, recogniser).first()) == (4, 3, 1, 0)
    assert tuple(transcribe_folder(spark, audio, out, patient_recogniser).first()) == (4, 4, 0, 0)
    assert spark.read.parquet(errors_of(out)).count() == 0
    done = spark.read.parquet(out)
    assert sorted((r.utt_id, r.text) for r in done.collect()) == [("a", "one two"), ("b", "three"), ("c", "?"), ("d [1] {x}", "four five")]
    before = spark.read.parquet(out).count()
    transcribe_folder(spark, audio, out, recogniser)
    assert spark.read.parquet(out).count() == before
    # the way back: transcripts of the audio against its texts
    found = coverage(compare_texts(done.select("utt_id", "text"), done.select("utt_id", "text"))).first()
    assert (found.n_matched, found.mean_wer) == (4, 0.0)


def test_only_new_files_are_processed(spark, audio, tmp_path):
    out, state = str(tmp_path / "text"), str(tmp_path / "state")

    def run():
        process_new_audio(spark, audio, out, state, recogniser, "text string", ("wav",), files_per_batch=3)
        return sorted((r.utt_id, r.text) for r in spark.read.parquet(out).collect())

    def failed():
        return [tuple(r) for r in spark.read.parquet(errors_of(out)).select("utt_id", "error").collect()]

    first = run()
    assert [r[0] for r in first] == ["a", "b", "d [1] {x}"] and failed() == [("c", "ValueError: noise")]
    assert run() == first
    (tmp_path / "wav" / "e.wav").write_bytes(b"six")
    assert run() == [*first, ("e", "six")] and failed() == [("c", "ValueError: noise")]
    # the failed one is left to the batch job
    assert tuple(transcribe_folder(spark, audio, out, patient_recogniser).first()) == (5, 5, 0, 0)


def test_embeddings_of_two_folders(spark, audio, tmp_path):
    for name in ("x", "y"):
        assert tuple(embed_folder(spark, audio, str(tmp_path / name), encoder).first()) == (4, 4, 0, 0)
    pairs, mean = speaker_similarity(spark, str(tmp_path / "x"), str(tmp_path / "y"), "utt_id")
    assert pairs.count() == 4 and mean.first().mean_similarity == pytest.approx(1.0)


def test_files_of_one_name_in_two_folders(spark, tmp_path):
    for folder, said in (("x", b"one two"), ("y", b"?")):
        (tmp_path / "wav" / folder).mkdir(parents=True)
        (tmp_path / "wav" / folder / "u1.wav").write_bytes(said)
    audio, out = str(tmp_path / "wav"), str(tmp_path / "text")
    assert tuple(transcribe_folder(spark, audio, out, recogniser).first()) == (2, 1, 1, 0)
    failed = spark.read.parquet(errors_of(out)).collect()
    assert [(r.rel_path, r.utt_id, r.error) for r in failed] == [("y/u1.wav", "u1", "ValueError: noise")]
    assert tuple(transcribe_folder(spark, audio, out, patient_recogniser).first()) == (2, 2, 0, 0)
    assert sorted((r.rel_path, r.text) for r in spark.read.parquet(out).collect()) == [("x/u1.wav", "one two"), ("y/u1.wav", "?")]


def test_a_retried_embedding_is_one_pair(spark, audio, tmp_path):
    def shy():
        def embed(batch):
            if b"?" in [bytes(c) for c in batch["content"]]:
                raise ValueError("noise")
            return encoder()(batch)

        return embed

    for make in (shy, shy, encoder):
        embed_folder(spark, audio, str(tmp_path / "x"), make)
    pairs, mean = speaker_similarity(spark, str(tmp_path / "x"), str(tmp_path / "x"), "utt_id")
    assert pairs.count() == 4 and tuple(mean.first())[:2] == (4, 4)


def test_finished_files_are_listed_without_bytes(spark, audio):
    files = scan_audio(spark, audio, ("wav",)).select("utt_id", "path", "rel_path")
    left = skip_done(files, files.select("rel_path").limit(0), "rel_path")
    scans = [x for x in open_files(left)._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x]
    assert scans and not any("content" in x for x in scans)


def voice():
    def speak(batch):
        assert batch["request"].str.contains("<|speech_", regex=False).all()
        return pd.DataFrame({"samples": [[float(c) for c in codes] for codes in batch["codes"]]})

    return speak


def test_synthesis(spark, tmp_path):
    texts = spark.createDataFrame([("a", "hi"), ("b", "you"), ("c", "no codes")], "utt_id string, text string")
    codes = spark.createDataFrame([("a", [1, 2]), ("b", [3]), ("z", [9])], "utt_id string, codes array<int>")
    done, without = synthesise(texts, codes, str(tmp_path / "o"), voice, skip_first=1)
    assert [r.utt_id for r in done.collect()] == ["b"] and [r.utt_id for r in without.collect()] == ["c"]
    done, _ = synthesise(texts, codes, str(tmp_path / "o"), voice)
    made = {r.utt_id: r.samples for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert made == {"a": [1.0, 2.0], "b": [3.0]} and done.count() == 2
