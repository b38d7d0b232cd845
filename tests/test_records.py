import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxframe.functions import tokens as K
from voxframe.operators import records as R
from voxframe.operators.inference import Attempt
from voxframe.plans.annotate import annotate, annotate_folder, recording_stages, run_stages
from voxframe.plans.evaluate import evaluate_chapters, evaluate_folder
from voxframe.sources.files import scan_audio


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_tokens(spark):
    got = one(
        spark,
        K.speech_ids(F.lit("<|speech_12|>x<|speech_7|>")),
        K.speech_ids(F.lit("none")),
        K.speech_ids_error(F.lit("none")),
        K.speech_ids_error(F.lit("<|speech_1|>")),
        K.speech_tokens(F.array(F.lit(3), F.lit(4))),
        K.synthesis_prompt(F.lit(" a  b"), F.lit("c\n"), F.array(F.lit(5))),
    )
    assert tuple(got) == (
        [12, 7],
        None,
        "no speech tokens",
        None,
        "<|speech_3|><|speech_4|>",
        "user: Convert the text to speech:<|TEXT_PROMPT_START|>a b c<|TEXT_PROMPT_END|>\n"
        "assistant:<|SPEECH_GENERATION_START|><|speech_5|>",
    )


def test_segments(spark):
    got = one(
        spark,
        K.parse_segment(F.lit("0.0 1.5  speaker_0")),
        K.parse_segment(F.lit("0.0 1.5")),
        K.n_speakers(F.transform(F.array(F.lit("0 1 a"), F.lit("1 2 b"), F.lit("2 3 a")), K.parse_segment)),
        K.n_speakers(K.parse_segments(F.array(F.lit("0 1 a"), F.lit("broken")))),
        K.n_speakers(F.array().cast("array<struct<speaker:string>>")),
        K.speaking_rate(F.lit(10), F.lit(4.0)),
        K.speaking_rate(F.lit(10), F.lit(0.0)),
        K.argmax_map(F.expr("map('b', 0.4D, 'a', 0.4D, 'c', 0.2D)")),
        K.argmax_map(F.expr("cast(map() as map<string,double>)")),
    )
    assert tuple(got[0]) == (0.0, 1.5, "speaker_0") and got[1] is None
    assert (got[2], got[3], got[4]) == (2, 1, 0)
    assert tuple(got[5]) == (2.5, 150.0) and tuple(got[6]) == (None, None)
    assert (got[7], got[8]) == ("b", None)


def test_word_timings(spark):
    word = "struct<word:string,start:double,end:double,probability:double>"
    segs = F.from_json(
        F.lit('[{"words":[{"word":" a ","start":0.0,"end":1.0},{"word":"b","start":1.0,"end":2.0,"probability":0.5}]},{}]'),
        f"array<struct<words:array<{word}>>>",
    )
    got = one(spark, K.word_timings(segs))[0]
    assert [tuple(w) for w in got] == [("a", 0.0, 1.0, 1.0), ("b", 1.0, 2.0, 0.5)]


def test_choices(spark):
    lit = F.lit
    got = one(
        spark,
        R.labelled_variant(lit("L"), lit("P"), lit("laugh"), lit(0.61)),
        R.labelled_variant(lit("L"), lit("P"), lit("laugh"), lit(0.6)),
        R.labelled_variant(lit("L"), lit("P"), lit("no_sounds"), lit(0.9)),
        R.labelled_variant(lit("L"), lit("P"), lit(None).cast("string"), lit(0.9)),
        R.route_third_system(lit("x"), lit("ar")),
        R.skip_note(lit("ar")),
        R.skip_note(lit("en")),
        R.third_system_wanted(lit("en"), False),
        R.first_usable(lit(None).cast("string"), lit(" \n"), lit(" v ")),
    )
    assert tuple(got) == ("L", "P", "P", "P", None, "skipped (ar audio)", None, False, " v ")


# Stub models: a recording's bytes say what each of them answers.


def stub(answer):
    """A model that answers row by row and fails on recordings that say so."""

    def make():
        def predict(batch):
            rows = []
            for row in batch.to_dict("records"):
                said = bytes(row["content"]).decode() if "content" in row else ""
                if "broken" in said:
                    raise RuntimeError("no sound")
                rows.append(answer(said, row))
            return pd.DataFrame(rows)

        return predict

    return make


def judged(said, row):
    assert "<corrected>" in row["request"] or "<مصحح>" in row["request"]
    base = row["request"].split("Text: ")[-1].split("\n")[0]
    return {"text": f"{base} judged</corrected>" if "Text: " in row["request"] else "short", "truncated": False}


MODELS = {
    "measure": stub(lambda s, r: {"duration": 0.0 if "empty" in s else 2.0, "snr": 1.5}),
    "language": stub(lambda s, r: {"probs": {"en": 0.7, "ar": 0.3} if "english" in s else {"ar": 0.6}}),
    "non_speech": stub(lambda s, r: {"label": "laugh", "confidence": 0.9 if "loud" in s else 0.1}),
    "noise": stub(lambda s, r: {"label": "street", "confidence": 0.5}),
    "emotion": stub(lambda s, r: {"label": "calm", "confidence": 0.5}),
    "first": stub(
        lambda s, r: {
            "text": f"first in {r['lang']}",
            "segments": [{"words": [{"word": " hi ", "start": 0.0, "end": 1.0, "probability": None}]}, {"words": None}],
        }
    ),
    "second": stub(
        lambda s, r: {"text": "[0m1s2ms] she said [laugh]" if "laugh" in r["request"] else "[0m1s2ms] she said words"}
    ),
    "third": stub(lambda s, r: {"text": "third"}),
    "judge": stub(judged),
    "polish": stub(lambda s, r: {"text": "" if "words judged" not in r["request"] else "She said words, judged."}),
    "speakers": stub(lambda s, r: {"segments": ["0.0 1.0 s0", "1.0 2.0 s1"]}),
    "gender": stub(lambda s, r: {"label": "f"}),
}


def mono_speakers():
    return lambda batch: pd.DataFrame({"segments": [["0.0 19.0 s0"]] * len(batch)})


@pytest.fixture()
def folder(tmp_path):
    for name, said in (("x/a.wav", "english loud"), ("b.wav", "empty"), ("x/y/bad.mp3", "broken")):
        file = tmp_path / "audio" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(said)
    return tmp_path


def test_annotation_of_a_folder(spark, folder):
    ladder = (Attempt("full"), Attempt("mono", make=mono_speakers))
    out = str(folder / "records")
    annotate_folder(spark, str(folder / "audio"), out, MODELS, speaker_attempts=ladder, pause_s=0.0)
    got = {r.utt_id: r for r in spark.read.json(out).collect()}
    assert {r.file for r in got.values()} == {"x/a.json", "b.json", "x/y/bad.json"}
    a, b, bad = got["a"], got["b"], got["bad"]

    said = a.transcriptions
    assert (said.detected_language, said.first, said.second, said.third) == ("en", "first in en", "she said words", "third")
    assert said.second_with_label == "she said [laugh]"
    assert (said.merged, said.final) == ("she said words judged", "She said words, judged.")
    assert [tuple(w) for w in a.alignment] == [(1.0, 1.0, 0.0, "hi")]
    assert (a.speaker_info.num_speakers, a.speaker_info.gender, a.speaker_info.word_per_sec) == (2, "f", 2.0)
    assert (a.audio_classification.non_speech.label, a.audio_classification.noise.confidence) == ("laugh", 0.5)

    said = b.transcriptions
    assert (said.detected_language, said.third, said.third_status) == ("ar", None, "skipped (ar audio)")
    # not sure of the sound, no usable correction, nothing polished
    assert said.second_with_label == said.merged == said.final == "she said words"
    assert b.speaker_info.word_per_min is None

    # every model failed on it but one, and the row is still there
    assert bad.transcriptions.detected_language == "ar" and bad.transcriptions.second == ""
    assert bad.speaker_info.num_speakers == 1 and bad.speaker_info.duration is None


def test_annotation_compat_and_errors(spark, folder):
    files = scan_audio(spark, str(folder / "audio")).select("utt_id", "rel_path", "content")
    compat = {r.utt_id: r.record for r in annotate(files, MODELS, pause_s=0.0, compat=True).collect()}
    assert compat["b"].transcriptions.third == "skipped (ar audio)"
    assert compat["a"].transcriptions.merged == "she said words judged</corrected>"
    # the failed diarization has no segments and one speaker
    assert (compat["bad"].speaker_info.num_speakers, compat["bad"].speaker_info.Diarization) == (1, [])
    # all that needs the sound has run before the cut; judge and polish follow it
    staged = run_stages(files, recording_stages(MODELS, pause_s=0.0), cut_after=("gender", "third"))
    assert staged._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 2
    errors = {r.utt_id: (r.first_error, r.judge_error) for r in staged.select("utt_id", "first_error", "judge_error").collect()}
    assert errors["bad"] == ("RuntimeError: no sound", None) and errors["a"] == (None, None)


def test_fixed_language_and_no_third_system(spark, folder):
    files = scan_audio(spark, str(folder / "audio")).select("utt_id", "rel_path", "content")
    models = {name: make for name, make in MODELS.items() if name != "language"}
    made = annotate(files, models, pause_s=0.0, language="en", third_enabled=False)
    said = {r.utt_id: r.record.transcriptions for r in made.collect()}
    assert (said["b"].detected_language, said["b"].first, said["b"].third) == ("en", "first in en", "")
    assert said["b"].third_status is None


def test_evaluation_of_folders(spark, tmp_path):
    for name in ("u1", "u2", "u3"):
        for file, body in ((f"wav/{name}.wav", "x"), (f"lab/{name}.lab", "third"), (f"s/c/{name}.flac", "english")):
            (tmp_path / file).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / file).write_text(body)
    (tmp_path / "s/c/c.trans.txt").write_text("u1 THIRD\nu3 Third!\nu9 NONE\n")
    arabic = evaluate_folder(spark, str(tmp_path / "wav"), str(tmp_path / "lab"), MODELS, first=2, pause_s=0.0)
    rows = {r.system: r for r in arabic.summary.collect()}
    assert (rows["first"].n_files, rows["third"].n_scored, rows["third"].n_missing) == (2, 0, 2)
    english = evaluate_chapters(spark, str(tmp_path / "s"), MODELS, pause_s=0.0)
    rows = {r.system: r for r in english.summary.collect()}
    assert (rows["third"].n_files, rows["third"].wer, rows["second"].wer) == (2, 0.0, 300.0)
    assert evaluate_chapters(spark, str(tmp_path / "s"), MODELS, first=1, pause_s=0.0).scores.select("utt_id").distinct().count() == 1
    english.write(str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/details")).count() == 2
    # the same ids in another chapter, where other words are said
    for name in ("u1", "u2"):
        (tmp_path / "s/d").mkdir(exist_ok=True)
        (tmp_path / f"s/d/{name}.flac").write_text("english")
    (tmp_path / "s/d/d.trans.txt").write_text("u1 something else\nu3 THIRD\n")
    both = evaluate_chapters(spark, str(tmp_path / "s"), MODELS, pause_s=0.0)
    third = {r.utt_id: r.wer for r in both.scores.where("system = 'third'").collect()}
    assert third == {"c/u1": 0.0, "c/u3": 0.0, "d/u1": 1.0}
    (tmp_path / "lab/u2.lab").unlink()
    with pytest.raises(Exception, match="no partner for u2"):
        evaluate_folder(spark, str(tmp_path / "wav"), str(tmp_path / "lab"), MODELS, pause_s=0.0)
