"""Annotation of recordings: models as stages, then one nested record per recording."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.functions.text import extract_tagged, prompt_by_language, strip_time_tags
from voxframe.functions.tokens import argmax_map, parse_segments, word_timings
from voxframe.operators.inference import FULL, Attempt, Call, Predictor, infer_group
from voxframe.operators.records import (
    DEFAULT_LANG,
    annotated_record,
    first_usable,
    label_is_sure,
    labelled_variant,
    third_system_wanted,
)
from voxframe.session import cut_lineage
from voxframe.sources.files import packed, scan_audio
from voxframe.sources.sinks import write_records

# Request texts; callers may hand in their own.
CORRECTION_PROMPTS = {
    "ar": "صحح الأخطاء الواضحة في النص بالاستعانة بالمرجع.\nالنص: {base}\nالمرجع: {first}\n<مصحح>",
    "": "Correct only clear mistakes of the text with the help of the references.\n"
    "Text: {base}\nReference 1: {first}\nReference 2: {third}\n<corrected>",
}
TRANSCRIPTION_PROMPTS = {
    "en": "Write down the English speech word by word, as plain text.",
    "": "اكتب الكلام العربي كلمة كلمة، نصا فقط.",
}
LABELLED_PROMPTS = {
    "en": "Write down the English speech word by word and mark sounds in brackets, such as [{label}].",
    "": "اكتب الكلام العربي كلمة كلمة وضع الأصوات بين قوسين مثل [{label}].",
}
POLISH_PROMPTS = {
    "ar": "أصلح الإملاء والترقيم دون تغيير المحتوى.\n{text}",
    "": "Fix spelling and punctuation without changing the content.\n{text}",
}


def request(prompts: Mapping[str, str], lang: Column, fields: Mapping[str, Column]) -> Column:
    """The request of the row's language; the entry ``''`` serves all others."""
    named = {code: text for code, text in prompts.items() if code}
    return prompt_by_language(named, prompts[""], lang, fields)


@dataclass(frozen=True)
class Stage:
    """One model call and how it is tried.

    ``inputs`` maps what the model calls its inputs to columns, ``outputs`` what it returns to
    columns with their types. ``before`` adds columns the call needs; ``only`` is the condition
    for rows that are sent at all. Stages with the same ``together`` run where the first of them stands, in one worker
    that gets the columns they share once; what any of them needs must be there before all of them.
    """

    name: str
    make: Callable[[], Predictor]
    inputs: Mapping[str, str]
    outputs: Mapping[str, tuple[str, str]]
    before: Callable[[DataFrame], DataFrame] | None = None
    only: Column | None = None
    attempts: Sequence[Attempt] = (FULL,)
    default: dict = field(default_factory=dict)
    batch_size: int = 16
    min_interval_s: float = 0.0
    together: str | None = None


def _renaming(make: Callable[[], Predictor], stage: Stage) -> Callable[[], Predictor]:
    """The predictor between the table's column names and the model's own."""
    given = dict(stage.inputs)
    returned = {theirs: column for theirs, (column, _) in stage.outputs.items()}

    def built() -> Predictor:
        model = make()
        return lambda batch: model(
            batch.set_axis(list(given.values()), axis=1).rename(columns={c: theirs for theirs, c in given.items()})
        ).rename(columns=returned)

    return built


def run_stages(
    df: DataFrame, stages: Sequence[Stage], cut_after: Collection[str] = (), files: Mapping[str, str] | None = None
) -> DataFrame:
    """Stages one after the other; each leaves its error under ``<name>_error``. For ``files`` see ``infer_group``.

    Stages run in one pass over the rows, each group with a worker of its own per task. ``cut_after``
    names stages after whose group the table is written to the shared folder: models before and after
    are then never loaded together, and a lost executor costs no finished calls.
    """
    groups: dict[str, list[Stage]] = {}
    for s in stages:
        groups.setdefault(s.together or f"alone {s.name}", []).append(s)
    for group in groups.values():
        columns = df.columns
        for s in group:
            if s.before:
                df = s.before(df)
        kept = list(dict.fromkeys([*columns, *df.columns]))
        for s in group:
            if s.only is not None:
                df = df.withColumn(f"_sent_{s.name}", s.only)
        calls = [
            Call(
                s.name,
                _renaming(s.make, s),
                list(s.inputs.values()),
                ", ".join(f"`{column}` {kind}" for column, kind in s.outputs.values()),
                s.batch_size,
                [replace(a, make=_renaming(a.make, s)) if a.make else a for a in s.attempts],
                s.default,
                min_interval_s=s.min_interval_s,
                only=f"_sent_{s.name}" if s.only is not None else None,
            )
            for s in group
        ]
        made = [c for s in group for c in [*[column for column, _ in s.outputs.values()], f"{s.name}_error"]]
        df = infer_group(df, calls, files).select(*kept, *made)
        if any(s.name in cut_after for s in group):
            df = cut_lineage(df)
    return df


def with_language(df: DataFrame, probs: str = "language_probs", out: str = "lang") -> DataFrame:
    """Most likely language, or the assumed one where detection gave nothing."""
    return df.withColumn(out, F.coalesce(argmax_map(F.col(probs)), F.lit(DEFAULT_LANG)))


def with_second(df: DataFrame) -> DataFrame:
    """The second system's text without time stamps, its labelled variant where the label is sure."""
    plain = strip_time_tags(F.col("second"))
    return df.withColumn("second", plain).withColumn(
        "second_labelled",
        labelled_variant(
            strip_time_tags(F.col("second_labelled")),
            F.col("second"),
            F.col("non_speech_label"),
            F.col("non_speech_confidence"),
        ),
    )


def with_merged(df: DataFrame, compat: bool = False) -> DataFrame:
    """The judge's text from its ``reply``, or the second system's."""
    cut = F.coalesce(F.col("truncated"), F.lit(False))
    return df.withColumn("merged", extract_tagged(F.col("reply"), F.col("second"), F.col("lang"), cut, compat))


def with_final(df: DataFrame) -> DataFrame:
    """The polished text, or the merged one."""
    return df.withColumn("final", first_usable(F.col("polished"), F.col("merged")))


WORDS = "array<struct<words:array<struct<word:string,start:double,end:double,probability:double>>>>"
# Taggers of a recording, seconds to wait after a call of the second system.
TAGGERS = ("non_speech", "noise", "emotion")
PAUSE_S = 7.0


def recording_stages(
    models: Mapping[str, Callable[[], Predictor]],
    speaker_attempts: Sequence[Attempt] = (FULL,),
    pause_s: float = PAUSE_S,
    compat: bool = False,
    language: str | None = None,
    third_enabled: bool | None = None,
) -> list[Stage]:
    """All calls for one recording, in order, over ``content`` (bytes).

    A fixed ``language`` is not detected; ``third_enabled=False`` switches the third system off.

    ``models`` names the makers: ``measure`` (to ``duration``, ``snr``), ``language`` (to
    ``probs``), the taggers (to ``label``, ``confidence``), ``first`` (from ``lang``; to ``text``,
    ``segments``), ``second`` (from ``request``; to ``text``) for plain and labelled transcripts,
    ``third`` (to ``text``), ``judge`` (from ``request``; to ``text``, ``truncated``), ``polish``
    (from ``request``; to ``text``), ``speakers`` (to ``segments``) and ``gender`` (to ``label``).
    """
    audio, lang = {"content": "content"}, F.col("lang")

    def fixed(df: DataFrame) -> DataFrame:
        return df.withColumn("lang", F.lit(language))

    def asking(prompts: Mapping[str, str], out: str = "request", **fields: str) -> Callable[[DataFrame], DataFrame]:
        return lambda df: df.withColumn(out, request(prompts, lang, {k: F.col(c) for k, c in fields.items()}))

    def judging(df: DataFrame) -> DataFrame:
        return asking(CORRECTION_PROMPTS, base="second", first="first", third="third")(with_second(df))

    def polishing(df: DataFrame) -> DataFrame:
        return asking(POLISH_PROMPTS, text="merged")(with_merged(df, compat))

    label, sure = F.col("non_speech_label"), F.col("non_speech_confidence")
    asked = {"request": "request"}
    return [
        # those that need the sound alone
        Stage(
            "measure", models["measure"], audio, {"duration": ("duration", "double"), "snr": ("snr", "double")}, together="sound"
        ),
        *(
            []
            if language
            else [
                Stage("language", models["language"], audio, {"probs": ("language_probs", "map<string,double>")}, together="sound")
            ]
        ),
        *[
            Stage(
                t,
                models[t],
                audio,
                {"label": (f"{t}_label", "string"), "confidence": (f"{t}_confidence", "double")},
                together="sound",
            )
            for t in TAGGERS
        ],
        Stage(
            "speakers",
            models["speakers"],
            audio,
            {"segments": ("speech_segments", "array<string>")},
            attempts=speaker_attempts,
            together="sound",
        ),
        Stage("gender", models["gender"], audio, {"label": ("gender", "string")}, together="sound"),
        # those that need language and label, too
        Stage(
            "first",
            models["first"],
            {**audio, "lang": "lang"},
            {"text": ("first", "string"), "segments": ("segments", WORDS)},
            before=fixed if language else with_language,
            together="speech",
        ),
        Stage(
            "second",
            models["second"],
            {**audio, "request": "request_second"},
            {"text": ("second", "string")},
            before=asking(TRANSCRIPTION_PROMPTS, "request_second"),
            default={"second": ""},
            min_interval_s=pause_s,
            together="speech",
        ),
        Stage(
            "labelled",
            models["second"],
            {**audio, "request": "request_labelled"},
            {"text": ("second_labelled", "string")},
            before=asking(LABELLED_PROMPTS, "request_labelled", label="non_speech_label"),
            only=label_is_sure(label, sure),
            default={"second_labelled": ""},
            min_interval_s=pause_s,
            together="speech",
        ),
        Stage(
            "third",
            models["third"],
            audio,
            {"text": ("third", "string")},
            only=third_system_wanted(lang, third_enabled),
            together="speech",
        ),
        Stage(
            "judge",
            models["judge"],
            asked,
            {"text": ("reply", "string"), "truncated": ("truncated", "boolean")},
            before=judging,
        ),
        Stage("polish", models["polish"], asked, {"text": ("polished", "string")}, before=polishing),
    ]


def to_record(df: DataFrame, taggers: Sequence[str] = TAGGERS, compat: bool = False) -> DataFrame:
    """Adds ``record`` to rows with the columns of ``recording_stages`` and the settled transcripts."""
    record = annotated_record(
        {t: (F.col(f"{t}_label"), F.col(f"{t}_confidence")) for t in taggers},
        F.col("lang"),
        F.col("first"),
        F.col("second"),
        F.col("third"),
        F.col("merged"),
        F.col("second_labelled"),
        F.col("final"),
        word_timings(F.col("segments")),
        F.col("snr"),
        parse_segments(F.col("speech_segments")),
        F.col("gender"),
        F.col("duration"),
        compat=compat,
    )
    return df.withColumn("record", record)


def annotate(
    recordings: DataFrame,
    models: Mapping[str, Callable[[], Predictor]],
    speaker_attempts: Sequence[Attempt] = (FULL,),
    pause_s: float = PAUSE_S,
    compat: bool = False,
    language: str | None = None,
    third_enabled: bool | None = None,
    cut_after: Collection[str] = (),
) -> DataFrame:
    """Recordings (``utt_id, rel_path, content``) through all models to ``(utt_id, rel_path, record)``.

    With ``path`` in place of ``content`` the workers of the models read the files.
    """
    stages = recording_stages(models, speaker_attempts, pause_s, compat, language, third_enabled)
    done = run_stages(recordings, stages, cut_after, None if "content" in recordings.columns else {"content": "path"})
    return to_record(with_final(done), compat=compat).select("utt_id", "rel_path", "record")


def annotate_folder(
    spark: SparkSession, audio: str, out: str, models: Mapping[str, Callable[[], Predictor]], **options
) -> None:
    """Annotate the audio files of a folder and write their records below the same folders."""
    files = packed(scan_audio(spark, audio)).select("utt_id", "rel_path", "content")
    write_annotations(annotate(files, models, **options), out)


def write_annotations(records: DataFrame, path: str) -> None:
    write_records(records.select("utt_id", "rel_path", "record.*"), path)
