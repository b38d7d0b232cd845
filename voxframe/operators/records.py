"""Row-wise choices and the nested annotation record."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.functions.text import n_words, strip_ws
from voxframe.functions.tokens import n_speakers, speaking_rate

# The label of silence, the least confidence of a usable label, the language with a
# third system, the language assumed when detection fails, the note left for a skipped system.
NO_SOUND = "no_sounds"
LABEL_CONFIDENCE = 0.6
THIRD_SYSTEM_LANG = "en"
DEFAULT_LANG = "ar"
SKIPPED_NOTE = "skipped (%s audio)"
SEGMENTS = "array<struct<start:double,end:double,speaker:string>>"


def label_is_sure(label: Column, confidence: Column) -> Column:
    """Whether a sound was heard, and surely enough."""
    return (label != NO_SOUND) & (confidence > LABEL_CONFIDENCE)


def labelled_variant(labelled: Column, plain: Column, label: Column, confidence: Column) -> Column:
    """The transcript with sound labels where the label is a sound and sure enough."""
    return F.when(label_is_sure(label, confidence), labelled).otherwise(plain)


def third_system_wanted(lang: Column, enabled: bool | None = None) -> Column:
    """Whether the third system runs on a row; ``enabled=False`` switches it off everywhere."""
    return F.lit(False) if enabled is False else lang == THIRD_SYSTEM_LANG


def route_third_system(text: Column, lang: Column) -> Column:
    """Its transcript for its language, null for others (see ``skip_note``)."""
    return F.when(lang == THIRD_SYSTEM_LANG, F.coalesce(text, F.lit("")))


def skip_note(lang: Column) -> Column:
    """Status of the third system: null where it ran, else the note."""
    return F.when(lang != THIRD_SYSTEM_LANG, F.format_string(SKIPPED_NOTE, lang))


def first_usable(*candidates: Column) -> Column:
    """First candidate that is neither null nor blank."""
    return F.coalesce(*[F.when(strip_ws(c) != "", c) for c in candidates])


def split_failures(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows that worked and rows that did not."""
    return df.where(F.col(error).isNull()), df.where(F.col(error).isNotNull())


def annotated_record(
    classification: Mapping[str, tuple[Column, Column]],
    lang: Column,
    first: Column,
    second: Column,
    third: Column,
    merged: Column,
    second_labelled: Column,
    final: Column,
    alignment: Column,
    snr: Column,
    diarization: Column,
    gender: Column,
    duration: Column,
    names: tuple[str, str, str] = ("first", "second", "third"),
    compat: bool = False,
) -> Column:
    """One nested struct per recording.

    ``classification`` maps a tagger to its label and confidence; ``names`` are the three systems'
    field names. A null ``diarization`` is a failed one: no segments, one speaker. ``compat``
    writes the skip note into the third transcript instead of null.
    """
    third_text = route_third_system(third, lang)
    if compat:
        third_text = F.coalesce(third_text, skip_note(lang))
    speeds = speaking_rate(n_words(merged), duration)
    return F.struct(
        F.struct(
            *[F.struct(lb.alias("label"), cf.alias("confidence")).alias(k) for k, (lb, cf) in classification.items()]
        ).alias("audio_classification"),
        F.struct(
            lang.alias("detected_language"),
            first.alias(names[0]),
            second.alias(names[1]),
            third_text.alias(names[2]),
            skip_note(lang).alias(f"{names[2]}_status"),
            merged.alias("merged"),
            second_labelled.alias(f"{names[1]}_with_label"),
            final.alias("final"),
        ).alias("transcriptions"),
        alignment.alias("alignment"),
        snr.alias("snr"),
        F.struct(
            n_speakers(diarization).alias("num_speakers"),
            gender.alias("gender"),
            F.coalesce(diarization, F.array().cast(SEGMENTS)).alias("Diarization"),
            duration.alias("duration"),
            speeds["word_per_sec"].alias("word_per_sec"),
            speeds["word_per_min"].alias("word_per_min"),
        ).alias("speaker_info"),
    )
