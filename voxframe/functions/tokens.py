"""Speech-token text, diarization segments and word timings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxframe.functions.text import WS, prompt, squeeze, strip_ws

# The text form of one speech token and of a synthesis request.
SPEECH_TOKEN = r"<\|speech_(\d+)\|>"
SYNTHESIS_PROMPT = (
    "user: Convert the text to speech:<|TEXT_PROMPT_START|>{ref_phones} {phones}"
    "<|TEXT_PROMPT_END|>\nassistant:<|SPEECH_GENERATION_START|>{codes}"
)


def speech_ids(c: Column) -> Column:
    """Ids of all speech tokens in a text, in order; null (with no token) is an error upstream."""
    found = F.regexp_extract_all(c, F.lit(SPEECH_TOKEN), F.lit(1))
    return F.when(F.size(found) > 0, F.transform(found, lambda x: x.try_cast("int")))


def speech_ids_error(c: Column) -> Column:
    """Why ``speech_ids`` is null, else null."""
    return F.when(~F.coalesce(F.rlike(c, F.lit(SPEECH_TOKEN)), F.lit(False)), F.lit("no speech tokens"))


def speech_tokens(ids: Column) -> Column:
    """Text form of an array of token ids."""
    return F.array_join(
        F.transform(ids, lambda i: F.concat(F.lit("<|speech_"), i.cast("string"), F.lit("|>"))), ""
    )


def squeeze_tokens(c: Column) -> Column:
    """Whitespace-normalised phone string."""
    return squeeze(c)


def synthesis_prompt(ref_phones: Column, phones: Column, ref_ids: Column) -> Column:
    fields = {
        "ref_phones": squeeze_tokens(ref_phones),
        "phones": squeeze_tokens(phones),
        "codes": speech_tokens(ref_ids),
    }
    return prompt(SYNTHESIS_PROMPT, fields)


def parse_segment(c: Column) -> Column:
    """``"start end speaker"`` to a struct; null unless there are exactly three parts."""
    parts = F.filter(F.split(c, f"{WS}+"), lambda p: p != "")
    return F.when(
        F.size(parts) == 3,
        F.struct(
            F.get(parts, F.lit(0)).try_cast("double").alias("start"),
            F.get(parts, F.lit(1)).try_cast("double").alias("end"),
            F.get(parts, F.lit(2)).alias("speaker"),
        ),
    )


def parse_segments(texts: Column) -> Column:
    """An array of segment texts to structs; null where any of them is malformed."""
    parsed = F.transform(texts, parse_segment)
    return F.when(F.forall(parsed, lambda s: s.isNotNull()), parsed)


def n_speakers(segments: Column) -> Column:
    """Distinct speakers of an array of segments; 1 where segmentation failed (null)."""
    found = F.size(F.array_distinct(F.transform(segments, lambda s: s["speaker"])))
    return F.when(segments.isNotNull(), found).otherwise(F.lit(1))


def word_timings(segments: Column) -> Column:
    """All words of an array of segments in order; a missing probability counts as 1."""
    spoken = F.filter(segments, lambda s: s["words"].isNotNull())

    def timing(w: Column) -> Column:
        return F.struct(
            strip_ws(w["word"]).alias("word"),
            w["start"].alias("start"),
            w["end"].alias("end"),
            F.coalesce(w["probability"], F.lit(1.0)).alias("probability"),
        )

    return F.flatten(F.transform(spoken, lambda s: F.transform(s["words"], timing)))


def speaking_rate(n: Column, seconds: Column) -> Column:
    """Words per second and per minute; null without duration."""
    length = F.nullif(seconds, F.lit(0.0))
    return F.struct((n / length).alias("word_per_sec"), (n / (length / 60)).alias("word_per_min"))


def argmax_map(m: Column) -> Column:
    """Key of the largest value; the first such entry on ties, null for an empty map."""
    entries = F.map_entries(m)
    best = F.aggregate(
        F.slice(entries, 2, F.greatest(F.size(entries) - 1, F.lit(0))),
        F.get(entries, F.lit(0)),
        lambda top, e: F.when(e["value"] > top["value"], e).otherwise(top),
    )
    return F.when(F.size(entries) > 0, best["key"])
