"""Why a passage needs review, which passages are shown, refined or used for voices.

Passage states: recording_id, passage_id, text, speaker, start_sample,
end_sample, separated, resolution, review_code, detection_mode,
detection_reason, language, audio_state, partial, candidate, issue, state,
protected (comma-joined), deleted, canonical, sealed, timing, finalized,
n_candidates, eligible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "recording_id"
#: Reasons that are used outside the table too (fixed values).
OVERLAP = "Overlapping speakers; voices are not separated"
EMPTY = "No transcript text returned; audio retained"
UNCERTAIN = "Language uncertain; audio retained"
MULTIPLE = "Multiple speakers; see localized turns where timing is available"
SPEAKER = "Speaker uncertain"
#: Texts by reason code (fixed values).
REASONS = {
    "uncertain": UNCERTAIN,
    "needs_language": "Choose the meeting language; audio retained",
    "recent_context": "Language inferred from recent speech",
    "best_effort": "Language uncertain; best-effort transcript",
    "change_pending": "Language change uncertain; audio retained",
    "unsupported": "Detected language unsupported; audio retained",
    "insufficient_speech": "Too little usable speech; audio retained",
    "insufficient_acoustic_context": "Too little acoustic context to decode; audio retained",
    "short_acoustic_context": "Unconfirmed words from a short audio fragment; review the recording",
    "possible_non_speech": "Audio may contain no speech; model words need review",
    "overlapping_speech": OVERLAP,
    "empty_result": EMPTY,
    "transcription_failed": "Transcription failed for this passage; audio retained",
    "token_limit": "Transcript may be incomplete; audio retained",
    "unassigned_audio": "Audio outside detected speech; may be silence or missed speech",
    "refinement_incomplete": "Refinement incomplete; previous words and audio retained",
    "canonical_ownership_unresolved": "Word ownership unresolved; previous words and original audio retained",
    "speech_admission_uncertain": "Speech detection uncertain; original audio retained for review",
}
UNRESOLVED = ("uncertain", "change_pending", "needs_language", "unsupported", "mixed")


def known(code: str | Column) -> Column:
    """The text of a reason code, null for an unknown one."""
    return F.create_map(*(F.lit(x) for pair in REASONS.items() for x in pair))[F.col(code) if isinstance(code, str) else code]


def blank() -> Column:
    """No sign but white space of any kind."""
    return ~F.col("text").rlike(r"(?U)\S")


def overlaps() -> Column:
    return F.startswith("speaker", F.lit("overlap"))


def reason() -> Column:
    """The reason in exports, null if there is none."""
    reviewed = F.col("resolution").eqNullSafe(F.lit("words_reviewed"))
    automatic = F.col("detection_mode").eqNullSafe(F.lit("auto"))
    return (
        F.when(F.col("separated") & ~reviewed, "Separated voice estimate; check words and speaker")
        .when(reviewed & ~blank(), F.when(overlaps(), OVERLAP).when(F.col("speaker") == "unassigned", SPEAKER))
        .when(known("review_code").isNotNull(), known("review_code"))
        .when(F.col("speaker") == "multiple_speakers", MULTIPLE)
        .when(overlaps(), OVERLAP)
        .when(automatic & F.col("detection_reason").isin("recent_context", "best_effort"), known("detection_reason"))
        .when(automatic & (F.coalesce("language", F.lit("")) == ""), F.coalesce(known("detection_reason"), F.lit(UNCERTAIN)))
        .when(blank(), EMPTY)
        .when(F.col("speaker") == "unassigned", SPEAKER)
    )


def review(passages: DataFrame) -> DataFrame:
    """The reason for which a passage needs review, and its exported text with the marker."""
    return passages.select(KEY, "passage_id", reason().alias("reason"), marked().alias("marked"))


def marked() -> Column:
    """The text, with the reason behind it if there is one."""
    space = F.when(blank(), "").otherwise(" ")
    return F.when(reason().isNull(), F.col("text")).otherwise(F.concat("text", space, F.lit("[Needs review: "), reason(), F.lit("]")))


def refinable() -> Column:
    """Not separated, of a sealed utterance, unprotected, no coverage row, not verified as free of speech."""
    silent = F.coalesce(F.col("audio_state").isin("digital_silence", "constant_signal", "model_non_speech"), F.lit(False))
    return ~F.col("separated") & F.col("canonical") & F.col("sealed") & (F.col("protected") == "") & ~F.col("timing").eqNullSafe(F.lit("audio_coverage")) & ~silent


def protects_text() -> Column:
    return F.array_contains(F.split("protected", ","), "text")


def placeholder() -> Column:
    """No words, no partial text, and only reasons that speak of too little or no speech."""
    code, detected = F.coalesce("review_code", F.lit("")), F.coalesce("detection_reason", F.lit(""))
    state = F.coalesce("audio_state", F.lit(""))
    quiet = state.isin("digital_silence", "model_non_speech", "insufficient_speech") | (detected == "insufficient_speech") | (code == "insufficient_speech")
    return blank() & ~F.col("partial") & code.isin("", "insufficient_speech") & ~state.isin("speech_evidence_pending", "insufficient_acoustic_context") & quiet


def blocked() -> Column:
    """Shown for its language alone: a language issue, or no text and an unresolved language."""
    touched = protects_text() | F.col("state").eqNullSafe(F.lit("edited"))
    unresolved = F.coalesce(F.col("detection_reason").isin(*UNRESOLVED), F.lit(False))
    return ~touched & (F.col("issue").eqNullSafe(F.lit("language")) | (blank() & ~placeholder() & unresolved))


def shown() -> Column:
    """Not deleted, and an accuracy issue, words, a blocked language, a pending candidate or a person's edit."""
    return ~F.col("deleted") & (F.col("issue").eqNullSafe(F.lit("accuracy")) | ~blank() | blocked() | F.col("candidate") | protects_text() | F.col("state").eqNullSafe(F.lit("edited")))


def retained() -> Column:
    """Hidden, no placeholder, but with something left to review."""
    open_reason = F.coalesce(F.col("detection_reason").isin(*UNRESOLVED, "insufficient_speech"), F.lit(False))
    unresolved = F.col("state").eqNullSafe(F.lit("unresolved")) & ~F.col("detection_reason").eqNullSafe(F.lit("silence"))
    return ~F.col("deleted") & ~shown() & ~placeholder() & (F.col("review_code").isNotNull() | open_reason | unresolved)


def visibility(passages: DataFrame) -> DataFrame:
    return passages.select(KEY, "passage_id", shown().alias("shown"), blocked().alias("language_blocked"), placeholder().alias("placeholder"), retained().alias("retained"), refinable().alias("refinable"))


def voice_exclusion(track: Column) -> Column:
    """Why a passage can't give voice clips for a track; null if it can."""
    return (
        F.when(F.col("separated"), "unverified_audio")
        .when(F.col("speaker") != track, "different_speaker")
        .when(F.coalesce("audio_state", F.lit("")) != "", "unverified_audio")
        .when(~F.col("finalized"), "unfinished")
        .when(F.startswith(track, F.lit("overlap")) | (F.col("n_candidates") > 1), "overlap")
        .when((F.col("n_candidates") != 1) | ~F.col("eligible"), "unverified_audio")
    )


def voice_eligible(passages: DataFrame, track: Column) -> DataFrame:
    """The exclusion reason for a track, and whether the passage is eligible: none, and 2 to 10 s long."""
    out = passages.withColumn("why", voice_exclusion(track))
    length = F.col("end_sample") - F.col("start_sample")
    return out.select(KEY, "passage_id", F.col("why").alias("reason"), (F.col("why").isNull() & length.between(32_000, 160_000)).alias("eligible"))


def exception_counts(passages: DataFrame) -> DataFrame:
    """Per recording: shown passages, those with an issue, and whether the accuracy pass ends with exceptions."""
    out = passages.groupBy(KEY).agg(F.count_if(shown()).alias("shown"), F.count_if(F.col("issue").isNotNull()).alias("issues"), F.bool_or(refinable() & F.col("issue").isNotNull()).alias("failed"))
    return out.select(KEY, "shown", "issues", F.when(F.col("failed"), "complete_with_exceptions").otherwise("complete").alias("status"))
