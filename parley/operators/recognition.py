"""Around the recognizer: which probes and passages go in, what its output is worth, how parts are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranges
from .language import SUPPORTED

KEY = "recording_id"
#: Samples below which a probe isn't tried, and a text is doubtful; tokens of a full output.
LEAST, SHORT, TOKENS = 320, 3_200, 448
#: Silence put before and after a recording's outer edges.
PADDING = 3_200
#: Separation: shortest and longest passage, in samples.
SHORTEST, LONGEST = 16, 392_000
SILENT = ("model_non_speech", "digital_silence", "constant_signal")


def classify(probes: DataFrame) -> DataFrame:
    """(recording_id, probe_id, reason, language, review, audio_state, recognize) for probes with blocked (null, or reason:state), manual (a language or null), and the automatic decision in reason, language, review and detector_error.

    In this order: blocked audio, too short, a manual language, a failed
    detector, the decision. Only a speech probe with a language and enough
    audio is recognized.
    """
    short = F.col("end_sample") - F.col("start_sample") < LEAST
    parts = F.split("blocked", ":")
    blocked, manual = F.col("blocked").isNotNull(), F.col("manual").isNotNull()
    reason = F.when(blocked, parts[0]).when(short, "insufficient_speech").when(manual, "override").when(F.col("detector_error"), "needs_language").otherwise(F.col("reason"))
    language = F.when(blocked | short | manual, F.col("manual")).when(~F.col("detector_error"), F.col("language"))
    review = F.when(blocked | short, True).when(manual, False).when(F.col("detector_error"), True).otherwise(F.col("review"))
    state = F.when(blocked, parts[1]).when(short, "insufficient_acoustic_context")
    out = probes.select(KEY, "probe_id", reason.alias("reason"), language.alias("language"), review.alias("review"), state.alias("audio_state"), blocked.alias("b"))
    return out.withColumn("recognize", F.col("language").isNotNull() & ~F.col("b") & (F.col("reason") != "insufficient_speech")).drop("b")


def output_review(text: Column, tokens: Column, samples: Column) -> Column:
    """(reason, partial_text, decoder_reason) of an output that needs review; null for a good one."""
    full = tokens >= TOKENS
    said = lambda reason, partial, decoder: F.struct(F.lit(reason).alias("reason"), partial.alias("partial_text"), decoder.alias("decoder_reason"))
    none = F.lit(None).cast("string")
    return F.when((text != "") & (samples < SHORT), said("short_acoustic_context", full, F.when(full, "token_limit"))).when(full, said("token_limit", F.lit(True), none)).when(text == "", said("empty_result", F.lit(False), none))


def complete(review: Column) -> Column:
    """Is a transcription whole: no review, or a harmless reason without partial text or a full decoder? ``review`` as from output_review."""
    harmless = review["reason"].isin("short_acoustic_context", "possible_non_speech")
    return review.isNull() | F.coalesce(harmless & ~F.coalesce(review["partial_text"], F.lit(False)) & ~review["decoder_reason"].eqNullSafe("token_limit"), F.lit(False))


def padded(parts: DataFrame) -> DataFrame:
    """leading and trailing silence of each part (start_sample, end_sample, length of its audio): at outer edges only."""
    return parts.select("*", F.when(F.col("start_sample") == 0, PADDING).otherwise(0).alias("leading"), F.when(F.col("end_sample") == F.col("length"), PADDING).otherwise(0).alias("trailing"))


def _ordered(*fields: str) -> Column:
    return F.array_sort(F.collect_list(F.struct("start_sample", "end_sample", *fields)))


def routed(parts: DataFrame, spans: DataFrame) -> DataFrame:
    """(recording_id, span_id, text, hashes) where parts of one supported language join a span without a break; others give no row.

    ``parts``: recording_id, span_id, start_sample, end_sample, text,
    language, clean (complete speech evidence, no review, no audio state). A
    span needs two parts or more.
    """
    d = parts.groupBy(KEY, "span_id").agg(_ordered("text", "language", "clean").alias("parts")).join(spans.select(KEY, "span_id", F.col("start_sample").alias("low"), F.col("end_sample").alias("high")), [KEY, "span_id"])
    fits = F.expr("""aggregate(parts, named_struct('at', low, 'ok', size(parts) >= 2),
      (s, p) -> named_struct('at', p.end_sample, 'ok', s.ok AND coalesce(p.start_sample = s.at AND p.start_sample < p.end_sample AND trim(p.text) <> '' AND p.language = parts[0].language AND p.clean, false)), s -> s.ok AND s.at = high)""")
    d = d.where(fits & F.col("parts")[0]["language"].isin(*SUPPORTED))
    text, hashes = F.transform("parts", lambda p: p["text"]), F.transform("parts", lambda p: F.sha2(p["text"], 256))
    return d.select(KEY, "span_id", F.array_join(text, " ").alias("text"), F.array_join(hashes, ",").alias("hashes"))


def retry_candidates(parts: DataFrame) -> DataFrame:
    """(recording_id, span_id, text, review, reason, partial) of decoded parts in order, for a span that is tried again.

    ``parts``: start_sample, end_sample, text, review, reason, partial_text,
    audio_state. Texts with words are joined; review if any part has it; the
    first reason is kept, with partial set if any part is partial or
    unexpectedly empty.
    """
    d = parts.groupBy(KEY, "span_id").agg(_ordered("text", "review", "reason", "partial_text", "audio_state").alias("parts"))
    blank = lambda p: F.trim(p["text"]) == ""
    text = F.array_join(F.transform(F.filter("parts", lambda p: ~blank(p)), lambda p: p["text"]), " ")
    reasons = F.filter("parts", lambda p: p["reason"].isNotNull())
    partial = F.exists(reasons, lambda p: F.coalesce(p["partial_text"], F.lit(False))) | F.exists("parts", lambda p: blank(p) & ~F.coalesce(p["audio_state"].isin(*SILENT), F.lit(False)))
    return d.select(KEY, "span_id", text.alias("text"), F.exists("parts", lambda p: p["review"]).alias("review"), F.get(reasons, F.lit(0))["reason"].alias("reason"), F.when(F.size(reasons) > 0, partial).alias("partial"))


def separable(passages: DataFrame, turns: DataFrame, epochs: DataFrame) -> DataFrame:
    """(recording_id, span_id): passages that two voices share and that can be taken apart.

    ``passages``: start_sample, end_sample, separated; ``turns``: what each
    speaker was heard to say; ``epochs``: recording_id, start_sample of
    language settings. A passage lasts 16 samples to 24.5 s, holds exactly two
    tracks that speak at once somewhere, and no setting begins inside it.
    """
    size = F.col("end_sample") - F.col("start_sample")
    fit = passages.where(~F.col("separated") & size.between(SHORTEST, LONGEST)).select(KEY, "span_id", "start_sample", "end_sample")
    inside = ranges.clipped(turns, fit)
    # Two tracks overlap if, in order of start, one begins before the latest end of the other.
    who = inside.groupBy(KEY, "span_id").agg(F.min("speaker").alias("one"), F.max("speaker").alias("two"), F.countDistinct("speaker").alias("n")).where("n = 2")
    step = F.expr("""aggregate(array_sort(spoken), named_struct('a', -1L, 'b', -1L, 'both', false), (s, t) -> CASE WHEN t.speaker = one
        THEN named_struct('a', greatest(s.a, t.end_sample), 'b', s.b, 'both', s.both OR t.start_sample < s.b)
        ELSE named_struct('a', s.a, 'b', greatest(s.b, t.end_sample), 'both', s.both OR t.start_sample < s.a) END, s -> s.both)""")
    spoken = inside.join(who, [KEY, "span_id"]).groupBy(KEY, "span_id", "one").agg(F.collect_list(F.struct("start_sample", "end_sample", "speaker")).alias("spoken")).where(step)
    edges = epochs.select(KEY, F.col("start_sample").alias("at"), F.lit("epoch").alias("speaker"))
    split = ranges.clipped(edges.select(KEY, "speaker", F.col("at").alias("start_sample"), (F.col("at") + 1).alias("end_sample")), fit.withColumn("start_sample", F.col("start_sample") + 1))
    return spoken.select(KEY, "span_id").join(split.select(KEY, "span_id"), [KEY, "span_id"], "left_anti")
