"""Publishing into documents: which refined passages, import rows and live rows are taken, and why others aren't.

Everything here is a batch of candidates against the rows that stand. The
outcome is a column, so nothing is lost silently; ``streaming.publish`` runs
it once a micro-batch, so that a batch that comes twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.changes import version

KEY = ["recording_id", "passage_id"]
#: What a refined passage takes over unchanged.
IDENTITY = ("start_sample", "end_sample", "speaker", "capture_source", "audio_revision", "utterance_id", "language_epoch", "language_generation", "language_mode", "canonical_state")
#: What a row's version is made of: a candidate is stale once one of these changed.
VERSIONED = ("start_sample", "end_sample", "speaker", "text", "language", "audio_revision", "machine_revision", "language_epoch", "capture_source", "protected", "refinement_state")
#: Reasons that make a transcription incomplete (fixed values).
INCOMPLETE = ("token_limit", "transcription_failed", "empty_result")


def passage_version() -> Column:
    return version(*VERSIONED)


def free() -> Column:
    return F.coalesce(F.col("protected"), F.lit("")) == ""


def context_current(candidates: DataFrame, rows: DataFrame) -> DataFrame:
    """(recording_id, passage_id) of the candidates whose borrowed context no longer holds.

    A candidate's witnesses are an array of (passage_id, version); each must
    stand in ``rows`` with that version. Candidates without witnesses borrow
    nothing.
    """
    named = candidates.select(*KEY, F.explode("witnesses").alias("w")).select(*KEY, F.col("w.passage_id").alias("_of"), F.col("w.version").alias("_version"))
    standing = rows.select("recording_id", F.col("passage_id").alias("_of"), passage_version().alias("_version"))
    return named.join(standing, ["recording_id", "_of", "_version"], "left_anti").select(*KEY).distinct()


def refinements(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """(recording_id, passage_id, outcome) of refined candidates, at most one a passage; outcome is one of

    missing (no such row), context (a witness changed), protected, stale (the
    row isn't the version that the candidate was made from), invalid (identity
    changed, revisions not one higher, row not sealed or without utterance, no
    text, or incomplete), or published.

    candidates: IDENTITY, text, machine_revision, canonical_revision,
    review_code, of_version, witnesses.
    """
    broken = context_current(candidates, rows).withColumn("_broken", F.lit(True))
    now = rows.withColumn("_version", passage_version())
    a, b = candidates.alias("c"), now.alias("r")
    joined = a.join(b, KEY, "left").join(broken, KEY, "left")
    same = F.lit(True)
    for c in IDENTITY:
        same = same & F.col(f"c.{c}").eqNullSafe(F.col(f"r.{c}"))
    machine = F.coalesce(F.col("r.machine_revision"), F.lit(0))
    canonical = F.coalesce(F.col("r.canonical_revision"), machine)
    sound = same & (F.col("r.start_sample") >= 0) & (F.col("r.start_sample") < F.col("r.end_sample")) & F.col("r.utterance_id").isNotNull() & F.col("r.canonical_state").eqNullSafe(F.lit("sealed"))
    sound = sound & F.col("c.machine_revision").eqNullSafe(machine + 1) & F.col("c.canonical_revision").eqNullSafe(canonical + 1)
    sound = sound & F.coalesce(F.col("c.text").rlike(r"(?U)\S"), F.lit(False)) & ~F.coalesce(F.col("c.review_code").isin(*INCOMPLETE), F.lit(False))
    outcome = (
        F.when(F.col("_broken"), "context").when(F.col("r._version").isNull(), "missing").when(F.coalesce(F.col("r.protected"), F.lit("")) != "", "protected")
        .when(~F.col("r._version").eqNullSafe(F.col("c.of_version")), "stale").when(~sound, "invalid").otherwise("published")
    )
    return joined.select(*KEY, outcome.alias("outcome"))


def refined(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """``rows`` with the published candidates' text and revisions in place; they are final, refined, and have no pending separation."""
    done = refinements(rows, candidates).where("outcome = 'published'").select(*KEY)
    new = candidates.join(done, KEY, "left_semi").select(*KEY, F.col("text").alias("_text"), F.col("machine_revision").alias("_machine"), F.col("canonical_revision").alias("_canonical"))
    hit = F.col("_machine").isNotNull()
    set_ = {"text": F.when(hit, F.col("_text")).otherwise(F.col("text")), "machine_revision": F.coalesce("_machine", "machine_revision"), "canonical_revision": F.coalesce("_canonical", "canonical_revision"), "refinement_state": F.when(hit, "refined").otherwise(F.col("refinement_state")), "finalized": hit | F.col("finalized")}
    return rows.join(new, KEY, "left").withColumns(set_).drop("_text", "_machine", "_canonical")


def imports(rows: DataFrame, checkpoints: DataFrame, proposed: DataFrame) -> DataFrame:
    """``proposed`` import rows (source_sha256, plan_sha256, next_work, witnesses and what a row has) with outcome.

    superseded: the recording's checkpoint is of another source or plan, or
    already further. context: a witness changed, which holds back the whole
    step of its recording, so that the cursor doesn't pass it. kept: the row
    is there already and stays as it is, edits included. inserted: new.
    """
    broken = context_current(proposed.join(rows.select(*KEY), KEY, "left_anti"), rows).select("recording_id").distinct().withColumn("_broken", F.lit(True))
    at = checkpoints.select("recording_id", F.col("source_sha256").alias("_source"), F.col("plan_sha256").alias("_plan"), F.col("next_work").alias("_next"))
    joined = proposed.join(at, "recording_id", "left").join(broken, "recording_id", "left").join(rows.select(*KEY, F.lit(True).alias("_there")), KEY, "left")
    other = F.col("_next").isNotNull() & ~(F.col("_source").eqNullSafe(F.col("source_sha256")) & F.col("_plan").eqNullSafe(F.col("plan_sha256")) & (F.col("_next") <= F.col("next_work")))
    outcome = F.when(other, "superseded").when(F.col("_broken"), "context").when(F.col("_there"), "kept").otherwise("inserted")
    return joined.withColumn("outcome", outcome).drop("_source", "_plan", "_next", "_broken", "_there")


def moved_on(checkpoints: DataFrame, judged: DataFrame) -> DataFrame:
    """Checkpoints after ``imports``: a recording whose step was taken points behind it."""
    taken = judged.where("outcome IN ('kept', 'inserted')").groupBy("recording_id", "source_sha256", "plan_sha256").agg(F.max("next_work").alias("next_work"))
    return checkpoints.join(taken.select("recording_id"), "recording_id", "left_anti").select(*taken.columns).unionByName(taken)


def live_outcomes(recordings: DataFrame, rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """(recording_id, passage_id, outcome) of live candidates, at most one a passage; outcome is one of

    superseded (the recording's stream generation is another, or it is gone),
    retry (its language context changed, and the row is still the stream's),
    lost (the same, but the row is no longer the stream's), split (accepted
    voices stand in its place), sealed (an edited row ends before it: the row
    stays and is sealed there), or published.

    recordings: stream_generation, context_generation. candidates:
    stream_generation, context_generation (null: nothing borrowed),
    utterance_id, start_sample, end_sample, capture_source, language_epoch,
    audio_revision. rows also: original (of a separated row), protected,
    refinement_state.
    """
    now = recordings.select("recording_id", F.col("stream_generation").alias("_stream"), F.col("context_generation").alias("_context"))
    voices = rows.where("original IS NOT NULL").select("recording_id", F.col("original").alias("passage_id")).distinct().withColumn("_split", F.lit(True))
    own = ("utterance_id", "start_sample", "end_sample", "capture_source", "language_epoch", "audio_revision", "protected", "refinement_state")
    prior = rows.select(*KEY, F.lit(True).alias("_there"), *(F.col(c).alias(f"_{c}") for c in own))
    joined = candidates.join(now, "recording_id", "left").join(voices, KEY, "left").join(prior, KEY, "left")
    edited = F.coalesce(F.col("_protected"), F.lit("")) != ""
    same = ~edited & ~(F.col("_refinement_state").eqNullSafe(F.lit("refined")) & F.col("_audio_revision").eqNullSafe(F.col("audio_revision")))
    for c in ("utterance_id", "start_sample", "capture_source", "language_epoch"):
        same = same & F.col(f"_{c}").eqNullSafe(F.col(c))
    moved = F.col("context_generation").isNotNull() & ~F.col("context_generation").eqNullSafe(F.col("_context"))
    outcome = (
        F.when(~F.coalesce(F.col("stream_generation") == F.col("_stream"), F.lit(False)), "superseded")
        .when(moved, F.when(F.col("_there").isNull() | same, "retry").otherwise("lost"))
        .when(F.col("_split"), "split")
        .when(edited & (F.col("_end_sample") < F.col("end_sample")), "sealed")
        .otherwise("published")
    )
    return joined.select(*KEY, outcome.alias("outcome"))


def one_each(candidates: DataFrame) -> DataFrame:
    """At most one candidate a passage: of several the one of the highest revision, then the smallest text."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("machine_revision"), "text")
    return candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
