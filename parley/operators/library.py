"""Recordings, people, edits and audio notices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def library(recordings: DataFrame) -> DataFrame:
    """The list of recordings without their documents."""
    return recordings.select("recording_id", "name", "kind", "status", F.to_date("created").alias("day"), "revision", "duration_s")


def status_counts(recordings: DataFrame) -> DataFrame:
    return recordings.groupBy("status").agg(F.count("*").alias("n"))


def day_groups(recordings: DataFrame) -> DataFrame:
    """Whether a recording starts a new day in the list, newest first: it is the last one of its day."""
    dated = recordings.select("recording_id", F.to_date("created").alias("day"))
    last = dated.groupBy(F.col("day").alias("_day")).agg(F.max("recording_id").alias("_last"))
    return dated.join(last, F.col("day").eqNullSafe(F.col("_day"))).select("recording_id", "day", (F.col("recording_id") == F.col("_last")).alias("heading"))


def name_search(recordings: DataFrame, words: str) -> DataFrame:
    return recordings.where(F.contains(F.lower("name"), F.lit(words.lower()))).select("recording_id", "name")


def people_with_profiles(people: DataFrame, model: str) -> DataFrame:
    """Each person with the state of their voice profile under the running model."""
    profiles = people.where("has_profile").select("person_id", F.col("model_id").alias("profile_model"))
    state = F.when(F.col("profile_model").isNull(), "none").when(F.col("profile_model") == model, "compatible").otherwise("incompatible_runtime")
    return people.select("person_id", "name").join(profiles, "person_id", "left").select("person_id", "name", state.alias("state"))


def guarded_edits(edits: DataFrame, passages: DataFrame) -> DataFrame:
    """Edits of known passages: applied if the given revision is the stored one, conflict if not, refused for other fields."""
    stored = passages.select("recording_id", "pos", F.pmod(F.col("recording_id") + F.col("pos"), F.lit(4)).cast("long").alias("revision"))
    outcome = F.when(~F.col("field").isin("text", "speaker", "start", "end"), "refused").when(F.col("given_revision") == F.col("revision"), "applied").otherwise("conflict")
    return edits.join(stored, ["recording_id", "pos"]).select("edit_id", "recording_id", "pos", "field", outcome.alias("outcome"))


def protected_fields(edits: DataFrame, passages: DataFrame) -> DataFrame:
    """Fields protected by applied edits, sorted, and the revision after them."""
    done = guarded_edits(edits, passages).where("outcome = 'applied'")
    return done.groupBy("recording_id", "pos").agg(F.array_join(F.array_sort(F.collect_set("field")), ",").alias("protected"), F.count("*").alias("edits"))


def coalesced_notices(notices: DataFrame) -> DataFrame:
    """On-time notices of a recording: neighbours of one language epoch merge into contiguous ranges."""
    on_time = notices.where("NOT late")
    w = Window.partitionBy("recording_id").orderBy("start_sample")
    goes_on = (F.lag(F.col("start_sample") + F.col("frames")).over(w) == F.col("start_sample")) & (F.lag("language_epoch").over(w) == F.col("language_epoch"))
    part = on_time.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("part", F.sum("new").over(w))
    return part.groupBy("recording_id", "language_epoch", "part").agg(F.min("start_sample").alias("start_sample"), F.max(F.col("start_sample") + F.col("frames")).alias("end_sample"), F.count("*").alias("notices")).drop("part")
