"""Names of tracks: voice checks, suggestions, assignments to people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .identity import PEOPLE

TRACK = ["recording_id", "speaker"]


def unnamed(label: Column) -> Column:
    """Does a track still show its number in place of a name?"""
    return label.rlike(r"^Speaker \d+$")


def scheduled_versions(profiles: DataFrame, model: str) -> str:
    """person:version of the model's profiles, sorted and comma-joined. A library holds PEOPLE of them at most; more are an error."""
    rows = profiles.where(F.col("model_id") == model).select("person_id", "version").distinct().limit(PEOPLE + 1).collect()
    if len(rows) > PEOPLE:
        raise ValueError(f"more than {PEOPLE} profiles")
    return ",".join(sorted(f"{r.person_id}:{r.version}" for r in rows))


def plan(speakers: DataFrame, assignments: DataFrame, checks: DataFrame, clips: DataFrame, versions: str) -> DataFrame:
    """(recording_id, speaker, clips, versions): tracks to check, which have a number for a name, no person, no check so far, and chosen clips.

    Nothing is planned without a compatible profile (``versions`` empty).
    """
    out = speakers.where(unnamed(F.col("name")) & F.lit(versions != ""))
    out = out.join(assignments, TRACK, "left_anti").join(checks, TRACK, "left_anti")
    return out.join(clips.select(*TRACK, "clips"), TRACK).where("clips <> ''").select(*TRACK, "clips", F.lit(versions).alias("versions"))


def outcomes(planned: DataFrame, results: DataFrame, speakers: DataFrame, assignments: DataFrame, clips: DataFrame, versions: str) -> DataFrame:
    """(recording_id, speaker, status, person_id) of planned checks (clips, versions) by results (failed, person_id).

    cancelled if the clips, the profiles, the label or the assignment have
    changed since; unavailable on failure; matched with a person; else unknown.
    """
    now = speakers.select(*TRACK, unnamed(F.col("name")).alias("open")).join(assignments.select(*TRACK, F.lit(True).alias("taken")), TRACK, "left").join(clips.select(*TRACK, F.col("clips").alias("current")), TRACK, "left")
    d = planned.join(results, TRACK).join(now, TRACK, "left")
    same = F.coalesce(F.col("open") & F.col("taken").isNull() & (F.col("clips") == F.col("current")) & (F.col("versions") == versions), F.lit(False))
    status = F.when(~same, "cancelled").when(F.col("failed"), "unavailable").when(F.col("person_id").isNotNull(), "matched").otherwise("unknown")
    return d.select(*TRACK, status.alias("status"), F.when(status == "matched", F.col("person_id")).alias("person_id"))


def suggestions(introductions: DataFrame, voices: DataFrame, people: DataFrame, assignments: DataFrame, dismissed: DataFrame, model: str) -> DataFrame:
    """(recording_id, speaker, kind, name): introductions (id, name), then voice suggestions (id, person_id, version, model_id) of tracks without one.

    Dismissed ids (recording_id, id) are left out of both. A voice suggestion
    also needs its person, that person's current profile version, the current
    model, and a track that nobody is assigned to.
    """
    by_id = ["recording_id", "id"]
    heard = introductions.join(dismissed, by_id, "left_anti")
    known = people.select("person_id", F.col("name").alias("called"), "version")
    own = voices.where(F.col("model_id") == model).join(known, ["person_id", "version"]).join(heard, TRACK, "left_anti").join(assignments, TRACK, "left_anti").join(dismissed, by_id, "left_anti")
    return heard.select(*TRACK, F.lit("introduction").alias("kind"), "name").unionByName(own.select(*TRACK, F.lit("voice").alias("kind"), F.col("called").alias("name")))


def kept_assignments(assignments: DataFrame, speakers: DataFrame, imported: DataFrame) -> DataFrame:
    """Assignments whose track still shows the name; recordings that were imported anew (recording_id) lose all."""
    return assignments.join(speakers.select(*TRACK, "name"), [*TRACK, "name"], "left_semi").join(imported, "recording_id", "left_anti")


def settled_checks(checks: DataFrame, only_automatic: bool = False) -> DataFrame:
    """Open checks become cancelled; with ``only_automatic`` those that somebody asked for go on."""
    stops = (F.col("status") == "checking") & (~F.coalesce(F.col("manual"), F.lit(False)) if only_automatic else F.lit(True))
    return checks.withColumn("status", F.when(stops, "cancelled").otherwise(F.col("status")))


def named_everywhere(confirmed: DataFrame, assignments: DataFrame, speakers: DataFrame) -> DataFrame:
    """(recording_id, speaker, name): tracks that a confirmation (speaker, name, all_tracks) renames.

    With all_tracks those are all tracks of the recording that are assigned to
    the same person and still show the assigned name; none if the track has no person.
    """
    known = assignments.where("person_id <> ''").select(*TRACK, "person_id")
    held = kept_assignments(assignments, speakers, assignments.limit(0).select("recording_id")).select("recording_id", "person_id", F.col("speaker").alias("other"))
    wide = confirmed.where("all_tracks").join(known, TRACK).join(held, ["recording_id", "person_id"]).select("recording_id", F.col("other").alias("speaker"), F.col("name"))
    return confirmed.where("NOT all_tracks").select(*TRACK, "name").unionByName(wide)


def visible(speakers: DataFrame, assignments: DataFrame) -> DataFrame:
    """(recording_id, identity, speaker, name): one row a person whose assigned name is shown, else a track; the first track stands for a person."""
    held = assignments.select(*TRACK, "person_id", F.col("name").alias("given"))
    own = F.when((F.col("given") == F.col("name")) & (F.col("person_id") != ""), F.concat(F.lit("person:"), "person_id")).otherwise(F.concat(F.lit("track:"), "speaker"))
    d = speakers.join(held, TRACK, "left").select("recording_id", own.alias("identity"), "speaker", "name")
    first = Window.partitionBy("recording_id", "identity").orderBy("speaker")
    return d.withColumn("place", F.row_number().over(first)).where("place = 1").drop("place")
