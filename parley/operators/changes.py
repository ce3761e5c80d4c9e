"""Changes of passages: whole saves, merges of live candidates, repairs after late audio, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["recording_id", "passage_id"]


def version(*fields: str) -> Column:
    """A hash of the named fields: equal versions, equal fields. Null is told from the empty text."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), F.col(f).cast("string")), F.lit("-")) for f in fields)), 256)


def protected(field: str, of: str = "prior.protected") -> Column:
    return F.array_contains(F.split(F.coalesce(F.col(of), F.lit("")), ","), field)


def live_merge(prior: DataFrame, candidates: DataFrame) -> DataFrame:
    """What stands after live candidates (text, speaker, start_sample, end_sample) come in for prior rows (also protected, deleted, refined).

    Deleted and refined rows win whole. Of others, protected fields keep the
    prior value, and an empty text never replaces words. Rows without a
    counterpart stay as they are.
    """
    a, b = prior.alias("prior"), candidates.alias("new")
    keep = F.coalesce(F.col("prior.deleted") | F.col("prior.refined"), F.lit(False)) | F.col("new.speaker").isNull()
    joined = a.join(b, KEY, "full")

    def field(name: str, column: str) -> Column:
        own = F.when(F.col("prior.speaker").isNull(), F.col(f"new.{column}")).when(keep | protected(name), F.col(f"prior.{column}"))
        if name == "text":
            own = own.when((F.trim(F.col("new.text")) == "") & (F.trim(F.col("prior.text")) != ""), F.col("prior.text"))
        return own.otherwise(F.col(f"new.{column}")).alias(column)

    origin = F.when(F.col("prior.speaker").isNull(), "new").when(keep, "kept").otherwise("merged")
    return joined.select(*KEY, field("text", "text"), field("speaker", "speaker"), field("start", "start_sample"), field("end", "end_sample"), origin.alias("origin"))


def whole_save(prior: DataFrame, incoming: DataFrame, owned: list[str]) -> DataFrame:
    """A saved document: incoming rows, with the fields in ``owned`` always from the prior row, then deleted prior rows that are missing.

    provenance: imported for a row that the prior document has, manual for a new one.
    """
    before = prior.select(*KEY, *(F.col(c).alias(f"_{c}") for c in owned), F.lit(True).alias("_known"))
    rest = [c for c in incoming.columns if c not in (*KEY, *owned)]
    saved = incoming.join(before, KEY, "left").select(*KEY, *rest, *(F.col(f"_{c}").alias(c) for c in owned), F.when(F.col("_known"), "imported").otherwise("manual").alias("provenance"))
    gone = prior.where("deleted").join(incoming.select(*KEY), KEY, "left_anti").select(*KEY, *rest, *owned, F.lit("imported").alias("provenance"))
    return saved.unionByName(gone)


def current(candidates: DataFrame, passages: DataFrame) -> DataFrame:
    """Candidates whose passage still has the version that they were made for."""
    return candidates.join(passages.select(*KEY, "version"), [*KEY, "version"], "left_semi")


#: What a passage's language was judged on. Names and spelling are no part of it.
ACOUSTIC = ("start_sample", "end_sample", "capture_source", "audio_revision", "language_epoch", "language_mode", "stream_generation", "speaker_candidates", "language")


def interpretation_changed(prior: DataFrame, incoming: DataFrame) -> DataFrame:
    """Per recording: does a change touch what its language was judged on?

    Both: the ACOUSTIC columns, protected, detection_mode and detection_reason.
    It does if rows come or go, if one of ACOUSTIC differs, if the speaker
    becomes protected or free, or if a detection set by hand differs. A changed
    speaker label or text alone doesn't count.
    """
    fields = (*ACOUSTIC, "protected", "detection_mode", "detection_reason")
    a, b = prior.select(*KEY, F.struct(*fields).alias("a")), incoming.select(*KEY, F.struct(*fields).alias("b"))
    differs = detected = F.lit(False)
    for c in ACOUSTIC:
        differs = differs | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    guarded = protected("speaker", "a.protected") != protected("speaker", "b.protected")
    for c in ("detection_mode", "detection_reason"):
        detected = detected | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    manual = F.coalesce(F.col("b.detection_mode") == "manual", F.lit(False)) & detected
    changed = F.col("a").isNull() | F.col("b").isNull() | differs | guarded | manual
    return a.join(b, KEY, "full").groupBy("recording_id").agg(F.bool_or(changed).alias("changed"))


#: What was derived from a passage's samples, and goes when they are repaired.
EVIDENCE = ("detection_mode", "detection_reason", "acoustic_evidence", "activity", "alignment", "turns", "turn_receipt", "candidate_text", "separation_candidate", "resolution", "anchor", "eligible", "audio_state")


def invalidated(passages: DataFrame, repairs: DataFrame) -> DataFrame:
    """``passages`` after late audio (recording_id, repaired_from).

    Words, times, speakers and protection stay as they are. A passage that
    ends after the repaired place gets the next audio and machine revision,
    loses the columns of EVIDENCE that the table has, is sealed and final with
    the reason capture_audio_repaired, and is up for review; without protected
    fields it counts as unresolved. Of several repairs of a recording the
    earliest place counts.
    """
    first = repairs.groupBy("recording_id").agg(F.min("repaired_from").alias("_from"))
    joined = passages.join(first, "recording_id", "left")
    hit = F.coalesce(F.col("end_sample") > F.col("_from"), F.lit(False))
    free = F.coalesce(F.col("protected"), F.lit("")) == ""
    new = {c: F.when(~hit, F.col(c)) for c in EVIDENCE if c in passages.columns}
    new |= {c: F.coalesce(F.col(c), F.lit(0)).cast("long") + hit.cast("long") for c in ("audio_revision", "machine_revision")}
    new |= {"review": hit | F.col("review"), "sealed": hit | F.col("sealed"), "finalized": hit | F.col("finalized"), "unresolved": F.when(hit, "capture_audio_repaired").otherwise(F.col("unresolved")), "state": F.when(hit & free, "unresolved").otherwise(F.col("state"))}
    return joined.withColumns(new).drop("_from")


def repaired(recordings: DataFrame, repairs: DataFrame) -> DataFrame:
    """``recordings`` (stream_generation, context_generation, audio_revision, repaired_from) after late audio: the next generations and revision, and the place."""
    first = repairs.groupBy("recording_id").agg(F.min("repaired_from").alias("_from"))
    hit = F.col("_from").isNotNull()
    new = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") + hit.cast("long") for c in ("stream_generation", "context_generation", "audio_revision")}
    return recordings.join(first, "recording_id", "left").withColumns(new | {"repaired_from": F.coalesce("_from", "repaired_from")}).drop("_from")


def absent(rows: DataFrame, accepted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that weren't accepted before, by their keys: the insert of a batch that may come twice."""
    return rows.join(accepted.select(*keys).distinct(), keys, "left_anti")


def latest(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """A keyed upsert: incoming rows, and stored ones without a successor."""
    return incoming.unionByName(absent(stored, incoming, keys))


def grown(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """A checkpoint whose duration only grows (recording_id, duration_s)."""
    return stored.unionByName(incoming).groupBy("recording_id").agg(F.max("duration_s").alias("duration_s"))


def within_limit(active: DataFrame, batch: DataFrame, most: int) -> DataFrame:
    """The whole batch if it and the active rows, of whatever kind, stay within the limit, else none of it."""
    room = active.agg(F.count("*").alias("now")).crossJoin(batch.agg(F.count("*").alias("more"))).where(F.col("now") + F.col("more") <= most)
    return batch.join(F.broadcast(room.select(F.lit(True).alias("_fits"))), F.lit(True), "left_semi")


def dismissed(events: DataFrame, most: int = 256) -> DataFrame:
    """(recording_id, ids, n): the last ids dismissed, in order, comma-joined."""
    last = F.row_number().over(Window.partitionBy("recording_id").orderBy(F.desc("edit_id")))
    kept = events.withColumn("_n", last).where(F.col("_n") <= most)
    return kept.groupBy("recording_id").agg(F.array_join(F.array_sort(F.collect_list("edit_id")), ",").alias("ids"), F.count("*").alias("n"))


def split(passages: DataFrame, voices: DataFrame) -> DataFrame:
    """Passages of which those with an accepted pair of voices (recording_id, passage_id, episode, channel, text, language) become two rows.

    The pair is called episode-0 and episode-1, unassigned, up for review,
    without protected fields, and names its original. Both voices need words.
    """
    whole = voices.groupBy(*KEY, "episode").agg(F.count("*").alias("n"), F.min(F.length(F.trim("text"))).alias("least")).where("n = 2 AND least > 0")
    pair = voices.join(whole.select(*KEY, "episode"), [*KEY, "episode"], "left_semi")
    own = passages.select(*KEY, "start_sample", "end_sample", "text", "speaker", "language", F.lit(None).cast("string").alias("original"))
    rows = own.select(*KEY, "start_sample", "end_sample").join(pair, KEY)
    new = rows.select("recording_id", F.concat_ws("-", "episode", "channel").alias("passage_id"), "start_sample", "end_sample", "text", F.lit("unassigned").alias("speaker"), "language", F.col("passage_id").alias("original"))
    return own.join(pair, KEY, "left_anti").unionByName(new)


def restored(rows: DataFrame, history: DataFrame) -> DataFrame:
    """(recording_id, passage_id) of originals that can come back: both accepted rows (history: original, passage_id, version) stand unchanged in rows (version)."""
    same = history.join(rows.select(*KEY, "version"), [*KEY, "version"], "left_semi")
    return same.groupBy("recording_id", "original").agg(F.countDistinct("passage_id").alias("n")).where("n = 2").select("recording_id", F.col("original").alias("passage_id"))


def first_written(history: DataFrame, replaced: DataFrame) -> DataFrame:
    """History with the originals of replaced rows, for passages that have none so far; of several the earliest (at) is kept."""
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("at"))
    return history.unionByName(replaced.join(history, KEY, "left_anti").withColumn("_place", place).where("_place = 1").drop("_place").select(*history.columns))


def with_issues(passages: DataFrame, issues: DataFrame) -> DataFrame:
    """Passages (version, issue, issue_version) with new issues (kind, version): attached while the passage has the version that failed; stale ones go."""
    new = issues.select(*KEY, F.col("kind").alias("_kind"), F.col("version").alias("_version"))
    hit = F.col("_version").eqNullSafe(F.col("version"))
    stays = F.when(F.col("issue_version").eqNullSafe(F.col("version")), F.col("issue"))
    return passages.join(new, KEY, "left").select(*KEY, F.when(hit, F.col("_kind")).otherwise(stays).alias("issue"))


def undone_windows(windows: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Windows (recording_id, plan, n) that the checkpoint (plan, cursor) of their recording doesn't count as done; one of another plan counts for nothing."""
    done = checkpoints.select("recording_id", "plan", "cursor")
    return windows.join(done, ["recording_id", "plan"], "left").where("cursor IS NULL OR n >= cursor").drop("cursor")


def unattempted(passages: DataFrame, attempts: DataFrame, model: str) -> DataFrame:
    """Passages (source_key, protected, candidate) that this model hasn't tried with the same source, without edits or a candidate."""
    tried = attempts.where(F.col("model") == model).select(*KEY, "source_key")
    return passages.where("NOT candidate AND coalesce(protected, '') = ''").join(tried, [*KEY, "source_key"], "left_anti").select(*KEY, "source_key")
