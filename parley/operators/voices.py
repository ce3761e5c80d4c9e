"""Whose voice is alone where: solo ranges of passages, clips from them, and matches of the two voices of a separated passage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = "recording_id"
#: Shortest clip, longest range that is one clip, and length of the clips of longer ones, in samples (2, 10 and 6 s).
SHORTEST, LONGEST, PIECE = 32_000, 160_000, 96_000
#: Fields whose protection takes a passage's audio away from its track (fixed values).
MOVED = ("speaker", "start", "end")


def solo_ranges(passages: DataFrame) -> DataFrame:
    """(recording_id, passage_id, track, start_sample, end_sample): where a passage's one owner speaks and nobody else is heard.

    passages: track (the one asked for), speaker, start_sample, end_sample,
    utterance_id, canonical_state, finalized, separated, audio_state,
    unresolved, candidates and source_candidates (arrays), protected,
    audio_revision, activity_revision, observed_end, regions (array of
    start_sample, end_sample, speakers). Any break in the regions, any other
    speaker or another revision rejects the whole passage. A passage that was
    never part of a live utterance is its own range if its speaker is the track.
    """
    numbered = F.col("track").rlike(r"^speaker_[0-9]+$")
    sole = lambda c: F.coalesce((F.size(c) == 1) & (F.col(c)[0] == F.col("track")), F.lit(False))
    guarded = F.exists(F.split(F.coalesce("protected", F.lit("")), ","), lambda x: x.isin(*MOVED))
    clear = ~F.col("separated") & F.col("audio_state").isNull() & F.col("unresolved").isNull() & numbered
    imported = clear & F.col("utterance_id").isNull() & (F.col("speaker") == F.col("track"))
    sealed = (F.col("utterance_id") == F.col("passage_id")) & (F.col("canonical_state") == "sealed") & F.col("finalized")
    live = clear & sealed & ((F.col("speaker") == F.col("track")) | (F.col("speaker") == "unassigned"))
    live = live & sole("candidates") & sole("source_candidates") & ~guarded & (F.col("audio_revision") == F.col("activity_revision")) & (F.col("start_sample") >= 0)
    live = live & (F.col("observed_end") > F.col("start_sample")) & (F.col("observed_end") <= F.col("end_sample"))
    r = "regions"
    after = F.concat(F.array(F.col("start_sample")), F.transform(F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))), lambda x: x["end_sample"]))
    steady = F.forall(F.zip_with(r, after, lambda x, at: (x["start_sample"] == at) & (x["start_sample"] < x["end_sample"])), lambda x: x)
    alone = F.forall(r, lambda x: (F.size(x["speakers"]) == 0) | ((F.size(x["speakers"]) == 1) & (x["speakers"][0] == F.col("track"))))
    whole = (F.size(r) > 0) & (F.get(r, F.size(r) - 1)["end_sample"] == F.col("observed_end"))
    own = F.when(F.coalesce(imported, F.lit(False)), F.array(F.struct("start_sample", "end_sample"))).when(F.coalesce(live, F.lit(False)) & F.coalesce(whole, F.lit(False)) & steady & alone, F.transform(F.filter(r, lambda x: F.size(x["speakers"]) == 1), lambda x: F.struct(x["start_sample"].alias("start_sample"), x["end_sample"].alias("end_sample"))))
    each = passages.select(KEY, "passage_id", "track", F.explode(own).alias("s")).select(KEY, "passage_id", "track", "s.*")
    w = Window.partitionBy(KEY, "passage_id", "track").orderBy("start_sample")
    island = each.withColumn("new", F.when(F.lag("end_sample").over(w) == F.col("start_sample"), 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    return island.groupBy(KEY, "passage_id", "track", "island").agg(F.min("start_sample").alias("start_sample"), F.max("end_sample").alias("end_sample")).drop("island")


def clip_choices(ranges: DataFrame, passages: DataFrame) -> DataFrame:
    """(recording_id, passage_id, track, clip_id, start_sample, end_sample): clips of solo ranges of at least SHORTEST samples.

    A range of up to LONGEST is one clip; a longer one is parted into PIECEs
    from its start, and a rest that is too short is left out. A clip of a whole
    passage has the passage's id, others name their place.
    """
    size = F.col("end_sample") - F.col("start_sample")
    starts = F.when(size > LONGEST, F.sequence(F.lit(0).cast("long"), F.floor((size - SHORTEST) / PIECE) * PIECE, F.lit(PIECE).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    each = ranges.where(size >= SHORTEST).withColumn("at", F.explode(starts))
    cut = each.select(KEY, "passage_id", "track", (F.col("start_sample") + F.col("at")).alias("a"), F.when(size > LONGEST, F.least(F.col("start_sample") + F.col("at") + PIECE, F.col("end_sample"))).otherwise(F.col("end_sample")).alias("z"))
    joined = cut.join(passages.select(KEY, "passage_id", "start_sample", "end_sample"), [KEY, "passage_id"])
    whole = (F.col("a") == F.col("start_sample")) & (F.col("z") == F.col("end_sample"))
    name = F.when(whole, F.col("passage_id")).otherwise(F.concat("passage_id", F.lit("@"), F.col("a").cast("string"), F.lit(":"), F.col("z").cast("string")))
    return joined.select(KEY, "passage_id", "track", name.alias("clip_id"), F.col("a").alias("start_sample"), F.col("z").alias("end_sample"))


def _unit(vector) -> F.Column:
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(wide, lambda x: x / norm)


def channel_matches(channels: DataFrame, references: DataFrame, threshold: float, margin: float) -> DataFrame:
    """(episode, channel, target, score, margin): whom each of the two voices of a separated passage is taken to be.

    channels: recording_id, episode, channel (0 or 1), vector, several rows a
    channel. references: recording_id, target, person_id (null for a track
    that isn't assigned), centroid. A reference's identity is its person, else
    its target, so an assigned track and the person's profile are one. The
    best reference wins if its lowest score over the channel's vectors reaches
    ``threshold`` and its mean is ``margin`` over the best reference of another
    identity (0 without one). Two channels of one identity annul each other.
    """
    vectors = channels.select(KEY, "episode", "channel", _unit("vector").alias("v"))
    known = references.select(KEY, "target", F.coalesce(F.concat(F.lit("p:"), "person_id"), F.concat(F.lit("t:"), "target")).alias("identity"), _unit("centroid").alias("c"))
    dot = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.aggregate(F.zip_with("v", "c", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)))
    scored = vectors.join(known, KEY).withColumn("s", dot).groupBy(KEY, "episode", "channel", "target", "identity").agg(F.avg("s").alias("score"), F.min("s").alias("lowest"))
    w = Window.partitionBy(KEY, "episode", "channel")
    ranked = scored.withColumn("n", F.row_number().over(w.orderBy(F.desc("score"), "target"))).withColumn("best", F.first("identity").over(w.orderBy(F.desc("score"), "target")))
    other = F.coalesce(F.max(F.when(F.col("identity") != F.col("best"), F.col("score"))).over(w), F.lit(0.0))
    top = ranked.withColumn("margin", F.col("score") - other).where((F.col("n") == 1) & (F.col("lowest") >= threshold) & (F.col("margin") >= margin))
    both = Window.partitionBy(KEY, "episode", "identity")
    return top.withColumn("same", F.count("*").over(both)).where("same = 1").select(KEY, "episode", "channel", "target", "score", "margin")
