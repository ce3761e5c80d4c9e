"""Voices: unit vectors, profiles, ranking and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST_CLIPS, THRESHOLD, MARGIN = 2, 0.2, 0.05
#: People that a library may hold; so many profiles are broadcast at most.
PEOPLE = 500


def units(clips: DataFrame) -> DataFrame:
    """Clips with unit vectors in double precision; vectors of norm below 1e-12 or not finite are left out."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return clips.withColumn("v", v).withColumn("norm", norm).where("norm >= 1e-12 AND norm < double('infinity')").withColumn("unit", F.transform("v", lambda x: x / F.col("norm"))).drop("v", "norm")


def profiles(clips: DataFrame) -> DataFrame:
    """(person_id, model_id, n_clips, centroid): the normalised mean of enrolled unit vectors of one model, from two clips on."""
    d = units(clips.where("enrolled")).select("person_id", "model_id", F.posexplode("unit").alias("dim", "x"))
    mean = d.groupBy("person_id", "model_id", "dim").agg(F.avg("x").alias("x"), F.count("*").alias("n")).where(F.col("n") >= LEAST_CLIPS)
    c = mean.groupBy("person_id", "model_id").agg(F.max("n").alias("n_clips"), F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("c"))
    norm = F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x))
    return c.withColumn("norm", norm).select("person_id", "model_id", "n_clips", F.transform("c", lambda x: x / F.col("norm")).alias("centroid"))


def ranking(clips: DataFrame, known: DataFrame, salts: int = 64) -> DataFrame:
    """(track_id, person_id, mean, least, clips, place): clips of tracks that aren't enrolled against the profiles of the same model.

    Profiles are compared with every clip on purpose. Up to PEOPLE of them are
    broadcast; more are dealt to ``salts`` groups, and clips to all of these,
    so that no task holds all of a model's.
    """
    dot = F.aggregate(F.zip_with("unit", "centroid", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    query = units(clips.where("NOT enrolled")).select("track_id", "model_id", "unit")
    if known.limit(PEOPLE + 1).count() <= PEOPLE:
        pairs = query.join(F.broadcast(known), "model_id")
    else:
        pairs = query.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).join(known.withColumn("salt", F.pmod(F.xxhash64("person_id"), F.lit(salts)).cast("int")), ["model_id", "salt"])
    score = pairs.select("track_id", "person_id", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)).alias("s"))
    out = score.groupBy("track_id", "person_id").agg(F.avg("s").alias("mean"), F.min("s").alias("least"), F.count("*").alias("clips"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc(F.round("mean", 9)), "person_id")))


def decide(ranked: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN, least_clips: int = LEAST_CLIPS) -> DataFrame:
    """(track_id, person_id, outcome) per track: matched, or the reason why nobody is named.

    By a calibration of the same model: every clip of the track must reach the
    threshold with the best profile, and that one's mean must lead the second
    best (0 without one) by the margin.
    """
    best, second = ranked.where("place = 1"), ranked.where("place = 2").select("track_id", F.col("mean").alias("next"))
    d = best.join(second, "track_id", "left")
    gap = F.col("mean") - F.coalesce("next", F.lit(0.0))
    outcome = F.when(F.col("clips") < least_clips, "few_clips").when(F.col("least") < threshold, "below_threshold").when(gap < margin, "small_margin").otherwise("matched")
    return d.select("track_id", F.when(outcome == "matched", F.col("person_id")).alias("person_id"), outcome.alias("outcome"))
