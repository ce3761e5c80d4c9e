"""Joins of ranges and positions within a recording, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = "recording_id"
#: 30 s: a range is copied once for each bucket that it touches.
BUCKET = 480_000
#: Clips in samples: shortest (2 s), longest whole one (10 s), and the step through longer ranges (6 s).
SHORTEST, WHOLE, STEP = 32_000, 160_000, 96_000


def clipped(turns: DataFrame, spans: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Each turn cut to each span that it overlaps; ``spans`` has recording_id, span_id, start_sample, end_sample.

    Equi-join on recording and time bucket; a pair that shares several buckets
    counts in the one where its overlap starts. Empty ranges overlap nothing.
    """
    within = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor((F.col(b) - 1) / bucket))).alias("b")
    t = turns.where("start_sample < end_sample").select(KEY, "speaker", F.col("start_sample").alias("a"), F.col("end_sample").alias("z"), within("start_sample", "end_sample"))
    s = spans.where("start_sample < end_sample").select(KEY, "span_id", "start_sample", "end_sample", within("start_sample", "end_sample"))
    low, high = F.greatest("a", "start_sample"), F.least("z", "end_sample")
    pairs = t.join(s, [KEY, "b"]).where((low < high) & (F.floor(low / bucket) == F.col("b")))
    return pairs.select(KEY, "span_id", "speaker", low.alias("start_sample"), high.alias("end_sample"))


def span_speakers(turns: DataFrame, spans: DataFrame) -> DataFrame:
    """candidates: sorted distinct speakers of each span; speaker: unassigned, the only one, or multiple_speakers."""
    heard = clipped(turns, spans).groupBy(KEY, "span_id").agg(F.array_sort(F.collect_set("speaker")).alias("who"))
    n = F.coalesce(F.size("who"), F.lit(0))
    speaker = F.when(F.col("who").isNull(), "unassigned").when(n == 1, F.col("who")[0]).otherwise("multiple_speakers")
    return spans.select(KEY, "span_id").join(heard, [KEY, "span_id"], "left").select(KEY, "span_id", F.coalesce(F.array_join("who", ","), F.lit("")).alias("candidates"), speaker.alias("speaker"))


def epoch_at(events: DataFrame, epochs: DataFrame) -> DataFrame:
    """The latest epoch that starts at or before each event's start; null before the first.

    One shuffle by recording: epochs and events are sorted together and the last epoch is carried on.
    ``epochs``: recording_id, language_epoch, start_sample; ``events``: recording_id, turn_id, start_sample.
    """
    none = F.lit(None).cast("long")
    both = epochs.select(KEY, none.alias("turn_id"), "start_sample", F.col("language_epoch").cast("long").alias("epoch"), F.lit(0).alias("side"))
    both = both.unionByName(events.select(KEY, "turn_id", "start_sample", none.alias("epoch"), F.lit(1).alias("side")))
    w = Window.partitionBy(KEY).orderBy("start_sample", "side", "epoch").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("epoch", F.last("epoch", ignorenulls=True).over(w)).where("side = 1").select(KEY, "turn_id", "start_sample", F.col("epoch").alias("language_epoch"))


def clip_windows(spans: DataFrame) -> DataFrame:
    """Voice clips: a range of 2 to 10 s is one; a longer one gives 6 s clips, and its last piece if that has 2 s."""
    long = F.col("end_sample") - F.col("start_sample") > WHOLE
    starts = F.when(long, F.sequence(F.col("start_sample"), F.col("end_sample") - SHORTEST, F.lit(STEP).cast("long"))).otherwise(F.array("start_sample"))
    pieces = spans.where(F.col("end_sample") - F.col("start_sample") >= SHORTEST).withColumn("whole", ~long).withColumn("clip", F.explode(starts))
    stop = F.when(F.col("whole"), F.col("end_sample")).otherwise(F.least(F.col("clip") + STEP, F.col("end_sample")))
    return pieces.select(KEY, F.col("clip").alias("start_sample"), stop.alias("end_sample"), "whole")


def withdraw_overlapping(words: DataFrame) -> DataFrame:
    """Neighbours in order of ``pos`` where one ends after the next starts both lose their times."""
    w = Window.partitionBy(KEY).orderBy("pos")
    bad = F.coalesce((F.lag("end_sample").over(w) > F.col("start_sample")), F.lit(False)) | F.coalesce(F.col("end_sample") > F.lead("start_sample").over(w), F.lit(False))
    kept = words.withColumn("bad", bad)
    return kept.select(KEY, "pos", F.when(~F.col("bad"), F.col("start_sample")).alias("start_sample"), F.when(~F.col("bad"), F.col("end_sample")).alias("end_sample"))


def contiguous(spans: DataFrame, bounds: DataFrame) -> DataFrame:
    """Per recording: does the first span start at 0, each start where the last one ended, and the last end at the bound (recording_id, duration)?"""
    w = Window.partitionBy(KEY).orderBy("start_sample", "end_sample")
    touch = F.coalesce(F.lag("end_sample").over(w), F.lit(0)) == F.col("start_sample")
    checked = spans.withColumn("touch", touch & (F.col("start_sample") < F.col("end_sample"))).groupBy(KEY).agg(F.every("touch").alias("touching"), F.max("end_sample").alias("stop"))
    return checked.join(bounds, KEY).select(KEY, (F.col("touching") & (F.col("stop") == F.col("duration"))).alias("contiguous"))


def last_n(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def compare(prior: DataFrame, incoming: DataFrame) -> DataFrame:
    """Full outer join of passages by id: new, removed, edited or same, and which of text, speaker, start and end differ."""
    a, b = prior.alias("a"), incoming.alias("b")
    fields = {"text": "text", "speaker": "speaker", "start": "start_sample", "end": "end_sample"}
    differ = F.array_compact(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(k)) for k, c in fields.items())))
    joined = a.join(b, [KEY, "passage_id"], "full").select(KEY, "passage_id", F.col("a.pos").isNull().alias("new"), F.col("b.pos").isNull().alias("removed"), F.when(F.col("a.pos").isNotNull() & F.col("b.pos").isNotNull(), F.array_join(differ, ",")).otherwise("").alias("edited_keys"))
    status = F.when(F.col("new"), "new").when(F.col("removed"), "removed").when(F.col("edited_keys") != "", "edited").otherwise("same")
    return joined.select(KEY, "passage_id", status.alias("status"), "edited_keys")
