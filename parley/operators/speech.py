"""Speech frames: hysteresis, utterances between silences, inspection counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = "recording_id"
ON, OFF = 50, 35  # hundredths
SILENCE, LEAD = 8_000, 3_200


def hysteresis(frames: DataFrame) -> DataFrame:
    """speaking: on from 0.5, off below 0.35, else as before; a constant block is no speech but keeps the state."""
    signal = F.when(F.col("constant_block"), None).when(F.col("p100") >= ON, True).when(F.col("p100") < OFF, False)
    w = Window.partitionBy(KEY).orderBy("start_sample").rowsBetween(Window.unboundedPreceding, 0)
    state = F.coalesce(F.last(signal, ignorenulls=True).over(w), F.lit(False))
    return frames.select(KEY, "start_sample", "end_sample", "p100", "constant_block", (state & ~F.col("constant_block")).alias("speaking"))


def utterances(frames: DataFrame, silence: int = SILENCE, lead: int = LEAD) -> DataFrame:
    """Speaking frames less than ``silence`` apart, widened by ``lead`` within what was observed and after the last utterance."""
    on = hysteresis(frames)
    seen = on.groupBy(KEY).agg(F.max("end_sample").alias("observed"))
    w = Window.partitionBy(KEY).orderBy("start_sample")
    talk = on.where("speaking")
    new = F.when(F.col("start_sample") - F.lag("end_sample").over(w) < silence, 0).otherwise(1)
    talk = talk.withColumn("new", new).withColumn("n", F.sum("new").over(w))
    u = talk.groupBy(KEY, "n").agg(F.min("start_sample").alias("first"), F.max("end_sample").alias("last")).join(seen, KEY)
    return u.select(KEY, F.col("n").cast("long").alias("n"), F.greatest(F.lit(0), F.col("first") - lead).cast("long").alias("start_sample"), F.least("observed", F.col("last") + lead).cast("long").alias("end_sample"))


def utterances_by_epoch(frames: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(recording_id, source_id, n, epoch, start_sample, end_sample): utterances of each source that a language boundary (recording_id, epoch from 1, start_sample) ends.

    A boundary within a frame cuts it. An utterance starts after its epoch's
    start and ends before its epoch's end. Hysteresis goes on over boundaries.
    """
    keys = [KEY, "source_id"]
    spans = boundaries.select(KEY, "epoch", F.col("start_sample").alias("epoch_start")).unionByName(frames.select(KEY, F.lit(0).cast("long").alias("epoch"), F.lit(0).cast("long").alias("epoch_start")).distinct())
    spans = spans.withColumn("epoch_end", F.lead("epoch_start").over(Window.partitionBy(KEY).orderBy("epoch")))
    inside = (F.col("epoch_start") < F.col("end_sample")) & (F.col("epoch_end").isNull() | (F.col("start_sample") < F.col("epoch_end")))
    cut = frames.join(spans, KEY).where(inside)
    cut = cut.withColumns({"start_sample": F.greatest("start_sample", "epoch_start"), "end_sample": F.least("end_sample", "epoch_end")})
    signal = F.when(F.col("constant_block"), None).when(F.col("p100") >= ON, True).when(F.col("p100") < OFF, False)
    w = Window.partitionBy(*keys).orderBy("start_sample")
    state = F.coalesce(F.last(signal, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))
    talk = cut.withColumns({"speaking": state & ~F.col("constant_block"), "observed": F.max("end_sample").over(Window.partitionBy(*keys))}).where("speaking")
    goes_on = (F.col("start_sample") - F.lag("end_sample").over(w) < SILENCE) & (F.lag("epoch").over(w) == F.col("epoch"))
    numbered = talk.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("n", F.sum("new").over(w))
    own = numbered.groupBy(*keys, "n", "epoch").agg(F.min("start_sample").alias("first"), F.max("end_sample").alias("last"), F.first("epoch_start").alias("low"), F.first(F.least("observed", "epoch_end")).alias("high"))
    return own.select(*keys, F.col("n").cast("long").alias("n"), "epoch", F.greatest("low", F.col("first") - LEAD).alias("start_sample"), F.least("high", F.col("last") + LEAD).alias("end_sample"))


def inspection(frames: DataFrame) -> DataFrame:
    """Samples by kind and the decision for each recording: speech, else uncertain, else no speech.

    A frame that doesn't speak is uncertain if nothing observed it
    (``observed``), else negative, of a constant signal or by the model.
    """
    size = F.col("end_sample") - F.col("start_sample")
    kind = F.when(F.col("speaking"), "speech").when(~F.col("observed"), "uncertain").when(F.col("constant_block"), "negative_constant").otherwise("model_negative")
    total = lambda k: F.sum(F.when(F.col("kind") == k, F.col("size")).otherwise(0)).cast("long").alias(k)
    state = hysteresis(frames).join(frames.select(KEY, "start_sample", "observed"), [KEY, "start_sample"])
    out = state.select(KEY, kind.alias("kind"), size.alias("size")).groupBy(KEY).agg(*map(total, ("speech", "uncertain", "negative_constant", "model_negative")))
    return out.withColumn("decision", F.when(F.col("speech") > 0, "speech").when(F.col("uncertain") > 0, "uncertain").otherwise("no_speech"))


def admission(ranges: DataFrame, frames: DataFrame, bucket: int = 48_000) -> DataFrame:
    """(recording_id, span_id, complete, maximum, speech, decision) for each range, by the frames that it overlaps.

    ``ranges``: recording_id, span_id, start_sample, end_sample. Ranges meet
    frames by recording and a bucket of 3 s. A range that frames don't cover
    without a break is pending. speech lists the merged speech regions within
    the range as start-end, comma-joined.
    """
    own = ranges.withColumn("b", F.explode(F.sequence(F.floor(F.col("start_sample") / bucket), F.floor((F.col("end_sample") - 1) / bucket))))
    state = hysteresis(frames).select(KEY, F.col("start_sample").alias("a"), F.col("end_sample").alias("z"), "p100", "speaking")
    state = state.withColumn("b", F.explode(F.array_distinct(F.array(F.floor(F.col("a") / bucket), F.floor((F.col("z") - 1) / bucket)))))
    low, high = F.greatest("a", "start_sample"), F.least("z", "end_sample")
    met = own.join(state, [KEY, "b"]).where((low < high) & (F.floor(low / bucket) == F.col("b"))).withColumns({"low": low, "high": high})
    order = Window.partitionBy(KEY, "span_id").orderBy("low")
    met = met.withColumn("whole", F.coalesce(F.lag("high").over(order), F.col("start_sample")) >= F.col("low"))
    met = met.withColumn("new", F.when(F.col("speaking") & F.lag("speaking").over(order) & (F.lag("high").over(order) == F.col("low")), 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
    seen = met.groupBy(KEY, "span_id").agg(F.every("whole").alias("whole"), F.max("high").alias("stop"), F.max("p100").alias("maximum"))
    talk = met.where("speaking").groupBy(KEY, "span_id", "island").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    talk = talk.groupBy(KEY, "span_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("low", "high"))), lambda x: F.concat_ws("-", x["low"], x["high"])), ",").alias("speech"))
    out = ranges.join(seen, [KEY, "span_id"], "left").join(talk, [KEY, "span_id"], "left")
    complete = F.coalesce(F.col("whole") & (F.col("stop") == F.col("end_sample")), F.lit(False))
    decision = F.when(~complete, "pending").when(F.col("speech").isNotNull(), "speech").otherwise("no_speech")
    return out.select(KEY, "span_id", complete.alias("complete"), F.when(complete, F.col("maximum")).alias("maximum"), F.when(complete, F.coalesce("speech", F.lit(""))).alias("speech"), decision.alias("decision"))


def block_route(decision: F.Column, low: F.Column, high: F.Column) -> F.Column:
    """Reason and audio state of a block that isn't decoded, as reason:state; null for speech that varies. low and high are its extreme samples."""
    constant = F.when(low == high, F.when(low == 0, "digital_silence").otherwise("constant_signal"))
    return (
        F.when(decision == "speech", F.concat(F.lit("insufficient_speech:"), constant))
        .when(decision == "no_speech", F.lit("insufficient_speech:model_non_speech"))
        .when(decision == "uncertain", F.lit("speech_admission_uncertain:speech_evidence_pending"))
        .when(decision == "pending", F.lit("speech_evidence_pending:speech_evidence_pending"))
    )
