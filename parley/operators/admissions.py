"""Speech evidence in parts that can be put together: parts of a recording merge at their seams, in any order and any grouping.

A part: recording_id, start_sample, end_sample, complete, maximum,
model_maximum, policy, and the regions speech, negative and uncertain (arrays
of low, high). Merging parts gives a part, so a long recording keeps one row
instead of all its frames, and partial merges can be merged again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.speech import KEY, hysteresis

KINDS = ("speech", "negative", "uncertain")


def _gathered(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Arrays of the regions (kind, low, high) of each key, where those that touch are one."""
    w = Window.partitionBy(*keys, "kind").orderBy("low", "high")
    new = F.when(F.lag("high").over(w) == F.col("low"), 0).otherwise(1)
    merged = spans.withColumn("new", new).withColumn("island", F.sum("new").over(w)).groupBy(*keys, "kind", "island").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    listed = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("low", "high")))).alias(k)
    return merged.groupBy(*keys).agg(*(listed(k) for k in KINDS))


def parts(frames: DataFrame, size: int) -> DataFrame:
    """A part for every ``size`` samples of frames (start_sample, end_sample, p100, constant_block, observed, policy), by where a frame starts.

    A frame without observation is uncertain unless there is speech; a part
    with a break between its frames isn't complete.
    """
    state = hysteresis(frames).select(KEY, "start_sample", "speaking").join(frames, [KEY, "start_sample"])
    own = state.withColumn("part", F.floor(F.col("start_sample") / size))
    w = Window.partitionBy(KEY, "part").orderBy("start_sample")
    own = own.withColumn("joined", F.coalesce(F.lag("end_sample").over(w) == F.col("start_sample"), F.lit(True)))
    heads = own.groupBy(KEY, "part").agg(F.min("start_sample").alias("start_sample"), F.max("end_sample").alias("end_sample"), F.bool_and("joined").alias("complete"), F.max("p100").alias("maximum"), F.max(F.when(F.col("observed"), F.col("p100"))).alias("model_maximum"), *_one_policy())
    kind = F.when(F.col("speaking"), "speech").when(F.col("observed"), "negative").otherwise("uncertain")
    regions = _gathered(own.select(KEY, "part", kind.alias("kind"), F.col("start_sample").alias("low"), F.col("end_sample").alias("high")), [KEY, "part"])
    return _whole(heads.join(regions, [KEY, "part"])).drop("part")


def _one_policy() -> list[Column]:
    return [F.when((F.count("policy") == F.count("*")) & (F.min("policy") == F.max("policy")), F.min("policy")).alias("policy")]


def _whole(rows: DataFrame) -> DataFrame:
    """Evidence of different policies has none, and then no maximum of the model."""
    return rows.withColumn("model_maximum", F.when(F.col("policy").isNotNull(), F.col("model_maximum")))


def merge(given: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One part for each recording (and ``by``) of the parts given. Parts that leave a break or overlap, or aren't complete, make one that isn't."""
    keys = [KEY, *(by or [])]
    w = Window.partitionBy(*keys).orderBy("start_sample", "end_sample")
    seamed = given.withColumn("joined", F.coalesce(F.lag("end_sample").over(w) == F.col("start_sample"), F.lit(True)))
    heads = seamed.groupBy(*keys).agg(F.min("start_sample").alias("start_sample"), F.max("end_sample").alias("end_sample"), F.bool_and(F.col("joined") & F.col("complete")).alias("complete"), F.max("maximum").alias("maximum"), F.max("model_maximum").alias("model_maximum"), *_one_policy())
    named = lambda kind: F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x["low"].alias("low"), x["high"].alias("high")))
    spans = F.concat(*map(named, KINDS))
    regions = _gathered(given.select(*keys, F.explode(spans).alias("s")).select(*keys, "s.*"), keys)
    none = F.array().cast("array<struct<low: bigint, high: bigint>>")
    joined = heads.join(regions, keys, "left").withColumns({k: F.coalesce(k, none) for k in KINDS})
    return _whole(joined)


def decision() -> Column:
    """speech, no_speech, or pending for a part that isn't complete."""
    return F.when(~F.col("complete"), "pending").when(F.size("speech") > 0, "speech").otherwise("no_speech")
