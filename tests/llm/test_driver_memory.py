"""What near duplicates broadcast and shuffle: nothing through the driver that Spark sizes too low, as keys behind a Python step or packed sketches and texts."""

import re

from pyspark.sql import functions as F

from parley.llm import simhash
from parley.llm.common import stored


def joins(df):
    """(kind, first key) of each join in the plan, under Spark's own limit of what is broadcast."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"(\w+Join) \[(\w+)#", plan)


def nodes(spark, n):
    return stored(spark.range(n).select(F.col("id").alias("node"), *(F.xxhash64("id", F.lit(i)).alias(f"f{i}") for i in range(4))))


def test_keys_of_fingerprints_are_shuffled(spark):
    own, families = nodes(spark, 300), simhash.wide_families(256)
    assert simhash.with_keys(own, families).count() > 50 * own.count()  # Spark takes them for as many as the nodes
    crowded = own.where("node % 3 = 0").select("node")
    assert joins(simhash.near_fingerprints(own.select("node", "f0"))) == [("SortMergeJoin", "key")]
    found = [kind for kind, key in joins(simhash.near_fingerprints(own, families, simhash.WIDE_DISTANCE, crowded)) if key == "key"]
    assert found == ["SortMergeJoin"] * 2


def test_keys_are_made_and_shuffled_once(spark):
    own, families = nodes(spark, 300), simhash.wide_families(256)
    found = simhash.near_fingerprints(own, families, simhash.WIDE_DISTANCE, stored(own.where("node % 3 = 0").select("node")))
    plan = found._jdf.queryExecution()
    found.collect()
    final = plan.executedPlan().toString().split("Initial Plan")[0]
    assert len(re.findall(r"MapInPandas", final)) == 2  # those of crowded nodes and all others


def test_sketches_and_texts_are_shuffled(spark):
    links = stored(spark.range(50).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    sketches = stored(spark.range(60).select(F.col("id").alias("node"), F.sequence(F.lit(0).cast("long"), F.lit(99).cast("long")).alias("sketch")))
    texts = stored(spark.range(60).select(F.col("id").alias("node"), F.repeat(F.lit("one two "), 20_000).alias("text")))
    assert joins(simhash.plausible(links, sketches, 0.8)) == [("SortMergeJoin", "dst"), ("SortMergeJoin", "src")]
    assert joins(simhash.alike(links, texts, 5, 0.8)) == [("SortMergeJoin", "dst"), ("SortMergeJoin", "src")]
    assert simhash.plausible(links, sketches, 0.8).where("sure").count() == simhash.alike(links, texts, 5, 0.8).count() == 50
