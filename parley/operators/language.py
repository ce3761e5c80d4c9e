"""Language decisions over probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = "recording_id"
#: Supported languages (fixed values).
SUPPORTED = ("en", "fr", "de", "es", "it", "pt", "nl", "pl", "el", "ar", "ja", "zh", "vi", "ko")
CONFIDENT_PCT, MARGIN, RECENT = 90, 200, 960_000


def decide(probes: DataFrame) -> DataFrame:
    """reason, language, margin (thousandths) and review flag of each probe.

    The winner is supported and confident: detected; supported: best_effort
    with review; unsupported and confident: unsupported; else needs_language.
    """
    margin = F.col("top_pct") * 10 - F.col("second_permille")
    sure = (F.col("top_pct") >= CONFIDENT_PCT) & (margin >= MARGIN)
    known = F.col("top_code").isin(*SUPPORTED)
    reason = F.when(known & sure, "detected").when(known, "best_effort").when(sure, "unsupported").otherwise("needs_language")
    out = probes.select("*", margin.cast("long").alias("margin"), sure.alias("confident"), reason.alias("reason"))
    return out.withColumn("language", F.when(F.col("reason").isin("detected", "best_effort"), F.col("top_code"))).withColumn("review", F.col("reason") != "detected")


def rescue(probes: DataFrame) -> DataFrame:
    """rescued: a weak probe takes the last established language if that ended 0 to 60 s before.

    A confident probe with text sets the context; unsupported ones, and
    confident ones of another language without text, clear it.
    """
    d = decide(probes)
    w = Window.partitionBy(KEY).orderBy("start_sample").rowsBetween(Window.unboundedPreceding, -1)
    sets = (F.col("reason") == "detected") & F.col("text_ok")
    fails = (F.col("reason") == "detected") & ~F.col("text_ok")
    event = F.when(sets, F.struct(F.col("language").alias("lang"), F.col("end_sample").alias("at"), F.col("start_sample").alias("since"))).when(F.col("reason") == "unsupported", F.struct(F.lit(None).cast("string").alias("lang"), F.col("end_sample").alias("at"), F.col("start_sample").alias("since")))
    d = d.withColumn("context", F.last(event, ignorenulls=True).over(w))
    # The latest failure in each supported language: one in another than the context's, after it was set, ends it.
    last = F.array(*(F.struct(F.lit(x).alias("language"), F.max(F.when(fails & (F.col("language") == x), F.col("start_sample"))).over(w).alias("at")) for x in SUPPORTED))
    d = d.withColumn("failed", last)
    against = F.exists("failed", lambda f: F.coalesce(f["at"] > F.col("context.since"), F.lit(False)) & (f["language"] != F.col("context.lang")))
    near = (F.col("start_sample") - F.col("context.at")).between(0, RECENT)
    use = F.col("reason").isin("best_effort", "needs_language") & F.col("context.lang").isNotNull() & near & ~against
    return d.select(KEY, "probe_id", "reason", "language", F.when(use, F.col("context.lang")).alias("rescued"))


def summary(probes: DataFrame) -> DataFrame:
    """Per recording: the language if all probes agree, why not, and whether it needs review.

    mixed: two languages; unknown: a probe without one; either gives no
    language and review, as does a probe that needs review. chosen is the
    probe that stands for the decision: the first unknown one, else a reviewed
    one, else the least probable. reason is that probe's, or mixed.
    detector_error is true if any probe's detector failed.
    """
    d = decide(probes)
    first = F.min(F.when(F.col("language").isNull(), F.struct("start_sample", "probe_id", "reason")))
    least = F.min(F.struct((~F.col("review")).cast("int").alias("sure"), "top_pct", "start_sample", "probe_id", "reason"))
    out = d.groupBy(KEY).agg((F.countDistinct("language") > 1).alias("mixed"), F.bool_or(F.col("language").isNull()).alias("unknown"), F.bool_or("review").alias("any_review"), F.min("language").alias("one"), first.alias("first"), least.alias("least"), F.bool_or("detector_error").alias("detector_error"))
    one = F.when(~F.col("mixed") & ~F.col("unknown"), F.col("one"))
    chosen, reason = F.coalesce("first.probe_id", "least.probe_id"), F.when(F.col("mixed"), "mixed").otherwise(F.coalesce("first.reason", "least.reason"))
    return out.select(KEY, "mixed", "unknown", (F.col("mixed") | F.col("unknown") | F.col("any_review")).alias("review"), one.alias("language"), reason.alias("reason"), chosen.alias("chosen"), "detector_error")


def from_scores(scores: DataFrame) -> DataFrame:
    """(id, valid, candidates, language, reason, review) from a map of scores by language code.

    A distribution is valid if all scores lie within 0 to 1, no code is empty
    and they add up to 0.98 to 1.02; another one is a detector error.
    candidates are the three best as code:score, by score, then code.
    """
    pairs = F.transform(F.map_entries("scores"), lambda e: F.struct((-e["value"]).alias("minus"), e["key"].alias("code")))
    total = F.aggregate(F.map_values("scores"), F.lit(0.0), lambda s, x: s + x)
    valid = F.forall(F.map_values("scores"), lambda x: (x >= 0) & (x <= 1)) & F.forall(F.map_keys("scores"), lambda k: k != "") & total.between(0.98, 1.02)
    out = scores.withColumns({"best": F.array_sort(pairs), "valid": F.coalesce(valid, F.lit(False))})
    top, second = -F.col("best")[0]["minus"], F.coalesce(-F.try_element_at("best", F.lit(2))["minus"], F.lit(0.0))
    sure = (top >= CONFIDENT_PCT / 100) & (F.round(top - second, 9) >= MARGIN / 1000)
    code = F.col("best")[0]["code"]
    reason = F.when(~F.col("valid"), "detector_error").when(code.isin(*SUPPORTED), F.when(sure, "detected").otherwise("best_effort")).when(sure, "unsupported").otherwise("needs_language")
    out = out.withColumn("reason", reason)
    three = F.array_join(F.transform(F.slice("best", 1, 3), lambda x: F.concat(x["code"], F.lit(":"), F.format_number(-x["minus"], 3))), ",")
    return out.select("id", "valid", F.when(F.col("valid"), three).alias("candidates"), F.when(F.col("reason").isin("detected", "best_effort"), code).alias("language"), "reason", (F.col("reason") != "detected").alias("review"))
