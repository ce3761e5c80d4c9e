"""Long utterances from overlapping windows: where neighbours agree on a word, and the text that follows.

A window: recording_id, utterance_id, n (from 0), start_sample, end_sample,
core_end, language, descriptor, raw (its text), cells (array of token,
start_sample, end_sample in order) and words (array of start_char, end_char,
start_sample, end_sample, first_cell, end_cell in order). Windows are bounded,
so seams are judged inside the joined row of two neighbours, without a shuffle
of cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["recording_id", "utterance_id"]
#: How far times of the same sign may differ, and how far an anchor must lie within what both windows heard (0.25 s).
MARGIN = 4_000

#: Whether two runs of cells have the same tokens at about the same time, and overlap somewhere.
ALIKE = f"""size({{a}}) = size({{b}}) AND forall({{both}}, z -> z.a.token = z.b.token AND abs(z.a.start_sample - z.b.start_sample) <= {MARGIN} AND abs(z.a.end_sample - z.b.end_sample) <= {MARGIN})
 AND exists({{both}}, z -> greatest(z.a.start_sample, z.b.start_sample) < least(z.a.end_sample, z.b.end_sample))"""


def places(run: str, cells: str) -> Column:
    """Where in ``cells`` (from 0) a run of cells is found."""
    b = f"slice({cells}, i + 1, size({run}))"
    inner = ALIKE.format(a=run, b=b, both=f"zip_with({run}, {b}, (x, y) -> named_struct('a', x, 'b', y))")
    # the first token rules out most places before anything is cut out
    return F.expr(f"CASE WHEN size({cells}) >= size({run}) THEN filter(sequence(0, size({cells}) - size({run})), i -> get({cells}, i).token = get({run}, 0).token AND {inner}) ELSE array() END")


def seams(windows: DataFrame) -> DataFrame:
    """(recording_id, utterance_id, n, reason, left_end, right_start) for each window n and its next one.

    The last word of the left window that lies safely within both, has exactly
    one run of cells like its own in the right one that is whole words there,
    and whose run has no other like it on the left. left_end and right_start
    are the places in the raw texts behind it; else reason tells why not.
    """
    right = windows.select(*KEY, (F.col("n") - 1).alias("n"), *(F.col(c).alias(f"r_{c}") for c in ("start_sample", "end_sample", "cells", "words", "language", "descriptor")))
    pair = windows.join(right, [*KEY, "n"])
    low, high = F.greatest("start_sample", "r_start_sample"), F.least("end_sample", "r_end_sample")
    w = F.col("w")
    each = pair.select(*KEY, "n", "cells", "r_cells", "r_words", "core_end", low.alias("low"), high.alias("high"), F.posexplode("words").alias("k", "w")).where((w["start_sample"] < F.col("core_end") + MARGIN) & (F.col("low") + MARGIN <= w["start_sample"]) & (w["end_sample"] <= F.col("high") - MARGIN))
    found = each.withColumn("run", F.slice("cells", w["first_cell"] + 1, w["end_cell"] - w["first_cell"])).withColumn("hits", places("run", "r_cells"))
    size = F.size("run")
    starts = F.transform("r_words", lambda x: x["first_cell"])
    ends = F.transform("r_words", lambda x: x["end_cell"])
    whole = found.withColumn("hits", F.filter("hits", lambda i: F.array_contains(starts, i) & F.array_contains(ends, i + size)))
    hit = F.get("hits", F.lit(0))
    back = whole.withColumn("there", F.slice("r_cells", hit + 1, size)).withColumn("back", F.when(F.size("hits") == 1, places("there", "cells")))
    alone = (F.size("back") == 1) & (F.get("back", F.lit(0)) == w["first_cell"])
    reason = F.when(F.size("hits") == 0, "boundary_mapping_absent").when(F.size("hits") > 1, "ambiguous_boundary_mapping").when(~alone, "ambiguous_bidirectional_boundary")
    last = F.get(F.filter("r_words", lambda x: x["end_cell"] == hit + size), F.lit(0))["end_char"]
    judged = back.select(*KEY, "n", "k", reason.alias("reason"), w["end_char"].alias("left_end"), F.when(reason.isNull(), last).alias("right_start"))
    order = F.struct("k", "reason", "left_end", "right_start")
    # the last word that fits; without one, the reason of the word that was tried last, which is the first
    best = judged.groupBy(*KEY, "n").agg(F.max_by(order, F.when(F.col("reason").isNull(), F.col("k"))).alias("good"), F.min_by("reason", "k").alias("why"))
    out = pair.select(*KEY, "n", "language", "r_language", "descriptor", "r_descriptor").join(best, [*KEY, "n"], "left")
    why = (
        F.when(~F.col("language").eqNullSafe(F.col("r_language")), "context_language_mismatch").when(~F.col("descriptor").eqNullSafe(F.col("r_descriptor")), "context_timing_provider_mismatch")
        .when(F.col("good").isNull(), F.coalesce("why", F.lit("no_complete_boundary_anchor")))
    )
    return out.select(*KEY, "n", why.alias("reason"), F.when(why.isNull(), F.col("good.left_end")).alias("left_end"), F.when(why.isNull(), F.col("good.right_start")).alias("right_start"))


def pieces(windows: DataFrame) -> DataFrame:
    """Windows with what each gives to its utterance: reason, separator, piece and offset, and first and stop, the piece's place in raw."""
    s = seams(windows)
    left = s.select(*KEY, "n", "reason", F.col("left_end").alias("upto"))
    before = s.select(*KEY, (F.col("n") + 1).alias("n"), F.col("right_start").alias("from"))
    w = Window.partitionBy(*KEY).orderBy("n")
    joined = windows.join(left, [*KEY, "n"], "left").join(before, [*KEY, "n"], "left").withColumns({"last": F.lead("n").over(w).isNull(), "gap": F.col("n") != F.row_number().over(w) - 1})
    a, z = F.coalesce("from", F.lit(0)), F.when(F.col("last"), F.length("raw")).otherwise(F.col("upto"))
    kept = F.expr("substring(raw, a + 1, z - a)")
    bounded = joined.withColumns({"a": a, "z": z}).withColumn("reason", F.when(F.col("gap"), "missing_context").when(F.col("reason").isNotNull(), F.col("reason")).when((F.col("z") < F.col("a")) | (F.col("z") > F.length("raw")), "nonmonotonic_raw_boundary"))
    cut = bounded.withColumn("kept", kept).withColumn("piece", F.regexp_replace(F.regexp_replace("kept", r"(?U)^\s+", ""), r"(?U)\s+$", ""))
    lead = F.length("kept") - F.length(F.regexp_replace("kept", r"(?U)^\s+", ""))
    own = cut.withColumns({"first": F.col("a") + lead, "stop": F.col("a") + lead + F.length("piece")})
    had = F.coalesce(F.max(F.length("piece") > 0).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    own = own.withColumn("separator", F.when(had & (F.length("piece") > 0), F.expr("substring(raw, a + 1, first - a)")).otherwise(""))
    upto = F.sum(F.length("separator") + F.length("piece")).over(w)
    return own.withColumn("offset", upto - F.length("piece"))


def stitched(windows: DataFrame) -> DataFrame:
    """(recording_id, utterance_id, complete, reason, text, words): an utterance of all its windows, or the first reason why there is none.

    Words keep the times of their window, with their places in the text; of two
    neighbours whose times overlap neither keeps them.
    """
    p = pieces(windows)
    heads = p.groupBy(*KEY).agg(F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("n"))).alias("reason"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat("separator", "piece").alias("t")))), lambda x: x["t"]), "").alias("text"))
    w = Window.partitionBy(*KEY).orderBy("n", "k")
    each = p.select(*KEY, "n", "first", "stop", "offset", F.posexplode("words").alias("k", "w")).where((F.col("first") <= F.col("w.start_char")) & (F.col("w.end_char") <= F.col("stop")))
    clash = F.coalesce(F.lag("w.end_sample").over(w) > F.col("w.start_sample"), F.lit(False)) | F.coalesce(F.col("w.end_sample") > F.lead("w.start_sample").over(w), F.lit(False))
    timed = lambda c: F.when(~F.col("clash"), F.col(f"w.{c}")).alias(c)
    shift = lambda c: (F.col(f"w.{c}") + F.col("offset") - F.col("first")).cast("int").alias(c)
    words = each.withColumn("clash", clash).select(*KEY, F.struct("n", "k", F.struct(shift("start_char"), shift("end_char"), timed("start_sample"), timed("end_sample")).alias("w")).alias("x"))
    words = words.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["w"]).alias("words"))
    good = F.col("reason").isNull()
    return heads.join(words, KEY, "left").select(*KEY, good.alias("complete"), "reason", F.when(good, F.col("text")).alias("text"), F.when(good, F.col("words")).alias("words"))
