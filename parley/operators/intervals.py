"""Interval operators over (recording_id, start_sample, end_sample), all per recording and set-based."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = "recording_id"
#: Longest import piece (18 s), longest coverage piece (30 s), crop padding (0.22 s) and longest bridged interruption, in samples at 16 kHz.
PIECE, COVERAGE, PADDING = 288_000, 480_000, 3_520
TOLERANCE = 16


def normalize_turns(turns: DataFrame, durations: DataFrame, tracks: int = 8) -> DataFrame:
    """Valid speaker tracks only, clamped to the recording, empty ones dropped. ``durations``: recording_id, duration."""
    n = F.regexp_extract("speaker", r"^speaker_([0-9]+)$", 1)
    joined = turns.join(durations, KEY).where((n != "") & (F.expr("try_cast(regexp_extract(speaker, '^speaker_([0-9]+)$', 1) AS int)") < tracks))
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.col(c), F.col("duration"))).cast("long").alias(c)
    return joined.select(KEY, "turn_id", "speaker", clamp("start_sample"), clamp("end_sample")).where("start_sample < end_sample")


def boundaries(turns: DataFrame) -> DataFrame:
    """Distinct starts and ends of each recording."""
    return turns.select(KEY, F.explode(F.array("start_sample", "end_sample")).alias("sample")).distinct()


def elementary(turns: DataFrame) -> DataFrame:
    """(recording_id, start_sample, end_sample, owners): cells between neighbouring bounds and who speaks there, comma-joined.

    A sweep: +1 and -1 events are summed per sample and speaker, running sums
    give each speaker's state, so work follows the number of turns.
    """
    e = turns.where("start_sample < end_sample").select(KEY, "speaker", F.explode(F.array(F.struct(F.col("start_sample").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end_sample").alias("at"), F.lit(-1).alias("d")))).alias("e")).groupBy(KEY, "speaker", "e.at").agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(KEY, "speaker").orderBy("at")
    state = e.withColumn("on", (F.sum("d").over(w) > 0).cast("int"))
    flips = state.withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(0)))
    # One row per bound: which speakers switch on and off there; a running set fold over the bounds gives the owners.
    at = flips.groupBy(KEY, "at").agg(F.collect_list(F.when(F.col("on") != F.col("was"), F.struct("speaker", "on"))).alias("flips"))
    speakers = flips.groupBy(KEY).agg(F.array_sort(F.collect_set("speaker")).alias("all"))
    wide = at.join(speakers, KEY)
    by = Window.partitionBy(KEY, "speaker").orderBy("at")
    cells = wide.select(KEY, "at", F.explode("all").alias("speaker"), "flips")
    change = F.filter("flips", lambda f: f["speaker"] == F.col("speaker"))
    cells = cells.withColumn("on", F.last(F.when(F.size(change) > 0, change[0]["on"]), ignorenulls=True).over(by))
    cells = cells.groupBy(KEY, "at").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("on") == 1, F.col("speaker")))), ",").alias("owners"))
    stop = F.lead("at").over(Window.partitionBy(KEY).orderBy("at"))
    return cells.withColumn("end_sample", stop).where("end_sample IS NOT NULL").select(KEY, F.col("at").alias("start_sample"), "end_sample", "owners")


def coalesce_equal(cells: DataFrame) -> DataFrame:
    """Neighbours that touch and have the same owners become one."""
    w = Window.partitionBy(KEY).orderBy("start_sample")
    new = (F.lag("end_sample").over(w).eqNullSafe(F.col("start_sample")) & F.lag("owners").over(w).eqNullSafe(F.col("owners")))
    island = F.sum(F.when(new, 0).otherwise(1)).over(w)
    return cells.withColumn("island", island).groupBy(KEY, "island").agg(F.min("start_sample").alias("start_sample"), F.max("end_sample").alias("end_sample"), F.first("owners").alias("owners")).drop("island")


def islands(spans: DataFrame, gap: int = 0) -> DataFrame:
    """Unions of spans that overlap or lie at most ``gap`` samples apart."""
    w = Window.partitionBy(KEY).orderBy("start_sample", "end_sample")
    reach = F.max("end_sample").over(w.rowsBetween(Window.unboundedPreceding, -1))
    # by range: equal spans get one number, in whatever order they come
    island = F.sum("new").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    marked = spans.withColumn("new", F.when(F.col("start_sample") <= reach + gap, 0).otherwise(1)).withColumn("island", island)
    return marked.groupBy(KEY, "island").agg(F.min("start_sample").alias("start_sample"), F.max("end_sample").alias("end_sample")).drop("island")


def running_end(spans: DataFrame) -> DataFrame:
    """Running maximum end in the order of starts, for stabbing queries."""
    w = Window.partitionBy(KEY).orderBy("start_sample", "end_sample", "pos").rowsBetween(Window.unboundedPreceding, 0)
    return spans.select(KEY, "pos", "start_sample", "end_sample", F.max("end_sample").over(w).alias("running_end"))


def complement(spans: DataFrame, durations: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Uncovered time between 0 and the duration: gaps longer than the tolerance."""
    solid = islands(spans)
    w = Window.partitionBy(KEY).orderBy("start_sample")
    gaps = solid.select(KEY, F.coalesce(F.lag("end_sample").over(w), F.lit(0)).alias("a"), F.col("start_sample").alias("b"))
    tail = durations.join(solid.groupBy(KEY).agg(F.max("end_sample").alias("a")), KEY, "left").select(KEY, F.coalesce("a", F.lit(0)).alias("a"), F.col("duration").alias("b"))
    return gaps.unionByName(tail).where(F.col("b") - F.col("a") > tolerance).select(KEY, F.col("a").cast("long").alias("start_sample"), F.col("b").cast("long").alias("end_sample"))


def windows(spans: DataFrame, durations: DataFrame) -> DataFrame:
    """Work windows: speech spans and all gaps between them, up to the duration."""
    speech = islands(spans).withColumn("speech", F.lit(True))
    return speech.unionByName(complement(spans, durations, 0).withColumn("speech", F.lit(False)))


def chunk(spans: DataFrame, longest: int) -> DataFrame:
    """Pieces of at most ``longest`` samples, cut from the start."""
    starts = F.explode(F.sequence(F.col("start_sample"), F.col("end_sample") - 1, F.lit(longest).cast("long")))
    return spans.withColumn("piece", starts).select(KEY, F.col("piece").alias("start_sample"), F.least(F.col("piece") + longest, F.col("end_sample")).alias("end_sample"))


def uncovered_rows(passages: DataFrame, durations: DataFrame) -> DataFrame:
    """Coverage rows of at most 30 s for uncovered time.

    Ids are ``unassigned-<n>``, n being the number of ids so far; ``-gap`` is
    put behind one as often as it is taken.
    """
    pieces = chunk(complement(passages, durations), COVERAGE)
    pieces = pieces.withColumn("row", F.row_number().over(Window.partitionBy(KEY).orderBy("start_sample")))
    ids = passages.select(KEY, "passage_id").distinct()
    pieces = pieces.join(ids.groupBy(KEY).agg(F.count("*").alias("ids")), KEY, "left")
    n = F.coalesce("ids", F.lit(0)) + F.col("row") - 1
    # Taken ids of this form by their number, and how many of unassigned-n, unassigned-n-gap, ... are taken without a break.
    form = r"^unassigned-([0-9]+)((?:-gap)*)$"
    taken = ids.select(KEY, F.regexp_extract("passage_id", form, 1).alias("n"), (F.length(F.regexp_extract("passage_id", form, 2)) / 4).cast("long").alias("gaps")).where("n <> ''")
    at = F.row_number().over(Window.partitionBy(KEY, "n").orderBy("gaps")) - 1
    broken = taken.withColumn("at", at).groupBy(KEY, "n").agg(F.count_if(F.col("gaps") == F.col("at")).alias("more"))
    named = pieces.withColumn("n", n.cast("string")).join(broken, [KEY, "n"], "left")
    name = F.concat(F.lit("unassigned-"), "n", F.repeat(F.lit("-gap"), F.coalesce("more", F.lit(0)).cast("int")))
    return named.select(KEY, name.alias("passage_id"), "start_sample", "end_sample")


def crop_padding(regions: DataFrame, durations: DataFrame, padding: int = PADDING) -> DataFrame:
    """Regions padded on both sides, never past the midpoint to a neighbour or to the recording's bounds."""
    w = Window.partitionBy(KEY).orderBy("start_sample")
    before, after = F.coalesce(F.lag("end_sample").over(w), F.lit(0)), F.coalesce(F.lead("start_sample").over(w), F.col("duration"))
    low, high = F.floor((before + F.col("start_sample")) / 2), F.floor((F.col("end_sample") + after) / 2)
    start, end = F.greatest(F.lit(0), F.col("start_sample") - padding, low), F.least("duration", F.col("end_sample") + padding, high)
    return regions.join(durations, KEY).select(KEY, "start_sample", "end_sample", start.cast("long").alias("audio_start"), end.cast("long").alias("audio_end"))


#: Context windows: longest core (14 s), padding (3 s), longest range that stays whole (20 s); packets are cut at tiles.
CORE, PAD, WHOLE, TILE = 224_000, 48_000, 320_000, 4_000


def _padded(cores: DataFrame) -> DataFrame:
    return cores.select(KEY, "start_sample", "end_sample", "core_start", "core_end", F.greatest(F.col("core_start") - PAD, "start_sample").alias("window_start"), F.least(F.col("core_end") + PAD, "end_sample").alias("window_end"))


def context_windows(spans: DataFrame) -> DataFrame:
    """Nearly equal cores of at most 14 s, padded by 3 s within the span."""
    size = F.col("end_sample") - F.col("start_sample")
    parts = spans.where("start_sample < end_sample").withColumn("n", F.ceil(size / CORE).cast("long")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    edge = lambda i: (F.col("start_sample") + F.floor(size * i / F.col("n"))).cast("long")
    return _padded(parts.withColumns({"core_start": edge(F.col("i")), "core_end": edge(F.col("i") + 1)}))


def fixed_windows(spans: DataFrame) -> DataFrame:
    """Cores of 14 s from the start, only where a span exceeds 20 s, padded by 3 s within the span."""
    size = F.col("end_sample") - F.col("start_sample")
    step = F.when(size > WHOLE, CORE).otherwise(size).cast("long")
    parts = spans.where("start_sample < end_sample").withColumn("core_start", F.explode(F.sequence("start_sample", F.col("end_sample") - 1, step)))
    return _padded(parts.withColumn("core_end", F.least(F.col("core_start") + step, "end_sample")))


def tiles(packets: DataFrame) -> DataFrame:
    """Packets cut where tiles of 4,000 samples begin."""
    first, last = F.floor(F.col("start_sample") / TILE), F.floor((F.col("end_sample") - 1) / TILE)
    cut = packets.where("start_sample < end_sample").withColumn("tile", F.explode(F.sequence(first, last)))
    return cut.select(KEY, "tile", F.greatest("start_sample", F.col("tile") * TILE).alias("start_sample"), F.least("end_sample", (F.col("tile") + 1) * TILE).alias("end_sample"))


def best_range(spans: DataFrame) -> DataFrame:
    """Per recording the longest of the spans, touching ones merged, of at least 2 s: the earliest on ties, cut to 6 s."""
    solid = islands(spans).where("end_sample - start_sample >= 32000")
    best = solid.groupBy(KEY).agg(F.max_by(F.struct("start_sample", "end_sample"), F.struct(F.col("end_sample") - F.col("start_sample"), -F.col("start_sample"))).alias("b"))
    return best.select(KEY, "b.start_sample", F.least(F.col("b.end_sample"), F.col("b.start_sample") + 96_000).alias("end_sample"))


def probe_edges(spans: DataFrame, length: int = 48_000) -> DataFrame:
    """Nearly equal parts of at most 3 s with floored edges."""
    n = F.ceil((F.col("end_sample") - F.col("start_sample")) / length).cast("long")
    size = F.col("end_sample") - F.col("start_sample")
    edge = lambda i: F.col("start_sample") + F.floor(size * i / F.col("n"))
    parts = spans.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return parts.select(KEY, "start_sample", "i", edge(F.col("i")).cast("long").alias("part_start"), edge(F.col("i") + 1).cast("long").alias("part_end"))


def stabbing(passages: DataFrame, positions: DataFrame, bucket: int = COVERAGE) -> DataFrame:
    """Passages that hold each position: equi-join on recording and time bucket, then the exact predicate."""
    spans = passages.withColumn("b", F.explode(F.sequence(F.floor(F.col("start_sample") / bucket), F.floor((F.col("end_sample") - 1) / bucket))))
    at = positions.withColumn("b", F.floor(F.col("sample") / bucket))
    return at.join(spans, [KEY, "b"]).where("start_sample <= sample AND sample < end_sample").select(KEY, "sample", "passage_id")
