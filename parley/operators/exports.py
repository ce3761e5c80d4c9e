"""Transcripts as TXT, SRT and VTT: which passages or turns are written, how, and up to which size.

Passages: the states that ``review`` reads, with channel (0 or 1 of a
separated voice, else null). Turns: what ``reading.reading_turns`` gives, as far
as their receipts still hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators import review
from parley.operators.transcript import cleaned, label, timestamp

KEY = "recording_id"
#: Bytes that an export may have.
LARGEST = 16 << 20
#: What stands before the times of a turn (fixed values).
COARSE, UNTIMED = "Coarse timing ", "Timing unknown; parent audio "
#: Names of the two voices of a separated passage (fixed values).
VOICES = ("Voice A", "Voice B")


def written() -> Column:
    """Neither deleted nor without words."""
    return ~F.coalesce(F.col("deleted"), F.lit(False)) & F.col("text").rlike(r"(?U)\S")


def canonical(passages: DataFrame) -> list[Column]:
    """The order of passages: start, end, then rows of a named source by source and id, separated rows by episode and channel, and as they came.

    capture_source, episode, channel and pos count where the table has them.
    """
    have = set(passages.columns)
    keys = [F.col("start_sample"), F.col("end_sample")]
    if "capture_source" in have:
        ranked = F.col("capture_source").isin("microphone_clean", "system")
        keys += [F.when(ranked, F.col("capture_source")).otherwise(""), F.when(ranked, F.col("passage_id")).otherwise("")]
    keys += [F.col(c).asc_nulls_first() for c in ("episode", "channel") if c in have]
    return [*keys, *(F.col(c) for c in ("pos",) if c in have), F.col("passage_id")]


def ordered(passages: DataFrame) -> DataFrame:
    """``passages`` with place, their number from 1 in canonical order."""
    return passages.withColumn("place", F.row_number().over(Window.partitionBy(KEY).orderBy(*canonical(passages))))


def rows(passages: DataFrame, speakers: DataFrame, turns: DataFrame, kind: str) -> DataFrame:
    """(recording_id, place, n, label, marked, start_sample, end_sample, prefix): what is written, one row a passage or turn.

    A passage with turns is written as its turns: in a TXT always, in subtitles
    if each of them is attributed. Turns without times take the passage's.
    ``turns`` are rows, or gathered as ``reading.standing`` gives them.
    """
    if "turns" in turns.columns:
        per = turns.select(KEY, "passage_id", F.forall("turns", lambda t: t["attribution"] != "unknown").alias("_known"), F.col("turns").alias("_turns"))
    else:
        whole = F.array_sort(F.collect_list(F.struct("n", "text", "speaker", "attribution", "start_sample", "end_sample")))
        per = turns.groupBy(KEY, "passage_id").agg(F.bool_and(F.col("attribution") != "unknown").alias("_known"), whole.alias("_turns"))
    joined = ordered(passages).where(written()).join(per, [KEY, "passage_id"], "left")
    used = F.col("_turns") if kind == "txt" else F.when(F.col("_known"), F.col("_turns"))
    each = joined.withColumn("_t", F.explode_outer(used))
    is_turn = F.col("_t").isNotNull()
    own = {c: F.coalesce(F.col(f"_t.{c}"), F.col(c)) for c in ("text", "speaker", "start_sample", "end_sample")}
    each = each.withColumns(own | {"n": F.coalesce("_t.n", F.lit(0)), "prefix": F.when(~is_turn, "").when(F.col("_t.attribution") != "unknown", COARSE).otherwise(UNTIMED)})
    named = each.join(speakers.select(KEY, "speaker", F.col("name").alias("_name")), [KEY, "speaker"], "left")
    voice = F.when(F.col("speaker").isin("unknown", "unassigned") & F.col("separated"), F.element_at(F.array(*map(F.lit, VOICES)), F.col("channel").cast("int") + 1))
    return named.select(KEY, "place", "n", F.coalesce(voice, F.col("_name"), label(F.col("speaker"))).alias("label"), review.marked().alias("marked"), "start_sample", "end_sample", "prefix")


def text_lines(found: DataFrame) -> DataFrame:
    """rows() with line: ``[start – end] label: text``."""
    return found.withColumn("line", F.concat(F.lit("["), "prefix", timestamp(F.col("start_sample"), "."), F.lit(" – "), timestamp(F.col("end_sample"), "."), F.lit("] "), "label", F.lit(": "), "marked", F.lit("\n")))


def cues(found: DataFrame, mark: str = ",") -> DataFrame:
    """rows() with cue, numbered within a recording, and line, the cue's text."""
    cue = F.row_number().over(Window.partitionBy(KEY).orderBy("place", "n")).cast("long")
    times = F.concat(timestamp(F.col("start_sample"), mark), F.lit(" --> "), timestamp(F.col("end_sample"), mark))
    text = F.concat(cleaned(F.col("label")), F.lit(": "), cleaned(F.col("marked")))
    return found.withColumn("cue", cue).withColumn("line", F.concat(F.col("cue").cast("string"), F.lit("\n"), times, F.lit("\n"), text, F.lit("\n\n")))


def export(passages: DataFrame, speakers: DataFrame, turns: DataFrame, recordings: DataFrame, kind: str) -> DataFrame:
    """(recording_id, body, bytes, allowed) for every row of ``recordings``; kind is txt, srt or vtt.

    Sizes are summed up first: a body over LARGEST is never put together, it
    is null and not allowed. A recording with nothing to write has one empty
    line, or a VTT's head alone.
    """
    found = rows(passages, speakers, turns, kind)
    lines = text_lines(found) if kind == "txt" else cues(found, "." if kind == "vtt" else ",")
    head = "WEBVTT\n\n" if kind == "vtt" else ""
    size = F.sum(F.octet_length("line")).over(Window.partitionBy(KEY)) + len(head)
    kept = lines.withColumn("bytes", size.cast("long")).withColumn("line", F.when(F.col("bytes") <= LARGEST, F.col("line")))
    inside = F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("place", "n", "line"))))
    bodies = kept.groupBy(KEY).agg(F.max("bytes").alias("bytes"), F.array_join(F.transform(inside, lambda x: x["line"]), "").alias("body"))
    nothing = head or "\n"
    out = recordings.select(KEY).join(bodies, KEY, "left").withColumn("bytes", F.coalesce("bytes", F.lit(len(nothing)).cast("long")))
    allowed = F.col("bytes") <= LARGEST
    body = F.when(allowed, F.concat(F.lit(head), "body"))
    return out.select(KEY, F.when(allowed, F.coalesce(body, F.lit(nothing))).alias("body"), "bytes", allowed.alias("allowed"))
