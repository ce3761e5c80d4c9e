"""Passages: validation, review, rendering, search, introductions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "recording_id"
RATE = 16_000
LONGEST_TEXT = 20_000


def timestamp(samples: Column, mark: str = ",") -> Column:
    """HH:MM:SS and milliseconds, half even; hours aren't wrapped."""
    ms = F.rint(samples * 1000 / RATE).cast("long")
    part = lambda unit, size, mod: F.lpad((F.floor(ms / unit) % mod).cast("string"), size, "0")
    hours = F.floor(ms / 3_600_000).cast("string")
    return F.concat(F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours), F.lit(":"), part(60_000, 2, 60), F.lit(":"), part(1000, 2, 60), F.lit(mark), part(1, 3, 1000))


def label(speaker: Column) -> Column:
    """The name of a speaker without an entry in the document's speaker map."""
    return F.when(speaker == "unassigned", "Unknown speaker").otherwise("Overlapping speakers")


def named(passages: DataFrame, speakers: DataFrame) -> DataFrame:
    """``passages`` with label: the name in the document's speaker map (recording_id, speaker, name), else as ``label`` says."""
    return passages.join(speakers.select(KEY, "speaker", F.col("name").alias("label")), [KEY, "speaker"], "left").withColumn("label", F.coalesce("label", label(F.col("speaker"))))


def cleaned(text: Column) -> Column:
    """One line of subtitle text: white space collapsed, arrows and angle brackets replaced."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.translate(F.replace(flat, F.lit("-->"), F.lit("→")), "<>", "‹›")


def validate(passages: DataFrame, durations: DataFrame) -> DataFrame:
    """violations of each passage, sorted and comma-joined; empty if it is valid."""
    p = passages.join(durations, KEY, "left")
    many = F.count("*").over(Window.partitionBy(KEY, "passage_id")) > 1
    rules = [
        F.when((F.col("start_sample") < 0) | (F.col("start_sample") >= F.col("end_sample")), "bad_range"),
        F.when(F.col("end_sample") > F.col("duration") + 16, "past_end"),
        F.when(many, "duplicate_id"),
        F.when(F.length("text") > LONGEST_TEXT, "long_text"),
        F.when(F.trim("text") == "", "empty_text"),
    ]
    return p.select(KEY, "passage_id", F.array_join(F.array_sort(F.array_compact(F.array(*rules))), ",").alias("violations"))


def continuation(passages: DataFrame) -> DataFrame:
    """Whether a passage goes on with the speaker of the one before: one known speaker, neither passage separated."""
    w = Window.partitionBy(KEY).orderBy("start_sample", "end_sample", "passage_id")
    same = (F.lag("speaker").over(w) == F.col("speaker")) & ~F.col("speaker").isin("unassigned", "multiple_speakers") & ~F.col("separated") & ~F.lag("separated").over(w)
    return passages.select(KEY, "passage_id", F.coalesce(same, F.lit(False)).alias("continues"))


def search(passages: DataFrame, words: str) -> DataFrame:
    """Passages (with label) whose text or speaker label holds ``words``, without regard to case."""
    return passages.where(F.contains(F.lower(F.concat_ws(" ", "text", "label")), F.lit(words.lower()))).select(KEY, "passage_id")


#: An introduction: a greeting or none, then a name of up to three words (fixed patterns).
WORD = r"[\p{L}\p{M}\p{Nl}]+(?:[-’'][\p{L}\p{M}\p{Nl}]+)*"
INTRODUCTION = rf"^(?:(?i:hi|hello|hey)[,!]?\s+)?(?i:i['’]m|i am|my name is)\s+({WORD}(?:\s+{WORD}){{0,2}})"
LEADING = r"^(\p{Lu}\S*(?:\s+\p{Lu}\S*)*)"


def introduced_name(text: Column) -> Column:
    """The leading capitalised words of the name with which a text introduces someone; empty without one."""
    raw = F.regexp_extract(F.trim(text), INTRODUCTION, 1)
    return F.regexp_replace(F.regexp_extract(raw, LEADING, 1), r"\s+", " ")


def introductions(passages: DataFrame) -> DataFrame:
    """The first introduced name of each single speaker."""
    found = passages.where("speaker NOT IN ('unassigned', 'multiple_speakers') AND speaker NOT LIKE 'overlap%'").withColumn("name", introduced_name(F.col("text"))).where("name <> ''")
    first = F.row_number().over(Window.partitionBy(KEY, "speaker").orderBy("start_sample", "pos"))
    return found.withColumn("n", first).where("n = 1").select(KEY, "speaker", "passage_id", "name")
