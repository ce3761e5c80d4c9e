"""The main language of a recording and of its speakers, by votes of confident probes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = "recording_id"
VOTE = [KEY, "start_sample", "end_sample", "language", "speaker"]
WITNESSES = 2


def agreed(votes: DataFrame) -> DataFrame:
    """One row for each range whose votes name one language and one speaker (or none)."""
    said = F.struct("language", "speaker")
    one = votes.groupBy(KEY, "start_sample", "end_sample").agg(F.min(said).alias("least"), F.max(said).alias("most")).where("least <=> most")
    return one.select(KEY, "start_sample", "end_sample", "least.language", "least.speaker")


def first_disjoint(spans: list[tuple[int, int]]) -> list[bool]:
    """Of spans in order of start, then end: those that begin at or after the end of the last one kept."""
    out, through = [], -1
    for start, end in spans:
        out.append(start >= through)
        through = end if start >= through else through
    return out


def selected(votes: DataFrame) -> DataFrame:
    """The votes that count: agreed ones that don't overlap an earlier one. One ordered pass a recording, of a row each 3 s."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["start_sample", "end_sample"], kind="stable")
        return b[first_disjoint(list(b[["start_sample", "end_sample"]].itertuples(index=False, name=None)))]

    return agreed(votes).select(*VOTE).groupBy(KEY).applyInPandas(run, f"{KEY} long, start_sample long, end_sample long, language string, speaker string")


def choose(counted: DataFrame) -> DataFrame:
    """(recording_id, speaker, language, votes, witnesses) from selected votes; speaker is null for the whole recording.

    A language wins with two votes or more and over half of all. witnesses are
    its last two ranges as start-end, comma-joined, the later one first.
    """
    level = counted.withColumn("speaker", F.explode(F.array_distinct(F.array("speaker", F.lit(None).cast("string")))))
    by = [KEY, "speaker"]
    last = Window.partitionBy(*by, "language").orderBy(F.desc("start_sample"), F.desc("end_sample"))
    ranked = level.withColumn("place", F.row_number().over(last))
    shown = F.struct("place", F.concat_ws("-", "start_sample", "end_sample").alias("span"))
    own = ranked.groupBy(*by, "language").agg(F.count("*").alias("votes"), F.array_sort(F.collect_list(F.when(F.col("place") <= WITNESSES, shown))).alias("seen"))
    own = own.withColumn("all", F.sum("votes").over(Window.partitionBy(*by))).where(f"votes >= {WITNESSES} AND votes * 2 > all")
    return own.select(*by, "language", "votes", F.array_join(F.transform("seen", lambda x: x["span"]), ",").alias("witnesses"))


def main_language(votes: DataFrame) -> DataFrame:
    return choose(selected(votes))


def context_of(targets: DataFrame, chosen: DataFrame) -> DataFrame:
    """(recording_id, speaker, language, level): each target's own main language, else its recording's, else null."""
    own = chosen.where("speaker IS NOT NULL").select(KEY, "speaker", F.col("language").alias("own"))
    common = chosen.where("speaker IS NULL").select(KEY, F.col("language").alias("common"))
    level = F.when(F.col("own").isNotNull(), "speaker").when(F.col("common").isNotNull(), "recording")
    return targets.join(own, [KEY, "speaker"], "left").join(common, KEY, "left").select(KEY, "speaker", F.coalesce("own", "common").alias("language"), level.alias("level"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Votes that a replacement removes or adds (``change``); equal votes count once."""
    both = before.select(*VOTE, F.lit("removed").alias("change")).unionByName(after.select(*VOTE, F.lit("added").alias("change")))
    return both.groupBy(*VOTE).agg(F.min("change").alias("change"), F.max("change").alias("other")).where("change = other").drop("other")


def kept_up(chosen: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """main_language(after) from main_language(before): only recordings whose votes changed are counted again."""
    touched = changes(before, after).select(KEY).distinct()
    again = main_language(after.join(touched, KEY, "left_semi"))
    return chosen.join(touched, KEY, "left_anti").unionByName(again)
