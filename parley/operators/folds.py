"""Rules whose next step depends on the last result: one ordered pass over the rows of a recording, or of a span.

A recording's rows come to one task, as its length bounds them; recordings are
spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "recording_id"
#: Longest interruption that is bridged (0.65 s), in samples.
INTERRUPTION = 10_400
#: Cut plans: longest and shortest core (20 s, 6 s), reach of a cut (1 s), shortest silent gap.
CAP, LEAST, RADIUS, GAP = 320_000, 96_000, 16_000, 2_048
#: Echo delays: samples of a jump, matches that confirm one, matches kept; largest slope and error of a drift.
JUMP, CONFIRM, KEPT = 48.0, 3, 12
SLOPE, ERROR = 0.0005, 0.6


def bridge(rows: list[tuple[int, int, str]]) -> list[tuple[int, int, str, int]]:
    """(start, end, speakers, parts) of envelopes from (start, end, owners comma-joined) in order.

    A single owner's region goes on over a middle region of at most 0.65 s,
    empty or an overlap with that owner, if the owner's next one follows.
    """
    out, i = [], 0
    while i < len(rows):
        start, end, owner = rows[i]
        speakers, parts, i = set(filter(None, owner.split(","))), 1, i + 1
        while i + 1 < len(rows) and owner and "," not in owner:
            a, z, middle = rows[i]
            b, stop, following = rows[i + 1]
            others = middle.split(",")
            if (middle and (len(others) < 2 or owner not in others)) or following != owner or z - a > INTERRUPTION or a != end or b != z:
                break
            end, parts, i = stop, parts + 2, i + 2
            speakers |= set(filter(None, others))
        out.append((start, end, ",".join(sorted(speakers)), parts))
    return out


def decode_regions(cells: DataFrame) -> DataFrame:
    """Envelopes of coalesced cells (recording_id, start_sample, end_sample, owners), short interruptions bridged."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("start_sample", kind="stable")
        found = bridge(list(b[["start_sample", "end_sample", "owners"]].itertuples(index=False, name=None)))
        return pd.DataFrame(found, columns=["start_sample", "end_sample", "speakers", "parts"]).assign(**{KEY: b[KEY].iloc[0]})[[KEY, "start_sample", "end_sample", "speakers", "parts"]]

    return cells.groupBy(KEY).applyInPandas(run, f"{KEY} long, start_sample long, end_sample long, speakers string, parts long")


def earliest_end(clips: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """The first ``least`` clips by end, then start, that don't overlap the one taken before; none if there are fewer."""
    chosen, last = [], -1
    for start, end in sorted(clips, key=lambda c: (c[1], c[0])):
        if start >= last:
            chosen.append((start, end))
            last = end
            if len(chosen) == least:
                return chosen
    return []


def chosen_clips(clips: DataFrame, least: int = 3) -> DataFrame:
    """Recommended clips of each recording: ``least`` disjoint ones, or none."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        found = earliest_end(list(b[["start_sample", "end_sample"]].itertuples(index=False, name=None)), least)
        return pd.DataFrame(found, columns=["start_sample", "end_sample"]).assign(**{KEY: b[KEY].iloc[0]})[[KEY, "start_sample", "end_sample"]]

    return clips.groupBy(KEY).applyInPandas(run, f"{KEY} long, start_sample long, end_sample long")


def cut_plan(start: int, end: int, gaps: list[tuple[int, int, bool]]) -> list[tuple[int, bool]]:
    """Where a span is cut into nearly equal cores of 6 to 20 s, and whether a verified silent gap (start, end, verified) moved the cut.

    Of the gaps within 1 s of a target the three nearest are tried, and the
    first verified one takes the cut to its middle.
    """
    count = max(1, -(-(end - start) // CAP))
    cuts, last = [], start
    for i in range(1, count):
        left = count - i
        low, high = max(last + LEAST, end - left * CAP), min(last + CAP, end - left * LEAST)
        aim = start + (end - start) * i // count
        target = min(max(aim, low), high)
        near = sorted((abs((a + z) // 2 - target), (a + z) // 2, sure) for a, z, sure in gaps if z - a >= GAP and low <= (a + z) // 2 <= high and abs((a + z) // 2 - aim) <= RADIUS)
        last, moved = next(((middle, True) for _, middle, sure in near[:3] if sure), (target, False))
        cuts.append((last, moved))
    return cuts


def cut_plans(spans: DataFrame) -> DataFrame:
    """(recording_id, start_sample, end_sample, cut, moved) for spans with an array ``gaps`` of (a, z, sure)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, s, e, cut, moved) for k, s, e, gaps in b[[KEY, "start_sample", "end_sample", "gaps"]].itertuples(index=False) for cut, moved in cut_plan(s, e, [(g["a"], g["z"], g["sure"]) for g in gaps])]
            yield pd.DataFrame(rows, columns=[KEY, "start_sample", "end_sample", "cut", "moved"])

    return spans.select(KEY, "start_sample", "end_sample", "gaps").mapInPandas(run, f"{KEY} long, start_sample long, end_sample long, cut long, moved boolean")


def regimes(matches: list[tuple[float, float]]) -> list[tuple[int, int]]:
    """After each match (centre, delay): how many are kept, and how many changes of regime there were.

    A jump over 48 samples waits for three matches that agree with one another;
    these then replace what was kept. Otherwise the last twelve are kept.
    """
    kept, waiting, changes, out = [], [], 0, []
    for match in matches:
        if kept and abs(match[1] - kept[-1][1]) > JUMP:
            if waiting and abs(match[1] - waiting[-1][1]) > JUMP:
                waiting = []
            waiting.append(match)
            if len(waiting) >= CONFIRM:
                kept, waiting, changes = waiting[-CONFIRM:], [], changes + 1
        else:
            waiting = []
            kept = [*kept, match][-KEPT:]
        out.append((len(kept), changes))
    return out


def regime_changes(matches: DataFrame) -> DataFrame:
    """(recording_id, n, kept, changes) after each match (recording_id, n, centre, delay) in order of n."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("n", kind="stable")
        found = pd.DataFrame(regimes(list(b[["centre", "delay"]].itertuples(index=False, name=None))), columns=["kept", "changes"])
        return pd.concat([b[[KEY, "n"]].reset_index(drop=True), found], axis=1)

    return matches.groupBy(KEY).applyInPandas(run, f"{KEY} long, n long, kept long, changes long")


def drift(matches: DataFrame) -> DataFrame:
    """(recording_id, slope, error, accepted): a common slope of delay over time, channels centred each by itself, of those with four matches or more."""
    by = [KEY, "channel"]
    mean = matches.groupBy(*by).agg(F.avg("centre").alias("t"), F.avg("delay").alias("d"), F.count("*").alias("n")).where("n >= 4")
    own = matches.join(mean, by).select(KEY, (F.col("centre") - F.col("t")).alias("t"), (F.col("delay") - F.col("d")).alias("d"))
    sums = own.groupBy(KEY).agg(F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("t") * F.col("d")).alias("td"), F.sum(F.col("d") * F.col("d")).alias("dd"), F.count("*").alias("n")).where("tt > 0")
    slope = F.col("td") / F.col("tt")
    error = F.sqrt(F.greatest(F.lit(0.0), F.col("dd") - F.col("td") * slope) / F.col("n"))
    return sums.select(KEY, slope.alias("slope"), error.alias("error"), ((F.abs(slope) <= SLOPE) & (error < ERROR)).alias("accepted"))


def smoothed(values: DataFrame) -> DataFrame:
    """The first value, then three quarters of what was and a quarter of the next, in order of n."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", F.col("value").cast("double").alias("value")))), lambda x: x["value"])
    out = values.groupBy(KEY).agg(ordered.alias("v"))
    return out.select(KEY, F.aggregate(F.slice("v", F.lit(2), F.greatest(F.size("v") - 1, F.lit(0))), F.col("v")[0], lambda s, x: s * 0.75 + x * 0.25).alias("smoothed"))
