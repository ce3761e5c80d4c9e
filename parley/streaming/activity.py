"""Who speaks when, as it becomes known: only what was newly observed is swept, and the last region stays open.

Rows of a stream (ROWS): turns (speaker, start, end), marks up to where the
speakers were observed, and the end. What was observed doesn't change: of a
turn that comes after its time, only the part beyond the mark counts. Batch
twin: ``activity_regions``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parley.operators.intervals import KEY, coalesce_equal, elementary
from parley.streaming.gather import gathered, spread

#: kind: turn, observed or end. observed and end have end_sample; ``at`` is when a row came.
ROWS = f"{KEY} long, source_id string, kind string, speaker string, start_sample long, end_sample long, at timestamp"
OUT = f"{KEY} long, source_id string, start_sample long, end_sample long, owners string, final boolean"
FOUND = Row(*(c.split()[0] for c in OUT.split(", ")))
#: What the operator reads of a row; ``at`` in milliseconds.
TAKEN = ("kind", "speaker", "start_sample", "end_sample", "at")
#: A source without rows for so long (event time) is taken to have ended, in milliseconds.
IDLE = 60_000


def sweep(turns: list[tuple[str, int, int]], start: int, end: int) -> list[tuple[int, int, str]]:
    """Regions of one set of speakers between start and end, in order; equal neighbours are one."""
    events: dict[int, list[tuple[str, int]]] = {start: [], end: []}
    for speaker, a, z in turns:
        a, z = max(a, start), min(z, end)
        if a < z:
            events.setdefault(a, []).append((speaker, 1))
            events.setdefault(z, []).append((speaker, -1))
    active: dict[str, int] = {}
    found: list[tuple[int, int, str]] = []
    before = start
    for at in sorted(events):
        if before < at:
            owners = ",".join(sorted(active))
            if found and found[-1][2] == owners:
                found[-1] = (found[-1][0], at, owners)
            else:
                found.append((before, at, owners))
        for speaker, n in events[at]:
            active[speaker] = active.get(speaker, 0) + n
            if not active[speaker]:
                del active[speaker]
        before = at
    return found


class Activity(StatefulProcessor):
    """State per recording and source, read and written once a micro-batch: the mark, the open region, the timer, and the turns that reach beyond the mark (as JSON)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "observed long, first long, last long, owners string, closed boolean, timer long, turns string")

    def read(self) -> tuple[int, list, bool, int, list]:
        kept = self.kept.get()
        observed, first, last, owners, closed, timer, turns = kept if kept is not None else (0, 0, 0, "", False, -1, "[]")
        return observed, [(first, last, owners)] if last > first else [], closed, timer, json.loads(turns)

    def write(self, mark: int, regions: list, closed: bool, timer: int, turns: list) -> None:
        self.kept.update((mark, *(regions[-1] if regions else (0, 0, "")), closed, timer, json.dumps(turns)))

    def rows(self, key, regions: list, final: bool, tail: bool) -> Iterator[Row]:
        """The regions as rows; the last one is open unless ``final``."""
        for k, (a, z, owners) in enumerate(regions):
            known = final or k + 1 < len(regions)
            if tail or known:
                yield FOUND(key[0], key[1], a, z, owners, known)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        observed, regions, closed, timer, turns = self.read()
        if closed:
            return iter(())
        mark, ended, latest = observed, False, 0
        for kind, speaker, a, z, at in spread(rows, *TAKEN):
            latest = max(latest, at or 0)
            if z is None:
                continue
            if kind == "turn" and a is not None and speaker is not None:
                turns.append((speaker, a, z))
            elif kind in ("observed", "end"):
                mark, ended = max(mark, z), ended or kind == "end"
        for region in sweep(turns, observed, mark):
            if regions and regions[-1][2] == region[2]:
                regions[-1] = (regions[-1][0], region[1], region[2])
            else:
                regions.append(region)
        due = -1 if ended else max(latest, timerValues.getCurrentWatermarkInMs()) + IDLE
        if due != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            if due >= 0:
                self.handle.registerTimer(due)
        self.write(mark, regions, ended, due, [x for x in turns if x[2] > mark])
        return self.rows(key, regions, ended, mark > observed or ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        observed, regions, closed, _, _ = self.read()
        if closed:
            return iter(())
        self.write(observed, regions, True, -1, [])
        return self.rows(key, regions, True, True)

    def close(self) -> None:
        pass


def live(rows: DataFrame) -> DataFrame:
    """Streaming ``rows`` (ROWS, with a watermark on ``at``) to OUT, in update mode: each final region once, and the open one as it stands.

    Needs the RocksDB state store (``sources.use_rocksdb``). Rows come gathered by recording and source. The watermark sets
    the timers; a row behind it isn't dropped, it counts beyond the mark as any other, unless its source has ended.
    """
    taken = rows.where(F.col(KEY).isNotNull()).withColumn("at", F.unix_millis("at"))
    return gathered(taken.select(KEY, "source_id", *TAKEN), KEY, "source_id").groupBy(KEY, "source_id").transformWithState(Activity(), OUT, "Update", "EventTime")


def activity_regions(turns: DataFrame, observed: DataFrame) -> DataFrame:
    """(recording_id, start_sample, end_sample, owners): regions from 0 to what was observed (recording_id, end_sample); nobody's too.

    turns may have known_from, the mark when a turn came: what lies before it doesn't count.
    """
    if "known_from" in turns.columns:
        turns = turns.withColumn("start_sample", F.greatest("start_sample", "known_from"))
    upto = observed.groupBy(KEY).agg(F.max("end_sample").alias("upto")).where("upto > 0")
    inside = turns.join(upto, KEY).select(KEY, "speaker", F.greatest(F.lit(0), "start_sample").alias("start_sample"), F.least("end_sample", "upto").alias("end_sample")).where("start_sample < end_sample")
    # a speaker that sorts last and is there all the time gives the bounds at either end
    ground = upto.select(KEY, F.lit("~").alias("speaker"), F.lit(0).cast("long").alias("start_sample"), F.col("upto").alias("end_sample"))
    cells = elementary(inside.unionByName(ground)).withColumn("owners", F.regexp_replace("owners", ",?~$", ""))
    return coalesce_equal(cells)


def closed_regions(found: DataFrame) -> DataFrame:
    """The final regions of a replay, each once."""
    w = Window.partitionBy(KEY, "source_id", "start_sample").orderBy("batch")
    return found.where("final").withColumn("_n", F.row_number().over(w)).where("_n = 1").select(KEY, "source_id", "start_sample", "end_sample", "owners")
