"""Audio packets of a recording as tiles, half a second behind its clock; what comes too late is told apart and moves the repair point back.

A packet has the recording's clock when it came (milliseconds since its
start). Before a packet is placed, all whole tiles half a second behind the
clock are written, with silence where nothing came. Of a packet that begins
before the written part, that part is late: it goes to a side output, and
everything derived from its tile on must be made anew. Batch twins: ``late``,
``repairs`` and ``tiles``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import inf

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parley.streaming.gather import gathered, packed, spread, unpacked

KEY = "recording_id"
TILE, DELAY_MS, SAMPLES_PER_MS = 4_000, 500, 16
#: ``at`` is the packet's clock as event time; an end row (ended) has neither source nor samples.
PACKETS = f"{KEY} long, source_id string, start_sample long, frames long, clock_ms long, ended boolean, at timestamp"
#: kind: tile (samples: those that are silence), late (samples: those that came too late) or repair (start_sample: the point now).
OUT = f"{KEY} long, kind string, source_id string, start_sample long, samples long"
#: What is taken of a packet, and a row of OUT.
TAKEN = ("clock_ms", "ended", "start_sample", "source_id", "frames")
FOUND = Row(*(c.split()[0] for c in OUT.split(", ")))
#: The sources that a tile holds (fixed values).
SOURCES = ("microphone_clean", "system")


def missing(parts: list[tuple[int, int]], start: int, end: int) -> int:
    """Samples of a span that none of the parts covers."""
    left, at = 0, start
    for a, z in sorted(parts):
        left += max(0, min(a, end) - at)
        at = max(at, min(z, end))
    return left + max(0, end - at)


class Writer(StatefulProcessor):
    """State per recording, as one value: what is written, the clock, the repair point, and the parts (source, tile, start, end) of tiles that aren't written yet."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "written long, clock long, repair long, ended boolean, parts binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        written, clock, repair, ended, parts = self.kept.get() or (0, 0, -1, False, b"")
        kept: dict[tuple[str, int], list[tuple[int, int]]] = {}
        for s, tile, a, z in unpacked(parts, 4):
            kept.setdefault((SOURCES[s], tile), []).append((a, z))
        out = []

        def write(upto: int, final: bool) -> int:
            at = written
            while at < upto:
                stop = min(upto, (at // TILE + 1) * TILE) if final else at + TILE
                out.extend((key[0], "tile", s, at, missing(kept.pop((s, at // TILE), []), at, stop)) for s in SOURCES)
                at = stop
            return at

        # in the order of the clock, so that a micro-batch doesn't decide what is late
        packets = sorted(spread(rows, *TAKEN), key=lambda r: (inf if r[0] is None else r[0], bool(r[1]), inf if r[2] is None else r[2], r[3] is None, r[3] or ""))
        for ms, last, start, source, n in packets:
            if ended or ms is None:
                continue
            clock = max(clock, ms)
            if last:
                written, ended = write(clock * SAMPLES_PER_MS, True), True
                continue
            written = write(max(0, clock - DELAY_MS) * SAMPLES_PER_MS // TILE * TILE, False)
            if start is None or n is None or n <= 0 or source not in SOURCES:
                continue
            end = start + n
            late = min(end, max(start, written)) - start
            if late > 0:
                out.append((key[0], "late", source, start, late))
                point = start // TILE * TILE
                if repair < 0 or point < repair:
                    repair = point
                    out.append((key[0], "repair", None, repair, 0))
            for tile in range((start + late) // TILE, -(-end // TILE)):
                a, z = max(start + late, tile * TILE), min(end, (tile + 1) * TILE)
                if a < z:
                    kept.setdefault((source, tile), []).append((a, z))
        left = packed((SOURCES.index(s), tile, a, z) for (s, tile), spans in kept.items() for a, z in spans)
        self.kept.update((written, clock, repair, ended, left))
        return iter([FOUND(*found) for found in out])

    def close(self) -> None:
        pass


def live(packets: DataFrame) -> DataFrame:
    """Streaming ``packets`` (PACKETS) to OUT, in update mode. Needs the RocksDB state store (``sources.use_rocksdb``).

    The watermark is half a second behind the packets' clock, as the tiles
    are; what Spark itself drops behind it would have been late here too.
    """
    return gathered(packets.where(F.col(KEY).isNotNull()).select(KEY, *TAKEN), KEY).groupBy(KEY).transformWithState(Writer(), OUT, "Update", "None")


def written(clock: Column) -> Column:
    """What is written when the clock (milliseconds) stands there."""
    return F.floor(F.greatest(F.lit(0), clock - DELAY_MS) * SAMPLES_PER_MS / TILE).cast("long") * TILE


def late(packets: DataFrame) -> DataFrame:
    """``packets`` with late, the number of their samples that came too late."""
    order = Window.partitionBy(KEY).orderBy("clock_ms", "start_sample", "source_id").rowsBetween(Window.unboundedPreceding, 0)
    now = written(F.max("clock_ms").over(order))
    return packets.withColumn("late", F.least(F.col("frames"), F.greatest(F.lit(0), now - F.col("start_sample"))).cast("long"))


def repairs(packets: DataFrame) -> DataFrame:
    """(recording_id, late, repaired_from): packets with late samples, and the tile from which derived data must be made anew."""
    return late(packets).where("late > 0").groupBy(KEY).agg(F.count("*").alias("late"), F.min(F.floor(F.col("start_sample") / TILE).cast("long") * TILE).alias("repaired_from"))


def tiles(packets: DataFrame, ends: DataFrame) -> DataFrame:
    """(recording_id, source_id, start_sample, samples): all tiles up to the end (recording_id, clock_ms), and their samples of silence."""
    upto = ends.select(KEY, (F.col("clock_ms") * SAMPLES_PER_MS).alias("upto"))
    grid = upto.where("upto > 0").select(KEY, "upto", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("upto") - 1) / TILE).cast("long"))).alias("tile")).withColumn("source_id", F.explode(F.array(*map(F.lit, SOURCES))))
    placed = late(packets).withColumns({"a": F.col("start_sample") + F.col("late"), "z": F.col("start_sample") + F.col("frames")}).where("a < z")
    parts = placed.select(KEY, "source_id", "a", "z", F.explode(F.sequence(F.floor(F.col("a") / TILE).cast("long"), F.floor((F.col("z") - 1) / TILE).cast("long"))).alias("tile"))
    w = Window.partitionBy(KEY, "source_id", "tile").orderBy("a", "z")
    low, high = F.greatest("a", F.col("tile") * TILE), F.least("z", (F.col("tile") + 1) * TILE)
    cut = parts.join(upto, KEY).withColumns({"a": low, "z": F.least(high, "upto")}).where("a < z")
    seen = cut.withColumn("reach", F.coalesce(F.max("z").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("a")))
    covered = seen.groupBy(KEY, "source_id", "tile").agg(F.sum(F.greatest(F.lit(0), F.col("z") - F.greatest("a", "reach"))).alias("covered"))
    size = F.least(F.lit(TILE), F.col("upto") - F.col("tile") * TILE)
    return grid.join(covered, [KEY, "source_id", "tile"], "left").select(KEY, "source_id", (F.col("tile") * TILE).alias("start_sample"), (size - F.coalesce("covered", F.lit(0))).cast("long").alias("samples"))
