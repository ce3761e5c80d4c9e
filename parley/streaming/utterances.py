"""Live utterances: speech frames in, open, sealed and rejected rows out, with state per recording.

Batch twin: ``operators.speech.utterances``. Sealed rows of a stream that was
ended equal it, however the frames were cut into micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parley.operators.speech import KEY, LEAD, OFF, ON, SILENCE
from parley.streaming.gather import gathered, spread
from parley.streaming.sources import use_rocksdb

FRAMES = f"{KEY} long, start_sample long, end_sample long, p100 long, constant_block boolean, ended boolean"
OUT = f"{KEY} long, kind string, n long, start_sample long, end_sample long, reason string"
#: What is taken of a frame, and a row of OUT.
TAKEN = ("start_sample", "end_sample", "p100", "constant_block", "ended")
FOUND = Row(*(c.split()[0] for c in OUT.split(", ")))
#: Longest frame in samples.
LONGEST = 512
#: cursor: samples observed so far; first and last: the open utterance (first is -1 when there is none).
STATE = "cursor long, speaking boolean, n long, first long, last long, closed boolean"


def fold(frames: list[tuple], values: tuple) -> tuple[list[tuple], tuple]:
    """One recording's new frames in order of their start; a frame that doesn't start at the cursor changes nothing.

    A micro-batch holds a bounded part of a recording (the source's files a trigger), and state is six values.
    Rows: each sealed utterance once, the open one as it now stands, and each
    rejected frame with its reason (closed, probability, length, late, gap or endpoint).
    """
    cursor, speaking, n, first, last, closed = values
    out = []
    for a, b, p, constant, ended in sorted(frames, key=lambda r: (r[0], r[4])):
        reason = None
        if closed:
            reason = "closed"
        elif a != cursor:
            reason = "endpoint" if ended else "late" if a < cursor else "gap"
        elif not ended and (p is None or not 0 <= p <= 100 or b is None or b <= a):
            reason = "probability"
        elif not ended and b - a > LONGEST:
            reason = "length"
        if reason:
            out.append(("rejected", None, a, b, reason))
            continue
        if ended:
            closed = True
            continue
        if not constant:
            speaking = True if p >= ON else False if p < OFF else speaking
        if speaking and not constant:
            if first < 0:
                first, n = a, n + 1
            last = b
        cursor = b
        # Silence long enough seals without waiting for the next speech.
        if first >= 0 and cursor - last >= SILENCE:
            out.append(("sealed", n, max(0, first - LEAD), last + LEAD, None))
            first = -1
    if first >= 0:
        kind = "sealed" if closed else "open"
        out.append((kind, n, max(0, first - LEAD), min(cursor, last + LEAD), None))
        first = -1 if closed else first
    return out, (cursor, speaking, n, first, last, closed)


class Utterances(StatefulProcessor):
    """State per recording: ``fold``'s six values."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        out, values = fold(spread(rows, *TAKEN), self.kept.get() or (0, False, 0, -1, -1, False))
        self.kept.update(values)
        return iter([FOUND(key[0], *found) for found in out])

    def close(self) -> None:
        pass


def live_utterances(frames: DataFrame) -> DataFrame:
    """Streaming ``frames`` (FRAMES) to OUT; run it in update mode.

    A row with ``ended`` closes a recording; its start must be the cursor. Null
    recordings and rows without a start are left out, as they have no place in any ledger.
    State is kept in RocksDB, which the session is set to.
    """
    use_rocksdb(frames.sparkSession)
    rows = frames.where(F.col(KEY).isNotNull() & F.col("start_sample").isNotNull())
    rows = rows.withColumn("ended", F.coalesce("ended", F.lit(False))).withColumn("constant_block", F.coalesce("constant_block", F.lit(False)))
    return gathered(rows.select(KEY, *TAKEN), KEY).groupBy(KEY).transformWithState(Utterances(), OUT, "Update", "None")


def end_rows(frames: DataFrame) -> DataFrame:
    """The control row that closes each recording at its last observed sample."""
    end = frames.groupBy(KEY).agg(F.max("end_sample").alias("start_sample"))
    return end.select(KEY, "start_sample", F.col("start_sample").alias("end_sample"), F.lit(0).cast("long").alias("p100"), F.lit(False).alias("constant_block"), F.lit(True).alias("ended"))
