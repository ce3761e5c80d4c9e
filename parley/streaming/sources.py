"""Live recordings of two sources: utterances with language epochs, as far as both speech and speakers were observed.

Two streams, microphone and system, become one, keyed by recording and source.
Rows of a stream (ROWS) are frames of the speech model, marks up to where the
speakers were observed (heard), language boundaries and the end. A source is
processed to the least of what its frames and its speakers reach, and the
watermark of the whole stream is that of its slower input. Rows may come in
any order and in any micro-batch: what can't be used yet waits in state.
Batch twin: ``operators.speech.utterances_by_epoch``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import inf

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parley.operators.speech import KEY, LEAD, OFF, ON, SILENCE
from parley.streaming.gather import gathered, packed, spread, unpacked

#: kind: frame, heard, boundary or end. heard has end_sample, boundary start_sample and epoch, end its start_sample; ``at`` is when a row came.
ROWS = f"{KEY} long, source_id string, kind string, start_sample long, end_sample long, p100 long, constant_block boolean, epoch long, at timestamp"
OUT = f"{KEY} long, source_id string, kind string, n long, epoch long, start_sample long, end_sample long, processed long, reason string"
#: The two sources in their order (fixed values).
SOURCES = ("microphone_clean", "system")
#: Longest frame; an open utterance is put out from this length on, and again after this advance, in samples.
LONGEST, FIRST_LENGTH, ADVANCE = 512, 96_000, 32_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BOOK = ("cursor", "speaking", "n", "first", "last", "epoch", "epoch_start", "heard", "end", "closed", "shown")
#: What is taken of a row, and a row of OUT.
TAKEN = ("start_sample", "end_sample", "p100", "kind", "constant_block", "epoch")
FOUND = Row(*(c.split()[0] for c in OUT.split(", ")))


def by_place(row: tuple) -> list[float]:
    """Start, end and probability, nulls last."""
    return [inf if x is None else x for x in row[:3]]


class Book:
    """One source's utterances: ``cursor`` is what was processed; an utterance is open while first >= 0."""

    def __init__(self, values: tuple | None):
        values = values or (0, False, 0, -1, -1, 0, 0, 0, -1, False, -1)
        self.__dict__.update(zip(BOOK, values, strict=True))
        self.out: list[tuple] = []

    def values(self) -> tuple:
        return tuple(getattr(self, x) for x in BOOK)

    def begin(self) -> int:
        return max(self.epoch_start, self.first - LEAD)

    def put(self, kind: str, n: int | None, start: int | None, end: int | None, reason: str | None = None) -> None:
        self.out.append((kind, n, self.epoch, start, end, self.cursor, reason))

    def seal(self) -> None:
        if self.first >= 0:
            self.put("sealed", self.n, self.begin(), min(self.cursor, self.last + LEAD))
            self.first = self.shown = -1

    def observe(self, end: int, p: int, constant: bool) -> None:
        """The samples from the cursor to ``end``, judged alike."""
        start, self.cursor = self.cursor, end
        if not constant:
            self.speaking = True if p >= ON else False if p < OFF else self.speaking
        if self.speaking and not constant:
            if self.first < 0:
                self.first, self.n = start, self.n + 1
            self.last = end
        elif self.first >= 0 and self.cursor - self.last >= SILENCE:
            self.seal()

    def advance(self, waiting: dict[int, tuple], boundaries: dict[int, int]) -> None:
        """Uses up the waiting frames as far as frames, speakers and boundaries allow; a boundary inside a frame cuts it."""
        while not self.closed:
            boundary = boundaries.get(self.epoch + 1)
            if boundary is not None and boundary <= self.cursor:
                if boundary < self.cursor:
                    self.put("rejected", None, boundary, None, "boundary")
                    del boundaries[self.epoch + 1]
                    continue
                self.seal()
                del boundaries[self.epoch + 1]
                self.epoch, self.epoch_start = self.epoch + 1, self.cursor
                continue
            if self.cursor == self.end:
                self.seal()
                self.closed = True
                break
            # after the end of the recording nothing more is heard, so speech alone counts
            most = self.heard if self.end < 0 else self.end
            if boundary is not None:
                most = min(most, boundary)
            frame = waiting.get(self.cursor)
            if frame is None or most <= self.cursor:
                break
            end, p, constant = waiting.pop(self.cursor)
            if end > most:
                waiting[most] = (end, p, constant)
                end = most
            self.observe(end, p, constant)

    def provisional(self) -> None:
        """The open utterance, once it is long enough and then whenever it has grown by ADVANCE."""
        end = min(self.cursor, self.last + LEAD)
        if self.first >= 0 and (end - self.begin() >= FIRST_LENGTH if self.shown < 0 else end - self.shown >= ADVANCE):
            self.put("open", self.n, self.begin(), end)
            self.shown = end


class Runtime(StatefulProcessor):
    """State per recording and source, as one value: the book's values, frames that wait by their start, and boundaries to come by their epoch.

    Each call of a state variable asks the JVM, so state is read and written
    once a micro-batch, with the waiting frames and boundaries as packed longs.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "cursor long, speaking boolean, n long, first long, last long, epoch long, epoch_start long, heard long, end long, closed boolean, shown long, waiting binary, boundaries binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = self.kept.get()
        book = Book(tuple(kept[: len(BOOK)]) if kept else None)
        waiting = {start: (end, p, bool(constant)) for start, end, p, constant in unpacked(kept[-2], 4)} if kept else {}
        boundaries = dict(unpacked(kept[-1], 2)) if kept else {}
        for r in sorted(spread(rows, *TAKEN), key=by_place):
            self.take(book, waiting, boundaries, *r)
        book.advance(waiting, boundaries)
        book.provisional()
        self.kept.update((*book.values(), packed((k, *v) for k, v in waiting.items()), packed(boundaries.items())))
        return iter([FOUND(*key, *found) for found in book.out])

    @staticmethod
    def take(book: Book, waiting: dict[int, tuple], boundaries: dict[int, int], start: int | None, end: int | None, p: int | None, kind: str, constant: bool | None, epoch: int | None) -> None:
        """Adds a row to what waits, or rejects it with a reason: closed, invalid, late, repeated, boundary or endpoint."""
        reason = None
        if book.closed:
            reason = "closed"
        elif kind == "heard":
            book.heard = max(book.heard, end or 0)
        elif kind == "boundary":
            if start is None or epoch is None or epoch <= book.epoch or start < book.cursor or epoch in boundaries:
                reason = "boundary"
            else:
                boundaries[epoch] = start
        elif kind == "end":
            if start is None or start < book.cursor or book.end >= 0:
                reason = "endpoint"
            else:
                book.end = start
        elif kind != "frame" or start is None or end is None or p is None or not 0 <= p <= 100 or not 0 < end - start <= LONGEST:
            reason = "invalid"
        elif start < book.cursor:
            reason = "late"
        elif start in waiting:
            reason = "repeated"
        else:
            waiting[start] = (end, p, bool(constant))
        if reason:
            book.put("rejected", None, start, end, reason)

    def close(self) -> None:
        pass


def both_sources(microphone: DataFrame, system: DataFrame) -> DataFrame:
    """One stream of two: rows get the name of their source; boundaries and ends without a source (null) go to both."""
    named = microphone.withColumn("source_id", F.lit(SOURCES[0])).unionByName(system.withColumn("source_id", F.lit(SOURCES[1])))
    return named.where(F.col(KEY).isNotNull())


def for_both(rows: DataFrame) -> DataFrame:
    """A row for each source: what is said of a whole recording, its boundaries and its end."""
    return rows.drop("source_id").withColumn("source_id", F.explode(F.array(*map(F.lit, SOURCES))))


def live(rows: DataFrame) -> DataFrame:
    """Streaming ``rows`` (ROWS) to OUT, in update mode: sealed utterances once, open ones when they are due, and rejected rows.

    Needs the RocksDB state store (``use_rocksdb``). ``n`` counts a source's utterances.
    """
    return gathered(rows.select(KEY, "source_id", *TAKEN), KEY, "source_id").groupBy(KEY, "source_id").transformWithState(Runtime(), OUT, "Update", "None")


def use_rocksdb(spark: SparkSession) -> None:
    """Keep state in RocksDB, and let the slower of several inputs set the watermark."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "min")


def sequenced(sealed: DataFrame) -> DataFrame:
    """Sealed utterances with sequence: one numbering of a recording's utterances over its sources, by the place up to which was processed, then the source."""
    order = Window.partitionBy(KEY).orderBy("processed", F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source_id")), "n")
    return sealed.withColumn("sequence", F.row_number().over(order).cast("long"))
