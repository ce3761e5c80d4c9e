"""State of the live operators costs as many calls for many rows as for few, and rows of one key come together."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from parley.streaming import capture, sources, utterances


class State:
    """A value state in memory that counts its calls."""

    def __init__(self):
        self.value, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.value

    def exists(self):
        self.calls += 1
        return self.value is not None

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None


class Handle:
    def __init__(self):
        self.states, self.timers = [], 0

    def getValueState(self, name, schema, *more):  # noqa: N802
        self.states.append(State())
        return self.states[-1]

    def calls(self):
        return sum(s.calls for s in self.states)


def test_two_sources_read_and_write_state_once_a_micro_batch():
    """Frames that wait for a first one are no calls of their own."""
    columns = Row("recording_id", "source_id", *sources.TAKEN)
    for many in (3, 300):
        handle, runtime = Handle(), sources.Runtime()
        runtime.init(handle)
        frames = [(i * 512, i * 512 + 512, 90, "frame", False, None) for i in range(1, many)]
        assert not list(runtime.handleInputRows((1, "system"), iter([columns(1, "system", *zip(*frames, strict=True))]), None))
        rest = [(0, 512, 90, "frame", False, None), (many * 512, None, None, "end", None, None)]
        found = list(runtime.handleInputRows((1, "system"), iter([columns(1, "system", *zip(*rest, strict=True))]), None))
        assert [(x.kind, x.start_sample, x.end_sample) for x in found] == [("sealed", 0, many * 512)]
        assert handle.calls() == 4


def test_gathered_rows_keep_all_values_in_order(spark):
    from parley.streaming.gather import gathered, spread

    rows = spark.createDataFrame([(i % 3, "s", i, None if i % 4 else "x") for i in range(500)] + [(None, "s", 1, "y")], "k long, s string, a long, b string").coalesce(1)
    found = gathered(rows, "k", "s")
    assert found.where("k = 1").count() < 10
    assert [r for r in spread(found.where("k = 1").collect(), "a", "b")] == [(i, None if i % 4 else "x") for i in range(500) if i % 3 == 1]
    assert found.agg(F.sum(F.size("a"))).first()[0] == 501


def test_late_audio_reads_and_writes_state_once_a_micro_batch():
    """Tiles that aren't written yet are no calls of their own."""
    columns = Row("recording_id", *capture.TAKEN)
    for many in (3, 300):
        handle, writer = Handle(), capture.Writer()
        writer.init(handle)
        ahead = [(100, False, i * 4000, "system", 4000) for i in range(many)]
        assert not list(writer.handleInputRows((1,), iter([columns(1, *zip(*ahead, strict=True))]), None))
        found = list(writer.handleInputRows((1,), iter([columns(1, *zip(*[(many * 250, True, None, None, None)], strict=True))]), None))
        assert [x.samples for x in found if x.source_id == "system"] == [0] * many
        assert [x.samples for x in found if x.source_id == "microphone_clean"] == [4000] * many
        assert handle.calls() == 4


def test_utterances_read_and_write_state_once_a_micro_batch():
    columns = Row("recording_id", *utterances.TAKEN)
    handle, live = Handle(), utterances.Utterances()
    live.init(handle)
    frames = [(i * 512, i * 512 + 512, 90, False, False) for i in range(300)]
    found = list(live.handleInputRows((1,), iter([columns(1, *zip(*frames[:150], strict=True)), columns(1, *zip(*frames[150:], strict=True))]), None))
    assert [(x.kind, x.start_sample, x.end_sample) for x in found] == [("open", 0, 300 * 512)] and handle.calls() == 2


def test_activity_reads_and_writes_state_once_a_micro_batch():
    """Turns that reach beyond the mark are no calls of their own, and neither are their rows."""
    from types import SimpleNamespace

    from parley.streaming import activity

    class Timers(Handle):
        def registerTimer(self, at):  # noqa: N802
            self.timers += 1

        def deleteTimer(self, at):  # noqa: N802
            self.timers -= 1

    now, columns = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0), Row("recording_id", "source_id", *activity.TAKEN)
    for many in (3, 300):
        handle, operator = Timers(), activity.Activity()
        operator.init(handle)
        turns = [("turn", "speaker_0", i * 100, i * 100 + 150, 5) for i in range(many)]
        first = columns(1, "system", *zip(*turns, ("observed", None, None, 50, 5), strict=True))
        assert [tuple(x) for x in operator.handleInputRows((1, "system"), iter([first]), now)] == [(1, "system", 0, 50, "speaker_0", False)]
        assert handle.timers == 1
        rest = columns(1, "system", *zip(("turn", None, 0, 10, 6), ("end", None, None, many * 100 + 100, 6), strict=True))
        found = [tuple(x) for x in operator.handleInputRows((1, "system"), iter([rest]), now)]
        assert found == [(1, "system", 0, many * 100 + 50, "speaker_0", True), (1, "system", many * 100 + 50, many * 100 + 100, "", True)]
        assert handle.timers == 0 and handle.calls() == 4
