"""Registered queries of the conversation operators, each with the same result as plain SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions import scalars, signals
from parley.operators import admissions, changes, checks, documents, exports, folds, identity, intervals, language, library, preparing, publishing, ranges, reading, recognition, review, speech, stitching, transcript, voices, votes
from parley.sources.fixtures import oracle, view
from parley.streaming import activity, capture, sources, utterances
from parley.streaming.publish import Store, published
from parley.streaming.replay import current, replay, replay_all, shared_folder, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

P, T, V, L, E, R, N, H = (oracle(n) for n in ("passages", "turns", "vad_frames", "lang_probes", "edits", "recordings", "audio_notices", "people"))
CLIPS, S, NAMES = oracle("clips"), oracle("states"), oracle("doc_speakers")
#: Passage states with the label of their speaker.
NAMED = f"(SELECT p.*, coalesce(n.name, CASE WHEN p.speaker = 'unassigned' THEN 'Unknown speaker' ELSE 'Overlapping speakers' END) AS label FROM {S} p LEFT JOIN {NAMES} n ON p.recording_id = n.recording_id AND p.speaker = n.speaker)"
#: Length of a recording with passages: half a minute after the last end.
LENGTH = f"(SELECT recording_id, max(end_sample) + 480000 AS duration FROM {P} GROUP BY recording_id)"
TURN_LENGTH = f"(SELECT recording_id, max(end_sample) - 20000 AS duration FROM {T} GROUP BY recording_id)"


def query(name: str, sql: str | None):
    """Registers a query with its SQL; None where an ordered pass can't be written as SQL, and tests compare with plain Python."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


def durations(spans: DataFrame, more: int) -> DataFrame:
    return spans.groupBy("recording_id").agg((F.max("end_sample") + more).alias("duration"))


# Intervals


@query("p19_normalized_turns", f"""SELECT recording_id, turn_id, speaker, greatest(0, least(start_sample, duration)) AS start_sample, greatest(0, least(end_sample, duration)) AS end_sample
FROM {T} t JOIN {TURN_LENGTH} d USING (recording_id) WHERE greatest(0, least(start_sample, duration)) < greatest(0, least(end_sample, duration)) AND speaker IN ('speaker_0', 'speaker_1', 'speaker_2')""")
def _(s, d):
    t = view(s, d, "turns")
    return intervals.normalize_turns(t, durations(t, -20000))


@query("u1_boundaries", f"SELECT recording_id, start_sample AS sample FROM {T} UNION SELECT recording_id, end_sample FROM {T}")
def _(s, d):
    return intervals.boundaries(view(s, d, "turns"))


CELLS = f"""(WITH t AS {T}, b AS (SELECT recording_id, start_sample AS edge FROM t UNION SELECT recording_id, end_sample FROM t),
c AS (SELECT * FROM (SELECT recording_id, edge AS start_sample, lead(edge) OVER (PARTITION BY recording_id ORDER BY edge) AS end_sample FROM b) x WHERE end_sample IS NOT NULL)
SELECT c.recording_id, c.start_sample, c.end_sample, coalesce(string_agg(DISTINCT t.speaker, ',' ORDER BY t.speaker), '') AS owners
FROM c LEFT JOIN t ON t.recording_id = c.recording_id AND t.start_sample < c.end_sample AND t.end_sample > c.start_sample GROUP BY 1, 2, 3)"""


@query("j1_g10_elementary", f"SELECT * FROM {CELLS} q")
def _(s, d):
    return intervals.elementary(view(s, d, "turns"))


@query("w4_coalesced", f"""WITH c AS {CELLS}, m AS (SELECT *, CASE WHEN lag(end_sample) OVER w = start_sample AND lag(owners) OVER w = owners THEN 0 ELSE 1 END AS n FROM c WINDOW w AS (PARTITION BY recording_id ORDER BY start_sample)),
i AS (SELECT *, sum(n) OVER (PARTITION BY recording_id ORDER BY start_sample) AS island FROM m)
SELECT recording_id, min(start_sample) AS start_sample, max(end_sample) AS end_sample, min(owners) AS owners FROM i GROUP BY recording_id, island""")
def _(s, d):
    return intervals.coalesce_equal(intervals.elementary(view(s, d, "turns")))


ISLANDS = f"""(WITH t AS {T}, m AS (SELECT *, CASE WHEN start_sample <= max(end_sample) OVER (PARTITION BY recording_id ORDER BY start_sample, end_sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM t),
i AS (SELECT *, sum(n) OVER (PARTITION BY recording_id ORDER BY start_sample, end_sample ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT recording_id, min(start_sample) AS start_sample, max(end_sample) AS end_sample FROM i GROUP BY recording_id, island)"""


@query("w4_islands", f"SELECT * FROM {ISLANDS} q")
def _(s, d):
    return intervals.islands(view(s, d, "turns"))


@query("g1_chunks", f"SELECT recording_id, unnest(generate_series(start_sample, end_sample - 1, 288000)) AS start_sample, least(unnest(generate_series(start_sample, end_sample - 1, 288000)) + 288000, end_sample) AS end_sample FROM {ISLANDS} q")
def _(s, d):
    return intervals.chunk(intervals.islands(view(s, d, "turns")), intervals.PIECE)


@query("w6_crop_padding", f"""WITH i AS {ISLANDS} SELECT recording_id, start_sample, end_sample,
CAST(greatest(0, start_sample - 3520, floor((lag(end_sample, 1, 0) OVER w + start_sample) / 2.0)) AS BIGINT) AS audio_start,
CAST(least(duration, end_sample + 3520, floor((end_sample + coalesce(lead(start_sample) OVER w, duration)) / 2.0)) AS BIGINT) AS audio_end
FROM i JOIN (SELECT recording_id, max(end_sample) + 1000 AS duration FROM {T} GROUP BY 1) d USING (recording_id) WINDOW w AS (PARTITION BY recording_id ORDER BY start_sample)""")
def _(s, d):
    t = view(s, d, "turns")
    return intervals.crop_padding(intervals.islands(t), durations(t, 1000))


@query("g4_probe_edges", f"""SELECT recording_id, start_sample, i, CAST(start_sample + floor((end_sample - start_sample) * i / (n * 1.0)) AS BIGINT) AS part_start, CAST(start_sample + floor((end_sample - start_sample) * (i + 1) / (n * 1.0)) AS BIGINT) AS part_end
FROM (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM (SELECT *, CAST(ceil((end_sample - start_sample) / 48000.0) AS BIGINT) AS n FROM {ISLANDS} q) x) y""")
def _(s, d):
    return intervals.probe_edges(intervals.islands(view(s, d, "turns")))


UNCOVERED = f"""(WITH p AS {P}, m AS (SELECT *, CASE WHEN start_sample <= max(end_sample) OVER (PARTITION BY recording_id ORDER BY start_sample, end_sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM p),
i AS (SELECT *, sum(n) OVER (PARTITION BY recording_id ORDER BY start_sample, end_sample ROWS UNBOUNDED PRECEDING) AS island FROM m),
s AS (SELECT recording_id, min(start_sample) AS a, max(end_sample) AS b FROM i GROUP BY recording_id, island)
SELECT * FROM (SELECT recording_id, lag(b, 1, 0) OVER (PARTITION BY recording_id ORDER BY a) AS start_sample, a AS end_sample FROM s
  UNION ALL SELECT recording_id, max(b), max(b) + 480000 FROM s GROUP BY recording_id) g WHERE end_sample - start_sample > 16)"""


@query("u7_complement", f"SELECT * FROM {UNCOVERED} q")
def _(s, d):
    p = view(s, d, "passages")
    return intervals.complement(p, durations(p, 480000))


@query("w3_g2_uncovered", f"""WITH g AS (SELECT recording_id, a AS start_sample, least(a + 480000, b) AS end_sample FROM (SELECT recording_id, end_sample AS b, unnest(generate_series(start_sample, end_sample - 1, 480000)) AS a FROM {UNCOVERED} q) x),
n AS (SELECT g.*, (SELECT count(DISTINCT passage_id) FROM {P} p WHERE p.recording_id = g.recording_id) + row_number() OVER (PARTITION BY recording_id ORDER BY start_sample) - 1 AS n FROM g)
SELECT recording_id, 'unassigned-' || CAST(n AS VARCHAR) || CASE WHEN EXISTS (SELECT 1 FROM {P} p WHERE p.recording_id = n.recording_id AND p.passage_id = 'unassigned-' || CAST(n.n AS VARCHAR)) THEN '-gap' ELSE '' END AS passage_id, start_sample, end_sample FROM n""")
def _(s, d):
    p = view(s, d, "passages")
    return intervals.uncovered_rows(p, durations(p, 480000))


@query("w13_running_end", f"SELECT recording_id, pos, start_sample, end_sample, max(end_sample) OVER (PARTITION BY recording_id ORDER BY start_sample, end_sample, pos ROWS UNBOUNDED PRECEDING) AS running_end FROM {P} q")
def _(s, d):
    return intervals.running_end(view(s, d, "passages"))


@query("j15_stabbing", f"SELECT a.recording_id, a.sample, p.passage_id FROM (SELECT DISTINCT recording_id, start_sample + 1000 AS sample FROM {P} x) a JOIN {P} p ON a.recording_id = p.recording_id AND p.start_sample <= a.sample AND a.sample < p.end_sample")
def _(s, d):
    p = view(s, d, "passages")
    return intervals.stabbing(p.select("recording_id", "passage_id", "start_sample", "end_sample"), p.select("recording_id", (F.col("start_sample") + 1000).alias("sample")).distinct())


# Speech

STATE = f"""(SELECT recording_id, start_sample, end_sample, p100, constant_block, NOT constant_block AND coalesce(last_value(CASE WHEN constant_block THEN NULL WHEN p100 >= 50 THEN true WHEN p100 < 35 THEN false END IGNORE NULLS)
OVER (PARTITION BY recording_id ORDER BY start_sample ROWS UNBOUNDED PRECEDING), false) AS speaking FROM {V} f)"""


@query("w1_hysteresis", f"SELECT * FROM {STATE} q")
def _(s, d):
    return speech.hysteresis(view(s, d, "vad_frames"))


UTTERANCES = f"""WITH f AS {STATE}, t AS (SELECT *, CASE WHEN start_sample - lag(end_sample) OVER (PARTITION BY recording_id ORDER BY start_sample) < 8000 THEN 0 ELSE 1 END AS new FROM f WHERE speaking),
i AS (SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY start_sample) AS n FROM t)
SELECT recording_id, CAST(n AS BIGINT) AS n, greatest(0, min(start_sample) - 3200) AS start_sample, least((SELECT max(end_sample) FROM f WHERE f.recording_id = i.recording_id), max(end_sample) + 3200) AS end_sample FROM i GROUP BY recording_id, n"""


@query("w2_utterances", UTTERANCES)
def _(s, d):
    return speech.utterances(view(s, d, "vad_frames"))


def thirds(s: SparkSession, d: str) -> tuple[DataFrame, list[DataFrame]]:
    """All frames, and the first, second and last third of each recording as stream rows."""
    frames = view(s, d, "vad_frames").withColumn("p100", F.col("p100").cast("long"))
    frames = stored(frames.withColumn("until", F.max("end_sample").over(Window.partitionBy("recording_id"))))
    cut = frames.withColumn("third", F.floor(F.col("start_sample") * 3 / F.col("until")))
    return frames, [cut.where(F.col("third") == k).select("recording_id", "start_sample", "end_sample", "p100", "constant_block", F.lit(False).alias("ended")) for k in range(3)]


@query("st3_live_utterances", UTTERANCES)
def _(s, d):
    """The same frames as a stream in three steps, state kept in between; each recording is ended in the last."""
    frames, steps = thirds(s, d)
    steps[2] = steps[2].unionByName(utterances.end_rows(frames))
    return replay(steps, utterances.live_utterances).where("kind = 'sealed'").select("recording_id", "n", "start_sample", "end_sample")


TWO_THIRDS = f"(SELECT f.* FROM {V} f JOIN (SELECT recording_id, max(end_sample) AS observed FROM {V} g GROUP BY 1) o ON f.recording_id = o.recording_id WHERE f.start_sample * 3 < 2 * o.observed)"


#: Frames of both sources (the system hears the microphone's frames 29 percent louder, modulo 100) and two language boundaries a recording, one of them within a frame.
BOTH = f"(SELECT *, 'microphone_clean' AS source_id FROM {V} q UNION ALL SELECT * REPLACE ((p100 + 29) % 100 AS p100), 'system' FROM {V} q)"
EPOCHS = f"(SELECT recording_id, CAST(1 AS BIGINT) AS epoch, m // 3 // 512 * 512 AS start_sample FROM (SELECT recording_id, max(end_sample) AS m FROM {V} q GROUP BY 1) x WHERE m > 30000 UNION ALL SELECT recording_id, 2, m // 2 + 100 FROM (SELECT recording_id, max(end_sample) AS m FROM {V} q GROUP BY 1) x WHERE m > 30000)"
EPOCH_UTTERANCES = f"""WITH f AS {BOTH}, o AS (SELECT recording_id, max(end_sample) AS observed FROM f GROUP BY 1), b AS (SELECT * FROM {EPOCHS} q UNION ALL SELECT recording_id, 0, 0 FROM o),
s AS (SELECT *, lead(start_sample) OVER (PARTITION BY recording_id ORDER BY epoch) AS stop FROM b),
c AS (SELECT f.recording_id, f.source_id, s.epoch, greatest(f.start_sample, s.start_sample) AS a, least(f.end_sample, coalesce(s.stop, f.end_sample)) AS z, s.start_sample AS low, least(o.observed, coalesce(s.stop, o.observed)) AS high, constant_block,
  CASE WHEN constant_block THEN NULL WHEN p100 >= 50 THEN 1 WHEN p100 < 35 THEN 0 END AS signal FROM f JOIN s ON f.recording_id = s.recording_id AND s.start_sample < f.end_sample AND (s.stop IS NULL OR f.start_sample < s.stop) JOIN o ON o.recording_id = f.recording_id),
h AS (SELECT *, last_value(signal IGNORE NULLS) OVER (PARTITION BY recording_id, source_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM c),
t AS (SELECT *, CASE WHEN a - lag(z) OVER w < 8000 AND lag(epoch) OVER w = epoch THEN 0 ELSE 1 END AS new FROM h WHERE state = 1 AND NOT constant_block WINDOW w AS (PARTITION BY recording_id, source_id ORDER BY a)),
n AS (SELECT *, sum(new) OVER (PARTITION BY recording_id, source_id ORDER BY a) AS n FROM t)
SELECT recording_id, source_id, CAST(n AS BIGINT) AS n, epoch, greatest(min(low), min(a) - 3200) AS start_sample, least(min(high), max(z) + 3200) AS end_sample FROM n GROUP BY recording_id, source_id, n, epoch"""


def both(v: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames of both sources, and the language boundaries."""
    frames = v.withColumn("source_id", F.lit("microphone_clean")).unionByName(v.withColumns({"p100": (F.col("p100") + 29) % 100, "source_id": F.lit("system")}))
    m = v.groupBy("recording_id").agg(F.max("end_sample").alias("m")).where("m > 30000")
    places = F.array(F.struct(F.lit(1).cast("long").alias("epoch"), F.expr("m div 3 div 512 * 512").alias("start_sample")), F.struct(F.lit(2).cast("long").alias("epoch"), F.expr("m div 2 + 100").alias("start_sample")))
    return frames, m.select("recording_id", F.explode(places).alias("b")).select("recording_id", "b.epoch", "b.start_sample")


@query("w2_epoch_utterances", EPOCH_UTTERANCES)
def _(s, d):
    return speech.utterances_by_epoch(*both(view(s, d, "vad_frames")))


@query("st13_u2_live_sources", EPOCH_UTTERANCES)
def _(s, d):
    """Two inputs in two steps: boundaries come first, every eleventh frame a step late, and what the speakers were observed to holds back the rest until the end."""
    sources.use_rocksdb(s)
    v = stored(view(s, d, "vad_frames").withColumn("m", F.max("end_sample").over(Window.partitionBy("recording_id"))))
    frames, bounds = both(v)
    seen = v.groupBy("recording_id").agg(F.max("m").alias("m"))
    none = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in sources.ROWS.split(", ")}
    row = lambda df, kind, **own: df.select(*(own.get(c, F.lit(kind) if c == "kind" else df[c] if c in df.columns and c not in own else none[c]).alias(c) for c in none))
    half = F.expr("m div 2 div 512 * 512")
    step = F.when((F.col("start_sample") >= half) | (F.col("start_sample") % 11 == 0), 1).otherwise(0)
    placed = frames.withColumn("step", step)
    parts = lambda i: row(placed.where(F.col("step") == i), "frame")
    said = [sources.for_both(row(bounds, "boundary")).unionByName(sources.for_both(row(seen, "heard", end_sample=half))), sources.for_both(row(seen, "end", start_sample=F.col("m")))]
    names = [c.split()[0] for c in sources.ROWS.split(", ")]
    steps = []
    for i in range(2):
        rows = parts(i).unionByName(said[i]).withColumn("at", F.timestamp_millis(F.lit(1_700_000_000_000 + 1000 * i)))
        steps.append([rows.where(F.col("source_id") == x) for x in sources.SOURCES])
    run = lambda a, b: sources.live(sources.both_sources(*(x.drop("source_id").withWatermark("at", "1 second") for x in (a, b))).select(*names))
    return replay_all(steps, run).where("kind = 'sealed'").select("recording_id", "source_id", "n", "epoch", "start_sample", "end_sample")


#: Who speaks between 0 and the last start of a turn, which is how far speakers were observed.
OBSERVED = f"(SELECT recording_id, max(start_sample) AS upto FROM {T} q GROUP BY 1 HAVING max(start_sample) > 0)"
ACTIVITY = f"""WITH t AS (SELECT q.recording_id, speaker, greatest(0, start_sample) AS a, least(end_sample, upto) AS z, upto FROM {T} q JOIN {OBSERVED} o ON q.recording_id = o.recording_id WHERE greatest(0, start_sample) < least(end_sample, upto)),
b AS (SELECT recording_id, a AS edge FROM t UNION SELECT recording_id, z FROM t UNION SELECT recording_id, 0 FROM {OBSERVED} o UNION SELECT recording_id, upto FROM {OBSERVED} o),
c AS (SELECT recording_id, edge AS a, lead(edge) OVER (PARTITION BY recording_id ORDER BY edge) AS z FROM b),
w AS (SELECT c.recording_id, c.a, c.z, coalesce(string_agg(DISTINCT t.speaker, ',' ORDER BY t.speaker), '') AS owners FROM c LEFT JOIN t ON t.recording_id = c.recording_id AND t.a <= c.a AND c.z <= t.z WHERE c.z IS NOT NULL GROUP BY 1, 2, 3),
i AS (SELECT *, sum(CASE WHEN was = owners THEN 0 ELSE 1 END) OVER (PARTITION BY recording_id ORDER BY a) AS n FROM (SELECT *, lag(owners) OVER (PARTITION BY recording_id ORDER BY a) AS was FROM w) x)
SELECT recording_id, min(a) AS start_sample, max(z) AS end_sample, any_value(owners) AS owners FROM i GROUP BY recording_id, n"""


@query("st16_activity", ACTIVITY)
def _(s, d):
    t = view(s, d, "turns")
    return activity.activity_regions(t, t.groupBy("recording_id").agg(F.max("start_sample").alias("end_sample")))


@query("st16_live_activity", ACTIVITY)
def _(s, d):
    """The turns in two steps, with a mark at the middle in the first: each final region is put out once."""
    sources.use_rocksdb(s)
    t = view(s, d, "turns").where("start_sample < end_sample")
    seen = t.groupBy("recording_id").agg(F.max("start_sample").alias("m")).where("m > 0")
    turns = t.join(seen, "recording_id").select("recording_id", F.lit("system").alias("source_id"), F.lit("turn").alias("kind"), "speaker", "start_sample", "end_sample", "m")
    mark = lambda kind, at: seen.select("recording_id", F.lit("system").alias("source_id"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("speaker"), F.lit(None).cast("long").alias("start_sample"), at.cast("long").alias("end_sample"))
    early = F.col("start_sample") < F.col("m") / 2
    steps = [turns.where(early).drop("m").unionByName(mark("observed", F.expr("m div 2"))), turns.where(~early).drop("m").unionByName(mark("end", F.col("m")))]
    found = replay([x.withColumn("at", F.timestamp_millis(F.lit(1_700_000_000_000 + 1000 * i))) for i, x in enumerate(steps)], lambda x: activity.live(x.withWatermark("at", "1 second")))
    return activity.closed_regions(found).drop("source_id")


@query("a3_merged_evidence", f"""WITH s AS (SELECT q.recording_id, q.start_sample, q.start_sample + 512 AS stop, q.p100, CASE WHEN speaking THEN 'speech' WHEN f.observed THEN 'negative' ELSE 'uncertain' END AS kind, f.observed FROM {STATE} q JOIN {V} f ON q.recording_id = f.recording_id AND q.start_sample = f.start_sample),
i AS (SELECT *, sum(CASE WHEN was = kind THEN 0 ELSE 1 END) OVER (PARTITION BY recording_id ORDER BY start_sample) AS n FROM (SELECT *, lag(kind) OVER (PARTITION BY recording_id ORDER BY start_sample) AS was FROM s) x),
r AS (SELECT recording_id, kind, min(start_sample) AS a, max(stop) AS z FROM i GROUP BY recording_id, kind, n)
SELECT h.*, t.speech, t.regions FROM (SELECT recording_id, min(start_sample) AS start_sample, max(stop) AS end_sample, max(p100) AS maximum, max(CASE WHEN observed THEN p100 END) AS model_maximum FROM s GROUP BY 1) h
JOIN (SELECT recording_id, coalesce(string_agg(CASE WHEN kind = 'speech' THEN CAST(a AS VARCHAR) || '-' || CAST(z AS VARCHAR) END, ',' ORDER BY a), '') AS speech, count(*) AS regions FROM r GROUP BY 1) t USING (recording_id)""")
def _(s, d):
    """Parts of 7,000 samples, merged in two levels."""
    small = admissions.parts(view(s, d, "vad_frames").withColumn("policy", F.lit("a")), 7_000)
    found = admissions.merge(admissions.merge(small.withColumn("branch", F.floor(F.col("start_sample") / 50_000)), ["branch"]))
    spans = F.array_join(F.transform("speech", lambda x: F.concat_ws("-", x["low"], x["high"])), ",")
    regions = (F.size("speech") + F.size("negative") + F.size("uncertain")).cast("long")
    return found.where("complete").select("recording_id", "start_sample", "end_sample", "maximum", "model_maximum", spans.alias("speech"), regions.alias("regions"))


@query("st8_current_utterances", f"""SELECT u.*, CASE WHEN end_sample < observed AND observed - (end_sample - 3200) >= 8000 THEN 'sealed' ELSE 'open' END AS kind FROM ({UTTERANCES.replace(V, TWO_THIRDS)}) u
JOIN (SELECT recording_id, max(end_sample) AS observed FROM {TWO_THIRDS} v GROUP BY 1) o USING (recording_id)""".replace("SELECT u.*,", "SELECT u.recording_id, n, start_sample, end_sample,"))
def _(s, d):
    """After two of the three steps: sealed utterances, and the open one of each recording as it then stands."""
    _, steps = thirds(s, d)
    found = replay(steps[:2], utterances.live_utterances).where("kind <> 'rejected'")
    return current(found, ["recording_id", "n"]).select("recording_id", "n", "start_sample", "end_sample", "kind")


@query("a1_inspection", f"""SELECT *, CASE WHEN speech > 0 THEN 'speech' WHEN uncertain > 0 THEN 'uncertain' ELSE 'no_speech' END AS decision FROM (SELECT q.recording_id,
CAST(sum(CASE WHEN speaking THEN 512 ELSE 0 END) AS BIGINT) AS speech, CAST(sum(CASE WHEN NOT speaking AND NOT observed THEN 512 ELSE 0 END) AS BIGINT) AS uncertain,
CAST(sum(CASE WHEN NOT speaking AND observed AND q.constant_block THEN 512 ELSE 0 END) AS BIGINT) AS negative_constant, CAST(sum(CASE WHEN NOT speaking AND observed AND NOT q.constant_block THEN 512 ELSE 0 END) AS BIGINT) AS model_negative
FROM {STATE} q JOIN (SELECT recording_id, start_sample, observed FROM {V} z) f ON q.recording_id = f.recording_id AND q.start_sample = f.start_sample GROUP BY q.recording_id) x""")
def _(s, d):
    return speech.inspection(view(s, d, "vad_frames"))


SPANS = f"(SELECT recording_id, n AS span_id, least(n * 3000, 60000 + n * 700) AS start_sample, least(n * 3000, 60000 + n * 700) + 2000 + n * 40 AS end_sample FROM (SELECT DISTINCT recording_id, CAST(start_sample / 2048 AS BIGINT) AS n FROM {V} v WHERE start_sample % 2048 = 0) x)"


@query("a2_j3_admission", f"""WITH r AS {SPANS}, f AS {STATE},
m AS (SELECT r.recording_id, r.span_id, r.start_sample AS s0, r.end_sample AS e0, greatest(f.start_sample, r.start_sample) AS low, least(f.end_sample, r.end_sample) AS high, p100, speaking
  FROM r JOIN f ON f.recording_id = r.recording_id AND f.start_sample < r.end_sample AND f.end_sample > r.start_sample),
c AS (SELECT recording_id, span_id, sum(high - low) = max(e0 - s0) AS complete, max(p100) AS maximum FROM m GROUP BY 1, 2),
t AS (SELECT *, CASE WHEN lag(high) OVER w = low THEN 0 ELSE 1 END AS new FROM m WHERE speaking WINDOW w AS (PARTITION BY recording_id, span_id ORDER BY low)),
i AS (SELECT *, sum(new) OVER (PARTITION BY recording_id, span_id ORDER BY low) AS island FROM t),
g AS (SELECT recording_id, span_id, min(low) AS low, max(high) AS high FROM i GROUP BY recording_id, span_id, island),
x AS (SELECT recording_id, span_id, string_agg(CAST(low AS VARCHAR) || '-' || CAST(high AS VARCHAR), ',' ORDER BY low) AS speech FROM g GROUP BY 1, 2)
SELECT r.recording_id, r.span_id, coalesce(complete, false) AS complete, CASE WHEN complete THEN maximum END AS maximum, CASE WHEN complete THEN coalesce(speech, '') END AS speech,
CASE WHEN NOT coalesce(complete, false) THEN 'pending' WHEN speech IS NOT NULL THEN 'speech' ELSE 'no_speech' END AS decision
FROM r LEFT JOIN c ON r.recording_id = c.recording_id AND r.span_id = c.span_id LEFT JOIN x ON r.recording_id = x.recording_id AND r.span_id = x.span_id""")
def _(s, d):
    f = view(s, d, "vad_frames")
    n = (F.col("start_sample") / 2048).cast("long")
    start = F.least(F.col("span_id") * 3000, F.col("span_id") * 700 + 60000)
    spans = f.where("start_sample % 2048 = 0").select("recording_id", n.alias("span_id")).distinct().withColumn("start_sample", start).withColumn("end_sample", F.col("start_sample") + 2000 + F.col("span_id") * 40)
    return speech.admission(spans, f)


@query("p22_block_routes", f"""SELECT recording_id, start_sample, CASE kind WHEN 'speech' THEN CASE WHEN low = high THEN 'insufficient_speech:' || CASE WHEN low = 0 THEN 'digital_silence' ELSE 'constant_signal' END END
WHEN 'no_speech' THEN 'insufficient_speech:model_non_speech' WHEN 'uncertain' THEN 'speech_admission_uncertain:speech_evidence_pending' ELSE 'speech_evidence_pending:speech_evidence_pending' END AS route
FROM (SELECT *, CASE WHEN p100 >= 50 THEN 'speech' WHEN p100 < 20 THEN 'no_speech' WHEN observed THEN 'pending' ELSE 'uncertain' END AS kind, p100 % 3 AS low, CASE WHEN constant_block THEN p100 % 3 ELSE 5 END AS high FROM {V} q) x""")
def _(s, d):
    kind = F.when(F.col("p100") >= 50, "speech").when(F.col("p100") < 20, "no_speech").when(F.col("observed"), "pending").otherwise("uncertain")
    low = F.col("p100") % 3
    return view(s, d, "vad_frames").select("recording_id", "start_sample", speech.block_route(kind, low, F.when(F.col("constant_block"), low).otherwise(5)).alias("route"))


# Language

DECIDED = f"""(SELECT *, CASE WHEN reason IN ('detected', 'best_effort') THEN top_code END AS language, reason <> 'detected' AS review FROM (SELECT *, CASE WHEN top_code <> 'sw' AND confident THEN 'detected' WHEN top_code <> 'sw' THEN 'best_effort' WHEN confident THEN 'unsupported' ELSE 'needs_language' END AS reason
FROM (SELECT *, top_pct * 10 - second_permille AS margin, top_pct >= 90 AND top_pct * 10 - second_permille >= 200 AS confident FROM {L} p) x) y)"""


@query("l1_language_decision", f"SELECT * FROM {DECIDED} q")
def _(s, d):
    return language.decide(view(s, d, "lang_probes"))


@query("w11_l3_rescue", f"""WITH d AS {DECIDED}, c AS (SELECT a.recording_id, a.probe_id, a.reason, a.language, a.start_sample,
  (SELECT max(b.start_sample) FROM d b WHERE b.recording_id = a.recording_id AND b.start_sample < a.start_sample AND (b.reason = 'unsupported' OR b.reason = 'detected' AND b.text_ok)) AS since FROM d a)
SELECT c.recording_id, c.probe_id, c.reason, c.language, CASE WHEN c.reason IN ('best_effort', 'needs_language') AND e.reason = 'detected' AND c.start_sample - e.end_sample BETWEEN 0 AND 960000
  AND NOT EXISTS (SELECT 1 FROM d f WHERE f.recording_id = c.recording_id AND f.start_sample > c.since AND f.start_sample < c.start_sample AND f.reason = 'detected' AND NOT f.text_ok AND f.language <> e.language) THEN e.language END AS rescued
FROM c LEFT JOIN d e ON e.recording_id = c.recording_id AND e.start_sample = c.since""")
def _(s, d):
    return language.rescue(view(s, d, "lang_probes"))


@query("a5_language_summary", f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY CASE WHEN language IS NULL THEN 0 ELSE 1 END, CASE WHEN language IS NULL THEN start_sample ELSE 0 END, CASE WHEN review THEN 0 ELSE 1 END, top_pct, start_sample, probe_id) AS place FROM {DECIDED} q),
g AS (SELECT recording_id, count(DISTINCT language) > 1 AS mixed, bool_or(language IS NULL) AS unknown, bool_or(review) AS any_review, min(language) AS one, max(CASE WHEN place = 1 THEN probe_id END) AS chosen, max(CASE WHEN place = 1 THEN reason END) AS reason, bool_or(detector_error) AS detector_error FROM d GROUP BY recording_id)
SELECT recording_id, mixed, "unknown", mixed OR "unknown" OR any_review AS review, CASE WHEN NOT mixed AND NOT "unknown" THEN one END AS language, CASE WHEN mixed THEN 'mixed' ELSE reason END AS reason, chosen, detector_error FROM g""")
def _(s, d):
    return language.summary(view(s, d, "lang_probes"))


SCORES = f"(SELECT probe_id AS id, top_code, second_code, top_pct / 100.0::DOUBLE AS a, second_permille / 1000.0::DOUBLE AS b, CASE WHEN probe_id % 9 = 0 THEN 0.1::DOUBLE ELSE 1.0::DOUBLE - top_pct / 100.0::DOUBLE - second_permille / 1000.0::DOUBLE END AS c FROM {L} q WHERE top_code <> second_code)"


@query("l1_p20_w9_scores", f"""WITH s AS {SCORES}, o AS (SELECT *, a >= 0 AND a <= 1 AND b >= 0 AND b <= 1 AND c >= 0 AND c <= 1 AND a + b + c BETWEEN 0.98 AND 1.02 AS valid, list_sort([(-a, top_code), (-b, second_code), (-c, 'zz')]) AS best FROM s),
r AS (SELECT *, -best[1][1] AS top, best[1][2] AS code, -best[2][1] AS second FROM o),
t AS (SELECT *, top >= 0.9 AND round(top - second, 9) >= 0.2 AS sure, code IN ('en', 'fr', 'de', 'es') AS supported FROM r)
SELECT id, valid, CASE WHEN valid THEN array_to_string(list_transform(best, lambda x: x[2] || ':' || printf('%.3f', -x[1])), ',') END AS candidates, CASE WHEN valid AND supported THEN code END AS language,
CASE WHEN NOT valid THEN 'detector_error' WHEN supported AND sure THEN 'detected' WHEN supported THEN 'best_effort' WHEN sure THEN 'unsupported' ELSE 'needs_language' END AS reason, NOT (valid AND supported AND sure) AS review FROM t""")
def _(s, d):
    p = view(s, d, "lang_probes").where("top_code <> second_code")
    a, b = F.col("top_pct") / F.lit(100.0), F.col("second_permille") / F.lit(1000.0)
    rest = F.when(F.col("probe_id") % 9 == 0, F.lit(0.1)).otherwise(F.lit(1.0) - a - b)
    return language.from_scores(p.select(F.col("probe_id").alias("id"), F.create_map("top_code", a, "second_code", b, F.lit("zz"), rest).alias("scores")))


# Transcript


def _time(c: str, mark: str) -> str:
    ms = f"CAST(round_even({c} * 1000 / 16000.0, 0) AS BIGINT)"
    return f"(lpad(CAST({ms} // 3600000 AS VARCHAR), CAST(greatest(2, length(CAST({ms} // 3600000 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST({ms} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({ms} // 1000 % 60 AS VARCHAR), 2, '0') || '{mark}' || lpad(CAST({ms} % 1000 AS VARCHAR), 3, '0'))"


LABEL = "label"


def labelled(s: SparkSession, d: str) -> DataFrame:
    return transcript.named(view(s, d, "states"), view(s, d, "doc_speakers"))


@query("p1_validation", f"""SELECT recording_id, passage_id, array_to_string(list_sort(list_filter([CASE WHEN start_sample < 0 OR start_sample >= end_sample THEN 'bad_range' END, CASE WHEN end_sample > duration + 16 THEN 'past_end' END,
CASE WHEN count(*) OVER (PARTITION BY recording_id, passage_id) > 1 THEN 'duplicate_id' END, CASE WHEN length(text) > 20000 THEN 'long_text' END, CASE WHEN trim(text) = '' THEN 'empty_text' END], lambda x: x IS NOT NULL)), ',') AS violations
FROM {P} p LEFT JOIN (SELECT recording_id, max(end_sample) - 4000 AS duration FROM {P} GROUP BY 1) d USING (recording_id)""")
def _(s, d):
    p = view(s, d, "passages")
    return transcript.validate(p, durations(p, -4000))


REASON_SQL = "CASE %s " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in review.REASONS.items()) + " END"
REASON = f"""CASE WHEN separated AND resolution IS DISTINCT FROM 'words_reviewed' THEN 'Separated voice estimate; check words and speaker'
WHEN resolution = 'words_reviewed' AND trim(text) <> '' THEN CASE WHEN speaker LIKE 'overlap%' THEN '{review.OVERLAP}' WHEN speaker = 'unassigned' THEN 'Speaker uncertain' END
WHEN review_code IN ('token_limit', 'transcription_failed', 'insufficient_speech', 'possible_non_speech') THEN {REASON_SQL % 'review_code'}
WHEN speaker = 'multiple_speakers' THEN '{review.MULTIPLE}' WHEN speaker LIKE 'overlap%' THEN '{review.OVERLAP}'
WHEN detection_mode = 'auto' AND detection_reason IN ('recent_context', 'best_effort') THEN {REASON_SQL % 'detection_reason'}
WHEN detection_mode = 'auto' AND language IS NULL THEN coalesce({REASON_SQL % 'detection_reason'}, '{review.UNCERTAIN}')
WHEN trim(text) = '' THEN '{review.EMPTY}' WHEN speaker = 'unassigned' THEN 'Speaker uncertain' END"""
REVIEWED = f"(SELECT *, {REASON} AS reason FROM {S} q)"


@query("p2_p4_review", f"SELECT recording_id, passage_id, reason, CASE WHEN reason IS NULL THEN text ELSE text || CASE WHEN trim(text) = '' THEN '' ELSE ' ' END || '[Needs review: ' || reason || ']' END AS marked FROM {REVIEWED} r")
def _(s, d):
    return review.review(view(s, d, "states"))


PLACED = f"""(SELECT *, NOT deleted AND (coalesce(issue = 'accuracy', false) OR trim(text) <> '' OR blocked OR candidate OR touched) AS shown FROM
(SELECT *, NOT touched AND (coalesce(issue = 'language', false) OR trim(text) = '' AND NOT placeholder AND detection_reason IN ('needs_language', 'unsupported', 'mixed')) AS blocked FROM
(SELECT *, protected = 'text' OR state = 'edited' AS touched, trim(text) = '' AND NOT partial AND coalesce(review_code, 'insufficient_speech') = 'insufficient_speech' AND audio_state IS DISTINCT FROM 'insufficient_acoustic_context'
  AND (coalesce(audio_state IN ('digital_silence', 'model_non_speech'), false) OR detection_reason = 'insufficient_speech' OR coalesce(review_code = 'insufficient_speech', false)) AS placeholder FROM {S} q) x) y)"""
REFINABLE = "NOT separated AND canonical AND sealed AND protected = '' AND timing <> 'audio_coverage' AND coalesce(audio_state NOT IN ('digital_silence', 'model_non_speech'), true)"


@query("p5_to_p9_visibility", f"""SELECT recording_id, passage_id, shown, blocked AS language_blocked, placeholder, NOT deleted AND NOT shown AND NOT placeholder AND (review_code IS NOT NULL OR detection_reason IN ('needs_language', 'unsupported', 'mixed', 'insufficient_speech') OR state = 'unresolved') AS retained,
{REFINABLE} AS refinable FROM {PLACED} p""")
def _(s, d):
    return review.visibility(view(s, d, "states"))


@query("p12_p13_voice_passages", f"""SELECT recording_id, passage_id, reason, reason IS NULL AND end_sample - start_sample BETWEEN 32000 AND 160000 AS eligible FROM (SELECT *, CASE WHEN separated THEN 'unverified_audio' WHEN speaker <> 'speaker_0' THEN 'different_speaker' WHEN audio_state IS NOT NULL THEN 'unverified_audio'
WHEN NOT finalized THEN 'unfinished' WHEN n_candidates > 1 THEN 'overlap' WHEN NOT eligible THEN 'unverified_audio' END AS reason FROM {S} q) x""")
def _(s, d):
    return review.voice_eligible(view(s, d, "states"), F.lit("speaker_0"))


@query("a9_a11_exceptions", f"""SELECT recording_id, count(*) FILTER (WHERE shown) AS shown, count(issue) AS issues, CASE WHEN bool_or({REFINABLE} AND issue IS NOT NULL) THEN 'complete_with_exceptions' ELSE 'complete' END AS status FROM {PLACED} p GROUP BY recording_id""")
def _(s, d):
    return review.exception_counts(view(s, d, "states"))


@query("w10_continuation", f"SELECT recording_id, passage_id, coalesce(lag(speaker) OVER w = speaker AND speaker NOT IN ('unassigned', 'multiple_speakers') AND NOT separated AND NOT lag(separated) OVER w, false) AS continues FROM {S} q WINDOW w AS (PARTITION BY recording_id ORDER BY start_sample, end_sample, passage_id)")
def _(s, d):
    return transcript.continuation(view(s, d, "states"))


@query("p10_passage_search", f"SELECT recording_id, passage_id FROM {NAMED} q WHERE contains(lower(text || ' ' || {LABEL}), 'the th')")
def _(s, d):
    return transcript.search(labelled(s, d), "the th")


@query("w7_f5_introductions", f"""SELECT recording_id, speaker, passage_id, name FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, speaker ORDER BY start_sample, pos) AS n FROM
(SELECT *, regexp_replace(regexp_extract(regexp_extract(trim(text), '{transcript.INTRODUCTION.replace("'", "''")}', 1), '{transcript.LEADING}', 1), '\\s+', ' ', 'g') AS name FROM {P} q WHERE speaker <> 'unassigned') x WHERE name <> '') y WHERE n = 1""")
def _(s, d):
    return transcript.introductions(view(s, d, "passages"))


# Library and changes


@query("s1_library", f"SELECT recording_id, name, kind, status, CAST(created AS DATE) AS day, revision, duration_s FROM {R} q")
def _(s, d):
    return library.library(view(s, d, "recordings"))


@query("a10_status_counts", f"SELECT status, count(*) AS n FROM {R} q GROUP BY status")
def _(s, d):
    return library.status_counts(view(s, d, "recordings"))


@query("w18_day_groups", f"SELECT recording_id, CAST(created AS DATE) AS day, NOT coalesce(lag(CAST(created AS DATE)) OVER (ORDER BY CAST(created AS DATE) DESC, recording_id DESC) = CAST(created AS DATE), false) AS heading FROM {R} q")
def _(s, d):
    return library.day_groups(view(s, d, "recordings"))


@query("p11_library_search", f"SELECT recording_id, name FROM {R} q WHERE contains(lower(name), '12')")
def _(s, d):
    return library.name_search(view(s, d, "recordings"), "12")


@query("j6_v12_people", f"SELECT person_id, name, CASE WHEN NOT has_profile THEN 'none' WHEN model_id = 'model_a' THEN 'compatible' ELSE 'incompatible_runtime' END AS state FROM {H} q")
def _(s, d):
    return library.people_with_profiles(view(s, d, "people"), "model_a")


GUARDED = f"""(SELECT edit_id, recording_id, pos, field, CASE WHEN field = 'machine' THEN 'refused' WHEN given_revision = (recording_id + pos) % 4 THEN 'applied' ELSE 'conflict' END AS outcome FROM {E} e JOIN (SELECT recording_id, pos FROM {P} q) p USING (recording_id, pos))"""


@query("e1_guarded_edits", f"SELECT * FROM {GUARDED} q")
def _(s, d):
    return library.guarded_edits(view(s, d, "edits"), view(s, d, "passages"))


@query("u3_e4_protected", f"SELECT recording_id, pos, string_agg(DISTINCT field, ',' ORDER BY field) AS protected, count(*) AS edits FROM {GUARDED} q WHERE outcome = 'applied' GROUP BY recording_id, pos")
def _(s, d):
    return library.protected_fields(view(s, d, "edits"), view(s, d, "passages"))


@query("st1_notice_ranges", f"""WITH t AS (SELECT *, CASE WHEN lag(start_sample + frames) OVER w = start_sample AND lag(language_epoch) OVER w = language_epoch THEN 0 ELSE 1 END AS n FROM {N} q WHERE NOT late WINDOW w AS (PARTITION BY recording_id ORDER BY start_sample)),
i AS (SELECT *, sum(n) OVER (PARTITION BY recording_id ORDER BY start_sample) AS part FROM t)
SELECT recording_id, language_epoch, min(start_sample) AS start_sample, max(start_sample + frames) AS end_sample, count(*) AS notices FROM i GROUP BY recording_id, language_epoch, part""")
def _(s, d):
    return library.coalesced_notices(view(s, d, "audio_notices"))


#: Audio packets with the recording's clock when they came; what lies before the tiles written half a second behind it is late.
PACKETS = f"(SELECT *, (seq + 1) * 250 AS clock_ms, least(frames, greatest(0, greatest(0, (seq + 1) * 250 - 500) * 16 // 4000 * 4000 - start_sample)) AS behind FROM {N} q)"


def packets(s: SparkSession, d: str) -> DataFrame:
    n = view(s, d, "audio_notices").withColumn("clock_ms", (F.col("seq") + 1) * 250)
    return n.select("recording_id", "source_id", "start_sample", "frames", "clock_ms", F.lit(False).alias("ended"), F.timestamp_millis("clock_ms").alias("at"))


REPAIRS = f"SELECT recording_id, count(*) AS late, min(start_sample // 4000 * 4000) AS repaired_from FROM {PACKETS} q WHERE behind > 0 GROUP BY recording_id"


@query("st7_late_repairs", REPAIRS)
def _(s, d):
    return capture.repairs(packets(s, d))


@query("st7_silent_tiles", f"""WITH e AS (SELECT recording_id, max(clock_ms) * 16 + 8000 AS upto FROM {PACKETS} q GROUP BY 1), g AS (SELECT recording_id, upto, t * 4000 AS tile, source_id FROM e, LATERAL (SELECT unnest(generate_series(0, (upto - 1) // 4000)) AS t) x, (SELECT unnest(['microphone_clean', 'system']) AS source_id) y),
c AS (SELECT DISTINCT q.recording_id, q.source_id, q.start_sample AS tile FROM {PACKETS} q WHERE behind = 0)
SELECT g.recording_id, g.source_id, tile AS start_sample, least(4000, upto - tile) - CASE WHEN c.tile IS NULL THEN 0 ELSE least(4000, upto - tile) END AS samples FROM g LEFT JOIN c USING (recording_id, source_id, tile)""")
def _(s, d):
    p = packets(s, d)
    return capture.tiles(p, p.groupBy("recording_id").agg((F.max("clock_ms") + 500).alias("clock_ms")))


@query("st7_live_repairs", REPAIRS)
def _(s, d):
    """The packets as a stream in two steps: late ones go to the side output, and the repair point is where it was moved last."""
    sources.use_rocksdb(s)
    p = stored(packets(s, d))
    found = replay([p.where("clock_ms <= 5000"), p.where("clock_ms > 5000")], lambda x: capture.live(x.withWatermark("at", "500 milliseconds")))
    return found.groupBy("recording_id").agg(F.count(F.when(F.col("kind") == "late", True)).alias("late"), F.min(F.when(F.col("kind") == "repair", F.col("start_sample"))).alias("repaired_from")).where("late > 0")


# Voices

RANKED = f"""(WITH c AS (SELECT *, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM {CLIPS} q),
u AS (SELECT person_id, track_id, model_id, enrolled, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS unit FROM c WHERE sqrt(list_dot_product(v, v)) >= 1e-12),
d AS (SELECT person_id, model_id, i, avg(unit[i]) AS x, count(*) AS n FROM (SELECT person_id, model_id, unit, unnest(generate_series(1, len(unit))) AS i FROM u WHERE enrolled) z GROUP BY person_id, model_id, i HAVING count(*) >= 2),
m AS (SELECT person_id, model_id, list(x ORDER BY i) AS c FROM d GROUP BY person_id, model_id),
k AS (SELECT person_id, model_id, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS centroid FROM m),
s AS (SELECT u.track_id, k.person_id, greatest(-1.0, least(1.0, list_dot_product(u.unit, k.centroid))) AS s FROM u JOIN k ON u.model_id = k.model_id WHERE NOT u.enrolled),
g AS (SELECT track_id, person_id, avg(s) AS mean, min(s) AS least, count(*) AS clips FROM s GROUP BY track_id, person_id)
SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY round(mean, 9) DESC, person_id) AS place FROM g)"""


def _ranked(s, d):
    c = view(s, d, "clips")
    return identity.ranking(c, identity.profiles(c))


@query("v6_a7_voice_ranking", f"SELECT track_id, person_id, round(mean, 6) AS mean, round(least, 6) AS least, clips, place FROM {RANKED} q")
def _(s, d):
    return _ranked(s, d).withColumns({"mean": F.round("mean", 6), "least": F.round("least", 6)})


@query("v7_voice_decision", f"""SELECT track_id, CASE WHEN outcome = 'matched' THEN person_id END AS person_id, outcome FROM (SELECT b.*, CASE WHEN b.clips < 2 THEN 'few_clips' WHEN b.least < 0.2 THEN 'below_threshold' WHEN b.mean - coalesce(n.mean, 0) < 0.05 THEN 'small_margin' ELSE 'matched' END AS outcome
FROM (SELECT * FROM {RANKED} q WHERE place = 1) b LEFT JOIN (SELECT * FROM {RANKED} q WHERE place = 2) n ON b.track_id = n.track_id) x""")
def _(s, d):
    return identity.decide(_ranked(s, d))


# Ranges


def spans(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "lang_probes").select("recording_id", F.col("probe_id").alias("span_id"), "start_sample", "end_sample")


CLIPPED = f"""(SELECT t.recording_id, p.probe_id AS span_id, t.speaker, greatest(t.start_sample, p.start_sample) AS start_sample, least(t.end_sample, p.end_sample) AS end_sample
FROM {T} t JOIN {L} p ON t.recording_id = p.recording_id AND t.start_sample < p.end_sample AND p.start_sample < t.end_sample AND t.start_sample < t.end_sample)"""


@query("j20_clipped_turns", f"SELECT * FROM {CLIPPED} q")
def _(s, d):
    return ranges.clipped(view(s, d, "turns"), spans(s, d))


@query("a16_p27_span_speakers", f"""SELECT p.recording_id, p.probe_id AS span_id, coalesce(string_agg(DISTINCT speaker, ',' ORDER BY speaker), '') AS candidates,
CASE count(DISTINCT speaker) WHEN 0 THEN 'unassigned' WHEN 1 THEN min(speaker) ELSE 'multiple_speakers' END AS speaker
FROM {L} p LEFT JOIN {CLIPPED} c ON p.recording_id = c.recording_id AND p.probe_id = c.span_id GROUP BY 1, 2""")
def _(s, d):
    return ranges.span_speakers(view(s, d, "turns"), spans(s, d))


EPOCHS = f"(SELECT recording_id, language_epoch, min(start_sample) AS start_sample FROM {N} n WHERE NOT late GROUP BY 1, 2)"


@query("j4_epoch_at", f"SELECT t.recording_id, t.turn_id, t.start_sample, e.language_epoch FROM {T} t ASOF LEFT JOIN {EPOCHS} e ON t.recording_id = e.recording_id AND t.start_sample >= e.start_sample")
def _(s, d):
    epochs = view(s, d, "audio_notices").where("NOT late").groupBy("recording_id", "language_epoch").agg(F.min("start_sample").alias("start_sample"))
    return ranges.epoch_at(view(s, d, "turns"), epochs)


@query("g3_clip_windows", f"""SELECT recording_id, a AS start_sample, CASE WHEN whole THEN z ELSE least(a + 96000, z) END AS end_sample, whole FROM (
SELECT recording_id, end_sample AS z, end_sample - start_sample <= 160000 AS whole, unnest(CASE WHEN end_sample - start_sample <= 160000 THEN [start_sample] ELSE generate_series(start_sample, end_sample - 32000, 96000) END) AS a
FROM {ISLANDS} q WHERE end_sample - start_sample >= 32000) x""")
def _(s, d):
    return ranges.clip_windows(intervals.islands(view(s, d, "turns")))


@query("w15_withdrawn_times", f"""SELECT recording_id, pos, CASE WHEN NOT bad THEN start_sample END AS start_sample, CASE WHEN NOT bad THEN end_sample END AS end_sample FROM (
SELECT *, coalesce(lag(end_sample) OVER w > start_sample, false) OR coalesce(end_sample > lead(start_sample) OVER w, false) AS bad FROM {P} q WINDOW w AS (PARTITION BY recording_id ORDER BY pos)) x""")
def _(s, d):
    return ranges.withdraw_overlapping(view(s, d, "passages"))


@query("w14_contiguous", f"""SELECT recording_id, bool_and(touch) AND max(end_sample) = max(duration) AS contiguous FROM (
SELECT c.*, c.recording_id AS r, (SELECT max(end_sample) FROM {T} t WHERE t.recording_id = c.recording_id) AS duration, coalesce(lag(end_sample) OVER (PARTITION BY recording_id ORDER BY start_sample, end_sample) = start_sample, start_sample = 0) AS touch FROM {ISLANDS} c) x GROUP BY recording_id""")
def _(s, d):
    t = view(s, d, "turns")
    return ranges.contiguous(intervals.islands(t), durations(t, 0))


@query("w20_last_edits", f"SELECT * FROM {E} q QUALIFY row_number() OVER (PARTITION BY recording_id, pos ORDER BY edit_id DESC) <= 8")
def _(s, d):
    return ranges.last_n(view(s, d, "edits"), ["recording_id", "pos"], "edit_id", 8)


INCOMING = "SELECT recording_id, pos, passage_id, CASE WHEN pos % 5 = 2 THEN 'speaker_2' ELSE speaker END AS speaker, CASE WHEN recording_id % 3 = 0 THEN concat(text, '!') ELSE text END AS text, CASE WHEN pos % 4 = 1 THEN start_sample + 160 ELSE start_sample END AS start_sample, end_sample FROM %s q WHERE pos % 7 <> 6 UNION ALL SELECT recording_id, 1000 + pos, concat('new-', passage_id), speaker, text, start_sample, end_sample FROM %s q WHERE pos = 0".replace("% ", "%% ")


@query("j10_u6_edited_keys", f"""SELECT coalesce(a.recording_id, b.recording_id) AS recording_id, coalesce(a.passage_id, b.passage_id) AS passage_id,
CASE WHEN a.pos IS NULL THEN 'new' WHEN b.pos IS NULL THEN 'removed' WHEN a.text IS DISTINCT FROM b.text OR a.speaker IS DISTINCT FROM b.speaker OR a.start_sample IS DISTINCT FROM b.start_sample OR a.end_sample IS DISTINCT FROM b.end_sample THEN 'edited' ELSE 'same' END AS status,
CASE WHEN a.pos IS NULL OR b.pos IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.text IS DISTINCT FROM b.text THEN 'text' END, CASE WHEN a.speaker IS DISTINCT FROM b.speaker THEN 'speaker' END, CASE WHEN a.start_sample IS DISTINCT FROM b.start_sample THEN 'start' END, CASE WHEN a.end_sample IS DISTINCT FROM b.end_sample THEN 'end' END) END AS edited_keys
FROM {P} a FULL JOIN ({INCOMING % (P, P)}) b ON a.recording_id = b.recording_id AND a.passage_id = b.passage_id""")
def _(s, d):
    p = view(s, d, "passages")
    return ranges.compare(p, s.sql(INCOMING % ("{p}", "{p}"), p=p))


# Windows over spans


@query("u7_windows", f"""WITH i AS {ISLANDS}, d AS (SELECT recording_id, max(end_sample) + 1000 AS duration FROM {T} GROUP BY 1), g AS (SELECT recording_id, lag(end_sample, 1, 0) OVER (PARTITION BY recording_id ORDER BY start_sample) AS start_sample, start_sample AS end_sample FROM i
UNION ALL SELECT d.recording_id, max(end_sample), max(duration) FROM d JOIN i ON i.recording_id = d.recording_id GROUP BY 1)
SELECT recording_id, start_sample, end_sample, true AS speech FROM i UNION ALL SELECT *, false FROM g WHERE end_sample > start_sample""")
def _(s, d):
    t = view(s, d, "turns")
    return intervals.windows(t, durations(t, 1000))


LONG = f"(SELECT recording_id, start_sample, end_sample + recording_id % 5 * 90000 AS end_sample FROM {ISLANDS} q)"


def long_spans(s: SparkSession, d: str) -> DataFrame:
    return intervals.islands(view(s, d, "turns")).withColumn("end_sample", F.col("end_sample") + F.col("recording_id") % 5 * 90000)


WINDOWED = "SELECT recording_id, start_sample, end_sample, core_start, core_end, greatest(core_start - 48000, start_sample) AS window_start, least(core_end + 48000, end_sample) AS window_end FROM"


@query("g5_context_windows", f"""{WINDOWED} (SELECT *, start_sample + (end_sample - start_sample) * i // n AS core_start, start_sample + (end_sample - start_sample) * (i + 1) // n AS core_end
FROM (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM (SELECT *, (end_sample - start_sample + 223999) // 224000 AS n FROM {LONG} q) x) y) z""")
def _(s, d):
    return intervals.context_windows(long_spans(s, d))


@query("g6_fixed_windows", f"""{WINDOWED} (SELECT *, least(core_start + step, end_sample) AS core_end FROM (SELECT *, unnest(generate_series(start_sample, end_sample - 1, step)) AS core_start
FROM (SELECT *, CASE WHEN end_sample - start_sample > 320000 THEN 224000 ELSE end_sample - start_sample END AS step FROM {LONG} q) x) y) z""")
def _(s, d):
    return intervals.fixed_windows(long_spans(s, d))


@query("g8_tiles", f"SELECT recording_id, tile, greatest(start_sample, tile * 4000) AS start_sample, least(end_sample, tile * 4000 + 4000) AS end_sample FROM (SELECT *, unnest(generate_series(start_sample // 4000, (end_sample - 1) // 4000)) AS tile FROM {ISLANDS} q) x")
def _(s, d):
    return intervals.tiles(intervals.islands(view(s, d, "turns")))


@query("o4_best_range", f"SELECT recording_id, start_sample, least(end_sample, start_sample + 96000) AS end_sample FROM {ISLANDS} q WHERE end_sample - start_sample >= 32000 QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY end_sample - start_sample DESC, start_sample) = 1")
def _(s, d):
    return intervals.best_range(view(s, d, "turns"))


# Ordered passes


@query("w5_decode_regions", None)
def _(s, d):
    return folds.decode_regions(intervals.coalesce_equal(intervals.elementary(view(s, d, "turns"))))


@query("v3_w12_chosen_clips", None)
def _(s, d):
    return folds.chosen_clips(ranges.clip_windows(intervals.islands(view(s, d, "turns"))))


@query("g7_cut_plans", None)
def _(s, d):
    """Spans cut at silences between their speech; a gap of an even number of frames counts as verified."""
    long, inside = long_spans(s, d).withColumn("span_id", F.col("start_sample")), view(s, d, "turns").withColumn("speaker", F.lit("any"))
    solid = intervals.islands(inside).withColumn("speaker", F.lit("any"))
    w = Window.partitionBy("recording_id", "span_id").orderBy("a")
    talk = ranges.clipped(solid, long).select("recording_id", "span_id", F.col("start_sample").alias("a"), F.col("end_sample").alias("z"))
    gap = F.struct(F.col("z").alias("a"), F.lead("a").over(w).alias("z"))
    gaps = talk.withColumn("g", gap).where("g.z IS NOT NULL").select("recording_id", "span_id", F.struct("g.a", "g.z", (F.floor((F.col("g.z") - F.col("g.a")) / 512) % 2 == 0).alias("sure")).alias("g"))
    grouped = gaps.groupBy("recording_id", "span_id").agg(F.array_sort(F.collect_list("g")).alias("gaps"))
    none = F.array().cast("array<struct<a:bigint,z:bigint,sure:boolean>>")
    return folds.cut_plans(long.join(grouped, ["recording_id", "span_id"], "left").withColumn("gaps", F.coalesce("gaps", none)))


MATCHES = "SELECT user_id AS recording_id, event_id %% 2 AS channel, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS n, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS DOUBLE) * 8000 AS centre, floor(event_id / 640.0E0) %% 3 * 60 + floor(value) %% 2 AS delay FROM %s"


def matches(s: SparkSession, d: str) -> DataFrame:
    return s.sql(MATCHES % f"parquet.`{d}/events.parquet`")


@query("w16_regime_changes", None)
def _(s, d):
    return folds.regime_changes(matches(s, d))


@query("a13_drift", f"""WITH m AS ({MATCHES % 'events'}), c AS (SELECT recording_id, centre - avg(centre) OVER w AS t, delay - avg(delay) OVER w AS d, count(*) OVER w AS k FROM m WINDOW w AS (PARTITION BY recording_id, channel)),
x AS (SELECT recording_id, sum(t * t) AS tt, sum(t * d) AS td, sum(d * d) AS dd, count(*) AS n FROM c WHERE k >= 4 GROUP BY recording_id)
SELECT recording_id, round(td / tt, 9) AS slope, round(sqrt(greatest(0, dd - td * td / tt) / n), 6) AS error, abs(td / tt) <= 0.0005 AND sqrt(greatest(0, dd - td * td / tt) / n) < 0.6 AS accepted FROM x WHERE tt > 0""")
def _(s, d):
    return folds.drift(matches(s, d)).withColumns({"slope": F.round("slope", 9), "error": F.round("error", 6)})


@query("a14_smoothing", f"SELECT recording_id, round(list_reduce(list(delay ORDER BY n), lambda s, x: s * 0.75::DOUBLE + x * 0.25::DOUBLE), 9) AS smoothed FROM ({MATCHES % 'events'}) q GROUP BY recording_id")
def _(s, d):
    return folds.smoothed(matches(s, d).withColumn("value", F.col("delay"))).withColumn("smoothed", F.round("smoothed", 9))


# Changes of passages

CANDIDATES = f"""(SELECT recording_id, passage_id, CASE WHEN pos % 6 = 1 THEN '' ELSE text || ' more' END AS text, CASE WHEN pos % 4 = 0 THEN 'speaker_9' ELSE speaker END AS speaker, start_sample + 160 AS start_sample, end_sample FROM {S} q WHERE pos % 5 <> 3
UNION ALL SELECT recording_id, 'live-' || passage_id, text, speaker, start_sample, end_sample FROM {S} q WHERE pos = 0)"""


def candidates(p: DataFrame) -> DataFrame:
    text, speaker = F.when(F.col("pos") % 6 == 1, "").otherwise(F.concat("text", F.lit(" more"))), F.when(F.col("pos") % 4 == 0, "speaker_9").otherwise(F.col("speaker"))
    moved = p.where("pos % 5 <> 3").select("recording_id", "passage_id", text.alias("text"), speaker.alias("speaker"), (F.col("start_sample") + 160).alias("start_sample"), "end_sample")
    return moved.unionByName(p.where("pos = 0").select("recording_id", F.concat(F.lit("live-"), "passage_id").alias("passage_id"), "text", "speaker", "start_sample", "end_sample"))


KEPT = "(a.deleted OR a.finalized = false OR b.speaker IS NULL)"


@query("e8_live_merge", f"""SELECT coalesce(a.recording_id, b.recording_id) AS recording_id, coalesce(a.passage_id, b.passage_id) AS passage_id,
CASE WHEN a.speaker IS NULL THEN b.text WHEN {KEPT} OR a.protected = 'text' OR trim(b.text) = '' AND trim(a.text) <> '' THEN a.text ELSE b.text END AS text,
CASE WHEN a.speaker IS NULL THEN b.speaker WHEN {KEPT} OR a.protected = 'speaker,start' THEN a.speaker ELSE b.speaker END AS speaker,
CASE WHEN a.speaker IS NULL THEN b.start_sample WHEN {KEPT} OR a.protected = 'speaker,start' THEN a.start_sample ELSE b.start_sample END AS start_sample,
CASE WHEN a.speaker IS NULL OR NOT {KEPT} THEN b.end_sample ELSE a.end_sample END AS end_sample, CASE WHEN a.speaker IS NULL THEN 'new' WHEN {KEPT} THEN 'kept' ELSE 'merged' END AS origin
FROM {S} a FULL JOIN {CANDIDATES} b ON a.recording_id = b.recording_id AND a.passage_id = b.passage_id""")
def _(s, d):
    p = view(s, d, "states")
    return changes.live_merge(p.withColumn("refined", ~F.col("finalized")), candidates(p))


@query("e3_e5_j18_whole_save", f"""SELECT b.recording_id, b.passage_id, b.text, b.speaker, a.audio_state, a.review_code, CASE WHEN a.passage_id IS NULL THEN 'manual' ELSE 'imported' END AS provenance FROM {CANDIDATES} b LEFT JOIN {S} a ON a.recording_id = b.recording_id AND a.passage_id = b.passage_id
UNION ALL SELECT recording_id, passage_id, text, speaker, audio_state, review_code, 'imported' FROM {S} a WHERE deleted AND NOT EXISTS (SELECT 1 FROM {CANDIDATES} b WHERE a.recording_id = b.recording_id AND a.passage_id = b.passage_id)""")
def _(s, d):
    p = view(s, d, "states")
    return changes.whole_save(p, candidates(p).select("recording_id", "passage_id", "text", "speaker"), ["audio_state", "review_code"])


VERSION = "sha256(concat_ws(chr(31), '=' || text, '=' || speaker, '=' || CAST(start_sample AS VARCHAR), coalesce('=' || audio_state, '-')))"


@query("j11_a18_current_candidates", f"""SELECT c.recording_id, c.passage_id, c.version FROM (SELECT recording_id, passage_id, {VERSION.replace('text', "CASE WHEN pos % 3 = 0 THEN text || '?' ELSE text END")} AS version FROM {S} q) c
JOIN (SELECT recording_id, passage_id, {VERSION} AS version FROM {S} q) p ON c.recording_id = p.recording_id AND c.passage_id = p.passage_id AND c.version = p.version""")
def _(s, d):
    p = view(s, d, "states")
    hashed = lambda x: x.select("recording_id", "passage_id", changes.version("text", "speaker", "start_sample", "audio_state").alias("version"))
    return changes.current(hashed(p.withColumn("text", F.when(F.col("pos") % 3 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text")))), hashed(p))


@query("e6_interpretation_changed", f"""SELECT recording_id, bool_or(changed) AS changed FROM (SELECT coalesce(a.recording_id, b.recording_id) AS recording_id, a.passage_id IS NULL OR b.passage_id IS NULL OR a.language IS DISTINCT FROM b.language OR b.moved OR a.protected LIKE '%speaker%' <> b.guarded OR b.manual AS changed
FROM {S} a FULL JOIN (SELECT recording_id, passage_id, CASE WHEN recording_id % 7 = 0 AND pos = 2 THEN 'fr' ELSE language END AS language, recording_id % 11 = 0 AND pos = 1 AS moved, protected LIKE '%speaker%' OR recording_id % 13 = 0 AND pos = 0 AS guarded,
  detection_mode = 'manual' AND recording_id % 17 = 0 AS manual FROM {S} q WHERE recording_id % 5 <> 0 OR pos <> 0) b ON a.recording_id = b.recording_id AND a.passage_id = b.passage_id) x GROUP BY recording_id""")
def _(s, d):
    """Speaker labels and texts change everywhere, and what counts in some recordings only."""
    p = said_states(s, d).withColumns({c: F.lit(None).cast("string") for c in ("language_mode", "stream_generation", "speaker_candidates")})
    r, at = F.col("recording_id"), F.col("pos")
    later = p.where("recording_id % 5 <> 0 OR pos <> 0").withColumns({
        "speaker": F.lit("speaker_9"), "text": F.concat("text", F.lit("!")), "language": F.when((r % 7 == 0) & (at == 2), "fr").otherwise(F.col("language")), "audio_revision": F.when((r % 11 == 0) & (at == 1), 2).otherwise(1),
        "protected": F.when((r % 13 == 0) & (at == 0), "speaker").otherwise(F.col("protected")), "detection_reason": F.when(r % 17 == 0, "other").otherwise(F.col("detection_reason"))})
    return changes.interpretation_changed(p, later)


@query("e16_invalidated", f"""SELECT recording_id, passage_id, text, speaker, start_sample, end_sample, CASE WHEN NOT hit THEN audio_state END AS audio_state, CASE WHEN NOT hit THEN resolution END AS resolution, CASE WHEN NOT hit THEN detection_reason END AS detection_reason, CASE WHEN NOT hit THEN eligible END AS eligible,
1 + CASE WHEN hit THEN 1 ELSE 0 END AS audio_revision, revision + CASE WHEN hit THEN 1 ELSE 0 END AS machine_revision, hit OR separated AS review, hit OR sealed AS sealed, hit OR finalized AS finalized, CASE WHEN hit THEN 'capture_audio_repaired' END AS unresolved, CASE WHEN hit AND protected = '' THEN 'unresolved' ELSE state END AS state
FROM (SELECT q.*, coalesce(end_sample > repaired_from, false) AS hit FROM {S} q LEFT JOIN (SELECT recording_id, min(start_sample) AS repaired_from FROM {N} n WHERE late GROUP BY 1) r ON q.recording_id = r.recording_id) x""")
def _(s, d):
    p = said_states(s, d).withColumns({"review": F.col("separated"), "unresolved": F.lit(None).cast("string")})
    found = changes.invalidated(p, capture.repairs(packets(s, d)))
    return found.select("recording_id", "passage_id", "text", "speaker", "start_sample", "end_sample", "audio_state", "resolution", "detection_reason", "eligible", "audio_revision", "machine_revision", "review", "sealed", "finalized", "unresolved", "state")


@query("e16_repaired_recordings", f"""SELECT recording_id, revision + CASE WHEN place IS NULL THEN 0 ELSE 1 END AS stream_generation, CASE WHEN place IS NULL THEN 0 ELSE 1 END AS context_generation, 3 + CASE WHEN place IS NULL THEN 0 ELSE 1 END AS audio_revision, place AS repaired_from
FROM {R} q LEFT JOIN (SELECT recording_id, min(start_sample) AS place FROM {N} n WHERE late GROUP BY 1) r USING (recording_id)""")
def _(s, d):
    r = view(s, d, "recordings").select("recording_id", F.col("revision").alias("stream_generation"), F.lit(None).cast("long").alias("context_generation"), F.lit(3).alias("audio_revision"), F.lit(None).cast("long").alias("repaired_from"))
    return changes.repaired(r, capture.repairs(packets(s, d)))


#: Refined candidates of every third passage: some of an older text, some protected, some with a wrong revision, and some whose witness (the passage itself in an older version) is gone.
REFINED = f"""SELECT recording_id, passage_id, CASE WHEN k % 5 = 0 THEN 'context' WHEN protected <> '' THEN 'protected' WHEN k % 7 = 0 THEN 'stale' WHEN NOT sealed OR k % 11 = 0 OR trim(text) = '' THEN 'invalid' ELSE 'published' END AS outcome
FROM (SELECT *, recording_id + pos AS k FROM {S} q) x WHERE pos % 3 = 0"""


def documents_to_refine(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = said_states(s, d).withColumns({"language_generation": F.lit(0), "language_mode": F.lit("auto"), "canonical_state": F.when(F.col("sealed"), "sealed").otherwise("open"), "refinement_state": F.col("state"), "machine_revision": F.col("revision"), "canonical_revision": F.col("revision")})
    k = F.col("recording_id") + F.col("pos")
    own = publishing.passage_version()
    none = F.expr("CAST(array() AS array<struct<passage_id: string, version: string>>)")
    gone = F.when(k % 5 == 0, F.array(F.struct("passage_id", F.lit("older").alias("version")))).otherwise(none)
    made = rows.where("pos % 3 = 0").withColumns({"of_version": F.when(k % 7 == 0, "older").otherwise(own), "witnesses": gone})
    made = made.withColumns({"machine_revision": F.col("machine_revision") + F.when(k % 11 == 0, 2).otherwise(1), "canonical_revision": F.col("canonical_revision") + 1, "text": F.when(F.trim("text") == "", "").otherwise(F.concat("text", F.lit(" (refined)"))), "review_code": F.lit(None).cast("string")})
    return rows, made.select("recording_id", "passage_id", *publishing.IDENTITY, "text", "machine_revision", "canonical_revision", "review_code", "of_version", "witnesses")


@query("e7_j12_refinements", REFINED)
def _(s, d):
    return publishing.refinements(*documents_to_refine(s, d))


@query("e7_published", f"SELECT q.recording_id, q.passage_id, CASE WHEN outcome = 'published' THEN text || ' (refined)' ELSE text END AS text, revision + CASE WHEN outcome = 'published' THEN 1 ELSE 0 END AS machine_revision FROM {S} q LEFT JOIN ({REFINED}) r ON q.recording_id = r.recording_id AND q.passage_id = r.passage_id")
def _(s, d):
    """As a stream in two steps, each row twice: the second time it is stale."""
    rows, made = documents_to_refine(s, d)
    home = shared_folder(s)
    store = Store(s, f"{home}/store")
    store.begin(rows)
    for i in range(2):
        made.where(F.col("recording_id") % 2 <= i).write.mode("append").parquet(f"{home}/candidates")
        published(s.readStream.schema(made.schema).parquet(f"{home}/candidates"), store, f"{home}/state").awaitTermination()
    return store.rows().select("recording_id", "passage_id", "text", F.col("machine_revision").cast("long").alias("machine_revision"))


@query("e19_imports", f"""SELECT recording_id, passage_id, CASE WHEN recording_id % 4 = 0 THEN 'superseded' WHEN recording_id % 6 = 1 AND max(CASE WHEN pos % 2 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id) = 1 THEN 'context' WHEN pos % 2 = 0 THEN 'kept' ELSE 'inserted' END AS outcome FROM {S} q""")
def _(s, d):
    """Rows at even positions are there; every fourth recording has a later checkpoint, and new rows of every sixth borrow from a passage that is gone."""
    rows, _ = documents_to_refine(s, d)
    none = F.expr("CAST(array() AS array<struct<passage_id: string, version: string>>)")
    borrowed = F.when((F.col("recording_id") % 6 == 1) & (F.col("pos") % 2 == 1), F.array(F.struct(F.lit("gone").alias("passage_id"), F.lit("v").alias("version")))).otherwise(none)
    step = rows.withColumns({"source_sha256": F.lit("s"), "plan_sha256": F.lit("p"), "next_work": F.lit(3), "witnesses": borrowed})
    at = rows.select("recording_id").distinct().select("recording_id", F.lit("s").alias("source_sha256"), F.lit("p").alias("plan_sha256"), F.when(F.col("recording_id") % 4 == 0, 9).otherwise(2).alias("next_work"))
    return publishing.imports(rows.where("pos % 2 = 0"), at, step).select("recording_id", "passage_id", "outcome")


@query("e22_live_outcomes", f"""SELECT recording_id, passage_id, CASE WHEN recording_id % 5 = 0 THEN 'superseded' WHEN recording_id % 5 = 1 THEN CASE WHEN protected <> '' OR (recording_id + pos) % 4 = 0 THEN 'lost' ELSE 'retry' END WHEN pos % 6 = 5 THEN 'split' WHEN protected <> '' THEN 'sealed' ELSE 'published' END AS outcome FROM {S} q""")
def _(s, d):
    """Every fifth recording has another stream generation and the next one another context; passages at every sixth position were split, and candidates are half a second longer."""
    rows, _ = documents_to_refine(s, d)
    k = F.col("recording_id") + F.col("pos")
    made = rows.withColumns({"stream_generation": F.lit(1), "context_generation": F.when(F.col("recording_id") % 2 < 2, 3), "end_sample": F.col("end_sample") + 8000, "capture_source": F.when(k % 4 == 0, "other").otherwise(F.col("capture_source"))})
    r = rows.select("recording_id").distinct().select("recording_id", F.when(F.col("recording_id") % 5 == 0, 2).otherwise(1).alias("stream_generation"), F.when(F.col("recording_id") % 5 == 1, 4).otherwise(3).alias("context_generation"))
    voices = rows.where("pos % 6 = 5").withColumn("original", F.col("passage_id")).withColumn("passage_id", F.concat("passage_id", F.lit("-0")))
    return publishing.live_outcomes(r, rows.withColumn("original", F.lit(None).cast("string")).unionByName(voices), made)


@query("s11_j17_upsert", f"""SELECT recording_id, name, revision + 1 AS revision FROM {R} q WHERE recording_id % 2 = 0 UNION ALL SELECT recording_id, name, revision FROM {R} q WHERE recording_id % 3 <> 0 AND recording_id % 2 <> 0""")
def _(s, d):
    r = view(s, d, "recordings").select("recording_id", "name", "revision")
    return changes.latest(r.where("recording_id % 3 <> 0"), r.where("recording_id % 2 = 0").withColumn("revision", F.col("revision") + 1), ["recording_id"])


@query("s14_grown_checkpoints", f"SELECT recording_id, max(duration_s) AS duration_s FROM (SELECT recording_id, duration_s FROM {R} q UNION ALL SELECT recording_id, duration_s + recording_id % 7 - 3 FROM {R} q WHERE recording_id % 2 = 0) x GROUP BY recording_id")
def _(s, d):
    r = view(s, d, "recordings").select("recording_id", "duration_s")
    return changes.grown(r, r.where("recording_id % 2 = 0").withColumn("duration_s", F.col("duration_s") + F.col("recording_id") % 7 - 3))


@query("s13_capped_batch", f"""WITH r AS {R}, b AS (SELECT recording_id, kind FROM r WHERE status = 'ready'),
a AS (SELECT count(*) FILTER (WHERE status = 'recording') AS busy, count(*) FILTER (WHERE status = 'recording' AND kind = 'meeting') AS meetings, count(*) FILTER (WHERE status = 'ready') AS more, count(*) * 2 // 5 AS most FROM r),
k AS (SELECT 1 AS batch, * FROM b UNION ALL SELECT 2, * FROM b UNION ALL SELECT CASE kind WHEN 'meeting' THEN 3 ELSE 4 END, * FROM b),
g AS (SELECT batch, count(*) AS n FROM k GROUP BY batch)
SELECT batch, recording_id, kind FROM k JOIN g USING (batch) CROSS JOIN a WHERE n + CASE WHEN batch <= 2 THEN busy ELSE meetings END <= CASE batch WHEN 1 THEN busy + more WHEN 2 THEN busy + more - 1 ELSE most END""")
def _(s, d):
    """All ready rows as two batches: the first takes the last free place, the second finds one too few and is refused whole. And one batch a kind, against the meetings under way and two fifths of all."""
    r = view(s, d, "recordings")
    active, ready = r.where("status = 'recording'"), r.where("status = 'ready'").select("recording_id", "kind")
    room = active.count() + ready.count()
    meetings, most = active.where("kind = 'meeting'"), r.count() * 2 // 5
    batch = lambda n, rows: rows.select(F.lit(n).alias("batch"), "*")
    taken = [changes.within_limit(active, batch(1, ready), room), changes.within_limit(active, batch(2, ready), room - 1)]
    taken += [changes.within_limit(meetings, batch(n, ready.where(own)), most) for n, own in ((3, "kind = 'meeting'"), (4, "kind <> 'meeting'"))]
    return reduce(DataFrame.unionByName, taken)


@query("e15_dismissed", f"SELECT recording_id, string_agg(CAST(edit_id AS VARCHAR), ',' ORDER BY edit_id) AS ids, count(*) AS n FROM (SELECT * FROM {E} q QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY edit_id DESC) <= 256) x GROUP BY recording_id")
def _(s, d):
    return changes.dismissed(view(s, d, "edits"))


# Scalar rules


@query("f9_utterance_ids", f"SELECT recording_id, start_sample, 'utterance-' || substr(sha256(concat_ws(':', CAST(recording_id AS VARCHAR), '0', CAST(start_sample AS VARCHAR))), 1, 24) AS utterance_id FROM ({UTTERANCES}) q")
def _(s, d):
    u = speech.utterances(view(s, d, "vad_frames"))
    return u.select("recording_id", "start_sample", scalars.utterance_id(F.col("recording_id"), F.lit(0), F.col("start_sample")).alias("utterance_id"))


@query("f14_quiet_gain", f"SELECT recording_id, start_sample, CASE WHEN p100 = 0 THEN 1.0::DOUBLE ELSE least(256.0::DOUBLE, greatest(1.0::DOUBLE, 0.25::DOUBLE / (p100 / 100.0::DOUBLE))) END AS gain FROM {V} q")
def _(s, d):
    return view(s, d, "vad_frames").select("recording_id", "start_sample", scalars.quiet_gain(F.col("p100") / 100.0).alias("gain"))


@query("f11_colors", f"""SELECT DISTINCT id, CASE WHEN id = 'unassigned' THEN -1 ELSE CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(id, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) % 8 AS INTEGER) END AS color
FROM (SELECT speaker AS id FROM {P} p UNION SELECT track_id FROM {CLIPS} c) x""")
def _(s, d):
    ids = view(s, d, "passages").select(F.col("speaker").alias("id")).unionByName(view(s, d, "clips").select(F.col("track_id").alias("id"))).distinct()
    return ids.select("id", scalars.color(F.col("id")).alias("color"))


@query("f2_f13_clocks", f"""SELECT recording_id, passage_id, lpad(CAST(u // 600000 AS VARCHAR), CAST(greatest(2, length(CAST(u // 600000 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(u % 600000 // 10000 AS VARCHAR), 2, '0') || '.' || lpad(CAST(u % 10000 AS VARCHAR), 4, '0') AS clock,
CAST(floor(x * 16000) AS BIGINT) AS low, CAST(ceil(x * 16000) AS BIGINT) AS high, CAST(round(x * 16000) AS BIGINT) AS nearest FROM (SELECT *, CAST(floor(start_sample * 10000 / 16000.0::DOUBLE + 0.5) AS BIGINT) AS u, start_sample / 48000.0::DOUBLE AS x FROM {P} q) z""")
def _(s, d):
    seconds = F.col("start_sample") / F.lit(48000.0)
    return view(s, d, "passages").select("recording_id", "passage_id", scalars.review_clock(F.col("start_sample")).alias("clock"), *(scalars.to_samples(seconds, w).alias(n) for w, n in (("floor", "low"), ("ceil", "high"), ("round", "nearest"))))


@query("f11_initials", f"""SELECT DISTINCT speaker, label, CASE WHEN speaker = 'multiple_speakers' THEN '…' WHEN speaker = 'unassigned' THEN '?' WHEN regexp_matches(label, '^Speaker [0-9]+$') THEN 'S' || regexp_extract(label, '[0-9]+') WHEN label = 'Unknown speaker' THEN '?'
ELSE upper(substr(string_split_regex(trim(label), ' +')[1], 1, 1) || coalesce(substr(string_split_regex(trim(label), ' +')[2], 1, 1), '')) END AS initials FROM {NAMED} q""")
def _(s, d):
    return labelled(s, d).select("speaker", "label", scalars.initials(F.col("label"), F.col("speaker")).alias("initials")).distinct()


NAMES_OF_FILES = "'../up/' || substr(text, 1, 24) || chr(160) || '(v' || CAST(pos AS VARCHAR) || ').txt'"


#: White space of any kind, for RE2.
BLANK = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


@query("f12_safe_file_names", rf"""SELECT recording_id, passage_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract({NAMES_OF_FILES}, '([^/]*)/*$', 1), '[^A-Za-z0-9.{BLANK}-]', '', 'g'), '^[{BLANK}]+|[{BLANK}]+$', '', 'g'), '[{BLANK}]+', '_', 'g'), '^[._]+', '') AS file FROM {P} q""")
def _(s, d):
    name = F.concat(F.lit("../up/"), F.substring("text", 1, 24), F.lit("\u00a0(v"), F.col("pos").cast("string"), F.lit(").txt"))
    return view(s, d, "passages").select("recording_id", "passage_id", scalars.safe_file_name(name).alias("file"))


@query("f10_namespaced", f"SELECT recording_id, turn_id, 'speaker_' || CAST(CAST(substr(speaker, 9) AS BIGINT) + 32 * (turn_id % 2) + 64 * (turn_id % 3) AS VARCHAR) AS speaker FROM {T} q")
def _(s, d):
    return view(s, d, "turns").select("recording_id", "turn_id", scalars.namespaced(F.col("speaker"), F.col("turn_id") % 2, F.col("turn_id") % 3).alias("speaker"))


@query("f16_masked_softmax", f"""SELECT clip_id, list_transform(e, lambda x: round(x / list_sum(e), 9)) AS p FROM (SELECT clip_id, list_transform(own, lambda x: exp(x - list_max(own))) AS e FROM (SELECT clip_id, [embedding[1]::DOUBLE, embedding[3]::DOUBLE, embedding[4]::DOUBLE] AS own FROM {CLIPS} q) x) y""")
def _(s, d):
    logits = F.transform("embedding", lambda x: x.cast("double"))
    p = scalars.masked_softmax(logits, F.array(*map(F.lit, (0, 2, 3))))
    return view(s, d, "clips").select("clip_id", F.transform(p, lambda x: F.round(x, 9)).alias("p"))


# Reading turns

#: Words of a passage with made-up times: one in eleven has none, one in seven starts before the last has ended. Regions are thirds of the passage.
WORDS = f"""(SELECT *, CASE WHEN (pos + n) % 11 <> 0 THEN low + start_char * 1000 - CASE WHEN (pos + n) % 7 = 0 AND n > 1 THEN 3000 ELSE 0 END END AS s, CASE WHEN (pos + n) % 11 <> 0 THEN low + end_char * 1000 END AS e
FROM (SELECT *, CAST(stop - length(ltrim(run, ' ' || chr(9) || chr(10) || chr(13))) AS INTEGER) AS start_char, stop AS end_char FROM (SELECT *, CAST(sum(length(run)) OVER (PARTITION BY recording_id, passage_id ORDER BY n) AS INTEGER) AS stop
FROM (SELECT recording_id, pos, passage_id, speaker, text, start_sample AS low, end_sample AS high, unnest(regexp_extract_all(text, '\\s*\\S+')) AS run, unnest(generate_series(1, len(regexp_extract_all(text, '\\s*\\S+')))) AS n FROM {P} p) x) y) z)""".replace("\\\\", "\\")
REGIONS = f"""(SELECT *, recording_id * 7 + pos * 3 AS k, low + (high - low) // 3 AS c1, low + 2 * (high - low) // 3 AS c2, CASE WHEN speaker LIKE 'speaker_%' THEN speaker ELSE '' END AS who FROM (SELECT recording_id, passage_id, pos, speaker, start_sample AS low, end_sample AS high FROM {P} p) x)"""
TURNS = f"""(WITH RECURSIVE w AS {WORDS}, q AS {REGIONS}, r AS (SELECT recording_id, passage_id, low AS a, c1 AS z, who FROM q UNION ALL SELECT recording_id, passage_id, c1, c2, CASE WHEN k % 4 = 0 THEN 'speaker_0,speaker_1' ELSE who END FROM q UNION ALL SELECT recording_id, passage_id, c2, high, CASE WHEN k % 3 = 0 THEN '' ELSE who END FROM q),
l AS (SELECT *, sum(CASE WHEN was = who THEN 0 ELSE 1 END) OVER (PARTITION BY recording_id, passage_id ORDER BY a) AS i FROM (SELECT *, lag(who) OVER (PARTITION BY recording_id, passage_id ORDER BY a) AS was FROM r) x),
m AS (SELECT recording_id, passage_id, i, min(a) AS a, max(z) AS z, who, max(max(i)) OVER (PARTITION BY recording_id, passage_id) AS parts FROM l GROUP BY recording_id, passage_id, i, who),
f AS (SELECT recording_id, passage_id, CAST(0 AS BIGINT) AS n, low AS last, false AS fits FROM q WHERE k % 13 <> 0
  UNION ALL SELECT w.recording_id, w.passage_id, w.n, CASE WHEN coalesce(f.last <= s AND s < e AND e <= high, false) THEN e ELSE f.last END, coalesce(f.last <= s AND s < e AND e <= high, false) FROM f JOIN w ON w.recording_id = f.recording_id AND w.passage_id = f.passage_id AND w.n = f.n + 1),
o AS (SELECT w.*, f.fits, CASE WHEN w.pos % 5 = 0 THEN w.high END AS seen FROM w JOIN f USING (recording_id, passage_id, n)),
h AS (SELECT o.recording_id, o.passage_id, o.n, m.who FROM o JOIN m ON o.recording_id = m.recording_id AND o.passage_id = m.passage_id AND m.a <= s AND e <= m.z AND m.who <> '' AND o.fits
  AND CASE WHEN seen IS NOT NULL THEN least(high, e + 4000) <= seen ELSE low + 4000 <= s AND e <= high - 4000 AND m.a + CASE WHEN i = 1 THEN 0 ELSE 4000 END <= s AND e <= m.z - CASE WHEN i < parts THEN 4000 ELSE 0 END END
  WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.recording_id = o.recording_id AND b.passage_id = o.passage_id AND b.a < least(high, e + 4000) AND greatest(low, s - 4000) < b.z AND b.who <> '' AND b.who <> m.who)),
t AS (SELECT o.*, coalesce(h.who, '') AS who, CASE WHEN n = 1 THEN 0 ELSE start_char END AS p, coalesce(lead(start_char) OVER v, length(text)) AS nxt, lag(coalesce(h.who, '')) OVER v AS was FROM o LEFT JOIN h USING (recording_id, passage_id, n) WINDOW v AS (PARTITION BY recording_id, passage_id ORDER BY n)),
g AS (SELECT *, sum(CASE WHEN was = who THEN 0 ELSE 1 END) OVER (PARTITION BY recording_id, passage_id ORDER BY n) AS island FROM t)
SELECT recording_id, passage_id, CAST(island - 1 AS INTEGER) AS n, CASE WHEN who = '' THEN 'unassigned' WHEN who LIKE '%,%' THEN 'overlap_' || replace(who, ',', '_') ELSE who END AS speaker, CASE WHEN who = '' THEN 'unknown' WHEN who LIKE '%,%' THEN 'overlap' ELSE 'single' END AS attribution,
min(p) AS start_offset, max(nxt) AS end_offset, substr(min(text), CAST(min(p) + 1 AS INTEGER), CAST(max(nxt) - min(p) AS INTEGER)) AS text, CASE WHEN who <> '' THEN arg_min(s, g.n) END AS start_sample, CASE WHEN who <> '' THEN arg_max(e, g.n) END AS end_sample FROM g GROUP BY recording_id, passage_id, island, who)"""


def timed_passages(s: SparkSession, d: str) -> DataFrame:
    p = view(s, d, "passages").withColumn("units", reading.units(F.col("text")))
    n, low = lambda i: i + 1 + F.col("pos"), F.col("start_sample")
    early = lambda i: F.when((n(i) % 7 == 0) & (i > 0), 3000).otherwise(0)
    word = lambda w, i: F.struct(w["start_char"].alias("start_char"), w["end_char"].alias("end_char"), F.when(n(i) % 11 != 0, low + w["start_char"] * 1000 - early(i)).alias("start_sample"), F.when(n(i) % 11 != 0, low + w["end_char"] * 1000).alias("end_sample"))
    third = lambda k: low + F.floor(k * (F.col("end_sample") - low) / 3)
    key, none = F.col("recording_id") * 7 + F.col("pos") * 3, F.array().cast("array<string>")
    who = F.when(F.col("speaker").startswith("speaker_"), F.array("speaker")).otherwise(none)
    region = lambda a, z, names: F.struct(a.alias("start_sample"), z.alias("end_sample"), names.alias("speakers"))
    both = F.when(key % 4 == 0, F.array(F.lit("speaker_1"), F.lit("speaker_0"))).otherwise(who)
    regions = F.array(region(low, third(1), who), region(third(1) + F.when(key % 13 == 0, 1).otherwise(0), third(2), both), region(third(2), F.col("end_sample"), F.when(key % 3 == 0, none).otherwise(who)))
    seen = F.when(F.col("pos") % 5 == 0, F.col("end_sample"))
    return p.select("recording_id", "passage_id", "text", "start_sample", "end_sample", low.alias("anchor_start"), F.col("end_sample").alias("anchor_end"), seen.alias("observed_end"), F.transform("units", word).alias("words"), regions.alias("regions"))


@query("f7_units", f"SELECT recording_id, passage_id, n, start_char, end_char FROM {WORDS} q")
def _(s, d):
    u = view(s, d, "passages").select("recording_id", "passage_id", F.posexplode(reading.units(F.col("text"))).alias("i", "u"))
    return u.select("recording_id", "passage_id", (F.col("i") + 1).cast("long").alias("n"), "u.start_char", "u.end_char")


@query("w17_j2_reading_turns", TURNS[1:-1])
def _(s, d):
    return reading.reading_turns(timed_passages(s, d))


@query("p29_turn_coverage", f"SELECT p.recording_id, p.passage_id, coalesce(t.most IS NOT NULL AND NOT (p.recording_id % 3 = 0 AND t.most >= 1), false) AS covered FROM {P} p LEFT JOIN (SELECT recording_id, passage_id, max(n) AS most FROM {TURNS} q GROUP BY 1, 2) t ON p.recording_id = t.recording_id AND p.passage_id = t.passage_id")
def _(s, d):
    """Turns of which one in the middle is missing in every third recording."""
    turns = reading.reading_turns(timed_passages(s, d))
    return reading.coverage(turns.where("recording_id % 3 <> 0 OR n <> 1"), view(s, d, "passages"))


#: A tail of other scripts behind every text; its five units stand at these places behind the text's end.
TAIL = " 東京、タワー5"


@query("f7_mixed_units", f"""SELECT recording_id, passage_id, start_char, end_char, 'whitespace_run' AS unit_kind FROM {WORDS} q
UNION ALL SELECT recording_id, passage_id, CAST(length(text) + t.a AS INTEGER), CAST(length(text) + t.z AS INTEGER), t.kind FROM {P} p, (SELECT unnest([1, 2, 4, 5, 7]) AS a, unnest([2, 4, 5, 7, 8]) AS z, unnest(['ctc_character', 'ctc_character', 'ctc_character', 'ctc_character', 'whitespace_run']) AS kind) t""")
def _(s, d):
    u = view(s, d, "passages").select("recording_id", "passage_id", F.explode(preparing.units(F.concat("text", F.lit(TAIL)))).alias("u"))
    return u.select("recording_id", "passage_id", "u.start_char", "u.end_char", "u.unit_kind")


@query("f8_prepared", r"""WITH p AS (SELECT recording_id, passage_id, CASE WHEN length(text) > 4096 THEN NULL ELSE text END AS t, recording_id % 10 = 0 AS other FROM [P] q),
k AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(t, '\p{P}', '', 'g'), '[^A-Za-z\s]', '', 'g'), '\s+', ' ', 'g') AS said FROM p)
SELECT recording_id, passage_id, CASE WHEN t IS NULL OR other THEN 'unsupported' WHEN length(said) > 1024 THEN 'too_many' END AS error, CASE WHEN NOT other AND length(said) <= 1024 THEN trim(lower(said)) END AS said,
CASE WHEN NOT other AND length(said) <= 1024 THEN length(regexp_replace(t, '[\p{P}\sA-Za-z]', '', 'g')) END AS unsupported, CASE WHEN NOT other AND length(said) <= 1024 THEN length(regexp_replace(t, '[^A-Z]', '', 'g')) END AS aliases FROM k""".replace("[P]", P))
def _(s, d):
    """Against a vocabulary of a to z; every tenth recording is of a language that isn't supported."""
    vocabulary = ["<s>", "<pad>", " ", *"abcdefghijklmnopqrstuvwxyz"]
    language = F.when(F.col("recording_id") % 10 == 0, "sw").otherwise("en")
    p = view(s, d, "passages").select("recording_id", "passage_id", preparing.preparer(s, vocabulary)(F.col("text"), language).alias("p"))
    count = lambda c: F.when(F.col("p.error").isNull(), F.size(f"p.{c}"))
    said = F.array_join(F.transform("p.targets", lambda t: t["text"]), "")
    return p.select("recording_id", "passage_id", "p.error", said.alias("said"), count("unsupported").alias("unsupported"), count("aliases").alias("aliases"))


#: Windows of twelve words, four of them shared. A word takes 10,000 samples of every 12,000; odd windows hear all of it later by up to 5,400 samples.
STITCHED = rf"""(SELECT recording_id, passage_id, trim(text) AS text, m, greatest(1, (m + 3) // 8) AS n, recording_id % 7 * 900 AS shift FROM (SELECT *, len(regexp_extract_all(text, '\S+')) AS m FROM {P} q) x WHERE m > 0)"""


def heard_windows(s: SparkSession, d: str) -> DataFrame:
    p = view(s, d, "passages").withColumn("units", reading.units(F.col("text"))).withColumn("m", F.size("units")).where("m > 0")
    each = p.withColumn("n", F.explode(F.sequence(F.lit(0), F.expr("greatest(1, (m + 3) div 8) - 1"))))
    low, later = F.col("n") * 8, F.when(F.col("n") % 2 == 1, F.col("recording_id") % 7 * 900).otherwise(0)
    heard = each.withColumns({"later": later, "own": F.slice("units", low + 1, F.lit(12))}).withColumn("begin", F.col("own")[0]["start_char"])
    start = lambda i: ((F.col("n") * 8 + i) * 12_000 + F.col("later")).cast("long")
    heard = heard.withColumn("raw", F.expr("substring(text, begin + 1, element_at(own, -1).end_char - begin)"))
    cells = F.transform("own", lambda u, i: F.struct(F.substring(F.col("text"), u["start_char"] + 1, u["end_char"] - u["start_char"]).alias("token"), start(i).alias("start_sample"), (start(i) + 10_000).alias("end_sample")))
    words = F.transform("own", lambda u, i: F.struct((u["start_char"] - F.col("begin")).alias("start_char"), (u["end_char"] - F.col("begin")).alias("end_char"), start(i).alias("start_sample"), (start(i) + 10_000).alias("end_sample"), i.alias("first_cell"), (i + 1).alias("end_cell")))
    return heard.select("recording_id", F.col("passage_id").alias("utterance_id"), "n", (start(F.lit(0)) - 12_000).alias("start_sample"), (start(F.size("own") - 1) + 16_000).alias("end_sample"), start(F.lit(10)).alias("core_end"), F.lit("en").alias("language"), F.lit("d").alias("descriptor"), "raw", cells.alias("cells"), words.alias("words"))


@query("j14_seams", f"SELECT recording_id, passage_id AS utterance_id, CAST(k AS INTEGER) AS n, CASE WHEN shift > 4000 THEN 'boundary_mapping_absent' END AS reason FROM {STITCHED} q, LATERAL (SELECT unnest(generate_series(0, n - 2)) AS k) x")
def _(s, d):
    return stitching.seams(heard_windows(s, d)).select("recording_id", "utterance_id", "n", "reason")


@query("g12_stitched", f"""SELECT recording_id, passage_id AS utterance_id, n = 1 OR shift <= 4000 AS complete, CASE WHEN n = 1 OR shift <= 4000 THEN text END AS text, CASE WHEN n = 1 OR shift <= 4000 THEN m END AS words,
CASE WHEN n = 1 OR shift <= 4000 THEN m - CASE WHEN shift > 2000 THEN 2 * ((n - 1) // 2) ELSE 0 END END AS timed FROM {STITCHED} q""")
def _(s, d):
    """Where an odd window is left by more than 2,000 samples, the words at the seam overlap and lose their times."""
    found = stitching.stitched(heard_windows(s, d))
    good = lambda x: F.when(F.col("complete"), x)
    return found.select("recording_id", "utterance_id", "complete", "text", good(F.size("words")).cast("long").alias("words"), good(F.size(F.filter("words", lambda w: w["start_sample"].isNotNull()))).cast("long").alias("timed"))


#: Thirds of a passage as regions of activity: nobody is heard in the middle one of every second passage, and somebody else in the last one of every seventh.
SOLO = f"""(WITH q AS (SELECT *, recording_id * 7 + pos * 3 AS k, start_sample + (end_sample - start_sample) // 3 AS c1, start_sample + 2 * (end_sample - start_sample) // 3 AS c2 FROM {S} z),
g AS (SELECT * FROM q WHERE NOT separated AND audio_state IS NULL AND sealed AND finalized AND speaker IN ('speaker_0', 'unassigned') AND protected <> 'speaker,start' AND k % 7 <> 0)
SELECT recording_id, passage_id, start_sample, CASE WHEN k % 2 = 0 THEN c1 ELSE end_sample END AS end_sample FROM g UNION ALL SELECT recording_id, passage_id, c2, end_sample FROM g WHERE k % 2 = 0)"""


def observed_passages(s: SparkSession, d: str) -> DataFrame:
    k, low, size = F.col("recording_id") * 7 + F.col("pos") * 3, F.col("start_sample"), F.col("end_sample") - F.col("start_sample")
    third = lambda n: low + F.floor(n * size / 3)
    own, none = F.array(F.lit("speaker_0")), F.array().cast("array<string>")
    part = lambda a, z, who: F.struct(a.alias("start_sample"), z.alias("end_sample"), who.alias("speakers"))
    regions = F.array(part(low, third(1), own), part(third(1), third(2), F.when(k % 2 == 0, none).otherwise(own)), part(third(2), F.col("end_sample"), F.when(k % 7 == 0, F.array(F.lit("speaker_1"))).otherwise(own)))
    return said_states(s, d).withColumns({"track": F.lit("speaker_0"), "canonical_state": F.when(F.col("sealed"), "sealed").otherwise("open"), "unresolved": F.lit(None).cast("string"), "candidates": own, "source_candidates": own, "activity_revision": F.lit(1), "observed_end": F.col("end_sample"), "regions": regions})


@query("g9_solo_ranges", f"SELECT recording_id, passage_id, start_sample, end_sample FROM {SOLO} q")
def _(s, d):
    return voices.solo_ranges(observed_passages(s, d)).select("recording_id", "passage_id", "start_sample", "end_sample")


@query("v2_clip_choices", f"""SELECT recording_id, passage_id, CASE WHEN a = low AND z = high THEN passage_id ELSE passage_id || '@' || CAST(a AS VARCHAR) || ':' || CAST(z AS VARCHAR) END AS clip_id, a AS start_sample, z AS end_sample FROM
(SELECT q.*, p.start_sample AS low, p.end_sample AS high, q.start_sample + n * 96000 AS a, CASE WHEN q.end_sample - q.start_sample > 160000 THEN least(q.end_sample, q.start_sample + n * 96000 + 96000) ELSE q.end_sample END AS z
FROM {SOLO} q JOIN {S} p ON q.recording_id = p.recording_id AND q.passage_id = p.passage_id, LATERAL (SELECT unnest(generate_series(0, CASE WHEN q.end_sample - q.start_sample > 160000 THEN (q.end_sample - q.start_sample - 32000) // 96000 ELSE 0 END)) AS n) x WHERE q.end_sample - q.start_sample >= 32000) y""")
def _(s, d):
    p = observed_passages(s, d)
    return voices.clip_choices(voices.solo_ranges(p), p).drop("track")


@query("v11_v16_channel_matches", f"""WITH c AS (SELECT clip_id // 50 AS recording_id, CAST(clip_id // 2 % 25 AS VARCHAR) AS episode, CAST(clip_id % 2 AS INTEGER) AS channel, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM {CLIPS} q),
r AS (SELECT clip_id // 50 AS recording_id, CAST(clip_id AS VARCHAR) AS target, CASE WHEN clip_id % 3 = 0 THEN 'p:' || person_id ELSE 't:' || CAST(clip_id AS VARCHAR) END AS identity, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM {CLIPS} q WHERE clip_id % 5 = 0),
s AS (SELECT c.recording_id, episode, channel, target, identity, greatest(-1.0, least(1.0, list_dot_product(c.v, r.v) / sqrt(list_dot_product(c.v, c.v)) / sqrt(list_dot_product(r.v, r.v)))) AS score FROM c JOIN r ON c.recording_id = r.recording_id),
k AS (SELECT *, row_number() OVER (PARTITION BY recording_id, episode, channel ORDER BY score DESC, target) AS n, first_value(identity) OVER (PARTITION BY recording_id, episode, channel ORDER BY score DESC, target) AS best FROM s),
t AS (SELECT recording_id, episode, channel, max(CASE WHEN n = 1 THEN target END) AS target, max(best) AS identity, max(CASE WHEN n = 1 THEN score END) AS score, max(CASE WHEN n = 1 THEN score END) - coalesce(max(CASE WHEN identity <> best THEN score END), 0.0) AS margin FROM k GROUP BY 1, 2, 3)
SELECT recording_id, episode, channel, target, round(score, 6) AS score, round(margin, 6) AS margin FROM (SELECT *, count(*) OVER (PARTITION BY recording_id, episode, identity) AS same FROM t WHERE score >= 0.3 AND margin >= 0.02) x WHERE same = 1""")
def _(s, d):
    """Fifty clips a recording: neighbours are the two channels of an episode, and every fifth is a reference too."""
    clips = view(s, d, "clips").withColumn("recording_id", F.expr("clip_id div 50"))
    channels = clips.select("recording_id", F.expr("clip_id div 2 % 25").cast("string").alias("episode"), (F.col("clip_id") % 2).cast("int").alias("channel"), F.col("embedding").alias("vector"))
    known = clips.where("clip_id % 5 = 0").select("recording_id", F.col("clip_id").cast("string").alias("target"), F.when(F.col("clip_id") % 3 == 0, F.col("person_id")).alias("person_id"), F.col("embedding").alias("centroid"))
    return voices.channel_matches(channels, known, 0.3, 0.02).withColumns({c: F.round(c, 6) for c in ("score", "margin")})


# Exports


def said_states(s: SparkSession, d: str) -> DataFrame:
    """Passage states with the columns that receipts and exports read besides."""
    k = F.col("recording_id") + F.col("pos")
    return view(s, d, "states").withColumns({
        "channel": F.when(F.col("separated"), F.col("pos") % 2), "episode": F.when(F.col("separated"), F.col("passage_id")),
        "capture_source": F.when(k % 7 == 0, "system"), "utterance_id": F.col("passage_id"), "machine_revision": F.col("revision"), "canonical_revision": F.col("revision"),
        "audio_revision": F.lit(1), "language_epoch": F.lit(0), "anchor_start": F.col("start_sample"), "anchor_end": F.col("end_sample"), "activity": F.lit("regions")})


def held_turns(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Turns of the texts as first recognized, gathered, as far as their receipts hold; every fifth receipt is of an older revision. And the states."""
    turns, now = reading.told(timed_passages(s, d)), said_states(s, d)
    first = now.drop("text").join(view(s, d, "passages").select("recording_id", "passage_id", "text"), ["recording_id", "passage_id"])
    older = F.col("revision") - F.when((F.col("recording_id") + F.col("pos")) % 5 == 0, 1).otherwise(0)
    return reading.standing(turns, now, reading.receipts(turns, first.withColumn("machine_revision", older))), now


#: Turns whose receipt holds: the text is as it was, nothing is protected, and the revision is the one that the turns were made from.
HELD = f"(SELECT t.* FROM {TURNS} t JOIN {S} q ON t.recording_id = q.recording_id AND t.passage_id = q.passage_id WHERE q.protected = '' AND (q.recording_id * 7 + q.pos * 3) % 8 <> 0 AND (q.recording_id + q.pos) % 5 <> 0)"
#: What is written of each passage, before kinds differ.
PRINTED = """(WITH q AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY start_sample, end_sample, CASE WHEN (recording_id + pos) % 7 = 0 THEN 'system' ELSE '' END, CASE WHEN (recording_id + pos) % 7 = 0 THEN passage_id ELSE '' END,
  CASE WHEN separated THEN passage_id END NULLS FIRST, CASE WHEN separated THEN pos % 2 END NULLS FIRST, pos, passage_id) AS place FROM [S]),
h AS (SELECT *, bool_and(attribution <> 'unknown') OVER (PARTITION BY recording_id, passage_id) AS known FROM [HELD]),
u AS (SELECT q.* REPLACE (coalesce(h.text, q.text) AS text, coalesce(h.speaker, q.speaker) AS speaker, coalesce(h.start_sample, q.start_sample) AS start_sample, coalesce(h.end_sample, q.end_sample) AS end_sample), coalesce(h.n, 0) AS n,
  CASE WHEN h.n IS NULL THEN '' WHEN h.attribution <> 'unknown' THEN 'Coarse timing ' ELSE 'Timing unknown; parent audio ' END AS prefix
  FROM q LEFT JOIN h ON q.recording_id = h.recording_id AND q.passage_id = h.passage_id AND ([TXT] OR h.known) WHERE NOT q.deleted AND trim(q.text) <> ''),
w AS (SELECT u.*, [REASON] AS reason FROM u),
r AS (SELECT u.*, CASE WHEN u.speaker IN ('unknown', 'unassigned') AND separated THEN CASE WHEN pos % 2 = 0 THEN 'Voice A' ELSE 'Voice B' END ELSE coalesce(n2.name, CASE WHEN u.speaker = 'unassigned' THEN 'Unknown speaker' ELSE 'Overlapping speakers' END) END AS label
  FROM w u LEFT JOIN [NAMES] n2 ON u.recording_id = n2.recording_id AND u.speaker = n2.speaker)
SELECT recording_id, place, n, label, prefix, start_sample, end_sample, CASE WHEN reason IS NULL THEN text ELSE text || ' [Needs review: ' || reason || ']' END AS marked FROM r)"""


def printed(kind: str) -> str:
    return PRINTED.replace("[S]", S).replace("[HELD]", HELD).replace("[NAMES]", NAMES).replace("[REASON]", REASON).replace("[TXT]", "true" if kind == "txt" else "false")


def clean(column: str) -> str:
    return rf"translate(replace(trim(regexp_replace({column}, '[ \t\r\n]+', ' ', 'g')), '-->', '→'), '<>', '‹›')"


def cue_sql(mark: str) -> str:
    return f"""(SELECT recording_id, place, n, cue, CAST(cue AS VARCHAR) || chr(10) || {_time('start_sample', mark)} || ' --> ' || {_time('end_sample', mark)} || chr(10) || {clean('label')} || ': ' || {clean('marked')} || chr(10) || chr(10) AS line
FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY place, n) AS cue FROM {printed('srt')} q) x)"""


def body_sql(lines: str, head: str, nothing: str) -> str:
    return f"""SELECT recording_id, coalesce({head} || body, {nothing}) AS body, CAST(octet_length(encode(coalesce({head} || body, {nothing}))) AS BIGINT) AS bytes, octet_length(encode(coalesce({head} || body, {nothing}))) <= 16777216 AS allowed
FROM (SELECT DISTINCT recording_id FROM {NAMES} q) r LEFT JOIN (SELECT recording_id, string_agg(line, '' ORDER BY place, n) AS body FROM {lines} c GROUP BY recording_id) x USING (recording_id)"""


def exported(s: SparkSession, d: str, kind: str) -> DataFrame:
    turns, now = held_turns(s, d)
    names = view(s, d, "doc_speakers")
    return exports.export(now, names, turns, names.select("recording_id").distinct(), kind)


@query("transcript", body_sql(f"""(SELECT recording_id, place, n, '[' || prefix || {_time('start_sample', '.')} || ' – ' || {_time('end_sample', '.')} || '] ' || label || ': ' || marked || chr(10) AS line FROM {printed('txt')} q)""", "''", "chr(10)"))
def _(s, d):
    return exported(s, d, "txt")


@query("s10_a12_vtt", body_sql(cue_sql("."), "'WEBVTT' || chr(10) || chr(10)", "'WEBVTT' || chr(10) || chr(10)"))
def _(s, d):
    return exported(s, d, "vtt")


@query("s10_srt", body_sql(cue_sql(","), "''", "chr(10)"))
def _(s, d):
    return exported(s, d, "srt")


@query("f4_w19_cues", f"SELECT recording_id, cue, line FROM {cue_sql(',')} c")
def _(s, d):
    turns, now = held_turns(s, d)
    return exports.cues(exports.rows(now, view(s, d, "doc_speakers"), turns, "srt")).select("recording_id", "cue", "line")


#: Passages as the segments of stored documents, with their places; every fifth has no id. Recordings by whether their payload can be taken.
SEGMENTS = f"(SELECT *, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY pos) - 1 AS INTEGER) AS k, start_sample / 16000.0 AS a, end_sample / 16000.0 AS z FROM {S} q)"
TAKEN = "recording_id % 13 <> 0 AND recording_id % 17 <> 1"


def stored_documents(s: SparkSession, d: str) -> DataFrame:
    """A payload a recording: every thirteenth is cut off, and every seventeenth says another id."""
    second = lambda c: (F.col(c) / F.lit(16000.0)).alias(c.split("_")[0])
    segment = F.struct("pos", F.when(F.col("pos") % 5 != 4, F.col("passage_id")).alias("id"), second("start_sample"), second("end_sample"), "speaker", "text", F.when(F.col("deleted"), True).alias("deleted"), "revision")
    rows = view(s, d, "states").groupBy("recording_id").agg(F.transform(F.array_sort(F.collect_list(segment)), lambda x: x.dropFields("pos")).alias("segments"))
    names = view(s, d, "doc_speakers").groupBy("recording_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("speaker", "name")))).alias("speakers"))
    whole = F.to_json(F.struct(F.when(F.col("recording_id") % 17 == 1, "-1").alias("id"), "speakers", "segments"))
    return rows.join(names, "recording_id").select("recording_id", F.when(F.col("recording_id") % 13 == 0, F.substring(whole, 1, 40)).otherwise(whole).alias("payload"))


@query("s4_rejected_payloads", f"SELECT DISTINCT recording_id, CASE WHEN recording_id % 13 = 0 THEN 'bad_json' ELSE 'other_id' END AS reject FROM {S} q WHERE NOT ({TAKEN})")
def _(s, d):
    return documents.rejected(documents.parsed(stored_documents(s, d)))


@query("s3_passages", f"SELECT recording_id, k AS pos, CASE WHEN pos % 5 = 4 THEN 'seg-' || CAST(k AS VARCHAR) ELSE passage_id END AS passage_id, a AS start, z AS \"end\", speaker, text, revision FROM {SEGMENTS} q WHERE {TAKEN}")
def _(s, d):
    p = documents.passages(documents.accepted(documents.parsed(stored_documents(s, d))))
    return p.select("recording_id", "pos", "passage_id", "start", "end", "speaker", "text", F.try_variant_get("segment", "$.revision", "long").alias("revision"))


@query("s3_speakers", f"SELECT recording_id, speaker, name FROM {NAMES} q WHERE {TAKEN}")
def _(s, d):
    return documents.speakers(documents.accepted(documents.parsed(stored_documents(s, d))))


@query("p1_document_rules", f"""WITH x AS (SELECT recording_id, k, CASE WHEN a >= z OR z > most - 1 + 0.001 THEN 'segment_bounds' WHEN speaker NOT IN ('speaker_0', 'speaker_1') THEN 'speaker_or_text' END AS rule FROM (SELECT *, max(z) OVER (PARTITION BY recording_id) AS most FROM {SEGMENTS} q WHERE {TAKEN}) y)
SELECT recording_id, arg_min(rule, k) FILTER (WHERE rule IS NOT NULL) AS rule, min(k) FILTER (WHERE rule IS NOT NULL) AS pos FROM x GROUP BY recording_id""")
def _(s, d):
    """Recordings are taken to end a second before their last passage does."""
    docs = documents.accepted(documents.parsed(stored_documents(s, d)))
    ends = view(s, d, "states").groupBy("recording_id").agg((F.max("end_sample") / F.lit(16000.0) - 1).alias("duration"))
    return documents.violations(docs, ends)


@query("s10_json", rf"""WITH g AS (SELECT *, '    {{' || chr(10) || concat_ws(',' || chr(10), '      "id": ' || to_json(CASE WHEN pos % 5 = 4 THEN 'seg-' || CAST(k AS VARCHAR) ELSE passage_id END), '      "start": ' || CAST(a AS VARCHAR), '      "end": ' || CAST(z AS VARCHAR), '      "speaker": ' || to_json(speaker), '      "text": ' || to_json(text), '      "revision": ' || CAST(revision AS VARCHAR)) || chr(10) || '    }}' AS body FROM {SEGMENTS} q WHERE {TAKEN}),
l AS (SELECT recording_id, string_agg(body, ',' || chr(10) ORDER BY a, z, k) FILTER (WHERE NOT deleted) AS body FROM g GROUP BY recording_id), n AS (SELECT recording_id, string_agg('    ' || to_json(speaker) || ': ' || to_json(name), ',' || chr(10) ORDER BY speaker) AS body FROM {NAMES} q GROUP BY recording_id)
SELECT recording_id, '{{' || chr(10) || '  "speakers": {{' || chr(10) || n.body || chr(10) || '  }},' || chr(10) || '  "segments": [' || CASE WHEN l.body IS NULL THEN '' ELSE chr(10) || l.body || chr(10) || '  ' END || '],' || chr(10) || '  "schema_version": 1' || chr(10) || '}}' || chr(10) AS body, true AS allowed FROM l JOIN n USING (recording_id)""")
def _(s, d):
    p = stored_documents(s, d)
    good = documents.accepted(documents.parsed(p)).select("recording_id")
    return documents.as_json(p.join(good, "recording_id", "left_semi"))


@query("s2_metadata", f"SELECT recording_id, 'Recording ' || CAST(recording_id AS VARCHAR) AS name, 'ready' AS status, bool_or(trim(text) <> '') AS refinable FROM {S} q WHERE {TAKEN} AND recording_id IN (3, 7, 11, 26) GROUP BY recording_id")
def _(s, d):
    docs = documents.accepted(documents.parsed(stored_documents(s, d))).select("recording_id", F.concat(F.lit("Recording "), F.col("recording_id").cast("string")).alias("name"), F.lit("ready").alias("status"), "document", F.lit("private").alias("extra"))
    return documents.lookup(docs, [3, 7, 11, 26], metadata=True).where("document IS NULL AND extra IS NULL").select("recording_id", "name", "status", "refinable")


@query("p30_held_turns", f"SELECT recording_id, passage_id, n, speaker, text FROM {HELD} q")
def _(s, d):
    return held_turns(s, d)[0].select("recording_id", "passage_id", F.explode("turns").alias("t")).select("recording_id", "passage_id", "t.n", "t.speaker", "t.text")


@query("o1_canonical_places", f"SELECT DISTINCT recording_id, passage_id, place FROM (SELECT recording_id, passage_id, row_number() OVER (PARTITION BY recording_id ORDER BY start_sample, end_sample, CASE WHEN (recording_id + pos) % 7 = 0 THEN 'system' ELSE '' END, CASE WHEN (recording_id + pos) % 7 = 0 THEN passage_id ELSE '' END, CASE WHEN separated THEN passage_id END NULLS FIRST, pos, passage_id) AS place FROM {S} q) x")
def _(s, d):
    return exports.ordered(said_states(s, d)).select("recording_id", "passage_id", "place")


@query("f20_st15_retained_times", f"""SELECT recording_id, passage_id, canonical AND pos % 3 > 0 AND (recording_id + pos) % 5 <> 0 AND revision + 1 - 2 * (pos % 4) >= revision AND protected = '' AS retained FROM {S} q""")
def _(s, d):
    p = view(s, d, "states").select("*", F.when(F.col("canonical"), F.col("passage_id")).alias("utterance_id"), F.lit("system").alias("source"), F.lit(0).alias("epoch"), F.col("revision").alias("audio_revision"))
    grown = p.withColumns({"end_sample": F.col("end_sample") + F.col("pos") % 3 * 1000, "text": F.when((F.col("recording_id") + F.col("pos")) % 5 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text")), "audio_revision": F.col("revision") + 1 - 2 * (F.col("pos") % 4)})
    return reading.retained(p, grown).withColumn("retained", F.coalesce("retained", F.lit(False)))


# Main languages

AFTER = f"(SELECT recording_id, start_sample, end_sample, CASE WHEN recording_id % 4 = 1 AND start_sample % 144000 = 0 THEN 'fr' ELSE language END AS language, speaker FROM {oracle('votes')} q WHERE NOT (recording_id % 4 = 0 AND start_sample % 96000 = 0))"
MAIN = """(WITH RECURSIVE given AS %s, g AS (SELECT recording_id, start_sample, end_sample, min(language) AS language, min(speaker) AS speaker, row_number() OVER (PARTITION BY recording_id ORDER BY start_sample, end_sample) AS rn FROM given
  GROUP BY recording_id, start_sample, end_sample HAVING count(DISTINCT language) = 1 AND count(DISTINCT coalesce(speaker, '-')) = 1),
x AS (SELECT a.recording_id, a.rn, min(b.rn) AS nxt FROM g a JOIN g b ON a.recording_id = b.recording_id AND b.start_sample >= a.end_sample GROUP BY 1, 2),
k AS (SELECT recording_id, CAST(1 AS BIGINT) AS rn FROM g GROUP BY 1 UNION ALL SELECT k.recording_id, x.nxt FROM k JOIN x ON k.recording_id = x.recording_id AND k.rn = x.rn),
l AS (SELECT g.* FROM g JOIN k USING (recording_id, rn)), b AS (SELECT * FROM l WHERE speaker IS NOT NULL UNION ALL SELECT * REPLACE (NULL AS speaker) FROM l),
p AS (SELECT *, row_number() OVER (PARTITION BY recording_id, speaker, language ORDER BY start_sample DESC, end_sample DESC) AS place, count(*) OVER (PARTITION BY recording_id, speaker) AS every FROM b)
SELECT recording_id, speaker, language, count(*) AS votes, string_agg(start_sample || '-' || end_sample, ',' ORDER BY place) FILTER (WHERE place <= 2) AS witnesses FROM p GROUP BY recording_id, speaker, language, every HAVING count(*) >= 2 AND count(*) * 2 > every)"""
TARGETS = "SELECT recording_id, 'speaker_' || CAST(n AS VARCHAR) AS speaker FROM (SELECT DISTINCT recording_id FROM {0} q) r, (SELECT unnest([0, 1, 2]) AS n) t".format(oracle("votes"))


def votes_after(s: SparkSession, d: str) -> DataFrame:
    v = view(s, d, "votes").where("NOT (recording_id % 4 = 0 AND start_sample % 96000 = 0)")
    return v.withColumn("language", F.expr("CASE WHEN recording_id % 4 = 1 AND start_sample % 144000 = 0 THEN 'fr' ELSE language END"))


@query("a4_main_languages", (MAIN % oracle("votes"))[1:-1])
def _(s, d):
    return votes.main_language(view(s, d, "votes"))


@query("a4_l5_contexts", f"SELECT t.recording_id, t.speaker, coalesce(a.language, b.language) AS language, CASE WHEN a.language IS NOT NULL THEN 'speaker' WHEN b.language IS NOT NULL THEN 'recording' END AS level FROM ({TARGETS}) t LEFT JOIN {MAIN % oracle('votes')} a ON t.recording_id = a.recording_id AND t.speaker = a.speaker LEFT JOIN (SELECT * FROM {MAIN % oracle('votes')} q WHERE speaker IS NULL) b ON t.recording_id = b.recording_id")
def _(s, d):
    v = view(s, d, "votes")
    targets = v.select("recording_id").distinct().select("recording_id", F.explode(F.array(*(F.lit(f"speaker_{n}") for n in range(3)))).alias("speaker"))
    return votes.context_of(targets, votes.main_language(v))


@query("u5_vote_changes", f"SELECT *, 'removed' AS change FROM (SELECT * FROM {oracle('votes')} a EXCEPT SELECT * FROM {AFTER} b) x UNION ALL SELECT *, 'added' FROM (SELECT * FROM {AFTER} a EXCEPT SELECT * FROM {oracle('votes')} b) y")
def _(s, d):
    return votes.changes(view(s, d, "votes"), votes_after(s, d))


@query("st9_kept_up_languages", (MAIN % AFTER)[1:-1])
def _(s, d):
    before = view(s, d, "votes")
    return votes.kept_up(votes.main_language(before), before, votes_after(s, d))


# Around the recognizer

PARTS = f"(SELECT recording_id, start_sample // 144000 AS span_id, probe_id, start_sample, end_sample, top_code AS language, text_ok, 'words ' || CAST(probe_id AS VARCHAR) AS text FROM {L} q)"


@query("l2_l4_probe_classes", f"""SELECT recording_id, probe_id, CASE WHEN b IS NOT NULL THEN split_part(b, ':', 1) WHEN short THEN 'insufficient_speech' WHEN m IS NOT NULL THEN 'override' WHEN detector_error THEN 'needs_language' ELSE reason END AS reason, lang AS language,
CASE WHEN b IS NOT NULL OR short THEN true WHEN m IS NOT NULL THEN false WHEN detector_error THEN true ELSE reason <> 'detected' END AS review, CASE WHEN b IS NOT NULL THEN split_part(b, ':', 2) WHEN short THEN 'insufficient_acoustic_context' END AS audio_state,
lang IS NOT NULL AND b IS NULL AND NOT short AND NOT (m IS NULL AND NOT detector_error AND reason = 'insufficient_speech') AS recognize FROM (SELECT *, CASE WHEN b IS NOT NULL OR short OR m IS NOT NULL THEN m WHEN NOT detector_error THEN language END AS lang
FROM (SELECT r.*, l.detector_error, CASE r.probe_id % 10 WHEN 0 THEN 'insufficient_speech:digital_silence' WHEN 1 THEN 'speech_admission_uncertain:speech_evidence_pending' END AS b, CASE WHEN r.probe_id % 8 = 0 THEN 'fr' END AS m, r.probe_id % 6 = 0 AS short FROM {DECIDED} r JOIN {L} l ON r.probe_id = l.probe_id AND r.recording_id = l.recording_id) x) y""")
def _(s, d):
    p = language.decide(view(s, d, "lang_probes"))
    blocked = F.when(F.col("probe_id") % 10 == 0, "insufficient_speech:digital_silence").when(F.col("probe_id") % 10 == 1, "speech_admission_uncertain:speech_evidence_pending")
    end = F.when(F.col("probe_id") % 6 == 0, F.col("start_sample") + 300).otherwise(F.col("end_sample"))
    return recognition.classify(p.withColumns({"blocked": blocked, "manual": F.when(F.col("probe_id") % 8 == 0, "fr"), "end_sample": end}))


@query("p23_p18_output_reviews", f"""SELECT recording_id, passage_id, reason, partial_text, decoder_reason, reason IS NULL OR (reason = 'short_acoustic_context' AND NOT partial_text) AS complete FROM (SELECT *, CASE WHEN text <> '' AND samples < 3200 THEN 'short_acoustic_context' WHEN tokens >= 448 THEN 'token_limit' WHEN text = '' THEN 'empty_result' END AS reason,
CASE WHEN text <> '' AND samples < 3200 THEN tokens >= 448 WHEN tokens >= 448 THEN true WHEN text = '' THEN false END AS partial_text, CASE WHEN text <> '' AND samples < 3200 AND tokens >= 448 THEN 'token_limit' END AS decoder_reason FROM (SELECT *, (recording_id * 37 + pos * 91) % 600 AS tokens, (recording_id * 911 + pos * 577) % 12000 AS samples FROM {S} q) x) y""")
def _(s, d):
    r = recognition.output_review(F.col("text"), F.expr("(recording_id * 37 + pos * 91) % 600"), F.expr("(recording_id * 911 + pos * 577) % 12000"))
    out = view(s, d, "states").select("recording_id", "passage_id", r.alias("r"))
    return out.select("recording_id", "passage_id", "r.reason", "r.partial_text", "r.decoder_reason", recognition.complete(F.col("r")).alias("complete"))


@query("g14_padding", f"SELECT recording_id, probe_id, CASE WHEN start_sample = 0 THEN 3200 ELSE 0 END AS leading, CASE WHEN end_sample = max(end_sample) OVER (PARTITION BY recording_id) THEN 3200 ELSE 0 END AS trailing FROM {L} q")
def _(s, d):
    p = view(s, d, "lang_probes")
    return recognition.padded(p.join(durations(p, 0).withColumnRenamed("duration", "length"), "recording_id")).select("recording_id", "probe_id", "leading", "trailing")


def decoded_parts(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "lang_probes").select("recording_id", F.floor(F.col("start_sample") / 144000).alias("span_id"), "probe_id", "start_sample", "end_sample", F.col("top_code").alias("language"), "text_ok", F.concat(F.lit("words "), F.col("probe_id").cast("string")).alias("text"))


@query("g13_routed_texts", f"""SELECT recording_id, span_id, string_agg(text, ' ' ORDER BY start_sample) AS text, string_agg(sha256(text), ',' ORDER BY start_sample) AS hashes FROM (SELECT * REPLACE (CASE WHEN span_id % 2 = 0 THEN 'en' ELSE language END AS language) FROM {PARTS} p) q
GROUP BY recording_id, span_id HAVING count(*) >= 2 AND bool_and(text_ok OR span_id % 2 = 0) AND count(DISTINCT language) = 1 AND min(language) <> 'sw' AND min(start_sample) = span_id * 144000 AND max(end_sample) = (span_id + 1) * 144000""")
def _(s, d):
    p = decoded_parts(s, d).withColumns({"language": F.when(F.col("span_id") % 2 == 0, "en").otherwise(F.col("language")), "clean": F.col("text_ok") | (F.col("span_id") % 2 == 0)})
    whole = p.select("recording_id", "span_id").distinct().select("*", (F.col("span_id") * 144000).alias("start_sample"), ((F.col("span_id") + 1) * 144000).alias("end_sample"))
    return recognition.routed(p, whole)


@query("g15_retry_candidates", f"""SELECT recording_id, span_id, coalesce(string_agg(text, ' ' ORDER BY start_sample) FILTER (WHERE trim(text) <> ''), '') AS text, bool_or(NOT text_ok) AS review, arg_min(reason, start_sample) FILTER (WHERE reason IS NOT NULL) AS reason,
CASE WHEN count(reason) > 0 THEN bool_or(coalesce(reason IS NOT NULL AND partial, false)) OR bool_or(trim(text) = '' AND state IS NULL) END AS partial FROM (SELECT * REPLACE (CASE WHEN probe_id % 4 = 0 THEN ' ' ELSE text END AS text), CASE probe_id % 5 WHEN 0 THEN 'token_limit' WHEN 1 THEN 'empty_result' END AS reason,
probe_id % 10 = 0 AS partial, CASE WHEN probe_id % 8 = 0 THEN 'digital_silence' END AS state FROM {PARTS} p) q GROUP BY recording_id, span_id""")
def _(s, d):
    i = F.col("probe_id")
    p = decoded_parts(s, d).withColumns({"text": F.when(i % 4 == 0, " ").otherwise(F.col("text")), "review": ~F.col("text_ok"), "reason": F.when(i % 5 == 0, "token_limit").when(i % 5 == 1, "empty_result"), "partial_text": i % 10 == 0, "audio_state": F.when(i % 8 == 0, "digital_silence")})
    return recognition.retry_candidates(p)


@query("p17_separable", f"""WITH c AS (SELECT q.* FROM {CLIPPED} q JOIN {L} l ON q.recording_id = l.recording_id AND q.span_id = l.probe_id WHERE l.probe_id % 11 <> 0), e AS (SELECT recording_id, language_epoch, min(start_sample) AS at FROM {N} n GROUP BY 1, 2)
SELECT recording_id, span_id FROM c GROUP BY 1, 2 HAVING count(DISTINCT speaker) = 2 AND EXISTS (SELECT 1 FROM c a JOIN c b ON a.recording_id = b.recording_id AND a.span_id = b.span_id AND a.speaker < b.speaker AND a.start_sample < b.end_sample AND b.start_sample < a.end_sample WHERE a.recording_id = c.recording_id AND a.span_id = c.span_id)
AND NOT EXISTS (SELECT 1 FROM e JOIN {L} l ON e.recording_id = l.recording_id AND e.at > l.start_sample AND e.at < l.end_sample WHERE l.recording_id = c.recording_id AND l.probe_id = c.span_id)""")
def _(s, d):
    epochs = view(s, d, "audio_notices").groupBy("recording_id", "language_epoch").agg(F.min("start_sample").alias("start_sample"))
    return recognition.separable(spans(s, d).withColumn("separated", F.col("span_id") % 11 == 0), view(s, d, "turns"), epochs)


# Signals


@query("s7_pcm16", f"SELECT clip_id, list_transform(embedding, lambda x: CAST(greatest(-32768, least(32767, round_even(CAST(x AS DOUBLE) * 32768, 0))) AS INTEGER)) AS pcm FROM {CLIPS} q")
def _(s, d):
    return view(s, d, "clips").select("clip_id", signals.pcm16(F.col("embedding")).alias("pcm"))


@query("s8_a20_p21_levels", f"""SELECT clip_id, round(list_max(list_transform(m, lambda x: abs(x))), 9) AS peak, round(least(1.0, sqrt(list_dot_product(m, m) / len(m))), 9) AS rms, CASE WHEN list_min(m) = list_max(m) THEN CASE WHEN list_min(m) = 0 THEN 'digital_silence' ELSE 'constant' END END AS constant
FROM (SELECT clip_id, CASE WHEN list_dot_product(mono, mono) < 0.05 * greatest(list_dot_product(a, a), list_dot_product(b, b)) THEN CASE WHEN list_dot_product(b, b) > list_dot_product(a, a) THEN b ELSE a END ELSE mono END AS m
FROM (SELECT *, list_transform(list_zip(a, b), lambda x: (x[1] + x[2]) * 0.5) AS mono FROM (SELECT clip_id, CASE WHEN clip_id % 6 = 1 THEN list_transform(v, lambda x: clip_id % 4 / 8.0) ELSE v END AS a, CASE WHEN clip_id % 5 = 0 THEN list_transform(v, lambda x: -x) WHEN clip_id % 6 = 1 THEN list_transform(v, lambda x: clip_id % 4 / 8.0) ELSE list_reverse(v) END AS b
FROM (SELECT clip_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM {CLIPS} q) t) u) w) z""")
def _(s, d):
    flat = F.transform("v", lambda x: F.col("clip_id") % 4 / F.lit(8.0))
    left = F.when(F.col("clip_id") % 6 == 1, flat).otherwise(F.col("v"))
    right = F.when(F.col("clip_id") % 5 == 0, F.transform("v", lambda x: -x)).when(F.col("clip_id") % 6 == 1, flat).otherwise(F.reverse("v"))
    c = view(s, d, "clips").select("clip_id", F.transform("embedding", lambda x: x.cast("double")).alias("v")).select("clip_id", signals.downmix(left, right).alias("m"))
    return c.select("clip_id", F.round(signals.peak(F.col("m")), 9).alias("peak"), F.round(signals.rms(F.col("m")), 9).alias("rms"), signals.constant(F.col("m")).alias("constant"))


# Names of tracks

A, K = oracle("assignments"), oracle("checks")
TRACK_CLIPS = f"(SELECT recording_id, speaker, CASE WHEN recording_id % 6 = 1 THEN '' ELSE 'c' || CAST(recording_id % 13 AS VARCHAR) END AS clips FROM {NAMES} q)"
PROFILES = f"(SELECT DISTINCT person_id, model_id, 'v' || CAST(length(person_id) AS VARCHAR) AS version FROM {CLIPS} q)"
VERSIONS = f"(SELECT string_agg(person_id || ':' || version, ',' ORDER BY person_id || ':' || version) FROM {PROFILES} q WHERE model_id = 'model_a')"
PLANNED = f"(SELECT n.recording_id, n.speaker, c.clips, {VERSIONS} AS versions FROM {NAMES} n JOIN {TRACK_CLIPS} c ON n.recording_id = c.recording_id AND n.speaker = c.speaker WHERE regexp_full_match(n.name, 'Speaker [0-9]+') AND c.clips <> '' AND NOT EXISTS (SELECT 1 FROM {A} a WHERE a.recording_id = n.recording_id AND a.speaker = n.speaker) AND NOT EXISTS (SELECT 1 FROM {K} k WHERE k.recording_id = n.recording_id AND k.speaker = n.speaker))"


def check_plan(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, str]:
    """Planned checks, the tracks' clips, and the versions of profiles."""
    names = view(s, d, "doc_speakers")
    clips = names.select("recording_id", "speaker", F.when(F.col("recording_id") % 6 == 1, "").otherwise(F.concat(F.lit("c"), (F.col("recording_id") % 13).cast("string"))).alias("clips"))
    known = view(s, d, "clips").select("person_id", "model_id", F.concat(F.lit("v"), F.length("person_id").cast("string")).alias("version")).distinct()
    versions = checks.scheduled_versions(known, "model_a")
    return checks.plan(names, view(s, d, "assignments"), view(s, d, "checks"), clips, versions), clips, versions


@query("v8_check_plan", PLANNED[1:-1])
def _(s, d):
    return check_plan(s, d)[0]


@query("v9_u4_check_outcomes", f"""SELECT recording_id, speaker, status, CASE WHEN status = 'matched' THEN 'person_1' END AS person_id FROM (SELECT *, CASE WHEN recording_id % 7 = 0 OR recording_id % 11 = 0 OR recording_id % 10 = 1 THEN 'cancelled' WHEN recording_id % 5 = 2 THEN 'unavailable' WHEN recording_id % 3 = 1 THEN 'matched' ELSE 'unknown' END AS status FROM {PLANNED} q) x""")
def _(s, d):
    """Since the plan every seventh recording's clips have changed, every eleventh's profiles were others, and a tenth have got a name."""
    planned, clips, versions = check_plan(s, d)
    i = F.col("recording_id")
    planned = planned.withColumn("versions", F.when(i % 11 == 0, "person_0:v0").otherwise(F.col("versions")))
    clips = clips.withColumn("clips", F.when(i % 7 == 0, F.concat("clips", F.lit("+"))).otherwise(F.col("clips")))
    names = view(s, d, "doc_speakers").withColumn("name", F.when(i % 10 == 1, "Ana").otherwise(F.col("name")))
    results = planned.select("recording_id", "speaker", (i % 5 == 2).alias("failed"), F.when(i % 3 == 1, "person_1").alias("person_id"))
    return checks.outcomes(planned, results, names, view(s, d, "assignments"), clips, versions)


@query("v13_j7_j8_suggestions", f"""WITH i AS (SELECT * FROM {NAMES} q WHERE recording_id % 4 = 0 AND recording_id % 12 <> 0 AND speaker = 'speaker_0'), v AS (SELECT recording_id, speaker, CAST(recording_id % 30 + 1 AS VARCHAR) AS person_id FROM {NAMES} q WHERE recording_id % 5 <> 4 AND recording_id % 6 <> 5 AND recording_id % 8 <> 3)
SELECT recording_id, speaker, 'introduction' AS kind, name FROM i UNION ALL SELECT v.recording_id, v.speaker, 'voice', h.name FROM v JOIN {H} h ON v.person_id = h.person_id WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.recording_id = v.recording_id AND i.speaker = v.speaker) AND NOT EXISTS (SELECT 1 FROM {A} a WHERE a.recording_id = v.recording_id AND a.speaker = v.speaker)""")
def _(s, d):
    """Introductions in every fourth recording, those of every twelfth dismissed; voices of old models or versions, or dismissed ones, are left out."""
    i, names = F.col("recording_id"), view(s, d, "doc_speakers")
    people = view(s, d, "people").select("person_id", "name", F.lit("v1").alias("version"))
    heard = names.where((i % 4 == 0) & (F.col("speaker") == "speaker_0")).select("*", F.lit("i1").alias("id"))
    voices = names.select("recording_id", "speaker", F.concat(F.lit("s"), "speaker").alias("id"), (i % 30 + 1).cast("string").alias("person_id"), F.when(i % 5 == 4, "v0").otherwise("v1").alias("version"), F.when(i % 6 == 5, "model_old").otherwise("model_a").alias("model_id"))
    dismissed = heard.where(i % 12 == 0).select("recording_id", "id").unionByName(voices.where(i % 8 == 3).select("recording_id", "id"))
    return checks.suggestions(heard, voices, people, view(s, d, "assignments"), dismissed, "model_a")


@query("j9_v15_assignments", f"SELECT a.recording_id, a.speaker, a.name, a.person_id FROM {A} a JOIN {NAMES} n ON a.recording_id = n.recording_id AND a.speaker = n.speaker AND a.name = n.name WHERE a.recording_id % 10 <> 5")
def _(s, d):
    names = view(s, d, "doc_speakers")
    return checks.kept_assignments(view(s, d, "assignments"), names, names.where("recording_id % 10 = 5").select("recording_id").distinct()).select("recording_id", "speaker", "name", "person_id")


@query("e12_v15_settled_checks", f"SELECT recording_id, speaker, CASE WHEN status = 'checking' AND NOT manual THEN 'cancelled' ELSE status END AS off, CASE WHEN status = 'checking' THEN 'cancelled' ELSE status END AS status FROM {K} q")
def _(s, d):
    k = view(s, d, "checks")
    return checks.settled_checks(k.join(checks.settled_checks(k, only_automatic=True).select("recording_id", "speaker", F.col("status").alias("off")), ["recording_id", "speaker"])).select("recording_id", "speaker", "off", "status")


@query("e14_j16_confirmed_names", f"""WITH c AS (SELECT recording_id, 'Ana ' || CAST(recording_id AS VARCHAR) AS name, recording_id % 2 = 1 AS every FROM {NAMES} q WHERE speaker = 'speaker_0'), h AS (SELECT a.* FROM {A} a JOIN {NAMES} n ON a.recording_id = n.recording_id AND a.speaker = n.speaker AND a.name = n.name)
SELECT recording_id, 'speaker_0' AS speaker, name FROM c WHERE NOT every UNION ALL SELECT c.recording_id, h.speaker, c.name FROM c JOIN {A} a ON c.recording_id = a.recording_id AND a.speaker = 'speaker_0' AND a.person_id <> '' JOIN h ON h.recording_id = a.recording_id AND h.person_id = a.person_id WHERE c.every""")
def _(s, d):
    names = view(s, d, "doc_speakers")
    confirmed = names.where("speaker = 'speaker_0'").select("recording_id", "speaker", F.concat(F.lit("Ana "), F.col("recording_id").cast("string")).alias("name"), (F.col("recording_id") % 2 == 1).alias("all_tracks"))
    return checks.named_everywhere(confirmed, view(s, d, "assignments"), names)


@query("a15_visible_speakers", f"""SELECT recording_id, identity, speaker, name FROM (SELECT n.*, CASE WHEN a.name = n.name AND a.person_id <> '' THEN 'person:' || a.person_id ELSE 'track:' || n.speaker END AS identity FROM {NAMES} n LEFT JOIN {A} a ON n.recording_id = a.recording_id AND n.speaker = a.speaker) x QUALIFY row_number() OVER (PARTITION BY recording_id, identity ORDER BY speaker) = 1""")
def _(s, d):
    return checks.visible(view(s, d, "doc_speakers"), view(s, d, "assignments"))


# Splits, history, issues

VOICES = f"(SELECT recording_id, passage_id, 'e' || passage_id AS episode, c AS channel, CASE WHEN c = 1 AND (recording_id + pos) % 5 = 0 THEN ' ' ELSE 'voice ' || CAST(c AS VARCHAR) || ' ' || substr(text, 1, 10) END AS text, 'en' AS language, start_sample, end_sample FROM {P} p, (SELECT unnest([0, 1]) AS c) t WHERE (recording_id + pos) % 6 = 1)"
PAIRS = f"(SELECT * FROM {VOICES} v WHERE EXISTS (SELECT 1 FROM {P} p WHERE p.recording_id = v.recording_id AND p.passage_id = v.passage_id AND (p.recording_id + p.pos) % 5 <> 0))"


def voices_of(s: SparkSession, d: str) -> DataFrame:
    p = view(s, d, "passages").where("(recording_id + pos) % 6 = 1").withColumn("channel", F.explode(F.array(F.lit(0), F.lit(1))))
    text = F.when((F.col("channel") == 1) & ((F.col("recording_id") + F.col("pos")) % 5 == 0), " ").otherwise(F.concat(F.lit("voice "), F.col("channel").cast("string"), F.lit(" "), F.substring("text", 1, 10)))
    return p.select("recording_id", "passage_id", F.concat(F.lit("e"), "passage_id").alias("episode"), "channel", text.alias("text"), F.lit("en").alias("language"))


@query("e10_split", f"""SELECT recording_id, passage_id, start_sample, end_sample, text, speaker, NULL AS language, NULL AS original FROM {P} p WHERE NOT EXISTS (SELECT 1 FROM {PAIRS} v WHERE v.recording_id = p.recording_id AND v.passage_id = p.passage_id)
UNION ALL SELECT recording_id, episode || '-' || CAST(channel AS VARCHAR), start_sample, end_sample, text, 'unassigned', language, passage_id FROM {PAIRS} v""")
def _(s, d):
    return changes.split(view(s, d, "passages").withColumn("language", F.lit(None).cast("string")), voices_of(s, d))


@query("e10_restored", f"SELECT DISTINCT recording_id, passage_id FROM {PAIRS} v WHERE recording_id % 4 <> 0")
def _(s, d):
    """In every fourth recording the second voice was edited since."""
    rows = changes.split(view(s, d, "passages").withColumn("language", F.lit(None).cast("string")), voices_of(s, d))
    history = rows.where("original IS NOT NULL").select("recording_id", "original", "passage_id", changes.version("text").alias("version"))
    edited = F.when((F.col("recording_id") % 4 == 0) & F.col("passage_id").endswith("-1"), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return changes.restored(rows.withColumn("text", edited).select("recording_id", "passage_id", changes.version("text").alias("version")), history)


@query("e17_first_history", f"SELECT recording_id, passage_id, CASE WHEN (recording_id + pos) % 3 = 0 THEN 'first' ELSE text END AS text, CASE WHEN (recording_id + pos) % 3 = 0 THEN 0 ELSE 1 END AS at FROM {P} p")
def _(s, d):
    p = view(s, d, "passages")
    history = p.where("(recording_id + pos) % 3 = 0").select("recording_id", "passage_id", F.lit("first").alias("text"), F.lit(0).alias("at"))
    replaced = p.select("recording_id", "passage_id", "text", F.explode(F.array(F.lit(1), F.lit(2))).alias("at"))
    return changes.first_written(history, replaced.withColumn("text", F.when(F.col("at") == 1, F.col("text")).otherwise("later")))


@query("e18_passage_issues", f"SELECT recording_id, passage_id, CASE WHEN (recording_id + pos) % 4 = 0 THEN 'accuracy' WHEN pos % 3 <> 0 THEN issue END AS issue FROM {S} q")
def _(s, d):
    """New issues for every second passage, half of them for an older text; the issues of every third position are stale."""
    p = view(s, d, "states").withColumn("version", changes.version("text"))
    k = F.col("recording_id") + F.col("pos")
    new = p.where(k % 2 == 0).select("recording_id", "passage_id", F.lit("accuracy").alias("kind"), F.when(k % 4 == 0, F.col("version")).otherwise("older").alias("version"))
    return changes.with_issues(p.withColumn("issue_version", F.when(F.col("pos") % 3 != 0, F.col("version")).otherwise("older")), new)


@query("j21_undone_windows", f"SELECT recording_id, 'plan' || CAST(recording_id % 3 AS VARCHAR) AS plan, n FROM (SELECT recording_id, start_sample // 48000 AS n FROM {L} q) x WHERE recording_id % 3 = 2 OR recording_id % 5 = 0 OR n >= 4")
def _(s, d):
    w = view(s, d, "lang_probes").select("recording_id", F.concat(F.lit("plan"), (F.col("recording_id") % 3).cast("string")).alias("plan"), F.expr("start_sample div 48000").alias("n"))
    done = w.where("recording_id % 5 <> 0").select("recording_id", F.when(F.col("recording_id") % 3 == 2, "plan_old").otherwise(F.col("plan")).alias("plan"), F.lit(4).alias("cursor")).distinct()
    return changes.undone_windows(w, done).select("recording_id", "plan", "n")


@query("j24_unattempted", f"SELECT recording_id, passage_id, sha256(text) AS source_key FROM {S} q WHERE NOT candidate AND protected = '' AND (recording_id + pos) % 3 <> 0")
def _(s, d):
    """Every third passage was tried, and of the others some with an older source or by another model."""
    p = view(s, d, "states").withColumn("source_key", F.sha2("text", 256))
    k = F.col("recording_id") + F.col("pos")
    tried = p.select("recording_id", "passage_id", F.when(k % 3 == 1, "older").otherwise(F.col("source_key")).alias("source_key"), F.when(k % 3 == 2, "other").otherwise("model_a").alias("model"))
    return changes.unattempted(p, tried, "model_a")



def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
