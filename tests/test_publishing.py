"""Publishing with literal rows, and a micro-batch that runs twice."""

import uuid

from pyspark.sql import functions as F

from parley.operators import publishing as p
from parley.streaming.publish import Store, published

ROW = {"recording_id": 1, "passage_id": "a", "start_sample": 0, "end_sample": 16000, "speaker": "speaker_0", "capture_source": "system", "audio_revision": 1, "utterance_id": "u", "language_epoch": 0, "language_generation": 0, "language_mode": "auto", "canonical_state": "sealed", "text": "old", "language": "en", "machine_revision": 3, "canonical_revision": 5, "protected": "", "refinement_state": "provisional", "finalized": False, "original": None}
KINDS = {int: "long", str: "string", bool: "boolean", type(None): "string"}
SCHEMA = ", ".join(f"{k} {KINDS[type(v)]}" for k, v in ROW.items())
CANDIDATE = ", ".join(f"{c} {KINDS[type(ROW[c])]}" for c in ("recording_id", "passage_id", *p.IDENTITY, "text", "machine_revision", "canonical_revision")) + ", review_code string, of_version string, witnesses array<struct<passage_id: string, version: string>>"


def rows(spark, *changes):
    return spark.createDataFrame([tuple((ROW | c).values()) for c in changes], SCHEMA)


def candidate(spark, of, changes=({},), witnesses=()):
    """Candidates made from the row ``of``."""
    version = of.select(p.passage_version().alias("v")).collect()[0].v
    base = of.collect()[0].asDict()
    fresh = {"recording_id": base["recording_id"], "passage_id": base["passage_id"], **{c: base[c] for c in p.IDENTITY}, "text": "new", "machine_revision": base["machine_revision"] + 1, "canonical_revision": base["canonical_revision"] + 1, "review_code": None, "of_version": version, "witnesses": list(witnesses)}
    return spark.createDataFrame([tuple((fresh | c).values()) for c in changes], CANDIDATE)


def outcome(spark, now, **change):
    return p.refinements(now, candidate(spark, rows(spark, {}), [change])).collect()[0].outcome


def test_refinements(spark):
    same = rows(spark, {})
    assert outcome(spark, same) == "published"
    assert outcome(spark, rows(spark, {"passage_id": "b"})) == "missing"
    assert outcome(spark, rows(spark, {"protected": "text"})) == "protected"
    for change in ({"text": "edited"}, {"machine_revision": 4}, {"audio_revision": 2}, {"speaker": "speaker_1"}):
        assert outcome(spark, rows(spark, change)) == "stale", change
    for change in ({"start_sample": 1}, {"end_sample": 9}, {"speaker": "x"}, {"capture_source": None}, {"audio_revision": 2}, {"utterance_id": "v"}, {"language_epoch": 1}, {"language_generation": 1}, {"language_mode": "manual"}, {"canonical_state": "open"}, {"machine_revision": 5}, {"machine_revision": 3}, {"canonical_revision": 5}, {"text": " 　"}, {"text": None}, {"review_code": "token_limit"}):
        assert outcome(spark, same, **change) == "invalid", change
    got = p.refined(same, candidate(spark, same)).collect()[0]
    assert (got.text, got.machine_revision, got.canonical_revision, got.refinement_state, got.finalized) == ("new", 4, 6, "refined", True)


def test_borrowed_context(spark):
    both = rows(spark, {}, {"passage_id": "w", "start_sample": 100})
    version = both.where("passage_id = 'w'").select(p.passage_version().alias("v")).collect()[0].v
    lent = candidate(spark, rows(spark, {}), witnesses=[("w", version)])
    ask = lambda now: p.refinements(now, lent).collect()[0].outcome
    assert ask(both) == "published"
    assert ask(rows(spark, {}, {"passage_id": "w", "start_sample": 100, "language": "fr"})) == "context"
    assert ask(rows(spark, {})) == "context"


def test_imports(spark):
    cols = "recording_id long, passage_id string, text string, source_sha256 string, plan_sha256 string, next_work long, witnesses array<struct<passage_id: string, version: string>>"
    make = lambda *x: spark.createDataFrame([(1, i, "t", s, plan, n, w) for i, s, plan, n, w in x], cols)
    at = lambda *x: spark.createDataFrame(list(x), "recording_id long, source_sha256 string, plan_sha256 string, next_work long")
    there = rows(spark, {"text": "edited", "protected": "text"})
    step = make(("a", "s", "p", 2, []), ("b", "s", "p", 2, []))
    ask = lambda c, x: {r.passage_id: r.outcome for r in p.imports(there, c, x).collect()}
    assert ask(at(), step) == ask(at((1, "s", "p", 2)), step) == ask(at((1, "s", "p", 1), (2, "z", "z", 9)), step) == {"a": "kept", "b": "inserted"}
    for stored in ((1, "other", "p", 1), (1, "s", "other", 1), (1, "s", "p", 3)):
        assert set(ask(at(stored), step).values()) == {"superseded"}
    assert set(ask(at(), make(("a", "s", "p", 2, []), ("b", "s", "p", 2, [("gone", "v")]))).values()) == {"context"}
    assert ask(at(), make(("a", "s", "p", 2, [("gone", "v")]))) == {"a": "kept"}
    moved = p.moved_on(at((1, "s", "p", 1), (2, "z", "z", 9)), p.imports(there, at((1, "s", "p", 1)), step))
    assert sorted(map(tuple, moved.collect())) == [(1, "s", "p", 2), (2, "z", "z", 9)]


def test_live(spark):
    kind = "recording_id long, passage_id string, stream_generation long, context_generation long, utterance_id string, start_sample long, end_sample long, capture_source string, language_epoch long, audio_revision long"
    base = {"recording_id": 1, "passage_id": "a", "stream_generation": 2, "context_generation": None, "utterance_id": "u", "start_sample": 0, "end_sample": 20000, "capture_source": "system", "language_epoch": 0, "audio_revision": 2}
    recordings = spark.createDataFrame([(1, 2, 7)], "recording_id long, stream_generation long, context_generation long")
    ask = lambda now, **c: p.live_outcomes(recordings, now, spark.createDataFrame([tuple((base | c).values())], kind)).collect()[0].outcome
    now = rows(spark, {})
    assert ask(now) == ask(now, context_generation=7) == ask(now.limit(0)) == "published"
    assert ask(now, stream_generation=1) == ask(now, recording_id=5) == "superseded"
    assert ask(now, context_generation=6) == ask(now.limit(0), context_generation=6) == "retry"
    for change in ({"protected": "text"}, {"capture_source": None}, {"utterance_id": "v"}, {"start_sample": 5}, {"language_epoch": 1}, {"refinement_state": "refined", "audio_revision": 2}):
        assert ask(rows(spark, change), context_generation=6) == "lost", change
    assert ask(rows(spark, {"refinement_state": "refined", "audio_revision": 1}), context_generation=6) == "retry"
    assert ask(rows(spark, {"passage_id": "e-0", "original": "a"}, {"passage_id": "e-1", "original": "a"})) == "split"
    assert ask(rows(spark, {"protected": "text"})) == "sealed" and ask(rows(spark, {"protected": "text", "end_sample": 20000})) == "published"


def test_a_batch_that_runs_twice_changes_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Store, "COMPACT", 2)
    store = Store(spark, f"{tmp_path}/{uuid.uuid4().hex}")
    first = rows(spark, {}, {"passage_id": "b", "protected": "text"}, {"passage_id": "c"})
    store.begin(first)
    one = candidate(spark, first.where("passage_id = 'a'"), [{}, {"text": "zzz"}, {"machine_revision": 3}])
    store.take(one, 0)
    then = store.rows().where("passage_id = 'a'")
    two = candidate(spark, then, [{"text": "newer"}]).unionByName(candidate(spark, first.where("passage_id = 'b'"))).unionByName(candidate(spark, first.where("passage_id = 'c'"), [{"text": "c1"}]))
    look = lambda: sorted((x.passage_id, x.text, x.machine_revision) for x in store.rows().collect())
    store.take(two, 1)
    after = look()
    assert after == [("a", "newer", 5), ("b", "old", 3), ("c", "c1", 4)]
    store.take(one, 0)
    store.take(two, 1)
    assert look() == after
    store.take(one, 2)  # the same candidates later are stale
    assert look() == after


def test_as_a_stream(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    first = rows(spark, *({"passage_id": f"p{i}"} for i in range(6)))
    store.begin(first)
    for i in range(6):
        candidate(spark, first.where(F.col("passage_id") == f"p{i}")).write.mode("append").parquet(f"{tmp_path}/in")
        if i % 3 == 2:
            schema = spark.read.parquet(f"{tmp_path}/in").schema
            published(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in"), store, f"{tmp_path}/state").awaitTermination()
    assert {x.text for x in store.rows().collect()} == {"new"} and store.rows().count() == 6
