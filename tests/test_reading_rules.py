"""Literal rows of reading turns, language votes, recognizer rules, signals and names of tracks."""

import pytest
from pyspark.sql import functions as F

from parley.functions import signals
from parley.operators import changes, checks, reading, recognition, votes

PASSAGE = """recording_id long, passage_id string, text string, start_sample long, end_sample long, anchor_start long, anchor_end long, observed_end long,
words array<struct<start_char:int,end_char:int,start_sample:long,end_sample:long>>, regions array<struct<start_sample:long,end_sample:long,speakers:array<string>>>"""


def passage(words, regions, text="go next", end=32000, observed=None):
    return (1, "a", text, 0, end, 0, end, observed, words, regions)


def turns(spark, *row):
    found = reading.reading_turns(spark.createDataFrame(list(row), PASSAGE)).orderBy("n").collect()
    return [(x.text, x.start_offset, x.end_offset, x.speaker, x.attribution, x.start_sample, x.end_sample) for x in found]


TWO = [(0, 16000, ["speaker_0"]), (16000, 32000, ["speaker_1"])]


def test_each_word_goes_to_its_speaker(spark):
    words = [(0, 2, 4000, 8000), (3, 7, 20000, 24000)]
    assert turns(spark, passage(words, TWO)) == [("go ", 0, 3, "speaker_0", "single", 4000, 8000), ("next", 3, 7, "speaker_1", "single", 20000, 24000)]


def test_overlaps_are_named_and_doubtful_words_stay_unknown(spark):
    both = [(0, 16000, ["speaker_1", "speaker_0"]), (16000, 32000, [])]
    assert turns(spark, passage([(0, 2, 4000, 8000), (3, 7, 20000, 24000)], both)) == [("go ", 0, 3, "overlap_speaker_0_speaker_1", "overlap", 4000, 8000), ("next", 3, 7, "unassigned", "unknown", None, None)]
    # Too near to another speaker; before the last word has ended; without a time.
    near = turns(spark, passage([(0, 2, 4000, 13000), (3, 7, 20000, 24000)], TWO))
    assert [t[4] for t in near] == ["unknown", "single"]
    back = turns(spark, passage([(0, 2, 4000, 8000), (3, 7, 7000, 9000)], TWO))
    assert [t[4] for t in back] == ["single", "unknown"]
    assert [t[4] for t in turns(spark, passage([(0, 2, None, None), (3, 7, 20000, 24000)], TWO))] == ["unknown", "single"]


def test_passages_without_turns(spark):
    words = [(0, 2, 4000, 8000), (3, 7, 20000, 24000)]
    assert turns(spark, passage(words, [(0, 16000, ["speaker_0"]), (16001, 32000, ["speaker_1"])])) == []
    assert turns(spark, passage(words[:1], TWO)) == []
    assert turns(spark, passage(words, [])) == []
    assert turns(spark, passage(words, None)) == []
    assert turns(spark, passage([], TWO, text="")) == []


def test_coverage_finds_a_hole_and_a_wrong_time(spark):
    words = [(0, 2, 4000, 8000), (3, 7, 20000, 24000)]
    p = spark.createDataFrame([passage(words, TWO)], PASSAGE)
    t = reading.reading_turns(p)
    covered = lambda t: reading.coverage(t, p).first().covered
    assert covered(t)
    assert not covered(t.where("n > 0")) and not covered(t.where("n < 0"))
    assert not covered(t.withColumn("end_sample", F.col("start_sample")))
    assert not covered(t.withColumn("speaker", F.lit("unassigned")))


def test_units_of_unicode_space(spark):
    got = spark.createDataFrame([(" a bc　 d",), ("",), (None,)], "t string").select(reading.units(F.col("t"))).collect()
    assert [tuple(x) for x in got[0][0]] == [(1, 2), (3, 5), (7, 8)] and got[1][0] == [] and got[2][0] is None


VOTE = "recording_id long, start_sample long, end_sample long, language string, speaker string"


def test_main_language_needs_two_disjoint_votes_and_a_majority(spark):
    rows = [(1, 0, 10, "en", "speaker_0"), (1, 5, 15, "de", "speaker_0"), (1, 10, 20, "en", "speaker_0"), (1, 20, 30, "fr", None), (1, 30, 40, "fr", None), (1, 30, 40, "en", None)]
    got = sorted(tuple(x) for x in votes.main_language(spark.createDataFrame(rows, VOTE)).collect() if x.speaker) + [tuple(x) for x in votes.main_language(spark.createDataFrame(rows, VOTE)).collect() if not x.speaker]
    assert got == [(1, "speaker_0", "en", 2, "10-20,0-10"), (1, None, "en", 2, "10-20,0-10")]
    assert votes.main_language(spark.createDataFrame(rows[:1], VOTE)).count() == 0
    assert votes.main_language(spark.createDataFrame([], VOTE)).count() == 0


def test_kept_up_languages_equal_a_new_count(spark):
    import random

    r = random.Random(5)
    before = [(k, s, s + r.choice([5, 10]), r.choice(["en", "fr"]), r.choice(["speaker_0", "speaker_1", None])) for k in range(12) for s in range(0, 100, 5) if r.random() < 0.5]
    after = [v for v in before if v[0] % 3 or r.random() < 0.7] + [(k, 200, 210, "en", None) for k in range(0, 15, 4)]
    a, b = spark.createDataFrame(before, VOTE), spark.createDataFrame(after, VOTE)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(votes.kept_up(votes.main_language(a), a, b)) == rows(votes.main_language(b))


@pytest.mark.parametrize(("text", "tokens", "samples", "want"), [("a", 10, 3200, None), ("a", 448, 3199, ("short_acoustic_context", True, "token_limit")), ("a", 448, 3200, ("token_limit", True, None)), ("", 1, 100, ("empty_result", False, None)), ("a", 1, 100, ("short_acoustic_context", False, None))])
def test_output_reviews(spark, text, tokens, samples, want):
    r = spark.createDataFrame([(text, tokens, samples)], "t string, n int, s int").select(recognition.output_review(F.col("t"), F.col("n"), F.col("s")).alias("r")).select("r", recognition.complete(F.col("r")).alias("c")).first()
    assert (None if r.r is None else tuple(r.r)) == want
    assert r.c == (want is None or want == ("short_acoustic_context", False, None))


def test_signals(spark):
    r = spark.createDataFrame([([1.0, -2.0, 0.5 / 32768, 1.5 / 32768], [0.5, 0.25], [-0.5, -0.25], [float("nan")], [0.0, 0.0], [0.5, 0.5])], "a array<double>, l array<double>, r array<double>, bad array<double>, zero array<double>, flat array<double>")
    got = r.select(signals.pcm16(F.col("a")), signals.downmix(F.col("l"), F.col("r")), signals.pcm16(F.col("bad")), signals.constant(F.col("zero")), signals.constant(F.col("flat")), signals.constant(F.col("l")), signals.peak(F.col("r")), signals.rms(F.col("flat"))).first()
    assert list(got) == [[32767, -32768, 0, 2], [0.5, 0.25], None, "digital_silence", "constant", None, 0.5, 0.5]


def test_separable_passages(spark):
    spans = spark.createDataFrame([(1, k, 0, 1000, False) for k in range(1)] + [(2, 1, 0, 1000, False), (3, 1, 0, 1000, False), (4, 1, 0, 1000, True), (5, 1, 0, 1000, False)], "recording_id long, span_id long, start_sample long, end_sample long, separated boolean")
    turn = [(1, "speaker_0", 0, 500), (1, "speaker_1", 400, 900), (2, "speaker_0", 0, 500), (2, "speaker_1", 500, 900), (3, "speaker_0", 0, 500), (3, "speaker_1", 400, 900), (4, "speaker_0", 0, 500), (4, "speaker_1", 400, 900), (5, "speaker_0", 0, 500), (5, "speaker_1", 0, 500), (5, "speaker_2", 0, 10)]
    turn = spark.createDataFrame(turn, "recording_id long, speaker string, start_sample long, end_sample long")
    epochs = spark.createDataFrame([(1, 0), (1, 1000), (3, 999)], "recording_id long, start_sample long")
    assert [x.recording_id for x in recognition.separable(spans, turn, epochs).collect()] == [1]


TRACK = "recording_id long, speaker string"


def test_check_outcomes(spark):
    planned = spark.createDataFrame([(k, "speaker_0", "c", "p:v1") for k in range(6)], f"{TRACK}, clips string, versions string")
    results = spark.createDataFrame([(k, "speaker_0", k == 1, "p" if k != 2 else None) for k in range(6)], f"{TRACK}, failed boolean, person_id string")
    names = spark.createDataFrame([(k, "speaker_0", "Ana" if k == 3 else "Speaker 1") for k in range(6)], f"{TRACK}, name string")
    held = spark.createDataFrame([(4, "speaker_0")], TRACK)
    clips = spark.createDataFrame([(k, "speaker_0", "d" if k == 5 else "c") for k in range(6)], f"{TRACK}, clips string")
    run = lambda versions: {x.recording_id: x.status for x in checks.outcomes(planned, results, names, held, clips, versions).collect()}
    assert run("p:v1") == {0: "matched", 1: "unavailable", 2: "unknown", 3: "cancelled", 4: "cancelled", 5: "cancelled"}
    assert set(run("p:v2").values()) == {"cancelled"}


def test_more_profiles_than_a_library_holds_are_an_error(spark):
    many = spark.range(checks.PEOPLE + 1).selectExpr("CAST(id AS STRING) AS person_id", "'m' AS model_id", "'v' AS version")
    with pytest.raises(ValueError):
        checks.scheduled_versions(many, "m")
    assert checks.scheduled_versions(many.limit(2), "m").count(":") == 2 and checks.scheduled_versions(many, "other") == ""


def test_a_pair_comes_back_only_unchanged(spark):
    rows = spark.createDataFrame([(1, "e-0", "x"), (1, "e-1", "y"), (2, "e-0", "x"), (2, "e-1", "z")], "recording_id long, passage_id string, version string")
    history = spark.createDataFrame([(k, "a", f"e-{i}", v) for k in (1, 2) for i, v in enumerate("xy")], "recording_id long, original string, passage_id string, version string")
    assert [tuple(x) for x in changes.restored(rows, history).collect()] == [(1, "a")]


def plain_turns(text, start, end, anchor_start, anchor_end, observed, words, regions):
    """The turns of one passage, every word against every region."""
    import re

    upto = end if observed is None else observed
    if anchor_start != start or not start < anchor_end <= end or not start <= upto <= end or not words or regions is None or [tuple(w[:2]) for w in words] != [m.span() for m in re.finditer(r"\S+", text)]:
        return []
    merged, at = [], start
    for a, z, who in regions:
        if a is None or z is None or not at == a < z <= upto:
            return []
        at, who = z, who if who is None else sorted(who)
        if merged and who is not None and merged[-1][2] == who:
            merged[-1] = (merged[-1][0], z, who)
        else:
            merged.append((a, z, who))
    if at != upto:
        return []
    found, last, margin = [], start, reading.MARGIN
    for i, (first, _, s, e) in enumerate(words):
        owner = None
        if s is not None and e is not None and last <= s < e <= anchor_end:
            last = e
            for k, (a, z, who) in enumerate(merged):
                far = min(end, e + margin) <= observed if observed is not None else anchor_start + margin <= s and e <= anchor_end - margin and a + (margin if k else 0) <= s and e <= z - (margin if k + 1 < len(merged) else 0)
                alone = not any(b < min(end, e + margin) and max(start, s - margin) < y and (o is None or o and o != who) for b, y, o in merged if (b, y) != (a, z))
                if a <= s and e <= z and who and far and alone and all(re.fullmatch("speaker_[0-9]+", n) for n in who):
                    owner = who
        offset = first if i else 0
        if found and found[-1][0] == owner:
            found[-1] = (owner, found[-1][1], found[-1][2], e)
        else:
            found.append((owner, offset, s, e))
    stops = [f[1] for f in found[1:]] + [len(text)]
    name = lambda w: "unassigned" if w is None else w[0] if len(w) == 1 else "overlap_" + "_".join(w)
    return [(n, a, z, text[a:z], name(w), "unknown" if w is None else "single" if len(w) == 1 else "overlap", s if w else None, e if w else None) for n, ((w, a, s, e), z) in enumerate(zip(found, stops, strict=True))]


def test_turns_equal_a_plain_search_for_each_word(spark):
    """Random passages, some of them broken; ``told`` gives one row for each with turns, and cuts batches into runs of words."""
    import random
    import re

    r, rows = random.Random(11), []
    for k in range(400):
        text = "".join(r.choice(["é", "ab", "𝒳c", " ", "  "]) for _ in range(r.randrange(1, 40)))
        start = r.choice([0, 7000])
        at, words = start, []
        for a, z in ((m.start(), m.end()) for m in re.finditer(r"\S+", text)):
            s = at + r.choice([0, 100, 3000, 9000, -50])
            e = s + r.choice([500, 2500, 0])
            words.append((a, z, *r.choice([(s, e)] * 6 + [(None, e), (s, None)])))
            at = max(at, e)
        end, at, regions = at + 5000, start, []
        observed = r.choice([None, end, end, end - 3000])
        upto = end if observed is None else observed
        while at < upto:
            z = min(upto, at + r.choice([500, 4000, 12000]))
            regions.append((at + (r.random() < 0.01), z, r.choice([["speaker_0"]] * 3 + [["speaker_1"], ["speaker_1", "speaker_0"], [], [], ["noise"], None])))
            at = z
        rows.append((k, "a", text, start, end, start + (r.random() < 0.03), end - r.choice([0, 1000]), observed, words[: -1 if r.random() < 0.03 else None], r.choice([regions] * 20 + [None])))
    want = {row[0]: plain_turns(*row[2:]) for row in rows}
    before, reading.AT_ONCE = reading.AT_ONCE, 50
    try:
        found = reading._told(spark.createDataFrame(rows, PASSAGE).toArrow().to_batches())
        small = [(x["recording_id"], [tuple(t.values()) for t in x["turns"]]) for b in found for x in b.to_pylist()]
    finally:
        reading.AT_ONCE = before
    whole = [(x.recording_id, [tuple(t) for t in x.turns]) for x in reading.told(spark.createDataFrame(rows, PASSAGE)).collect()]
    assert dict(whole) == {k: t for k, t in want.items() if t} and len(whole) == len(dict(whole)) > 200
    kept = {row[0] for row in rows if row[3] == row[5]}
    assert {k: t for k, t in small if k in kept} == dict(whole)
