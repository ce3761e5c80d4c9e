"""Reading turns: which words of a passage were said by whom, from timed words and regions of activity.

Words and regions come as arrays in the passage's row (a passage has at most
4,096 characters of timed text), so a passage is judged where it is, without a shuffle.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "recording_id"
#: No other speaker may be heard this close to a word (0.25 s), in samples.
MARGIN = 4_000
#: A run of characters that aren't white space by Unicode; Python's \s takes in four separators that are none.
RUN = re.compile(r"[\S\x1c-\x1f]+")


def _units(text: pa.Array) -> pa.Array:
    spans, offsets = array("i"), []
    for t in text.to_pylist():
        offsets.append(None if t is None else len(spans) // 2)
        spans.extend(chain.from_iterable(map(re.Match.span, RUN.finditer(t or ""))))
    both = np.frombuffer(spans, dtype=np.int32).reshape(-1, 2)
    found = pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["start_char", "end_char"])
    return pa.ListArray.from_arrays(pa.array([*offsets, len(both)], pa.int32()), found)


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType())])))
def units(text: pa.Array) -> pa.Array:
    """The runs of a text between white space as an array of (start_char, end_char), from 0, in code points; null for a null text.

    Linear in the text. Spark's lambdas on arrays copy what they have found for every word, and are repeated wherever the column is used.
    """
    return _units(text)


#: A speaker's name, as Java's ``^speaker_[0-9]+$`` finds it: a line end may follow.
SPEAKER = re.compile(r"speaker_[0-9]+(?:\r\n|[\n\r\u0085\u2028\u2029])?")
#: Words that are judged at once.
AT_ONCE = 65_536
#: What a turn consists of, beside its passage.
TURN = T.StructType([T.StructField(c, kind) for c, kind in (
    ("n", T.IntegerType()), ("start_offset", T.IntegerType()), ("end_offset", T.IntegerType()), ("text", T.StringType()), ("speaker", T.StringType()), ("attribution", T.StringType()),
    ("start_sample", T.LongType()), ("end_sample", T.LongType()))])
FIELDS = tuple(TURN.names)
Region = tuple[int, int, tuple | None]


def ledger(regions: list | None, start: int, upto: int) -> list[Region] | None:
    """Regions in order as one ledger from the passage's start to its end, or to where it was observed; equal neighbours are merged. None if it has a break."""
    if regions is None:
        return None
    at, found = start, []
    for r in regions:
        if r is None or r["start_sample"] is None or r["end_sample"] is None or not at == r["start_sample"] < r["end_sample"] <= upto:
            return None
        at, who = r["end_sample"], None if r["speakers"] is None else tuple(sorted(r["speakers"], key=lambda n: (n is None, n or "")))
        if found and who is not None and found[-1][2] == who:
            found[-1] = (found[-1][0], at, who)
        else:
            found.append((r["start_sample"], at, who))
    return found if at == upto else None


def others(regions: Iterable[Region], edge: int) -> list[int | None]:
    """For each region the edge of the nearest one before it in which others speak. Whose speakers aren't known is another's."""
    found, last = [], None
    for r in regions:
        near = last and (last[2] if r[2] is not None and last[0] == r[2] else last[1])
        found.append(near)
        if r[2] is None or r[2]:
            last = (r[2], r[edge], near)
    return found


def safe(regions: list[Region], end: int, anchor_start: int, anchor_end: int, observed: int | None) -> list[tuple[int, int]]:
    """For each region of a ledger from where to where a word in it is safe: nobody else within the margin, and far enough from what wasn't observed."""
    found = []
    for i, ((a, z, _), before, after) in enumerate(zip(regions, others(regions, 1), others(regions[::-1], 0)[::-1], strict=True)):
        low, high = [a], [z]
        if before is not None:
            low.append(before + MARGIN)
        if after is not None:
            high.append(after - MARGIN)
        if observed is None:
            low += [anchor_start + MARGIN, a + (MARGIN if i else 0)]
            high += [anchor_end - MARGIN, z - (MARGIN if i + 1 < len(regions) else 0)]
        elif end > observed:
            high.append(observed - MARGIN)
        found.append((max(low), min(high)))
    return found


def owners(starts: list[int], ends: list[int], first: int, last: int, regions: list[Region], bounds: list[tuple[int, int]], numbers: list[int]) -> list[int]:
    """For each word the number of the speakers that own it, -1 for nobody.

    Times count if they come in order and end within the anchor; a word whose
    times don't count sets no bound for the next. So the region only moves on.
    """
    stops = [z for _, z, _ in regions]
    found, at, k = [], first, 0
    for start, end in zip(starts, ends, strict=True):
        own = -1
        if at <= start < end <= last:
            at = end
            while k < len(stops) and stops[k] <= start:
                k += 1
            if k < len(stops) and bounds[k][0] <= start and end <= bounds[k][1]:
                own = numbers[k]
        found.append(own)
    return found


def _column(items: pa.Array, name: str, missing: int) -> np.ndarray:
    return pa.compute.fill_null(pa.compute.struct_field(items, name), missing).to_numpy(zero_copy_only=False)


def _turns(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The passages of ``rows`` that have turns, with these; work is linear in words and regions."""
    texts, said = rows["text"].combine_chunks(), rows["words"].combine_chunks()
    count, found = pa.compute.list_value_length(said).to_numpy(zero_copy_only=False), _units(texts)
    same = count == pa.compute.fill_null(pa.compute.list_value_length(found), -1).to_numpy(zero_copy_only=False)
    items, real = said.filter(pa.array(same)).flatten(), found.filter(pa.array(same)).flatten()
    differs = np.zeros(len(items), dtype=bool)
    for c in ("start_char", "end_char"):
        differs |= _column(items, c, -1) != _column(real, c, -1)
    same[np.flatnonzero(same)[np.repeat(np.arange(same.sum()), count[same])[differs]]] = False

    def of(c: str) -> list:
        return rows[c].to_pylist()

    spans = list(zip(of("start_sample"), of("end_sample"), of("anchor_start"), of("anchor_end"), of("observed_end"), strict=True))
    ledgers = [ledger(r, s[0], s[1] if s[4] is None else s[4]) if good else None for r, s, good in zip(of("regions"), spans, same.tolist(), strict=True)]
    kept = [i for i, x in enumerate(ledgers) if x is not None]
    if not kept:
        return
    rows, said, count = rows.take(pa.array(kept, pa.int64())), said.take(pa.array(kept, pa.int64())), count[kept].astype(np.int64)
    items, cuts = said.flatten(), np.append(0, np.cumsum(count))
    timed = np.ones(len(items), dtype=bool)
    for c in ("start_sample", "end_sample"):
        timed &= pa.compute.is_valid(pa.compute.struct_field(items, c)).to_numpy(zero_copy_only=False)
    starts, ends = np.where(timed, _column(items, "start_sample", 1), 1), np.where(timed, _column(items, "end_sample", 0), 0)
    numbers: dict[tuple, int] = {}
    own: list[int] = []
    some, others_ = starts.tolist(), ends.tolist()
    for i, a, z in zip(kept, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        first, end, anchor_start, anchor_end, observed = spans[i]
        named = [numbers.setdefault(who, len(numbers)) if who and all(n is not None and SPEAKER.fullmatch(n) for n in who) else -1 for _, _, who in ledgers[i]]
        own += owners(some[a:z], others_[a:z], first, anchor_end, ledgers[i], safe(ledgers[i], end, anchor_start, anchor_end, observed), named)
    # neighbours of one owner are a turn: first start, last end
    owner, chars = np.array(own, dtype=np.int64), _column(items, "start_char", 0).astype(np.int64)
    new = np.diff(owner, prepend=-2) != 0
    new[cuts[:-1]] = True
    at = np.flatnonzero(new)
    size = np.add.reduceat(new, cuts[:-1], dtype=np.int64)
    head, tail = np.cumsum(size) - size, np.cumsum(size) - 1
    left = chars[at]
    left[head] = 0
    right, whole = np.append(left[1:], 0), rows["text"].to_pylist()
    right[tail] = list(map(len, whole))
    who = owner[at]
    nobody, last = who < 0, np.append(at[1:], len(owner)) - 1
    names = pa.array([*("overlap_" * (len(x) > 1) + "_".join(x) for x in numbers), "unassigned"], pa.string())
    kinds = pa.array([*("overlap" if len(x) > 1 else "single" for x in numbers), "unknown"], pa.string())
    taken = pa.array(np.where(nobody, len(numbers), who))
    of_turn = np.repeat(np.arange(len(kept)), size)
    parts = pa.array([whole[i][a:z] for i, a, z in zip(of_turn.tolist(), left.tolist(), right.tolist(), strict=True)], pa.string())
    values = [pa.array((np.arange(len(at)) - head[of_turn]).astype(np.int32)), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), parts, names.take(taken), kinds.take(taken),
              pa.array(starts[at].astype(np.int64), mask=nobody), pa.array(ends[last].astype(np.int64), mask=nobody)]
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.StructArray.from_arrays(values, list(FIELDS)))
    yield pa.RecordBatch.from_arrays([rows[KEY].combine_chunks(), rows["passage_id"].combine_chunks(), lists], names=[KEY, "passage_id", "turns"])


def _told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = pa.compute.fill_null(pa.compute.list_value_length(b["words"]), 0).to_numpy(zero_copy_only=False)
        b, words = b.filter(pa.array(words > 0)), words[words > 0]
        cuts = [*np.flatnonzero(np.diff(np.cumsum(words) // AT_ONCE, prepend=-1)).tolist(), b.num_rows]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            yield from _turns(pa.Table.from_batches([b.slice(a, z - a)]))


def told(passages: DataFrame) -> DataFrame:
    """(recording_id, passage_id, turns): ``reading_turns`` as one row for each row of ``passages`` that has turns; nothing is shuffled."""
    anchored = (F.col("anchor_start") == F.col("start_sample")) & (F.col("start_sample") < F.col("anchor_end")) & (F.col("anchor_end") <= F.col("end_sample"))
    observed = F.col("observed_end").isNull() | F.col("observed_end").between(F.col("start_sample"), F.col("end_sample"))
    fit = passages.where(anchored & observed).select(KEY, "passage_id", "text", "start_sample", "end_sample", "anchor_start", "anchor_end", "observed_end", "words", "regions")
    return fit.mapInArrow(_told, T.StructType([fit.schema[KEY], fit.schema["passage_id"], T.StructField("turns", T.ArrayType(TURN))]))


def reading_turns(passages: DataFrame) -> DataFrame:
    """(recording_id, passage_id, n, speaker, attribution, start_offset, end_offset, text, start_sample, end_sample).

    ``passages``: text, start_sample, end_sample, anchor_start, anchor_end,
    observed_end (may be null), words: array of (start_char, end_char,
    start_sample, end_sample), regions: array of (start_sample, end_sample,
    speakers). A passage has no turns if its words aren't its text's, or if
    its regions leave a break. attribution: single, overlap, or unknown for
    words that nobody surely owns, which carry no time.
    """
    turns = told(passages).select(KEY, "passage_id", F.explode("turns").alias("t"))
    return turns.select(KEY, "passage_id", *(f"t.{c}" for c in ("n", "speaker", "attribution", "start_offset", "end_offset", "text", "start_sample", "end_sample")))


def coverage(turns: DataFrame, passages: DataFrame) -> DataFrame:
    """(recording_id, passage_id, covered): do a passage's turns, in order of n, give its text without a break, with names and times that fit?"""
    return covered(gathered(turns), passages)


def gathered(turns: DataFrame) -> DataFrame:
    """(recording_id, passage_id, turns): all turns of a passage in order; ``turns`` are rows of them, or what ``told`` gives."""
    if "turns" not in turns.columns:
        return turns.groupBy(KEY, "passage_id").agg(F.array_sort(F.collect_list(F.struct(*FIELDS))).alias("turns"))
    own = turns.groupBy(KEY, "passage_id").agg(F.collect_list("turns").alias("own"))
    return own.select(KEY, "passage_id", F.when(F.size("own") == 1, F.col("own")[0]).otherwise(F.array_sort(F.flatten("own"))).alias("turns"))


def complete() -> Column:
    """Whether ``turns`` give the text ``whole`` of a passage from ``low`` to ``high``; false for no turns."""
    named = r"CASE t.attribution WHEN 'single' THEN t.speaker RLIKE '^speaker_[0-9]+$' WHEN 'overlap' THEN t.speaker RLIKE '^overlap_speaker_[0-9]+(_speaker_[0-9]+)+$' ELSE false END"
    timed = f"CASE WHEN t.attribution = 'unknown' THEN t.speaker = 'unassigned' AND t.start_sample IS NULL AND t.end_sample IS NULL ELSE {named} AND low <= t.start_sample AND t.start_sample < t.end_sample AND t.end_sample <= high END"
    valid = f"t.start_offset = s.at AND t.end_offset > s.at AND t.end_offset <= length(whole) AND t.text = substring(whole, s.at + 1, t.end_offset - s.at) AND {timed}"
    ok = F.expr(f"aggregate(turns, named_struct('at', 0, 'ok', true), (s, t) -> named_struct('at', t.end_offset, 'ok', s.ok AND coalesce({valid}, false)), s -> s.ok AND s.at = length(whole))")
    return F.coalesce(ok, F.lit(False))


def covered(grouped: DataFrame, passages: DataFrame) -> DataFrame:
    """``coverage`` of ``gathered`` turns."""
    whole = passages.select(KEY, "passage_id", F.col("text").alias("whole"), F.col("start_sample").alias("low"), F.col("end_sample").alias("high"))
    return whole.join(grouped, [KEY, "passage_id"], "left").select(KEY, "passage_id", complete().alias("covered"))


def retained(prior: DataFrame, grown: DataFrame) -> DataFrame:
    """(recording_id, passage_id, retained): may the word times of the prior row serve the one that audio was appended to?

    Both: utterance_id, text, start_sample, end_sample, source, language,
    epoch, audio_revision; grown also protected. Same words, start, utterance,
    source, language and epoch, a later end, nothing protected, and an audio
    revision that hasn't gone back.
    """
    a, b = prior.alias("a"), grown.alias("b")
    same = F.lit(True)
    for c in ("text", "start_sample", "source", "language", "epoch"):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    later = (F.col("a.end_sample") < F.col("b.end_sample")) & (F.col("a.utterance_id") == F.col("b.utterance_id")) & (F.col("b.audio_revision") >= F.col("a.audio_revision"))
    free = F.coalesce(F.col("b.protected"), F.lit("")) == ""
    return b.join(a, [KEY, "passage_id"]).select(KEY, "passage_id", F.coalesce(same & later & free, F.lit(False)).alias("retained"))


def receipts(turns: DataFrame, passages: DataFrame) -> DataFrame:
    """A receipt for the turns of each passage: hashes of its text, activity and turns, its anchor, and the numbers of what they were made from.

    passages: RECEIPT columns, text, activity (any text that stands for the
    regions), anchor_start, anchor_end.
    """
    return made(passages).join(hashed_turns(turns), [KEY, "passage_id"])


def made(passages: DataFrame, *more: Column) -> DataFrame:
    """What a receipt says of the passage itself."""
    return passages.select(KEY, "passage_id", *RECEIPT, F.sha2("text", 256).alias("text_sha256"), F.sha2("activity", 256).alias("activity_sha256"), "anchor_start", "anchor_end", *more)


#: Numbers that a receipt shares with its passage.
RECEIPT = ("utterance_id", "machine_revision", "canonical_revision", "audio_revision", "language_epoch", "capture_source")


def hashed(turns: Column) -> Column:
    return F.sha2(F.to_json(turns, {"ignoreNullFields": "false"}), 256)


def hashed_turns(turns: DataFrame) -> DataFrame:
    return gathered(turns).select(KEY, "passage_id", hashed(F.col("turns")).alias("turns_sha256"))


def held(turns: DataFrame, passages: DataFrame, given: DataFrame) -> DataFrame:
    """The turns that still stand, as rows; see ``standing``."""
    return standing(turns, passages, given).select(KEY, "passage_id", F.explode("turns").alias("t")).select(KEY, "passage_id", *(f"t.{c}" for c in FIELDS))


def standing(turns: DataFrame, passages: DataFrame, given: DataFrame) -> DataFrame:
    """The ``gathered`` turns that still stand: their passage is unprotected, all that their receipt (of ``receipts``) names is unchanged, and they cover the text.

    A passage with more than one receipt has none. Turns are gathered once a passage, and judged and hashed there.
    """
    one = given.withColumn("_n", F.count("*").over(Window.partitionBy(KEY, "passage_id"))).where("_n = 1").drop("_n")
    own = gathered(turns)
    free = made(passages.where("coalesce(protected, '') = ''"), F.col("text").alias("whole"), F.col("start_sample").alias("low"), F.col("end_sample").alias("high"))
    now = own.join(free, [KEY, "passage_id"]).withColumn("turns_sha256", hashed(F.col("turns"))).where(complete())
    a, b = now.alias("a"), one.alias("b")
    match = (F.col(f"a.{KEY}") == F.col(f"b.{KEY}")) & (F.col("a.passage_id") == F.col("b.passage_id"))
    for c in (*RECEIPT, "text_sha256", "activity_sha256", "anchor_start", "anchor_end", "turns_sha256"):
        match = match & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, match, "left_semi").select(KEY, "passage_id", "turns")
