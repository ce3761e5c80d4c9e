"""Units and targets of texts in several scripts, typed from the expected files; and stitching against plain loops."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from parley.operators import preparing, stitching

#: Vocabulary of the expected cases (fixed values).
VOCABULARY = ["<s>", "<pad>", "</s>", "<unk>", " ", "h", "e", "l", "o", "w", "r", "d", "م", "ر", "ح", "ب", "ا", "ع", "コ", "ヒ"]
UNITS = {
    "Hello, world.": [(0, 6, 0, 6, "w"), (7, 13, 7, 13, "w")],
    "こんにちは、世界。": [(0, 1, 0, 1, "c"), (1, 2, 1, 2, "c"), (2, 3, 2, 3, "c"), (3, 4, 3, 4, "c"), (4, 6, 4, 6, "c"), (6, 7, 6, 7, "c"), (7, 9, 7, 9, "c")],
    "コーヒー": [(0, 2, 0, 2, "c"), (2, 4, 2, 4, "c")],
    "مرحبا بالعالم": [(0, 5, 0, 5, "w"), (6, 13, 6, 13, "w")],
    "Hello 東京 مرحبا": [(0, 5, 0, 5, "w"), (6, 7, 6, 7, "c"), (7, 8, 7, 8, "c"), (9, 14, 9, 14, "w")],
    "": [],
    " \t　": [],
    "、。東a1b京": [(0, 3, 0, 3, "c"), (3, 6, 3, 6, "w"), (6, 7, 6, 7, "c")],
    "\U00020000\U0001f600x": [(0, 1, 0, 2, "c"), (1, 3, 2, 5, "w")],
}
TARGETS = {
    ("Hello, world.", "en"): ([(5, 0, 1), (6, 1, 2), (7, 2, 3), (7, 3, 4), (8, 4, 5), (4, 6, 7), (9, 7, 8), (8, 8, 9), (10, 9, 10), (7, 10, 11), (11, 11, 12)], [], ["supported_single_character_lowercase_alias"]),
    ("コーヒー", "ja"): ([(18, 0, 1), (4, 1, 2), (19, 2, 3)], [], ["upstream_japanese_separator_alias"] * 2),
    ("مَرْحَبًا", "ar"): ([(12, 0, 1), (13, 2, 3), (14, 4, 5), (15, 6, 7), (16, 8, 9)], [], ["upstream_deleted_arabic_mark"] * 4),
    ("Hello Ω", "en"): ([(5, 0, 1), (6, 1, 2), (7, 2, 3), (7, 3, 4), (8, 4, 5)], [(6, 7, "Ω")], ["supported_single_character_lowercase_alias"]),
    (" \n ー h  e ", "en"): ([(5, 5, 6), (4, 6, 8), (6, 8, 9)], [(3, 4, "ー")], []),
    ("", "en"): ([], [], []),
}


def test_units(spark):
    got = spark.createDataFrame([(t,) for t in UNITS], "t string").select("t", preparing.units(F.col("t")).alias("u")).collect()
    assert {r.t: [(u.start_char, u.end_char, u.start_utf16, u.end_utf16, u.unit_kind[0]) for u in r.u] for r in got} == UNITS
    assert all(u.text == r.t[u.start_char : u.end_char] for r in got for u in r.u)


def test_targets(spark):
    rows = [*TARGETS, ("h" * 4097, "en"), ("h" * 1025, "en"), ("h", "sw"), (None, "en"), ("h", None)]
    found = spark.createDataFrame(rows, "t string, l string").select("t", "l", preparing.preparer(spark, VOCABULARY)(F.col("t"), F.col("l")).alias("p")).collect()
    good = {(r.t, r.l): ([(x.token_id, x.start_char, x.end_char) for x in r.p.targets], [tuple(x) for x in r.p.unsupported], [x.kind for x in r.p.aliases]) for r in found if r.p.error is None}
    assert good == TARGETS
    assert sorted(r.p.error for r in found if r.p.error) == ["too_many", *["unsupported"] * 4]


def test_composed_spans():
    assert preparing.composed("e\u0301x") == [("\u00e9", 0, 2), ("x", 2, 3)]
    assert preparing.composed("a\u0323\u0302") == [("\u1ead", 0, 3)]
    # marks in the other order are put right, and share what they came from
    assert preparing.composed("q\u0302\u0323") == [("q", 0, 1), ("\u0323", 1, 3), ("\u0302", 1, 3)]
    assert preparing.composed("\u1112\u1161\u11ab") == [("\ud55c", 0, 3)]
    assert preparing.composed("\u00e9\u65e5") == [("\u00e9", 0, 1), ("\u65e5", 1, 2)]


CELL, WORD = "struct<token: string, start_sample: long, end_sample: long>", "struct<start_char: int, end_char: int, start_sample: long, end_sample: long, first_cell: int, end_cell: int>"
SCHEMA = f"recording_id long, utterance_id string, n long, start_sample long, end_sample long, core_end long, language string, descriptor string, raw string, cells array<{CELL}>, words array<{WORD}>"


def alike(a, b):
    return len(a) == len(b) and all(x[0] == y[0] and abs(x[1] - y[1]) <= 4000 and abs(x[2] - y[2]) <= 4000 for x, y in zip(a, b, strict=True)) and any(max(x[1], y[1]) < min(x[2], y[2]) for x, y in zip(a, b, strict=True))


def seam(left, right):
    """By plain loops: (reason, left_end, right_start)."""
    if left[6] != right[6]:
        return "context_language_mismatch", None, None
    if left[7] != right[7]:
        return "context_timing_provider_mismatch", None, None
    low, high, why = max(left[3], right[3]), min(left[4], right[4]), "no_complete_boundary_anchor"
    for w in reversed(left[10]):
        if not (w[2] < left[5] + 4000 and low + 4000 <= w[2] and w[3] <= high - 4000):
            continue
        run = left[9][w[4] : w[5]]
        hits = [i for i in range(len(right[9]) - len(run) + 1) if alike(run, right[9][i : i + len(run)]) and any(x[4] == i for x in right[10]) and any(x[5] == i + len(run) for x in right[10])]
        if len(hits) != 1:
            why = "ambiguous_boundary_mapping" if hits else "boundary_mapping_absent"
            continue
        there = right[9][hits[0] : hits[0] + len(run)]
        if [i for i in range(len(left[9]) - len(run) + 1) if alike(left[9][i : i + len(run)], there)] != [w[4]]:
            why = "ambiguous_bidirectional_boundary"
            continue
        return None, w[1], next(x[1] for x in right[10] if x[5] == hits[0] + len(run))
    return why, None, None


def whole(windows):
    text, words, start = "", [], 0
    for k, w in enumerate(windows):
        stop, nxt = len(w[8]), 0
        if k + 1 < len(windows):
            why, stop, nxt = seam(w, windows[k + 1])
            if why:
                return False, why, None, None
        if stop < start:
            return False, "nonmonotonic_raw_boundary", None, None
        kept = w[8][start:stop]
        piece = kept.strip()
        if piece:
            a = start + len(kept) - len(kept.lstrip())
            if text:
                text += w[8][start:a]
            words += [(x[0] - a + len(text), x[1] - a + len(text), x[2], x[3]) for x in w[10] if a <= x[0] and x[1] <= a + len(piece)]
            text += piece
        start = nxt
    clash = {i for k in range(len(words) - 1) if words[k][3] > words[k + 1][2] for i in (k, k + 1)}
    return True, None, text, [(a, z, None if i in clash else s, None if i in clash else e) for i, (a, z, s, e) in enumerate(words)]


def heard(r, k, jitter):
    """Windows of one utterance, of words with one to three cells; some words repeat at once."""
    vocabulary = ["ab", "cd", "ef", "g"]
    said, at = [], 0
    for _ in range(r.randrange(4, 30)):
        said.append((r.choice(vocabulary), at, at + r.choice([1500, 3000, 4500])))
        at = said[-1][2] + r.choice([0, 500, 3000])
    windows = []
    for n, first in enumerate(range(0, max(1, len(said) - 4), 6)):
        own, off = said[first : first + 11], r.randrange(-jitter, jitter + 1)
        raw, cells, words = r.choice(["", " "]), [], []
        for word, a, z in own:
            start, c0 = len(raw), len(cells)
            step = (z - a) // len(word)
            cells += [(x, a + i * step + off, a + (i + 1) * step + off) for i, x in enumerate(word)]
            raw += word + r.choice([" ", " ", "  ", ""])
            words.append((start, start + len(word), a + off, z + off, c0, len(cells)))
        windows.append((1, f"u{k}", n, own[0][1] - 5000 + off, own[-1][2] + 5000 + off, own[min(8, len(own) - 1)][1] + off, r.choice(["en"] * 30 + ["fr"]), "d", raw, cells, words))
    return windows


@pytest.mark.parametrize("jitter", [300, 2500])
def test_stitching_against_plain_loops(spark, jitter):
    r = random.Random(jitter)
    utterances = [heard(r, k, jitter) for k in range(150)]
    windows = spark.createDataFrame([w for u in utterances for w in u], SCHEMA).repartition(5)
    want = {(f"u{k}", n): seam(u[n], u[n + 1]) for k, u in enumerate(utterances) for n in range(len(u) - 1)}
    got = {(x.utterance_id, x.n): (x.reason, x.left_end, x.right_start) for x in stitching.seams(windows).collect()}
    assert got == want and len({x[0] for x in want.values()}) >= (4 if jitter > 2000 else 2)
    done = {x.utterance_id: (x.complete, x.reason, x.text, None if not x.complete else [tuple(w) for w in x.words or []]) for x in stitching.stitched(windows).collect()}
    assert done == {f"u{k}": whole(u) for k, u in enumerate(utterances)}
    assert sum(x[0] for x in done.values()) > 20


def test_a_missing_window(spark):
    r = random.Random(9)
    u = next(x for x in (heard(r, 1, 0) for _ in range(50)) if len(x) > 2)
    got = stitching.stitched(spark.createDataFrame(u[:1] + u[2:], SCHEMA)).collect()[0]
    assert (got.complete, got.reason, got.text) == (False, "missing_context", None)


def test_results_are_made_in_bounded_parts():
    """A batch of many texts is turned into results a part at a time, in order and without loss; null texts count nothing."""
    texts = pd.Series(["x" * 1000, None] * 500 + ["y" * (2 * preparing.AT_ONCE)])
    parts = list(preparing.in_parts(texts, pd.Series(range(1001))))
    assert len(parts) > 7
    assert [i for _, n in parts for i in n] == list(range(1001))
    assert all(t.str.len().sum() <= preparing.AT_ONCE + 1000 for t, _ in parts[:-1])
    assert sum(len(t) for (t,) in preparing.in_parts(pd.Series([None, None], dtype=object))) == 2
