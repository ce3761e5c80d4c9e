"""Texts as units of timing and as targets of a character model, with offsets into the text as it stands.

Both depend on properties of single characters (general category, combining
class, NFC) that SQL doesn't know, so a batch of texts goes through Arrow; a
text has at most LONGEST characters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.operators.language import SUPPORTED

LONGEST, MOST_TARGETS = 4096, 1024
#: Characters of text that a task turns into results at a time, whatever the batches are.
AT_ONCE = 1 << 16
#: Ranges of code points (fixed values): characters that are units of their own, kana, and Arabic letters and marks.
CJK = ((0x3400, 0x9FFF), (0x20000, 0x3134F), (0x3041, 0x3096), (0x30A1, 0x30FA), (0xFF66, 0xFF9D))
KANA = CJK[2:]
ARABIC_MARKS = ((0x064B, 0x0652),)
ARABIC_LETTERS = ((0x61C, 0x61C), (0x620, 0x63F), (0x641, 0x64A), (0x66E, 0x6D3), (0x6D5, 0x6D5), (0x6EE, 0x6EF), (0x6FA, 0x6FC), (0x6FF, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8B4), (0x8B6, 0x8C7), (0xFB50, 0xFBB1), (0xFBD3, 0xFBE9), (0xFBFC, 0xFBFF), (0xFE80, 0xFEF4))
#: The mark that lengthens a kana.
PROLONGED = "ー"
#: White space by Unicode, which isn't quite what str.isspace says.
NOT_BLANK = "\x1c\x1d\x1e\x1f"


def within(c: str, ranges: tuple[tuple[int, int], ...]) -> bool:
    return any(a <= ord(c) <= z for a, z in ranges)


def blank(c: str) -> bool:
    return c.isspace() and c not in NOT_BLANK


def kind_of(c: str) -> str | None:
    """What a character makes of its place: a character unit, a run, or nothing for marks and punctuation, which go with what stands before."""
    if c == PROLONGED or unicodedata.category(c)[0] in "PM":
        return None
    return "ctc_character" if within(c, CJK) else "whitespace_run"


def mixed_units(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind): runs between white space; one that holds a CJK character is parted at each of them."""
    at, end = 0, len(text)
    while at < end:
        if blank(text[at]):
            at += 1
            continue
        stop = next((i for i in range(at, end) if blank(text[i])), end)
        kinds = [(i, kind_of(text[i])) for i in range(at, stop)]
        parts = [(at, "whitespace_run")]
        if any(within(c, CJK) for c in text[at:stop]):
            told = [x for x in kinds if x[1]]
            parts = [x for k, x in enumerate(told) if not k or x[1] == "ctc_character" or told[k - 1][1] != x[1]] or parts
            parts[0] = (at, parts[0][1])
        for (a, kind), z in zip(parts, [a for a, _ in parts[1:]] + [stop], strict=True):
            yield a, z, kind
        at = stop


UNITS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in ("start_char", "end_char", "start_utf16", "end_utf16")), T.StructField("unit_kind", T.StringType())]))


def in_parts(*columns: pd.Series) -> Iterator[tuple[pd.Series, ...]]:
    """Rows of a batch in parts of about AT_ONCE characters of the first column, as a text's result takes far more memory than the text."""
    part = columns[0].map(lambda t: len(t) if isinstance(t, str) else 0).cumsum() // AT_ONCE
    for _, rows in part.groupby(part.to_numpy()):
        yield tuple(c.loc[rows.index] for c in columns)


@F.pandas_udf(UNITS)
def units(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The timing units of mixed-script texts; null for a null text."""

    def one(t: str | None):
        if t is None:
            return None
        wide = [0]
        for c in t:
            wide.append(wide[-1] + 1 + (ord(c) > 0xFFFF))
        return [{"text": t[a:z], "start_char": a, "end_char": z, "start_utf16": wide[a], "end_utf16": wide[z], "unit_kind": kind} for a, z, kind in mixed_units(t)]

    for batch in batches:
        for (text,) in in_parts(batch):
            yield text.map(one)


def composed(text: str) -> list[tuple[str, int, int]]:
    """The NFC characters of a text, each with the span of raw characters that it came from.

    A text in NFC is its own spans. Else characters are taken in one by one:
    those that a new one changes get one span together, up to the new one.
    """
    if unicodedata.is_normalized("NFC", text):
        return [(c, i, i + 1) for i, c in enumerate(text)]

    def take(found: list[tuple[str, int, int]], new: tuple[int, str]) -> list[tuple[str, int, int]]:
        i, c = new
        # only what follows the last starter can still change
        last = next((k for k in range(len(found) - 1, -1, -1) if not unicodedata.combining(found[k][0])), 0)
        tail = found[last:]
        after = unicodedata.normalize("NFC", "".join(x[0] for x in tail) + c)
        same = next((k for k, (x, y) in enumerate(zip(tail, after, strict=False)) if x[0] != y), min(len(tail), len(after)))
        a = min((x[1] for x in tail[same:]), default=i)
        found[last + same :] = [(y, a, i + 1) for y in after[same:]]
        return found

    return reduce(take, enumerate(text), [])


def targets_of(text: str, vocabulary: dict[str, int]) -> dict:
    """Targets of a text, what has no target, and characters that stand for others."""
    targets: list[list] = []  # token, character, start, end
    unsupported, aliases = [], []
    for c, a, z in composed(text):
        raw = text[a:z]
        if c == PROLONGED or within(c, ARABIC_MARKS):
            base = next((t for t in reversed(targets) if t[1] != " " and t[3] <= a), None)
            between = text[base[3] : a] if base else ""
            arabic = base is not None and c != PROLONGED and within(base[1], ARABIC_LETTERS) and all(within(x, ARABIC_MARKS) for x in between)
            japanese = base is not None and c == PROLONGED and within(base[1], KANA) and not between.strip(PROLONGED)
            if not arabic and not japanese:
                unsupported.append((a, z, raw))
                continue
            aliases.append((a, z, raw, " " if japanese else None, "upstream_japanese_separator_alias" if japanese else "upstream_deleted_arabic_mark"))
            if arabic:
                continue
            c = " "
        if blank(c):
            if targets and targets[-1][1] == " ":
                targets[-1][3] = z
                continue
            c = " "
        elif unicodedata.category(c)[0] == "P":
            continue
        if c not in vocabulary and len(c.lower()) == 1 and c.lower() != c and c.lower() in vocabulary:
            c = c.lower()
            aliases.append((a, z, raw, c, "supported_single_character_lowercase_alias"))
        if c in vocabulary:
            targets.append([vocabulary[c], c, a, z])
        else:
            unsupported.append((a, z, raw))
    return {"targets": targets, "unsupported": unsupported, "aliases": aliases}


PREPARED = "struct<error: string, targets: array<struct<token_id: int, text: string, start_char: int, end_char: int>>, unsupported: array<struct<start_char: int, end_char: int, text: string>>, aliases: array<struct<start_char: int, end_char: int, raw_text: string, acoustic_token: string, kind: string>>>"


def preparer(spark: SparkSession, vocabulary: list[str]) -> Callable[[Column, Column], Column]:
    """A column function (text, language) -> PREPARED for a vocabulary (tokens by their id; single characters count).

    error: unsupported (null or too long text, or no such language) or
    too_many (targets); nothing else is given then. Separators at either end
    are no targets.
    """
    lookup = {}
    for i, token in enumerate(vocabulary):
        if len(token) == 1:
            lookup[token] = i
    sent = spark.sparkContext.broadcast(lookup)

    @F.pandas_udf(PREPARED)
    def prepare(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        def one(t: str | None, code: str | None) -> dict:
            failed = {"error": "unsupported", "targets": None, "unsupported": None, "aliases": None}
            if t is None or len(t) > LONGEST or code not in SUPPORTED:
                return failed
            found = targets_of(t, sent.value)
            own = found["targets"]
            if len(own) > MOST_TARGETS:
                return failed | {"error": "too_many"}
            inner = [k for k, x in enumerate(own) if x[1] != " "]
            own = own[inner[0] : inner[-1] + 1] if inner else []
            named = lambda rows, *names: [dict(zip(names, r, strict=True)) for r in rows]
            return {"error": None, "targets": named(own, "token_id", "text", "start_char", "end_char"), "unsupported": named(found["unsupported"], "start_char", "end_char", "text"), "aliases": named(found["aliases"], "start_char", "end_char", "raw_text", "acoustic_token", "kind")}

        for batch in batches:
            for text, language in in_parts(*batch):
                yield pd.DataFrame([one(t, c) for t, c in zip(text, language, strict=True)], columns=["error", "targets", "unsupported", "aliases"])

    return prepare
