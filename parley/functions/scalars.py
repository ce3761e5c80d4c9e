"""Scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Target level and largest gain of quiet speech.
TARGET, LARGEST = 0.25, 256.0
COLORS = 8


def utterance_id(recording: Column, epoch: Column, start: Column) -> Column:
    """``utterance-`` and 24 hex digits of the SHA-256 of ``recording:epoch:start``."""
    return F.concat(F.lit("utterance-"), F.substring(F.sha2(F.concat_ws(":", recording.cast("string"), epoch.cast("string"), start.cast("string")), 256), 1, 24))


def quiet_gain(peak: Column) -> Column:
    """Target over peak within 1 and the largest gain; 1 for silence; null for a negative or non-finite peak."""
    ok = (peak >= 0) & ~F.isnan(peak) & (peak < float("inf"))
    return F.when(ok & (peak == 0), F.lit(1.0)).when(ok, F.least(F.lit(LARGEST), F.greatest(F.lit(1.0), TARGET / peak)))


def color(speaker: Column) -> Column:
    """A track's colour: code points folded with 31 as unsigned 32 bits, modulo 8; -1 without a single speaker."""
    points = F.transform(F.split(speaker, ""), lambda c: F.ascii(c).cast("long"))
    folded = F.aggregate(points, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % (1 << 32))
    return F.when(speaker.isin("unassigned", "multiple_speakers"), F.lit(-1)).otherwise((folded % COLORS).cast("int"))


def review_clock(samples: Column) -> Column:
    """MM:SS.ffff of a place in samples; minutes aren't wrapped."""
    units = F.floor(samples * 10_000 / 16_000 + 0.5).cast("long")
    rest = units % 600_000
    minutes = F.floor(units / 600_000).cast("string")
    two = lambda x: F.lpad(x, 2, "0")
    return F.concat(F.when(F.length(minutes) < 2, two(minutes)).otherwise(minutes), F.lit(":"), two(F.floor(rest / 10_000).cast("string")), F.lit("."), F.lpad((rest % 10_000).cast("string"), 4, "0"))


def initials(label: Column, speaker: Column) -> Column:
    """What an avatar shows: S and the number, first letters of two words, or a sign where there is no single speaker."""
    number = F.regexp_extract(label, r"^Speaker ([0-9]+)$", 1)
    letters = F.upper(F.array_join(F.transform(F.slice(F.split(F.trim(label), r"\s+"), 1, 2), lambda w: F.substring(w, 1, 1)), ""))
    return F.when(speaker == "multiple_speakers", "…").when(speaker == "unassigned", "?").when(number != "", F.concat(F.lit("S"), number)).when(label == "Unknown speaker", "?").otherwise(letters)


def safe_file_name(name: Column) -> Column:
    """The last path part: ASCII letters, digits, dots and dashes; white space of any kind between kept characters becomes one underscore; no leading dots or underscores."""
    base = F.regexp_extract(name, r"([^/]*)/*$", 1)
    kept = F.regexp_replace(F.regexp_replace(base, r"(?U)[^A-Za-z0-9.\s-]", ""), r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(kept, r"(?U)\s+", "_"), r"^[._]+", "")


def to_samples(seconds: Column, way: str) -> Column:
    """Seconds to samples at 16 kHz, rounded down (floor), up (ceil) or to the nearest (round)."""
    return {"floor": F.floor, "ceil": F.ceil, "round": F.round}[way](seconds * 16_000).cast("long")


def namespaced(speaker: Column, source: Column, generation: Column) -> Column:
    """A track's name over sources and stream generations: numbers are moved by 32 for each source and 64 for each generation."""
    number = F.expr("try_cast(regexp_extract(speaker, '^speaker_([0-9]+)$', 1) AS bigint)")
    return F.when(number.isNull(), speaker).otherwise(F.concat(F.lit("speaker_"), (number + 32 * source + 64 * generation).cast("string")))


def masked_softmax(logits: Column, kept: Column) -> Column:
    """Softmax over the listed places (from 0) of an array, in their order."""
    own = F.transform(kept, lambda i: F.get(logits, i))
    top = F.array_max(own)
    e = F.transform(own, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))
