"""Blocks of audio samples (arrays of numbers) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A mix of two channels with less power than this share of the louder one has cancelled itself.
CANCELLED = 0.05


def _power(samples: Column) -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def pcm16(samples: Column) -> Column:
    """Samples within -1 to 1 as 16-bit integers, half to even, clamped; null if any isn't finite."""
    scaled = F.transform(samples, lambda x: F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), F.rint(x.cast("double") * 32768))).cast("int"))
    finite = F.forall(samples, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(finite, scaled)


def downmix(left: Column, right: Column) -> Column:
    """The mean of two channels, or the louder one (the left if equal) where they cancel each other."""
    mono = F.zip_with(left, right, lambda a, b: (a.cast("double") + b.cast("double")) * 0.5)
    louder = F.when(_power(right) > _power(left), F.transform(right, lambda x: x.cast("double"))).otherwise(F.transform(left, lambda x: x.cast("double")))
    return F.when(_power(mono) < CANCELLED * F.greatest(_power(left), _power(right)), louder).otherwise(mono)


def peak(samples: Column) -> Column:
    return F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double"))))


def rms(samples: Column) -> Column:
    """Root mean square, 1 at most; 0 for an empty block."""
    return F.when(F.size(samples) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.sqrt(_power(samples) / F.size(samples))))


def constant(samples: Column) -> Column:
    """digital_silence or constant if all samples are equal, else null."""
    low, high = F.array_min(samples), F.array_max(samples)
    return F.when(low == high, F.when(low == 0, "digital_silence").otherwise("constant"))
