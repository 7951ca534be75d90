"""Uniform and normal draws from hashes: the same for any partitioning, engine and rerun."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = "42"


def draw(tag: str, *keys: Column, seed: str = SEED) -> Column:
    """A uniform number in [0, 1) for the tag and keys."""
    text = F.concat_ws(":", F.lit(seed), F.lit(tag), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def draw_below(n: Column, tag: str, *keys: Column, seed: str = SEED) -> Column:
    """A uniform integer in [0, n)."""
    return F.floor(draw(tag, *keys, seed=seed) * n).cast("long")


def draw_normal(tag: str, *keys: Column, seed: str = SEED) -> Column:
    """A standard normal number by the Box-Muller transform."""
    u = F.greatest(draw(tag + "1", *keys, seed=seed), F.lit(2.0**-52))
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * 3.141592653589793 * draw(tag + "2", *keys, seed=seed))
