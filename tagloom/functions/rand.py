"""Reproducible pseudo-randomness from hashes: the same row and seed give the same number on any cluster."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts: Column | str | int) -> Column:
    """A double in [0, 1) from the first 32 bits of the MD5 of the parts, joined by bars."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def shuffled(items: Column, *parts: Column | str | int) -> Column:
    """The array in the order of hashed uniforms of its places."""
    keyed = F.transform(items, lambda x, i: F.struct(uniform(*parts, i).alias("u"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def dropped(items: Column, probability: float, *parts: Column | str | int) -> Column:
    """The items whose uniform is at least the probability."""
    return F.filter(items, lambda x, i: uniform(*parts, i) >= F.lit(float(probability)))
