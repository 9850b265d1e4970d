"""Reproducible draws: a hash of the row's key instead of a generator's state, the same on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: str, *key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the MD5 of seed and key, joined by '|'."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in key]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0
