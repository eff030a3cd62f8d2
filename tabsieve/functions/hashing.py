"""Seeded, engine-independent pseudo-randomness from md5 digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_digest(seed: int | str, *columns: str | Column) -> Column:
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def seeded_uniform(seed: int | str, *columns: str | Column) -> Column:
    """Uniform in [0, 1): the first 13 hex digits of the digest over 16^13."""
    return F.conv(F.substring(seeded_digest(seed, *columns), 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))
