"""Reproducible randomness: a row's draw depends on its key and a seed only.

``rand`` depends on how rows happen to be partitioned; an md5 of the key does
not, so a split or a sample survives a repartition, a retry and a re-run.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed, *keys) -> Column:
    """Hex md5 of ``key:key:...:seed``."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts], F.lit(str(seed))))


def draw(seed, *keys) -> Column:
    """A 32-bit integer drawn from the digest, as bigint."""
    return F.conv(F.substring(digest(seed, *keys), 1, 8), 16, 10).cast("bigint")


def uniform(seed, *keys) -> Column:
    """A double in [0, 1)."""
    return draw(seed, *keys).cast("double") / F.lit(4294967296.0)


def fine_uniform(seed, *keys) -> Column:
    """A double in [0, 1) with all of its 52 bits drawn."""
    return F.conv(F.substring(digest(seed, *keys), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(4503599627370496.0)


def gaussian(seed, *keys) -> Column:
    """A standard normal draw (Box-Muller over two uniforms in (0, 1])."""
    first = F.lit(1.0) - uniform(f"{seed}/r", *keys)
    second = uniform(f"{seed}/a", *keys)
    return F.sqrt(F.lit(-2.0) * F.log(first)) * F.cos(F.lit(6.283185307179586) * second)


def below(seed, share: float, *keys) -> Column:
    """True for ``share`` of the keys; compares the digest as text."""
    if share >= 1:
        return F.lit(True)
    return F.substring(digest(seed, *keys), 1, 8) < F.lit(f"{int(share * 2**32):08x}")
