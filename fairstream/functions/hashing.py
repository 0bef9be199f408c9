"""Seeded stand-ins for random draws, equal in every run and on every partitioning."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: the prime of the universal hash family
PRIME = 8191
DRAWS = 1 << 60


def _hex_draw(seed: int | str, key: Column, digits: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def coin(seed: int | str, key: Column | str) -> Column:
    """Uniform in [0, 1): ``draw`` as a fraction of ``DRAWS``."""
    return draw(seed, key) / F.lit(float(DRAWS))


def draw(seed: int | str, key: Column | str) -> Column:
    """60 random bits of an MD5 over seed and key, as bigint."""
    key = F.col(key) if isinstance(key, str) else key
    return _hex_draw(seed, key, 15)


def salt(parts: int, *keys: Column | str) -> Column:
    return F.pmod(F.hash(*keys), F.lit(parts))


def hash_pairs(depth: int, seed: int, prime: int = PRIME) -> list[tuple[int, int]]:
    """Coefficients ``(a, b)`` with a in 1..prime-1 and b in 0..prime-1."""
    rng = random.Random(seed)
    return [(rng.randrange(1, prime), rng.randrange(prime)) for _ in range(depth)]


def universal_hash(
    item: Column | str,
    a: Column | int,
    b: Column | int,
    width: Column | int,
    prime: Column | int = PRIME,
) -> Column:
    """``((a*x + b) mod prime) mod width``, never negative.

    The item is reduced first, which leaves the result as it is and keeps the product small.
    """
    item = F.col(item) if isinstance(item, str) else item
    a, b, width, prime = (
        (v if isinstance(v, Column) else F.lit(v)).cast("bigint") for v in (a, b, width, prime)
    )
    return F.pmod(F.pmod(a * F.pmod(item, prime) + b, prime), width).cast("int")
