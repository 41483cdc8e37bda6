"""Keyed randomness: every draw is a function of (seed, keys), never of partitioning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the integer hash used for bulk draws: a prime modulus and one
# additive constant per round. x -> x**5 is a bijection modulo this prime.
PRIME = 2147483647
ROUND_CONSTANTS = (1013904223, 1664525, 22695477)


def _text(key: Column | str | int) -> Column:
    if isinstance(key, Column):
        return key.cast("string")
    if isinstance(key, str):
        return F.col(key).cast("string")
    return F.lit(str(key))


def hash_hex(seed: Column | int, *keys: Column | str) -> Column:
    """md5 of `seed|key|key...` as 32 hex digits. String keys name columns."""
    return F.md5(F.concat_ws("|", _text(seed), *[_text(k) for k in keys]))


def uniform(seed: Column | int, *keys: Column | str) -> Column:
    """Uniform double in [0, 1) from the leading 52 bits of the keyed hash."""
    digits = F.substring(hash_hex(seed, *keys), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(2.0**52)


def group_code(*keys: Column | str) -> Column:
    """28-bit integer naming a group, used to decorrelate draws between groups."""
    digits = F.substring(F.md5(F.concat_ws("|", *[_text(k) for k in keys])), 1, 7)
    return F.conv(digits, 16, 10).cast("bigint")


def _fifth_power(x: np.ndarray) -> np.ndarray:
    square = x * x % PRIME
    return square * square % PRIME * x % PRIME


def draw_hash(counter: np.ndarray, group: int) -> np.ndarray:
    """Integer hash of (counter, group), uniform on [0, PRIME), for bulk draws in tasks."""
    c1, c2, c3 = ROUND_CONSTANTS
    x = _fifth_power((counter + c1) % PRIME)
    x = _fifth_power((x + group + c2) % PRIME)
    return _fifth_power((x + c3) % PRIME)
