"""Draws that depend on keys alone, so that no partitioning changes them."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) from a hash of the seed and the keys."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def normal(seed: int, *keys: Column | str) -> Column:
    """A standard normal number by the Box-Muller transform of two uniform draws."""
    first = 1.0 - uniform(seed, F.lit(1), *keys)
    second = uniform(seed, F.lit(2), *keys)
    return F.sqrt(-2.0 * F.log(first)) * F.cos(F.lit(2 * math.pi) * second)


def passed(cumulative: Column, draw: Column) -> Column:
    """Inverse of a cumulative row of probabilities: how many of its entries a draw exceeds."""
    return F.size(F.filter(cumulative, lambda c: draw > c))


def transition(seed: int, cumulative: Column, *keys: Column | str) -> Column:
    """The place that a draw of the keys falls to in a cumulative row of probabilities."""
    return passed(cumulative, uniform(seed, *keys))


def child_seed(seed: int, *parts: str | int) -> int:
    """A seed of its own for a file, a day or a stage, the same on every machine."""
    text = json.dumps([seed, *parts], separators=(",", ":"))
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:7], "big")
