"""Reproducible pseudo-random numbers: a hash of an id and a salt.

They depend on the row alone, so neither the partitioning nor a retried task changes them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(entity_id: Column, salt: str) -> Column:
    """A number in [0, 1) from the first 8 hex digits of md5(id:salt)."""
    digest = F.md5(F.concat(entity_id.cast("string"), F.lit(f":{salt}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def position(entity_id: Column, salt: str, size: int) -> Column:
    """A whole number from 0 to size - 1, drawn from the first 15 hex digits of md5(id:salt).

    uniform has 32 bits, which cannot reach every row of a larger table; this has 60.
    """
    digest = F.md5(F.concat(entity_id.cast("string"), F.lit(f":{salt}")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(max(size, 1)).cast("long"))


def uniform_between(entity_id: Column, salt: str, low: float, high: float) -> Column:
    return F.lit(low) + (F.lit(high) - F.lit(low)) * uniform(entity_id, salt)


def whole_between(entity_id: Column, salt: str, low: int, high: int) -> Column:
    """A whole number from low to high, both included."""
    return (F.lit(low) + F.floor(uniform(entity_id, salt) * F.lit(high - low + 1))).cast("int")


def pick(entity_id: Column, salt: str, choices: Column) -> Column:
    """One element of an array column, each equally likely."""
    position = F.floor(uniform(entity_id, salt) * F.size(choices)).cast("int")
    return F.get(choices, position)


def pick_of(entity_id: Column, salt: str, choices: list) -> Column:
    return pick(entity_id, salt, F.array(*[F.lit(c) for c in choices]))


def weighted(entity_id: Column, salt: str, weights: dict[str, float]) -> Column:
    """One name, drawn with the given weights, which sum to 1."""
    draw = uniform(entity_id, salt)
    names = list(weights)
    reached = 0.0
    chosen = None
    for name in names[:-1]:
        reached = round(reached + weights[name], 10)
        chosen = F.when(draw < reached, name) if chosen is None else chosen.when(draw < reached, name)
    return F.lit(names[-1]) if chosen is None else chosen.otherwise(names[-1])
