"""Deterministic message payloads and their verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weight of (iteration + 1) and of the sender in the whole-number forms.
POSITIONAL = (100000, 100)
SMALL = (8, 4)
TINY = (1.3, 1)
# Weights of (iteration + 1), sender and position in the floating form.
FLOATING = (1.00000001, 1.001001, 1.000001)


def payload_value(iteration: Column, sender: Column, position: Column, mode: str = "positional") -> Column:
    """The element a sender writes; ``mode`` is positional, small, tiny or floating."""
    step = iteration + 1
    if mode == "floating":
        a, b, c = FLOATING
        return step * F.lit(a) + sender * F.lit(b) + position * F.lit(c)
    if mode == "tiny":
        return F.floor(step * F.lit(TINY[0]) + sender * TINY[1] + position)
    try:
        a, b = {"positional": POSITIONAL, "small": SMALL}[mode]
    except KeyError:
        raise ValueError(f"unknown payload mode {mode}") from None
    return step * a + sender * b + position


def mismatches(received: DataFrame, value: Column, expected: Column) -> DataFrame:
    """Number of elements and of elements that differ from what was sent."""
    wrong = F.count_if(~value.eqNullSafe(expected))
    return received.agg(F.count(F.lit(1)).alias("n_elements"), wrong.alias("n_wrong"))
