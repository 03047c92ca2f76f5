"""Prefix sums over ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rankflow.plans import running_sum
from rankflow.plans.ordered import GROUP_ROWS


def scan(
    df: DataFrame,
    rank: str,
    values: dict[str, str],
    comm: list[str] | None = None,
    inclusive: bool = True,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Sum over this rank and all lower ones (``inclusive``) or only the lower ones.

    Pass ``comm=[..., "idx"]`` for an element-wise scan of arrays.
    """
    return running_sum(df, comm or [], [rank], values, inclusive, group_rows)


def scan_inclusive(df: DataFrame, rank: str, values: dict[str, str], comm: list[str] | None = None) -> DataFrame:
    return scan(df, rank, values, comm, inclusive=True)


def scan_exclusive(df: DataFrame, rank: str, values: dict[str, str], comm: list[str] | None = None) -> DataFrame:
    return scan(df, rank, values, comm, inclusive=False)
