"""Names for columns that an operator adds for a while."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free(wish: str, *frames: DataFrame) -> str:
    """wish, with underscores before it until none of the frames has such a column (as Spark compares names: whatever the case)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish
