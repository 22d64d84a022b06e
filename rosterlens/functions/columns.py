"""Naming helpers for columns whose names contain dots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def session_column(df: DataFrame, prefix: str = "") -> str:
    """The one column that starts with `prefix` and ends in `sessionid`, in any case.

    Survey feeds put the name of the product before `SessionId`; the ending is what is fixed.
    """
    found = [
        c for c in df.columns
        if c.lower().startswith(prefix.lower()) and c.lower().endswith("sessionid")
    ]
    if len(found) != 1:
        raise ValueError(f"expected one session id column under {prefix!r}, found {found}")
    return found[0]
