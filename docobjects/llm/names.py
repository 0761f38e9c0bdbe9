"""Column names that clash with no column of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def private(df: DataFrame, name: str) -> str:
    """A name made from `name` that no column of df has, in whatever case."""
    taken, name = {c.lower() for c in df.columns}, f"_{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> str:
    """A column name as one identifier, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of df by their names."""
    return [F.col(quoted(c)) for c in df.columns]
