"""Reading the columns an operator needs, whatever else a table carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def needed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, as ``name=type``; extra columns, whatever their names, are left out.

    A column that the table lacks is null. Rows are kept as they are, repeated ones too.
    """
    have = set(df.columns)
    return df.select(*[(F.col(f"`{name}`") if name in have else F.lit(None)).cast(kind).alias(name) for name, kind in columns.items()])


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times in ``body`` (a lambda), inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)
