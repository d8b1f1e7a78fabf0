"""Names for the columns that an operator adds for itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of df has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def named(column: str) -> Column:
    """A column by its name as it stands, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def plain(df: DataFrame) -> DataFrame:
    """df with names that Spark's Python functions can refer to: those with dots or backticks are replaced, in their places."""
    return df.toDF(*[free_names(df, f"column{i}")[0] if set(".`") & set(c) else c for i, c in enumerate(df.columns)])
