"""Names for frames, so that SQL can use them: views of this session, and tables that stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .files import table_name


def view(df: DataFrame, name: str) -> str:
    """Register the frame as a view of this session, in place of one of that name; the valid name it got."""
    own = table_name(name)
    df.createOrReplaceTempView(own)
    return own


def table(df: DataFrame, name: str) -> str:
    """Write the frame as a table of the warehouse, in place of one of that name; the valid name it got."""
    own = table_name(name)
    df.write.mode("overwrite").saveAsTable(own)
    return own


def views(spark: SparkSession, frames: dict[str, DataFrame]) -> dict[str, str]:
    """All frames as views; the name that each got."""
    return {n: view(df, n) for n, df in frames.items()}
