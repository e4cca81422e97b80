"""Sinks: counts, console display, prediction output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlane.functions.numeric import format_fixed


def show(df: DataFrame, n: int = 20, truncate: bool = True) -> None:
    """Console table of the first ``n`` rows (a peek, not a collect)."""
    df.show(n, truncate=truncate)


def count_rows(df: DataFrame) -> int:
    """The row count as a number."""
    return df.count()


def with_display(df: DataFrame, col: str = "prediction", decimals: int = 3,
                 out_col: str | None = None) -> DataFrame:
    """Fixed-decimal display text next to the number."""
    return df.withColumn(out_col or f"{col}_display", format_fixed(F.col(col), decimals))


def write_predictions(df: DataFrame, path: str, fmt: str = "parquet",
                      partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Write the prediction frame (numbers as DOUBLE, display as text)."""
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
