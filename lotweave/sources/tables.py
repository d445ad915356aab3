"""Reading the registered tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of a folder of Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def nan_to_null(c: Column | str) -> Column:
    """A double with NaN as null, so that both mean a missing value."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def select_available(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that df has; decided while planning, at no cost."""
    return df.select(*[c for c in columns if c in df.columns])
