"""Table access: Parquet folders by name, with a check of the columns a caller relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class SchemaMismatch(ValueError):
    """A table lacks columns that its contract promises."""


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Read `folder/name.parquet`; with columns given, check that they exist and read only those."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if columns:
        if missing := [c for c in columns if c not in df.columns]:
            raise SchemaMismatch(f"{name} lacks {', '.join(missing)}")
        df = df.select(*columns)
    return df
