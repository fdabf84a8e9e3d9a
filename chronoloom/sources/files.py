"""File sources and sinks: strict CSV, Parquet tables with a schema contract, reconciliation and fingerprints."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class PackageError(ValueError):
    """A delivery that doesn't hold what its manifest says."""


def field(name: str, kind: T.DataType, field_id: str, nullable: bool = True) -> T.StructField:
    """A column with the id by which its contract names it."""
    return T.StructField(name, kind, nullable, {"field_id": field_id})


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header that must equal the schema's names, UTF-8, quoted line breaks, empty fields as null; bad rows fail."""
    options = {"header": True, "enforceSchema": False, "mode": "FAILFAST", "nullValue": "", "emptyValue": "", "multiLine": True, "encoding": "UTF-8", "quote": '"', "escape": '"'}
    return spark.read.schema(schema).options(**options).csv(path)


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """A canonical CSV: one file in a fixed order, for fixtures of bounded size."""
    df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def checked(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df, if its names and types are those of the schema."""
    got, want = [(f.name, f.dataType) for f in df.schema], [(f.name, f.dataType) for f in schema]
    if got != want:
        raise PackageError(f"columns differ: {sorted(set(map(str, got)) ^ set(map(str, want)))}")
    return df


def load(df: DataFrame, path: str, expected_rows: int | None = None, partition_by: tuple[str, ...] = ()) -> int:
    """Write a table as Parquet, partitioned for pruning, and compare what was written with what was announced."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    rows = df.sparkSession.read.parquet(path).count()
    if expected_rows is not None and rows != expected_rows:
        raise PackageError(f"{path} holds {rows} rows instead of {expected_rows}")
    return rows


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, content): a digest of the multiset of rows that partial aggregation computes at any size, without a sort."""
    h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(df.columns)])
    return df.agg(F.count("*").alias("rows"), F.hex(F.bit_xor(h)).alias("xor"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("sum")).select("rows", F.concat_ws("-", "xor", "sum").alias("content"))


def preflight(folder: str) -> dict[str, dict]:
    """Check a delivery against its manifest.json: {"files": {name: {"sha256": ..., "rows": ...}}}."""
    manifest = json.loads(Path(folder, "manifest.json").read_text())["files"]
    for name, said in manifest.items():
        p = Path(folder, name)
        if not p.exists():
            raise PackageError(f"{name} is missing")
        digest = hashlib.sha256()
        with p.open("rb") as f:
            while block := f.read(1 << 20):
                digest.update(block)
        if digest.hexdigest() != said["sha256"]:
            raise PackageError(f"{name} has another content than announced")
    return manifest


def inventory(frames: dict[str, DataFrame]) -> list[tuple[str, str, str, bool, str | None]]:
    """(table, column, type, nullable, field id) of all tables, for contracts and lineage."""
    return [(n, f.name, f.dataType.simpleString(), f.nullable, f.metadata.get("field_id")) for n, df in sorted(frames.items()) for f in df.schema]
