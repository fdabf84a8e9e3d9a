"""Resolving codes, definitions and current rows of reference tables.

A code links to an entity only where exactly one entity claims it; no flag ever picks a winner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def candidates(reference: DataFrame, identity: str, methods: dict[str, str]) -> DataFrame:
    """(method, code, id): the distinct claims, by method; a union of equi-joinable aliases instead of an OR."""
    claims = F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("code")) for m, c in methods.items()])
    return reference.select(F.col(identity).alias("id"), F.explode(claims).alias("c")).select("c.method", "c.code", "id").where("code is not null and id is not null").distinct()


def outcomes(claims: DataFrame) -> DataFrame:
    """(method, code, n, id, ids): id only where one entity claims the code; ids lists all, sorted."""
    g = claims.groupBy("method", "code").agg(F.countDistinct("id").alias("n"), F.min("id").alias("one"), F.array_join(F.sort_array(F.collect_set("id")), ",").alias("ids"))
    return g.select("method", "code", "n", F.when(F.col("n") == 1, F.col("one")).alias("id"), "ids")


def resolve(rows: DataFrame, column: str, result: DataFrame, method: str, out: str) -> DataFrame:
    """rows with out and out_status: EXACT, AMBIGUOUS, UNRESOLVED or INVALID_INPUT. result: one row a code, of a reference table."""
    r = F.broadcast(result.where(F.col("method") == method).select(F.col("code").alias(column), F.col("id").alias(out), F.col("n").alias("_n")))
    status = F.when(F.col(column).isNull() | (F.trim(column) == ""), "INVALID_INPUT").when(F.col("_n").isNull(), "UNRESOLVED").when(F.col("_n") == 1, "EXACT").otherwise("AMBIGUOUS")
    return rows.join(r, column, "left").withColumn(f"{out}_status", status).drop("_n")


def definition(rows: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """(key, definitions, attributes...): attributes only where the key has exactly one definition."""
    g = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(F.struct(*[F.coalesce(F.col(a).cast("string"), F.lit("\0")) for a in attributes])).alias("definitions"), *[F.min(a).alias(a) for a in attributes])
    return g.select(key, "definitions", *[F.when(F.col("definitions") == 1, F.col(a)).alias(a) for a in attributes])


def first_row(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def violations(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that several rows share; a gate, empty where the key is unique."""
    return rows.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")
