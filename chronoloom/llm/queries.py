"""Queries of the language-model data problems 3, 8, 9 and 10 over their whole tables, and the SQL that checks what SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import containers, linkage, mixture, severity
from chronoloom.llm.tokens import token_counts
from chronoloom.session import cut
from chronoloom.sources.tables import table

_AIRLINES = ("airline_id", "carrier_code_iata", "carrier_code_icao")


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    """Flown legs with their plan rows, the number of the leg in the service, and the confidence."""
    return linkage.link_flights(table(spark, d, "aircraft_flight"), table(spark, d, "passenger_historical"), table(spark, d, "airline_reference", *_AIRLINES), table(spark, d, "airport_reference", "airport_id", "airport_code_iata"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_links(spark, d).select("flight_id", "historical_source_row_id").distinct()


def _sizes(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    return token_counts(table(spark, d, "documents", "doc_id", "text", *keep), "doc_id", "text", *keep)


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of all documents in their containers, for each container size."""
    return containers.fill_containers(_sizes(spark, d), table(spark, d, "container_sizes"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers used and fill rate of each size, the least number that can be proven, and what best fit would need."""
    sizes, items = table(spark, d, "container_sizes"), cut(_sizes(spark, d))
    return containers.fill_rates(containers.fill_containers(items, sizes), sizes, containers.bounds(items, sizes))


def p9_selection(spark: SparkSession, d: str) -> DataFrame:
    """The blocks drawn for each mix, with the pieces of documents in them."""
    return mixture.mix_sources(_sizes(spark, d, "source"), table(spark, d, "mixture_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached shares of each source in each mix."""
    return mixture.mix_sources(_sizes(spark, d, "source"), table(spark, d, "mixture_targets"))[1]


def _severity(spark: SparkSession, d: str) -> DataFrame:
    return severity.score_documents(table(spark, d, "documents", "doc_id", "text", "source"), "doc_id", "text", "source")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _severity(spark, d).where(F.col("severity") >= severity.THRESHOLD).select("doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """Expected severity of every document."""
    return _severity(spark, d)


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents, reported documents, rate and mean severity of each source."""
    hit = F.sum((F.col("severity") >= severity.THRESHOLD).cast("long"))
    return _severity(spark, d).groupBy("source").agg(F.count("*").alias("documents"), hit.alias("reported"), F.round(hit / F.count("*"), 6).alias("rate"), F.round(F.avg("severity"), 4).alias("mean_severity"))


QUERIES = {f.__name__: f for f in (p3_found, p3_links, p8_containers, p8_fill, p9_selection, p9_shares, p10_found, p10_scores, p10_rates)}
SQL: dict[str, str] = {}
