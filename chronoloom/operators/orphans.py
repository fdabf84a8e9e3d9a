"""References to records that do not exist, kept as incremental keyed state.

The state of a key is whether its parent exists and the references to it, each *waiting* or *resolved*. An increment
brings references, which probe the parent index, parents that arrive and resolve what waits for them, and parents that
are deleted, which reopens it. Three ways run the same rules:

- `replay` runs any number of numbered increments at once: the arrivals and deletions of a key are its timeline, one
  entry an increment at most, and each reference follows it from its own increment on. Only keys meet, in one
  equi-join whose hot keys AQE splits; nothing is rewritten from one increment to the next.
- `advance` applies one increment to stored state.
- `streaming.pending` keeps the state of each key in the state store of a stream, which touches the increment's keys.

Counts per table and period are taken of what waits after each increment.

Defined results: a reference without a key or without a referring id is none; repeated rows count once; a parent that
arrives and is deleted in one increment counts as existing (deletions apply first); a reference whose parent arrives
in its own increment never waits; a null period is 'unknown'; empty increments leave the state as it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.session import cut

REFERENCE = "source_table string, ref_id long, key long, period string"


@dataclass(frozen=True)
class OrphanState:
    """parents: (key); waiting and resolved: references as in REFERENCE."""

    parents: DataFrame
    waiting: DataFrame
    resolved: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> OrphanState:
        return OrphanState(spark.createDataFrame([], "key long"), spark.createDataFrame([], REFERENCE), spark.createDataFrame([], REFERENCE))

    def kept(self) -> OrphanState:
        """The state cut from its lineage, as it has to be between the increments of a long run."""
        return OrphanState(cut(self.parents), cut(self.waiting), cut(self.resolved))


def references(df: DataFrame, source_table: str, ref_id: str | Column, key: str | Column, day: str | Column) -> DataFrame:
    """Rows of a table as references; day gives the period, its month."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(F.lit(source_table).alias("source_table"), col(ref_id).cast("long").alias("ref_id"), col(key).cast("long").alias("key"), F.coalesce(F.date_format(col(day), "yyyy-MM"), F.lit("unknown")).alias("period")).where("ref_id is not null and key is not null")


def advance(state: OrphanState, refs: DataFrame | None = None, arrived: DataFrame | None = None, deleted: DataFrame | None = None) -> OrphanState:
    """Apply one increment. refs: as in REFERENCE; arrived, deleted: (key). None: nothing of that kind."""
    parents, waiting, resolved = state.parents, state.waiting, state.resolved
    if deleted is not None:
        gone = deleted.select("key").where("key is not null").distinct()
        gone = gone.join(arrived.select("key"), "key", "left_anti") if arrived is not None else gone
        parents = parents.join(gone, "key", "left_anti")
        reopened = resolved.join(gone, "key", "left_semi")
        resolved = resolved.join(gone, "key", "left_anti")
        waiting = waiting.unionByName(reopened)
    if arrived is not None:
        new = arrived.select("key").where("key is not null")
        freed = waiting.join(new, "key", "left_semi")
        waiting = waiting.join(new, "key", "left_anti")
        resolved = resolved.unionByName(freed)
        parents = parents.unionByName(new).distinct()
    if refs is not None:
        refs = refs.select("source_table", "ref_id", "key", "period")
        waiting = waiting.unionByName(refs.join(parents, "key", "left_anti")).distinct()
        resolved = resolved.unionByName(refs.join(parents, "key", "left_semi")).distinct()
    return OrphanState(parents, waiting, resolved)


def replay(refs: DataFrame, arrived: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """(source_table, ref_id, key, period, from_at, to_at): the increments at whose ends a reference waits, from_at until before to_at, null if to the end.

    refs: as in REFERENCE with at, the number of the increment; arrived, deleted: (key, at). A reference that waits
    again after a deletion has several rows.
    """
    refs, columns = refs.where("key is not null and ref_id is not null").withColumnRenamed("key", "k"), ["source_table", "ref_id", F.col("k").alias("key"), "period"]
    if deleted is None:  # the parent is there from its first arrival on
        since = arrived.where("key is not null").groupBy("key").agg(F.min("at").alias("since"))
        waits = refs.join(since, refs.k == since.key, "left").where("since is null or since > at")
        return waits.select(*columns, F.col("at").alias("from_at"), F.col("since").alias("to_at")).distinct()
    changes = arrived.select("key", "at", F.lit(True).alias("there")).unionByName(deleted.select("key", "at", F.lit(False).alias("there"))).where("key is not null")
    # At most one entry for each increment, whatever the number of rows.
    lines = changes.groupBy("key", "at").agg(F.max("there").alias("there")).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "there"))).alias("line"))
    x = refs.join(lines, refs.k == lines.key, "left").withColumn("line", F.coalesce("line", F.array().cast("array<struct<at:int,there:boolean>>"))).withColumn("now", F.try_element_at(F.filter("line", lambda c: c["at"] <= F.col("at")), F.lit(-1))["there"])
    own = F.array(F.struct(F.col("at"), F.coalesce("now", F.lit(False)).alias("there")))
    x = x.withColumn("line", F.concat(own, F.filter("line", lambda c: c["at"] > F.col("at"))))
    begins = lambda c, i: ~c["there"] & ((i == 0) | F.coalesce(F.get("line", i - 1)["there"], F.lit(False)))
    starts = F.filter(F.transform("line", lambda c, i: F.when(begins(c, i), F.struct(c["at"].alias("from_at"), F.array_min(F.transform(F.filter("line", lambda d: d["there"] & (d["at"] > c["at"])), lambda d: d["at"])).alias("to_at")))), lambda s: s.isNotNull())
    return x.select(*columns, F.explode(starts).alias("s")).select("source_table", "ref_id", "key", "period", "s.from_at", "s.to_at").distinct()


def waiting_at_end(spans: DataFrame) -> DataFrame:
    """The references that wait after the last increment, from `replay`."""
    return spans.where("to_at is null").select("source_table", "ref_id", "key", "period")


def counts_by_increment(spans: DataFrame, increments: DataFrame) -> DataFrame:
    """(at, source_table, period, orphans, missing_keys): what waits at the end of each increment. increments: (at), one row each, a calendar's worth."""
    live = spans.join(F.broadcast(increments.select(F.col("at").alias("end"))), (F.col("from_at") <= F.col("end")) & (F.col("to_at").isNull() | (F.col("end") < F.col("to_at"))))
    # Keys first, so that a key with any number of references is one row when distinct keys are counted.
    per_key = live.groupBy("end", "source_table", "period", "key").agg(F.count("*").alias("n"))
    return per_key.groupBy(F.col("end").alias("at"), "source_table", "period").agg(F.sum("n").alias("orphans"), F.count("*").alias("missing_keys"))


def snapshot_counts(state: OrphanState) -> DataFrame:
    """(source_table, period, orphans, missing_keys) of the references that wait now."""
    return state.waiting.groupBy("source_table", "period").agg(F.count("*").alias("orphans"), F.countDistinct("key").alias("missing_keys"))


def whole_number(token: str | Column) -> Column:
    """A token read as a whole number, however written: blanks, quotes, sign, thousands separators, zeros after the point, exponent. Null if it is none or exceeds a bigint."""
    plain = (F.col(token) if isinstance(token, str) else token).try_cast("long")  # most are; the rest is read with more care
    t = F.col(token) if isinstance(token, str) else token
    t = F.regexp_replace(t, r"[\s   ﻿\"'`“”‘’]", "")
    t = F.translate(t, "".join(chr(0xFF10 + i) for i in range(10)), "0123456789")
    t = F.when(t.rlike(r"^[+-]?\d{1,3}([,_]\d{3})+(\.\d*)?$"), F.regexp_replace(t, "[,_]", "")).when(t.rlike(r"^[+-]?\d{1,3}(\.\d{3}){2,}$"), F.regexp_replace(t, r"\.", "")).otherwise(t)
    exact = F.when(t.rlike(r"^[+-]?\d+(\.0*)?$"), F.regexp_replace(t, r"\.0*$", "").try_cast("decimal(38,0)"))
    spread = F.when(t.rlike(r"^[+-]?\d+(\.\d+)?[eE]\+?\d{1,2}$"), t.try_cast("decimal(38,9)"))
    return F.coalesce(plain, F.coalesce(exact, F.when(spread == F.round(spread, 0), spread)).try_cast("long"))
