"""Attributes as known at event time: the version of an entity valid and already recorded at each event.

Events and versions are co-grouped by a hash bucket of the entity. In a bucket, the versions of every
(entity, dimension) become a timeline: the points at which the winning version changes. A version counts from the
later of its begin and its publication to its end; where several count, the latest publication wins, then the highest
sequence, then the highest id. One binary search over all timelines of the bucket serves all its events at once.

An entity with more than `hot_rows` events and versions is cut into time slices of about that many, and slices with
more events are salted. Versions that cover a slice wholly are reduced to the winner before the shuffle, so a slice
receives that one and those that begin or end within it, and never the entity's whole history. Of versions with the
same period, dimension and publication only the winner is kept at all. What is known of hot entities (their slices and
salts) is broadcast only if it is small by its counted rows, else joined by entity.

Defined results: events without entity or day, and versions without entity, begin or publication, never match; an end
that is null or in year 9999 is open; a null sequence or id ranks lowest; repeated events come out once; events
without a version give no row; empty tables give an empty result; further columns of either side, whatever their
names, stay out unless named in `payload`.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.session import BROADCAST_ROWS, blocks, cut, small, stored

#: Days since 1970-01-01 of 9999-01-01; an end from there on is open.
OPEN_DAY = 2932532
FOREVER = 2**31 - 1


def timeline(start: np.ndarray, end: np.ndarray, rank: np.ndarray) -> tuple[list[int], list[int]]:
    """Points in time and, from each on, the index of the version with the highest rank, -1 for none."""
    order = np.argsort(start, kind="stable").tolist()
    s, e, r = start.tolist(), end.tolist(), rank.tolist()
    heap: list[tuple[int, int]] = []
    times, wins, k = [], [], 0
    for at in sorted({*s, *e}):
        while k < len(order) and s[order[k]] <= at:
            i = order[k]
            heapq.heappush(heap, (-r[i], i))
            k += 1
        while heap and e[heap[0][1]] <= at:
            heapq.heappop(heap)
        win = heap[0][1] if heap else -1
        if not wins or wins[-1] != win:
            times.append(at)
            wins.append(win)
    return times, wins


def _match(e: pa.Table, v: pa.Table, schema: pa.Schema) -> pa.Table:
    """Events and versions of some whole entities (or slices of them) matched dimension by dimension."""
    if not e.num_rows or not v.num_rows:
        return schema.empty_table()
    out = []
    dims = v["dim"].combine_chunks().dictionary_encode()
    names, dim = dims.dictionary, dims.indices.to_numpy()
    ent, start, end = (v[c].to_numpy() for c in ("entity", "start", "end"))
    rank = np.empty(len(ent), np.int64)
    rank[np.lexsort([v["id"].to_numpy(), v["seq"].to_numpy(), v["published"].to_numpy()])] = np.arange(len(ent))
    entities, code = np.unique(ent, return_inverse=True)
    group = code * len(names) + dim
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.diff(group[order])) + 1
    keys, wins = [], []
    for rows in np.split(order, cuts):
        times, win = timeline(start[rows], end[rows], rank[rows])
        keys.append((int(group[rows[0]]) << 32) + np.array(times, np.int64) + 2**31)
        wins.append(np.where(np.array(win) < 0, -1, rows[win]))
    keys, wins = np.concatenate(keys), np.concatenate(wins)
    ee, day = e["entity"].to_numpy(), e["day"].to_numpy().astype(np.int64)
    at = np.minimum(np.searchsorted(entities, ee), len(entities) - 1)
    known = np.flatnonzero(entities[at] == ee)
    for d in range(len(names)):
        g = at[known] * len(names) + d
        pos = np.searchsorted(keys, (g << 32) + day[known] + 2**31, "right") - 1
        hit = (pos >= 0) & (keys[pos] >> 32 == g) & (wins[pos] >= 0)
        left, right = e.take(pa.array(known[hit])), v.take(pa.array(wins[pos[hit]]))
        out.append(pa.table([(left if f.name == "e_id" else right)[f.name].cast(f.type) for f in schema], schema=schema))
    return pa.concat_tables(out)


#: Slices of one entity at most; slices of more events are salted.
SLICES = 256


def _slices(ev: DataFrame, ver: DataFrame, hot: DataFrame, hot_rows: int) -> DataFrame:
    """(entity, bounds): the days at which the slices of a hot entity begin, from quantiles of the days of its events and versions."""
    n = F.least(F.ceil(F.col("n") / hot_rows), F.lit(SLICES)).cast("int")
    days = ev.select("entity", "day").unionByName(ver.select("entity", F.col("start").alias("day")))
    q = days.join(hot.select("entity"), "entity", "left_semi").groupBy("entity").agg(F.percentile_approx("day", [i / SLICES for i in range(1, SLICES)], 10_000).alias("q"))
    picks = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.element_at("q", (i * SLICES / n).cast("int")))
    return q.join(hot, "entity").select("entity", F.when(n > 1, F.array_sort(F.array_distinct(picks))).otherwise(F.array().cast("array<int>")).alias("bounds"))


def as_of_join(
    events: DataFrame, versions: DataFrame, *, event_id: str, entity: str, event_day: str, version_entity: str, dimension: str, valid_from: str, valid_to: str, published: str,
    sequence: str, version_id: str, payload: tuple[str, ...] = (), hot_rows: int = 500_000, bucket_rows: int = 200_000,
) -> DataFrame:
    """(event_id, dimension, version_id, payload...) of the version in force and known at each event; see the module."""
    spark = events.sparkSession
    days = lambda c: F.unix_date(F.col(c).cast("date"))
    ev = events.select(F.col(event_id).cast("long").alias("e_id"), F.col(entity).cast("long").alias("entity"), days(event_day).alias("day")).where("e_id is not null and entity is not null and day is not null")
    end = F.when(F.col(valid_to).isNull() | (days(valid_to) >= OPEN_DAY), F.lit(FOREVER)).otherwise(days(valid_to))
    low = F.lit(-(2**63 - 1)).cast("long")
    ver = versions.select(
        F.col(version_entity).cast("long").alias("entity"), F.col(dimension).alias("dim"), F.greatest(days(valid_from), days(published)).alias("start"), end.alias("end"), days(published).alias("published"),
        F.coalesce(F.col(sequence).cast("long"), low).alias("seq"), F.coalesce(F.col(version_id).cast("long"), low).alias("id"), days(valid_from).alias("begins"), *[F.col(c).alias(f"p_{c}") for c in payload],
    ).where("entity is not null and dim is not null and begins is not null and published is not null and start < end").drop("begins")
    n = blocks(spark, events.count(), bucket_rows)
    bucket = F.pmod(F.xxhash64("entity"), F.lit(n)).cast("int")
    cols = [c for c in ver.columns if c not in ("entity", "dim", "start", "end", "published")]
    # Repeated versions, and those that another of the same times always beats, go before the shuffle.
    ver = ver.groupBy("entity", "dim", "start", "end", "published").agg(F.max(F.struct("seq", "id", *[c for c in cols if c not in ("seq", "id")])).alias("w")).select("entity", "dim", "start", "end", "published", "w.*")
    rows = ev.groupBy("entity").agg(F.count("*").alias("n")).unionByName(ver.groupBy("entity").agg(F.count("*").alias("n")))
    hot = cut(rows.groupBy("entity").agg(F.sum("n").alias("n")).where(F.col("n") > hot_rows))
    plain = F.lit(0).alias("slice"), F.lit(0).alias("salt")
    n_hot = hot.count()
    if not n_hot:
        left, right = ev.select("*", bucket.alias("bucket"), *plain), ver.select("*", bucket.alias("bucket"), *plain)
    else:
        # A row of bounds is up to SLICES days, so fewer of them are small.
        bounds = stored(_slices(ev, ver, hot, hot_rows))
        with_bounds = lambda df: df.join(small(bounds, n_hot, BROADCAST_ROWS // SLICES), "entity")
        cold_e, cold_v = (x.join(small(hot.select("entity"), n_hot), "entity", "left_anti").select("*", bucket.alias("bucket"), *plain) for x in (ev, ver))
        at = lambda day: F.size(F.filter("bounds", lambda b: b <= day))
        he = with_bounds(ev).withColumn("slice", at(F.col("day"))).drop("bounds")
        salts = cut(he.groupBy("entity", "slice").agg(F.ceil(F.count("*") / hot_rows).cast("int").alias("salts")))
        n_salts = salts.count()
        hot_e = he.join(small(salts, n_salts), ["entity", "slice"]).select("*", bucket.alias("bucket"), F.pmod(F.xxhash64("e_id", "day"), F.col("salts")).cast("int").alias("salt")).drop("salts")
        hv = with_bounds(ver).withColumn("lo", at(F.col("start"))).withColumn("hi", at(F.col("end") - 1)).drop("bounds")
        edges = hv.withColumn("slice", F.explode(F.array_distinct(F.array("lo", "hi"))))
        cols = [c for c in ver.columns if c not in ("entity", "dim")]
        inner = hv.where("hi - lo > 1").withColumn("slice", F.explode(F.sequence(F.col("lo") + 1, F.col("hi") - 1))).groupBy("entity", "dim", "slice").agg(F.max(F.struct("published", "seq", "id", *[c for c in cols if c not in ("published", "seq", "id")])).alias("w")).select("entity", "dim", "slice", "w.*")
        hot_v = edges.drop("lo", "hi").unionByName(inner).join(small(salts, n_salts), ["entity", "slice"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts").select("*", bucket.alias("bucket"))
        left, right = cold_e.unionByName(hot_e), cold_v.unionByName(hot_v)
    out = {f.name: f for f in right.schema}
    spark_schema = "e_id long, dim string, id long" + "".join(f", p_{c} {out[f'p_{c}'].dataType.simpleString()}" for c in payload)
    kinds = {"e_id": pa.int64(), "dim": pa.string(), "id": pa.int64()}
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([*kinds.items(), *[(f"p_{c}", to_arrow_type(out[f"p_{c}"].dataType)) for c in payload]])
    keys = ["bucket", "slice", "salt"]
    matched = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: _match(a, b, schema), spark_schema)
    return matched.select(F.col("e_id").alias(event_id), F.col("dim").alias(dimension), F.col("id").alias(version_id), *[F.col(f"p_{c}").alias(c) for c in payload]).distinct()
