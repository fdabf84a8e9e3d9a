"""Filling containers of fixed capacity with items of varying length, with little unused space.

Only the histogram of lengths matters: at most one row per length up to the capacity, whatever the number of items.
For each capacity, one task solves the configuration linear program over it by multiplicative weights. Prices begin at
the lengths, and a length gets dearer, by an exponential of its share that is still uncovered against the mean of all,
as it falls behind. In each round a knapsack dynamic program over the capacity finds the container of the highest
price among the dearest lengths for their size, with at most about twice the fair share of each, and that container is used for
at most 1/ROUNDS of all containers, in whole numbers and as far as its lengths last: so the fractional solution is
rounded down as it grows, and goes on until all is covered. Nothing is left to a plainer rule. As every round but
these full steps uses up a length, there are at most ROUNDS plus as many rounds as lengths, at any number of items.
Unless the plan reaches the least number of containers that can be proven, up to GAP, passes from better prices follow:
lengths that stood in badly filled containers begin dearer; the best of at most PASSES plans is taken. `bounds` gives the least number of containers that the program's dual proves, and what best fit would need. Items are
then numbered within their length in a distributed way and take the slots of the plan by their number.

An item longer than the capacity is cut into full containers and one remainder, which is packed like any item; no
other item is split. Defined results: items of no tokens (null and empty texts) take no room and belong to container
-1; ids must be unique; ties are broken by id; an empty table or a capacity that is null or below 1 gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.ranks import running
from chronoloom.session import blocks, cut

#: One round of multiplicative weights uses a container for at most this part of all; and how fast prices follow what is uncovered.
ROUNDS, STEP = 400, 0.1
#: Lengths that a knapsack chooses from, and how many of them are the shortest. All lengths have their turn, as prices rise.
PRICED, FILLERS = 320, 64
#: Passes that are made at most, how fast prices follow unused space from one to the next, and the gap to the bound that ends them.
PASSES, RAISE, GAP = 8, 3.0, 0.0002
PLAN = "size_name string, length long, first long, slots long, per_container long, container long, containers long"


def best_pattern(lengths: np.ndarray, prices: np.ndarray, most: np.ndarray, capacity: int) -> dict[int, int]:
    """Lengths of the container with the highest price, by dynamic programming over the room used; at most `most` of each."""
    goods = []  # (index, copies): binary splitting of the copies
    for i, k in enumerate(np.minimum(most, capacity // lengths).tolist()):
        step = 1
        while k > 0:
            goods.append((i, min(step, k)))
            k -= step
            step *= 2
    value = np.zeros(capacity + 1)
    taken = np.zeros((len(goods), capacity + 1), bool)
    for g, (i, k) in enumerate(goods):
        w = int(lengths[i]) * k
        if w <= capacity:
            gain = value[:-w] + prices[i] * k
            better = gain > value[w:]
            taken[g, w:] = better
            value[w:] = np.where(better, gain, value[w:])
    out: dict[int, int] = {}
    room = capacity
    for g in range(len(goods) - 1, -1, -1):
        if taken[g, room]:
            i, k = goods[g]
            out[i] = out.get(i, 0) + k
            room -= int(lengths[i]) * k
    return out


def _pass(lengths: np.ndarray, counts: np.ndarray, capacity: int, base: np.ndarray, rounds: int) -> dict[tuple, int]:
    """Containers, as {((index, how many), ...): how often}, of one pass of multiplicative weights from given prices."""
    left, demand = counts.astype(np.int64), counts.astype(float)
    total = float((lengths * demand).sum()) / capacity
    most_often = max(1, -(-int(total) // rounds))
    plan: dict[tuple, int] = {}
    while len(live := np.flatnonzero(left)):
        togo = float((lengths * left).sum()) / capacity
        behind = left[live] / demand[live] * total / togo - 1  # 0: covered like the mean
        prices = base[live] * np.exp(np.clip(STEP * behind, -10, 10))
        if len(live) > PRICED:
            # The lengths that are dearest for their size, and the shortest, with which any rest is filled.
            rank = np.argsort(-prices / lengths[live], kind="stable")
            some = np.unique(np.concatenate([rank[: PRICED - FILLERS], np.arange(FILLERS)]))
            live, prices = live[some], prices[some]
        # A container takes at most about twice its fair share of a length, so that containers stay alike.
        fair = np.ceil(2 * left[live] / togo).astype(np.int64) + 1
        content = best_pattern(lengths[live], prices, np.minimum(left[live], fair), capacity)
        often = min(most_often, *(int(left[live[i]] // k) for i, k in content.items()))
        key = tuple(sorted((int(live[i]), k) for i, k in content.items()))
        plan[key] = plan.get(key, 0) + often
        for i, k in key:
            left[i] -= often * k
    return plan


def plan_containers(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[int, dict[int, int]]]:
    """(how often, {index of a length: how many}) for every kind of container; together they hold all items."""
    base, enough = lengths.astype(float), lower_bound(lengths, counts, capacity) * (1 + GAP)
    best: dict[tuple, int] = {}
    for _ in range(PASSES):
        plan = _pass(lengths, counts, capacity, base, rounds)
        if not best or sum(plan.values()) < sum(best.values()):
            best = plan
        if sum(best.values()) <= enough:
            break
        # What stands in containers with much unused space is worth more than its length.
        waste = np.zeros(len(lengths))
        for key, often in plan.items():
            free = 1 - sum(int(lengths[i]) * k for i, k in key) / capacity
            for i, k in key:
                waste[i] += often * k * free
        base = base * np.exp(RAISE * waste / counts)
    return [(often, dict(key)) for key, often in best.items()]


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """The least number of containers by the program's dual at two prices: the lengths, and 1 for what is longer than half."""
    if not len(lengths):
        return 0
    fullest = sum(int(lengths[i]) * k for i, k in best_pattern(lengths, lengths.astype(float), counts, capacity).items())
    return max(-(-int((lengths * counts).sum()) // fullest), int(counts[2 * lengths > capacity].sum()))


def best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best fit of the longest first over a histogram, for comparison; bins of the same content are kept as one entry."""
    rooms: dict[int, list[list]] = {}  # free room: entries [how often, content]
    present = np.zeros(capacity + 1, bool)
    for i in range(len(lengths) - 1, -1, -1):
        size, todo = int(lengths[i]), int(left[i])
        while todo > 0:
            fits = np.flatnonzero(present[size:])
            if len(fits):
                room = size + int(fits[0])
                often, content = rooms[room].pop()
                if not rooms[room]:
                    present[room] = False
                each = max(1, min(room // size, todo // often)) if todo >= often else 1
                use = often if todo >= often else todo
                if use < often:
                    rooms.setdefault(room, []).append([often - use, content])
                    present[room] = True
            else:
                room, content, each = capacity, {}, min(capacity // size, todo)
                use = todo // each
            content = {**content, i: content.get(i, 0) + each}
            todo -= use * each
            free = room - each * size
            rooms.setdefault(free, []).append([use, content])
            present[free] = free > 0
    return [(often, content) for entries in rooms.values() for often, content in entries]


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    """The plan of one capacity as slot ranges: items first..first+slots-1 of a length fill containers from `container` on."""
    pdf = pdf.sort_values("length")
    lengths, counts, capacity = pdf["length"].to_numpy(np.int64), pdf["items"].to_numpy(np.int64), int(pdf["capacity"].iloc[0])
    used, base, rows = np.zeros(len(lengths), np.int64), 0, []
    for often, content in plan_containers(lengths, counts, capacity):
        for i, k in content.items():
            rows.append((int(lengths[i]), int(used[i]), often * k, k, base, often))
            used[i] += often * k
        base += often
    return pd.DataFrame(rows, columns=["length", "first", "slots", "per_container", "container", "containers"]).assign(size_name=pdf["size_name"].iloc[0])[[c.split()[0] for c in PLAN.split(", ")]]


def _parts(items: DataFrame, sizes: DataFrame) -> DataFrame:
    """(size_name, capacity, doc_id, length, first_token): what is to be packed, one row an item and size, long items' remainders."""
    caps = sizes.where("capacity_tokens >= 1 and size_name is not null").groupBy("size_name").agg(F.max("capacity_tokens").cast("long").alias("capacity"))  # a list of container kinds
    rest = F.col("tokens") % F.col("capacity")
    return items.where("tokens > 0").crossJoin(F.broadcast(caps)).where(rest > 0).select("size_name", "capacity", "doc_id", rest.alias("length"), (F.col("tokens") - rest).alias("first_token"))


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("length")
    lengths, counts, capacity = pdf["length"].to_numpy(np.int64), pdf["items"].to_numpy(np.int64), int(pdf["capacity"].iloc[0])
    return pd.DataFrame({"size_name": [pdf["size_name"].iloc[0]], "bound": [lower_bound(lengths, counts, capacity)], "best_fit": [sum(often for often, _ in best_fit(lengths, counts, capacity))]})


def bounds(items: DataFrame, sizes: DataFrame) -> DataFrame:
    """(size_name, bound, best_fit): containers that what is packed needs at least, and would need by best fit."""
    return _parts(items, sizes).groupBy("size_name", "capacity", "length").agg(F.count("*").alias("items")).groupBy("size_name").applyInPandas(_compare, "size_name string, bound long, best_fit long")


def fill_containers(items: DataFrame, sizes: DataFrame, item_rows: int = 500_000) -> DataFrame:
    """(size_name, container, doc_id, first_token, tokens): every piece of every item in a container of every size.

    items: (doc_id, tokens); sizes: (size_name, capacity_tokens), one row per size.
    """
    spark = items.sparkSession
    items = cut(items.select("doc_id", "tokens"))
    n = items.count()
    caps = sizes.where("capacity_tokens >= 1 and size_name is not null").groupBy("size_name").agg(F.max("capacity_tokens").cast("long").alias("capacity"))  # a list of container kinds
    # Full containers of items that are too long, and what is to be packed.
    sized = items.where("tokens > 0").crossJoin(F.broadcast(caps))
    full = sized.where("tokens >= capacity").select("size_name", "doc_id", "capacity", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("tokens") / F.col("capacity")) - 1)).alias("nth"))
    parts = _parts(items, sizes)
    histogram = parts.groupBy("size_name", "capacity", "length").agg(F.count("*").alias("items"))  # at most `capacity` rows a size
    plan = cut(histogram.repartition(16, "size_name").groupBy("size_name").applyInPandas(_solve, PLAN))  # sizes side by side
    slots = {}
    for r in plan.collect():  # bounded by lengths times configurations, whatever the number of items
        slots.setdefault((r.size_name, r.length), []).append((r.first, r.per_container, r.container))
    slots = {k: tuple(np.array(c, np.int64) for c in zip(*sorted(v))) for k, v in slots.items()}
    spread = spark.sparkContext.broadcast(slots)
    buckets = blocks(spark, n, item_rows)
    numbered = running(parts.withColumn("id", F.concat_ws("|", "doc_id", "first_token")), ["size_name", "length"], "id", None, "number", buckets).select("size_name", "doc_id", "length", "first_token", "number")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = spread.value
        for pdf in batches:
            at = np.empty(len(pdf), np.int64)
            number = pdf["number"].to_numpy()
            for key, rows in pdf.groupby(["size_name", "length"]).indices.items():
                first, each, container = table[key]
                k = np.searchsorted(first, number[rows], "right") - 1
                at[rows] = container[k] + (number[rows] - first[k]) // each[k]
            yield pdf.assign(container=at, tokens=pdf["length"])[["size_name", "container", "doc_id", "first_token", "tokens"]]

    schema = "size_name string, container long, doc_id long, first_token long, tokens long"
    packed = numbered.mapInPandas(place, schema)
    # Full containers are numbered after the packed ones.
    ends = plan.groupBy("size_name").agg(F.max(F.col("container") + F.col("containers")).alias("base"))
    long = running(full.withColumn("id", F.concat_ws("|", "doc_id", "nth")), ["size_name"], "id", None, "number", buckets).join(F.broadcast(ends), "size_name", "left")
    whole = long.select("size_name", (F.coalesce("base", F.lit(0).cast("long")) + F.col("number")).alias("container"), "doc_id", (F.col("nth") * F.col("capacity")).alias("first_token"), F.col("capacity").alias("tokens"))
    none = items.where("tokens = 0").crossJoin(F.broadcast(caps)).select("size_name", F.lit(-1).cast("long").alias("container"), "doc_id", F.lit(0).cast("long").alias("first_token"), F.lit(0).cast("long").alias("tokens"))
    return packed.unionByName(whole).unionByName(none)


def fill_rates(contents: DataFrame, sizes: DataFrame, compared: DataFrame | None = None) -> DataFrame:
    """(size_name, capacity, containers, least, tokens, fullest, fill_rate): least is the bound by total length.

    compared: as from `bounds`; adds packed, the containers of packed items and remainders, with their bound and best_fit.
    """
    caps = sizes.groupBy("size_name").agg(F.max("capacity_tokens").cast("long").alias("capacity"))
    per = contents.where("container >= 0").groupBy("size_name", "container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    per = per.join(F.broadcast(caps), "size_name")
    # Full containers of items that are too long hold one piece; so may a container packed with one of just that length, which never exists.
    used = per.groupBy("size_name", "capacity").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.count_if(~((F.col("pieces") == 1) & (F.col("tokens") == F.col("capacity")))).alias("packed"))
    out = used.select("size_name", "capacity", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"), "tokens", "fullest", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("fill_rate"), "packed")
    return out.drop("packed") if compared is None else out.join(compared, "size_name", "left")
