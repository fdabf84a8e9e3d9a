"""Mixing sources to target weights, with capped repetition and a report of the shares reached.

The tokens of each source, in a fixed order of its documents, are packed into blocks of fixed length, numbered from 0.
A mix is a sequence of slots, one block each, cut into output shards. Every shard draws the counts of its
sources from a multinomial distribution with the weights of the mix; prefix sums of the counts number a source's slots
over all shards. So a source of weight w has n w of n slots by expectation, with a standard deviation of
sqrt(n w (1 - w)), which is below half a percent of a mix from 10,000 slots on. Slot j of a source takes block perm(j mod n) of its n blocks, where perm is a keyed pseudorandom permutation of 0..n-1 that
changes with every repetition j div n. Slots and blocks are then joined by (source, block), which no large source
skews. Nothing is sampled on the driver but the sizes of the sources, one number each.

A mix is as long as its caps allow: the largest number of slots at which no source is drawn more than max_repeats
times, or, if no source is capped, at which every source is used once by expectation. Draws beyond a source's cap are
given to the sources of the same shard that are below theirs, in proportion to their weights, else left out.

Defined results: sources without tokens get no slots, and their weight falls to the others in proportion (the report
keeps their target and shows 0 reached); weights that are null or not positive give none; a cap below 1 gives none;
documents of no tokens belong to no block; the last block of a source may be shorter; equal seeds give equal mixes;
empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.ranks import running
from chronoloom.session import blocks, cut


#: What is added in each round of the permutation.
ROUND_KEYS = [np.uint64((r + 1) * 0xD1B54A32D192ED03 % 2**64) for r in range(4)]


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a keyed pseudorandom permutation of 0..n-1 sends each index: a Feistel network with cycle walking."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, out, todo = index.astype(np.uint64), np.zeros(len(index), np.int64), np.arange(len(index))
    key = key.astype(np.uint64)
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for r in range(len(ROUND_KEYS)):
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15) + ROUND_KEYS[r]
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & m)
        x = (left << h) | right
        done = x < n[todo].astype(np.uint64)
        out[todo[done]] = x[done].astype(np.int64)
        todo, x = todo[~done], x[~done]
    return out


def pack_blocks(docs: DataFrame, block_tokens: int, doc_rows: int = 500_000) -> DataFrame:
    """(source, block, doc_id, first_token, tokens): documents (doc_id, source, tokens) laid into blocks of their source."""
    kept = cut(docs.where("tokens > 0 and source is not null").select("doc_id", "source", "tokens"))
    placed = running(kept, ["source"], "doc_id", "tokens", "start", blocks(docs.sparkSession, kept.count(), doc_rows))
    b, end = F.lit(block_tokens), F.col("start") + F.col("tokens")
    spans = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((end - 1) / b))))
    first = F.greatest(F.col("block") * b - F.col("start"), F.lit(0))
    return spans.select("source", "block", "doc_id", first.alias("first_token"), (F.least(end, (F.col("block") + 1) * b) - F.col("start") - first).alias("tokens"))


def _mixes(targets: list, sizes: dict[str, int], tokens: dict[str, int]) -> dict[str, dict]:
    """For each mix its drawn sources with weights, block counts and caps, and how many slots it has."""
    out: dict[str, dict] = {}
    for t in targets:
        if t.mix_id is not None and t.source is not None:
            out.setdefault(t.mix_id, {})[t.source] = (float(t.target_weight or 0), t.max_repeats)
    mixes = {}
    for mix, rows in out.items():
        live = [(s, w, sizes[s], cap) for s, (w, cap) in sorted(rows.items()) if w > 0 and sizes.get(s) and (cap is None or cap >= 1)]
        if not live:
            continue
        w = np.array([x[1] for x in live])
        w = w / w.sum()
        n = np.array([x[2] for x in live])
        caps = [x[3] * x[2] for x in live if x[3] is not None]
        share = [w[i] for i, x in enumerate(live) if x[3] is not None]
        slots = min(int(c / p) for c, p in zip(caps, share)) if caps else int(max(n / w))
        most = np.array([x[3] * x[2] if x[3] is not None else 2**62 for x in live])
        mixes[mix] = {"sources": [x[0] for x in live], "weights": w, "blocks": n, "most": most, "slots": slots}
    return mixes


def draw_counts(mix: dict, name: str, shard: int, shard_slots: int, seed: int) -> np.ndarray:
    """A shard's counts, drawn multinomially by the weights; the same for the same seed, mix and shard."""
    n = min(shard_slots, mix["slots"] - shard * shard_slots)
    return np.random.default_rng([seed, zlib.crc32(name.encode()), shard]).multinomial(n, mix["weights"])


def mix_sources(docs: DataFrame, targets: DataFrame, block_tokens: int = 256, shard_slots: int = 4096, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The selection (mix_id, shard, source, slot, repeat, block, doc_id, first_token, tokens) and the shares reached.

    docs: (doc_id, source, tokens); targets: (mix_id, source, target_weight, max_repeats), one row for each source of a mix.
    """
    spark = docs.sparkSession
    packed = cut(pack_blocks(docs, block_tokens))
    sizes = packed.groupBy("source").agg((F.max("block") + 1).alias("n"), F.sum("tokens").alias("tokens")).collect()  # one row a source
    rows = targets.select("mix_id", "source", "target_weight", "max_repeats").collect()  # the mixes' definition
    mixes = _mixes(rows, {r.source: r.n for r in sizes}, {r.source: r.tokens for r in sizes})
    shards = [(m, int(-(-x["slots"] // shard_slots))) for m, x in mixes.items()]
    counts_schema = "mix_id string, source string, shard long, drawn long"
    if not shards:
        return packed.limit(0).select(F.lit("").alias("mix_id"), F.lit(0).cast("long").alias("shard"), "source", F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("repeat"), "block", "doc_id", "first_token", "tokens"), _report(spark, targets, None)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for m, s in zip(pdf["mix_id"], pdf["shard"]):
                out += [(m, x, s, int(c)) for x, c in zip(mixes[m]["sources"], draw_counts(mixes[m], m, s, shard_slots, seed))]
            yield pd.DataFrame(out, columns=["mix_id", "source", "shard", "drawn"])

    each = spark.createDataFrame(shards, "mix_id string, shards long").select("mix_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
    caps = spark.createDataFrame([(m, s, int(n), int(c), float(w)) for m, x in mixes.items() for s, n, c, w in zip(x["sources"], x["blocks"], x["most"], x["weights"])], "mix_id string, source string, n long, most long, weight double")
    drawn = cut(each.repartition(blocks(spark, sum(n for _, n in shards), 2000)).mapInPandas(draw, counts_schema))
    # One row for each source and shard: shard numbers group prefix sums, so no source's shards meet in one task.
    def prefix(df: DataFrame, size: str, out: str) -> DataFrame:
        g = df.withColumn("_g", F.floor(F.col("shard") / 4096))
        heads = g.groupBy("mix_id", "source", "_g").agg(F.sum(size).alias("_n"))
        heads = heads.select("mix_id", "source", "_g", (F.sum("_n").over(Window.partitionBy("mix_id", "source").orderBy("_g")) - F.col("_n")).alias("_a"))
        here = F.sum(size).over(Window.partitionBy("mix_id", "source", "_g").orderBy("shard")) - F.col(size)
        return g.withColumn("_h", here).join(heads, ["mix_id", "source", "_g"]).withColumn(out, F.col("_a") + F.col("_h")).drop("_g", "_a", "_h")

    first = prefix(drawn, "drawn", "before").join(F.broadcast(caps), ["mix_id", "source"])
    kept = F.greatest(F.lit(0), F.least(F.col("drawn"), F.col("most") - F.col("before")))
    first = first.withColumn("kept", kept)
    # What a cap cuts off goes to the sources of the shard whose cap lies well beyond what all shards draw.
    totals = first.groupBy("mix_id", "source").agg(F.sum("drawn").alias("all"))
    over = first.groupBy("mix_id", "shard").agg(F.sum(F.col("drawn") - F.col("kept")).alias("over"))
    sums = first.groupBy("mix_id").agg(F.sum(F.col("drawn") - F.col("kept")).alias("all_over"))
    roomy = first.join(totals, ["mix_id", "source"]).join(sums, "mix_id").join(over, ["mix_id", "shard"]).withColumn("takes", (F.col("most") - F.col("all") >= F.col("all_over")) & (F.col("over") > 0))
    w = Window.partitionBy("mix_id", "shard")
    upto = F.sum(F.when(F.col("takes"), F.col("weight")).otherwise(0.0)).over(w.orderBy("source"))
    whole = F.sum(F.when(F.col("takes"), F.col("weight")).otherwise(0.0)).over(w)
    share = lambda c: F.round(F.col("over") * c / F.col("whole")).cast("long")
    given = roomy.withColumn("upto", upto).withColumn("whole", whole).withColumn("count", F.col("kept") + F.when(F.col("takes") & (F.col("whole") > 0), share(F.col("upto")) - share(F.col("upto") - F.col("weight"))).otherwise(0))
    counts = prefix(cut(given.select("mix_id", "source", "shard", F.col("count").alias("slots"), "n")), "slots", "before").where("slots > 0")
    slots = counts.select("mix_id", "source", "shard", "n", F.explode(F.sequence("before", F.col("before") + F.col("slots") - 1)).alias("slot"))

    def permute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, slot = pdf["n"].to_numpy(), pdf["slot"].to_numpy()
            names = {x: zlib.crc32("|".join(x).encode()) for x in set(zip(pdf["mix_id"], pdf["source"]))}
            key = np.array([names[x] for x in zip(pdf["mix_id"], pdf["source"])], np.uint64) * np.uint64(1_000_003) + (slot // n).astype(np.uint64) * np.uint64(7919) + np.uint64(seed)
            yield pdf.assign(repeat=slot // n, block=permuted(slot % n, n, key))[["mix_id", "shard", "source", "slot", "repeat", "block"]]

    taken = slots.mapInPandas(permute, "mix_id string, shard long, source string, slot long, repeat long, block long")
    selection = taken.join(packed, ["source", "block"]).select("mix_id", "shard", "source", "slot", "repeat", "block", "doc_id", "first_token", "tokens")
    return selection, _report(spark, targets, selection)


def _report(spark, targets: DataFrame, selection: DataFrame | None) -> DataFrame:  # noqa: ANN001
    """(mix_id, source, target_share, reached_share, tokens, blocks, repeats, max_repeats) for every source of every mix."""
    t = targets.where("mix_id is not null and source is not null").select("mix_id", "source", "max_repeats", F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0)).alias("weight"))
    t = t.withColumn("target_share", F.round(F.col("weight") / F.sum("weight").over(Window.partitionBy("mix_id")), 6)).drop("weight")
    if selection is None:
        got = spark.createDataFrame([], "mix_id string, source string, tokens long, blocks long, repeats long")
    else:
        per = selection.groupBy("mix_id", "source", "slot").agg(F.sum("tokens").alias("tokens"), F.max("repeat").alias("repeat"))
        got = per.groupBy("mix_id", "source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("blocks"), (F.max("repeat") + 1).alias("repeats"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    x = t.join(got, ["mix_id", "source"], "left").select("mix_id", "source", "target_share", zero("tokens"), zero("blocks"), zero("repeats"), "max_repeats")
    return x.withColumn("reached_share", F.round(F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy("mix_id")), F.lit(0)), F.lit(0.0)), 6))
