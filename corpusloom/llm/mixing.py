"""Mixing sources to target weights, dealt to output shards by a splitting tree.

Every source is a random permutation of its documents, held as blocks of some BLOCK_TOKENS tokens: blocks by hash, documents by
size within a block. A source is used a number of whole passes plus the beginning of one more pass. Its blocks, one per pass and
block, are its units. The units of all sources are divided among the shards by a binary tree: a node gives its left
half a multivariate hypergeometric draw of its own units, so quotas are kept exactly at every level. A shard finds
its ranges of units by walking down with the random numbers of the nodes it passes; no list of shards or blocks is
kept anywhere. Documents are then put in random order within their shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.runtime import cut, let_workers_import

BLOCK_TOKENS = 16_384
SHARD_TOKENS = 1_048_576
SEED = 17


def plan(sources: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(mix_name, source, target_share, max_repeats, available, quota): tokens to take of each source.

    sources: (source, available). The total of a mix is the largest at which each source that has tokens still gets its target share
    within its repeats, shares taken anew over these; with total_tokens given, each gets its part of that or
    all it may give. Names are compared trimmed and in lower case; of repeated rows of a mix and source the shares add up.
    A source without tokens, share or repeats has quota 0.
    """
    t = targets.select("mix_name", F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats").groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    t = t.join(sources, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    most = F.col("available") * F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))
    live = (most > 0) & (F.col("target_share") > 0)
    mix = Window.partitionBy("mix_name")  # a mix lists its sources, a short list
    share = F.when(live, F.col("target_share") / F.sum(F.when(live, F.col("target_share"))).over(mix))
    t = t.withColumn("most", most).withColumn("live_share", share)
    total = F.min(F.col("most") / F.col("live_share")).over(mix) if total_tokens is None else F.lit(float(total_tokens))
    return t.withColumn("quota", F.coalesce(F.least(F.round(F.col("live_share") * total), F.col("most")), F.lit(0)).cast("long")).drop("most", "live_share")


def place_documents(docs: DataFrame) -> DataFrame:
    """(source, block, n_blocks, before, doc_id, n_tokens): documents in blocks; `before` counts the tokens of the pass ahead of it.

    Running sums are taken within blocks and over blocks, never over a whole source.
    """
    total = docs.groupBy("source").agg(F.greatest(F.ceil(F.sum("n_tokens") / BLOCK_TOKENS), F.lit(1)).cast("int").alias("n_blocks"))
    d = docs.join(total, "source").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.col("n_blocks")).cast("int"))
    # small ones first: only in the block where a quota ends does the order matter, and there the gap left is small
    order = Window.partitionBy("source", "block").orderBy("n_tokens", F.xxhash64("doc_id", F.lit(SEED + 1)), "doc_id")
    d = d.withColumn("inside", F.sum("n_tokens").over(order) - F.col("n_tokens"))
    # sums over blocks in two steps: over runs of 1024 blocks, then within a run
    each = d.groupBy("source", "block").agg(F.sum("n_tokens").alias("t")).withColumn("run", F.floor(F.col("block") / 1024))
    runs = each.groupBy("source", "run").agg(F.sum("t").alias("rt"))
    runs = runs.withColumn("run_ahead", F.sum("rt").over(Window.partitionBy("source").orderBy("run")) - F.col("rt")).drop("rt")
    each = each.withColumn("ahead", F.sum("t").over(Window.partitionBy("source", "run").orderBy("block")) - F.col("t")).join(runs, ["source", "run"])
    each = each.select("source", "block", (F.col("ahead") + F.col("run_ahead")).alias("block_ahead"))
    return d.join(each, ["source", "block"]).select("source", "block", "n_blocks", (F.col("block_ahead") + F.col("inside")).alias("before"), "doc_id", "n_tokens")


def leaf(units: np.ndarray, n_shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, count) of the units of every source that a shard gets; shards are disjoint and together take all units."""
    lo, hi, have, first = 0, n_shards, units.astype(np.int64).copy(), np.zeros(len(units), np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        draw = int(have.sum()) * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(have, draw, method="marginals") if have.sum() else have.copy()
        if shard < mid:
            hi, have = mid, left
        else:
            lo, first, have = mid, first + left, have - left
    return first, have


RUN = 1024  # units that are put in order within one task


def permuted(units: DataFrame) -> DataFrame:
    """(mix_name, source, unit, slot) of (mix_name, source, unit, units): slots 0 to units - 1 in the order of a random hash.

    Units fall into runs by hash and are ordered within a run; the runs' sizes add up to where each begins. Equal hashes go by unit.
    """
    rows = units.withColumn("run", F.pmod(F.xxhash64("mix_name", "source", "unit", F.lit(SEED + 3)), F.ceil(F.col("units") / RUN).cast("long")))
    sizes = rows.groupBy("mix_name", "source", "run").agg(F.count("*").alias("n"))
    # one row a run: a source of a billion units has a million of them
    ahead = sizes.withColumn("ahead", F.sum("n").over(Window.partitionBy("mix_name", "source").orderBy("run")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("mix_name", "source", "run").orderBy(F.xxhash64("unit", "mix_name", "source", F.lit(SEED + 4)), "unit"))
    return rows.withColumn("inside", inside).join(ahead, ["mix_name", "source", "run"]).select("mix_name", "source", "unit", (F.col("ahead") + F.col("inside") - 1).alias("slot"))


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(selection, shares).

    docs: (doc_id, source, n_tokens), source already trimmed and in lower case; documents without source or tokens are in no mix.
    selection: (mix_name, shard, position, doc_id, source, pass_no, n_tokens), a row per use of a document, at most max_repeats each.
    shares: (mix_name, source, target_share, max_repeats, available_tokens, used_tokens, actual_share, most_uses), sources
    of the mix without documents included. A source meets its quota to within half a document.
    """
    let_workers_import(docs.sparkSession)
    docs = docs.where("source is not null and n_tokens > 0 and doc_id is not null").select("doc_id", "source", "n_tokens")
    docs = docs.join(targets.select(F.lower(F.trim("source")).alias("source")).distinct(), "source", "left_semi")
    placed = cut(place_documents(docs))
    sources = placed.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.max("n_blocks").alias("n_blocks"))
    quotas = cut(plan(sources.select("source", "available"), targets, total_tokens).join(sources.select("source", "n_blocks"), "source", "left"))
    passes = quotas.where("quota > 0").select("mix_name", "source", "available", "quota", "max_repeats", "n_blocks", F.floor(F.col("quota") / F.col("available")).cast("int").alias("whole"), (F.col("quota") % F.col("available")).alias("part"))
    # the document that straddles the end of the last pass is taken if at least half of it lies within
    used = placed.join(passes.drop("n_blocks"), "source")
    reach = F.col("whole") + F.when((F.col("before") + F.col("n_tokens") / 2 <= F.col("part")) & (F.col("whole") < F.col("max_repeats")), 1).otherwise(0)
    used = used.withColumn("pass_no", F.explode(F.when(reach > 0, F.sequence(F.lit(1), reach.cast("int"))))).withColumn("unit", (F.col("pass_no") - 1).cast("long") * F.col("n_blocks") + F.col("block"))
    # every unit with documents is dealt, by the tree
    units = cut(used.groupBy("mix_name", "source", "unit").agg(F.max("quota").alias("quota")))
    spans = cut(units.groupBy("mix_name", "source").agg(F.count("*").alias("units"), F.max("quota").alias("quota")))
    trees = spans.groupBy("mix_name").agg(F.greatest(F.lit(1), F.round(F.sum("quota") / SHARD_TOKENS)).cast("int").alias("n_shards"), F.array_sort(F.collect_list(F.struct("source", "units"))).alias("sources"))
    shards = trees.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("n_shards") - 1)))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, n, sources, shard in zip(pdf["mix_name"], pdf["n_shards"], pdf["sources"], pdf["shard"]):
                units = np.array([s["units"] for s in sources], np.int64)
                first, count = leaf(units, int(n), int(shard), SEED)
                rows += [(name, int(shard), s["source"], int(a), int(a + c)) for s, a, c in zip(sources, first, count) if c]
            yield pd.DataFrame(rows, columns=["mix_name", "shard", "source", "first", "after"])

    ranges = shards.select("mix_name", "n_shards", "sources", "shard").mapInPandas(deal, "mix_name string, shard int, source string, first long, after long")
    dealt = ranges.withColumn("slot", F.explode(F.sequence("first", F.col("after") - 1))).select("mix_name", "source", "slot", "shard")
    # slots are the places of the units of a source in random order, so each shard draws blocks from all over its passes
    units = permuted(units.join(spans.select("mix_name", "source", "units"), ["mix_name", "source"]))
    homes = units.join(dealt, ["mix_name", "source", "slot"]).select("mix_name", "source", "unit", "shard")
    chosen = used.join(homes, ["mix_name", "source", "unit"]).select("mix_name", "shard", "source", "doc_id", "pass_no", "n_tokens")
    order = Window.partitionBy("mix_name", "shard").orderBy(F.xxhash64("doc_id", "pass_no", F.lit(SEED + 2)), "doc_id", "pass_no")
    selection = chosen.withColumn("position", F.row_number().over(order)).select("mix_name", "shard", "position", "doc_id", "source", "pass_no", "n_tokens")
    taken = used.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("used_tokens"), F.max("pass_no").alias("most_uses"))
    shares = quotas.join(taken, ["mix_name", "source"], "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
    shares = shares.withColumn("actual_share", F.coalesce(F.col("used_tokens") / F.sum("used_tokens").over(Window.partitionBy("mix_name")), F.lit(0.0)))
    return selection, shares.select("mix_name", "source", "target_share", "max_repeats", F.col("available").alias("available_tokens"), "used_tokens", "actual_share", F.coalesce("most_uses", F.lit(0)).alias("most_uses"))
