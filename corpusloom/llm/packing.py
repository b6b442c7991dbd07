"""Filling containers of fixed token capacity by cost-balanced packing.

The cost of a sequence is linear in its tokens plus quadratic in the length of each document (attention within documents).
Documents are dealt to groups by hash, each group some GROUP_CONTAINERS containers strong. Within a group they are taken
from the longest to the shortest, and each goes to the sequence of lowest cost that still has room for it.
Groups do not depend on each other, so they are packed side by side; only ids and sizes reach them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import let_workers_import

GROUP_CONTAINERS = 512
GROUP_ITEMS = 8192
WIDTH = 1024  # of the model that the sequences are for


def cost_of(width: int) -> tuple[float, float]:
    """(linear, quadratic) cost: of a token, and of a pair of tokens of one document as its share of that.

    A layer multiplies a token with 12 width ** 2 weights, and two tokens that attend with 2 width numbers, half of them under a causal mask.
    """
    return 1.0, width / (12.0 * width**2)


LINEAR, QUADRATIC = cost_of(WIDTH)


def assign(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Sequence number of each item, items in descending size; all are at most the capacity.

    It begins with as many sequences as the total needs. Where an item fits none, one is added.
    """
    n = max(1, -(-int(sizes.sum()) // capacity))
    room, cost, out = np.full(n, capacity, np.int64), np.zeros(n), np.empty(len(sizes), np.int64)
    for k, size in enumerate(sizes.tolist()):
        fits = np.where(room >= size, cost, np.inf)
        j = int(fits.argmin())
        if fits[j] == np.inf:
            j = len(room)
            room, cost = np.append(room, capacity), np.append(cost, 0.0)
        room[j] -= size
        cost[j] += LINEAR * size + QUADRATIC * size * size
        out[k] = j
    return out


def pack(items: DataFrame, sizes: DataFrame) -> DataFrame:
    """(pack_name, capacity, container, doc_id, piece_no, start_token, n_tokens) for each pack of (pack_name, capacity_tokens).

    items: (doc_id, n_tokens). An item above the capacity is cut into full pieces and a rest; the full pieces have containers to
    themselves and the rest is packed like an item. Others stay whole. Items without tokens (null or empty texts) take no
    room: they come out once per pack with container null. A pack without a positive capacity gives nothing.
    """
    let_workers_import(items.sparkSession)
    packs = sizes.where("capacity_tokens > 0").select("pack_name", F.col("capacity_tokens").cast("int").alias("capacity")).distinct().collect()  # a fixed, short list
    total = items.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), F.count("*").alias("n")).first()
    one = lambda df, **c: df.select(*[v.cast(t).alias(k) for (k, t), v in zip({"pack_name": "string", "capacity": "int", "container": "string", "doc_id": "long", "piece_no": "int", "start_token": "long", "n_tokens": "long"}.items(), c.values())])
    out = None
    for p in packs:
        name, cap = F.lit(p["pack_name"]), p["capacity"]
        groups = max(1, round(total["tokens"] / (cap * GROUP_CONTAINERS)), round(total["n"] / GROUP_ITEMS))
        full = F.floor(F.col("n_tokens") / cap)
        whole = items.where(F.col("n_tokens") >= cap).withColumn("piece", F.explode(F.sequence(F.lit(1).cast("long"), full)))
        whole = one(whole, pack_name=name, capacity=F.lit(cap), container=F.concat_ws("-", F.lit("f"), "doc_id", "piece"), doc_id=F.col("doc_id"), piece_no=F.col("piece"), start=(F.col("piece") - 1) * cap, n=F.lit(cap))
        empty = one(items.where(F.coalesce("n_tokens", F.lit(0)) <= 0), pack_name=name, capacity=F.lit(cap), container=F.lit(None), doc_id=F.col("doc_id"), piece_no=F.lit(1), start=F.lit(0), n=F.lit(0))
        rest = items.where(F.col("n_tokens") % cap > 0).select(F.lit(p["pack_name"]).alias("pack_name"), F.lit(cap).alias("capacity"), F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(groups)).cast("int").alias("grp"), "doc_id", (full + 1).cast("int").alias("piece_no"), (full * cap).cast("long").alias("start_token"), (F.col("n_tokens") % cap).cast("long").alias("n_tokens"))
        rows = (whole.unionByName(empty), rest)
        out = rows if out is None else (out[0].unionByName(rows[0]), out[1].unionByName(rows[1]))
    if out is None:
        return one(items.limit(0), pack_name=F.lit(""), capacity=F.lit(0), container=F.lit(""), doc_id=F.col("doc_id"), piece_no=F.lit(0), start=F.lit(0), n=F.lit(0))

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id"], ascending=[False, True])
        seq = assign(pdf["n_tokens"].to_numpy(), int(key[1]))
        return pdf.assign(container=[f"g{key[2]}-{s}" for s in seq])[["pack_name", "capacity", "container", "doc_id", "piece_no", "start_token", "n_tokens"]]

    packed = out[1].groupBy("pack_name", "capacity", "grp").applyInPandas(fill, "pack_name string, capacity int, container string, doc_id long, piece_no int, start_token long, n_tokens long")
    return out[0].unionByName(packed)


def fill_report(packed: DataFrame) -> DataFrame:
    """Per pack: containers, tokens, share of space used, and the spread of the cost over containers."""
    cost = F.sum(LINEAR * F.col("n_tokens") + QUADRATIC * F.col("n_tokens") * F.col("n_tokens"))
    each = packed.where("container is not null").groupBy("pack_name", "capacity", "container").agg(F.sum("n_tokens").alias("tokens"), cost.alias("cost"))
    return each.groupBy("pack_name", "capacity").agg(F.count("*").alias("n_containers"), F.sum("tokens").alias("n_tokens"), (F.sum("tokens") / (F.count("*") * F.col("capacity"))).alias("fill"), (F.stddev_pop("cost") / F.avg("cost")).alias("cost_spread"))
