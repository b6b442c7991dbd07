"""Most similar vectors by an inverted multi-index.

Unit vectors are cut into two halves, each with its own codebook; a cell is a pair of centroids. A query walks the cells in the
order of summed distances with a heap and stops once the cells passed hold enough entries. Entries of the cells it met
are reranked with exact cosines, cell by cell in one matrix product. Vectors are compared only within their model.

Equal vectors share one entry that knows its smallest ids, so a vector that holds a third of all rows is one entry.
Codebooks are fitted on at most SAMPLE vectors a model, chosen by hash; every vector is indexed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import cut, let_workers_import

SAMPLE = 16384  # vectors a model from which its codebooks are fitted
CELL = 256  # entries that a cell should hold on average
MOST_CENTROIDS = 256  # centroids per half, so a codebook never exceeds this
ENTRIES = 2048  # entries a query passes before it stops
BLOCK = 4096  # entries of one cell that are ranked as one matrix


def usable(vectors: DataFrame, key: str, vector: str, model: str, dimensions: str) -> DataFrame:
    """(id, model, v) of the vectors that can be compared: not null, of the stated size, without NaN or infinity, not all zero.

    One row per id and model; of differing rows the smallest vector by value stands.
    """
    v = F.col(vector).cast("array<double>")
    good = v.isNotNull() & (F.size(v) == F.col(dimensions)) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(good).select(F.col(key).cast("long").alias("id"), F.coalesce(model, F.lit("")).alias("model"), F.col(vector).cast("array<float>").alias("v")).where("id is not null").groupBy("id", "model").agg(F.min("v").alias("v"))


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of x; empty ones move to the points that fit worst. x has at most SAMPLE rows."""
    c = x[np.random.default_rng(7).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        d = (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)
        own = d.argmin(1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        if (n == 0).any():
            c[n == 0] = x[np.argsort(-d.min(1))[: (n == 0).sum()]]
    return c


def fit(points: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Two codebooks per model, fitted where the sample lies, one task a model; their size is bounded by MOST_CENTROIDS."""
    counts = points.groupBy("model", F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    picked = points.withColumn("dim", F.size("v")).join(counts, ["model", "dim"]).where(F.pmod(F.xxhash64("id", F.lit(11)), F.col("n")) < SAMPLE)

    def train(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, n = unit(np.stack(pdf["v"].to_numpy())), int(pdf["n"].iloc[0])
        x = x[np.argsort(pdf["id"].to_numpy())][: 2 * SAMPLE]
        k = int(min(MOST_CENTROIDS, max(1, round((n / CELL) ** 0.5)), len(x)))
        half = x.shape[1] // 2
        return pd.DataFrame({"model": [key[0]] * 2, "dim": [key[1]] * 2, "half": [0, 1], "c": [kmeans(x[:, :half], k).ravel().tolist(), kmeans(x[:, half:], k).ravel().tolist()], "k": [k, k]})

    rows = picked.groupBy("model", "dim").applyInPandas(train, "model string, dim int, half int, c array<double>, k int").collect()
    books: dict = {}
    for r in sorted(rows, key=lambda r: (r["model"], r["dim"], r["half"])):
        books.setdefault((r["model"], r["dim"]), []).append(np.array(r["c"]).reshape(r["k"], -1))
    return {k: tuple(v) for k, v in books.items()}


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0)


def walk(d1: np.ndarray, d2: np.ndarray, filled: np.ndarray, enough: int) -> list[int]:
    """Cells (i * len(d2) + j) by rising d1[i] + d2[j] until those passed hold `enough` entries; empty cells are skipped."""
    o1, o2, k2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable"), len(d2)
    s1, s2, o1, o2 = d1[o1].tolist(), d2[o2].tolist(), o1.tolist(), o2.tolist()
    heap, cells, total = [(s1[0] + s2[0], 0, 0)], [], 0
    while heap and total < enough:
        _, i, j = heapq.heappop(heap)
        cell = o1[i] * k2 + o2[j]
        if n := filled[cell]:
            cells.append(cell)
            total += n
        if j + 1 < k2:
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(s1):
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
    return cells


def _by_model(batch: pa.RecordBatch, name: str = "model") -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    """(model, dim, row numbers, unit vectors) for each model and size of vector in a batch."""
    models, lists = np.array(batch.column(name).to_pylist(), dtype=object), batch.column("v")
    dims = np.diff(lists.offsets.to_numpy())
    for model, dim in sorted(set(zip(models.tolist(), dims.tolist()))):
        at = np.flatnonzero((models == model) & (dims == dim))
        yield model, dim, at, unit(np.stack(lists.take(pa.array(at)).flatten().to_numpy().reshape(-1, dim)))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.astype(np.float32).ravel()))


def top_similar(points: DataFrame, k: int, least: float = -1.0, queries: DataFrame | None = None, enough: int = ENTRIES, share: float = 0.0) -> DataFrame:
    """(model, id, near_id, similarity, rank): for each query the k most similar other ids of its model, at or above `least`.

    A query passes at least `enough` entries and at least that share of its model.
    points: (id, model, v), see usable(). queries: (id, model), all points if None. Ties go to the smaller id. A point
    alone in its model has no row.
    """
    spark = points.sparkSession
    let_workers_import(spark)
    sorted_ids = lambda c, n: F.slice(F.array_sort(c), 1, n)
    # equal vectors are one entry with its k + 1 smallest ids, gathered in two steps so that no group grows large
    part = points.groupBy("model", "v", F.pmod(F.xxhash64("id"), F.lit(64)).alias("s"), F.floor(F.col("id") / 1024).alias("t")).agg(sorted_ids(F.collect_list("id"), k + 1).alias("ids"), F.min("id").alias("low"))
    best = part.groupBy("model", "v", "s").agg(F.min("low").alias("low"), sorted_ids(F.flatten(F.collect_list("ids")), k + 1).alias("ids"))
    entries = cut(best.groupBy("model", "v").agg(F.min("low").alias("rep"), sorted_ids(F.flatten(F.collect_list("ids")), k + 1).alias("ids")))
    books = spark.sparkContext.broadcast(fit(entries.select(F.col("rep").alias("id"), "model", "v")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for model, dim, at, x in _by_model(batch):
                c1, c2 = books.value[model, dim]
                half = c1.shape[1]
                cell = _distances(x[:, :half], c1).argmin(1) * len(c2) + _distances(x[:, half:], c2).argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array([model] * len(at), pa.string()), pa.array(np.full(len(at), dim, np.int32)), pa.array(cell), batch.column("rep").take(pa.array(at)), _lists(x)], ["model", "dim", "cell", "rep", "v"])

    placed = cut(entries.select("model", "rep", "v").mapInArrow(place, "model string, dim int, cell long, rep long, v array<float>"))
    sizes: dict = {}
    for r in placed.groupBy("model", "dim", "cell").agg(F.count("*").alias("n")).collect():  # at most MOST_CENTROIDS squared cells a model
        sizes.setdefault((r["model"], r["dim"]), {})[r["cell"]] = r["n"]
    filled = {}
    for key, own in sizes.items():
        filled[key] = np.zeros(len(books.value[key][0]) * len(books.value[key][1]), np.int64)
        filled[key][list(own)] = list(own.values())
    filled = spark.sparkContext.broadcast({key: f.tolist() for key, f in filled.items()})

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for model, dim, at, x in _by_model(batch):
                (c1, c2), half = books.value[model, dim], books.value[model, dim][0].shape[1]
                d1, d2, full = _distances(x[:, :half], c1), _distances(x[:, half:], c2), filled.value[model, dim]
                met = [walk(a, b, full, max(enough, share * sum(full))) for a, b in zip(d1, d2)]
                n = [len(m) for m in met]
                cells = np.fromiter(chain.from_iterable(met), np.int64)
                row = pa.array(np.repeat(at, n))
                blocks = [(full[c] - 1) // BLOCK + 1 for c in cells.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([model] * len(cells), pa.string()), pa.array(np.full(len(cells), dim, np.int32)), pa.array(cells), pa.array(blocks, pa.int32()), batch.column("rep").take(row), batch.column("v").take(row)], ["model", "dim", "cell", "blocks", "rep", "v"])

    asked = placed
    if queries is not None:
        wanted = points.join(queries.select("id", "model"), ["id", "model"], "left_semi").select("model", "v")
        asked = placed.join(entries.join(wanted.distinct(), ["model", "v"], "left_semi").select("model", "rep"), ["model", "rep"], "left_semi")
    probes = asked.select("model", "rep", "v").mapInArrow(probe, "model string, dim int, cell long, blocks int, rep long, v array<float>")
    block_of = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    n_blocks = spark.createDataFrame([(m, d, c, (n - 1) // BLOCK + 1) for (m, d), own in sizes.items() for c, n in own.items() if n > BLOCK] or [("", 0, -1, 1)], "model string, dim int, cell long, blocks int")
    stored = placed.join(n_blocks, ["model", "dim", "cell"], "left").withColumn("block", F.when(F.col("blocks") > 1, block_of(F.col("blocks"))).otherwise(0))
    spread = probes.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # entries of a large cell lie in several blocks; its queries, which stream, are dealt over copies of a block
    copies = lambda df: df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col("blocks") > 1, 7).otherwise(0))))
    dealt = spread.withColumn("copy", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(8)).cast("int")).otherwise(0))
    both = copies(stored).select("model", "dim", "cell", "block", "copy", F.lit(0).alias("kind"), "rep", "v").unionByName(dealt.select("model", "dim", "cell", "block", "copy", F.lit(1).alias("kind"), "rep", "v"))
    place_key = ["model", "dim", "cell", "block", "copy"]
    lined = both.repartition(*place_key).sortWithinPartitions(*place_key, "kind").select(F.concat_ws("/", *place_key).alias("key"), "model", "kind", "rep", "v")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries of a cell come first; its queries are then ranked against them, a batch at a time."""
        current, ids, vectors = None, [], []
        for batch in batches:
            keys, kinds = np.array(batch.column("key").to_pylist(), dtype=object), batch.column("kind").to_numpy()
            reps, lists = batch.column("rep").to_numpy(), batch.column("v")
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])]) if len(keys) else []
            for a, b in zip(starts, [*starts[1:], len(keys)]):
                x = lists.slice(a, b - a).flatten().to_numpy().reshape(b - a, -1)
                if keys[a] != current:
                    current, ids, vectors = keys[a], [], []
                if kinds[a] == 0:
                    ids.append(reps[a:b])
                    vectors.append(x)
                    continue
                if not ids:
                    continue
                e, ev = np.concatenate(ids), np.concatenate(vectors).astype(np.float64)
                ids, vectors = [e], [ev]
                for s in range(a, b, 1024):
                    q = lists.slice(s, min(1024, b - s)).flatten().to_numpy().reshape(-1, ev.shape[1]).astype(np.float64)
                    own = reps[s : s + len(q)]
                    sim = q @ ev.T
                    sim[own[:, None] == e[None, :]] = -9
                    if len(e) > k + 1:
                        kth = np.partition(sim, len(e) - k - 1, axis=1)[:, len(e) - k - 1]
                        i, j = np.nonzero(sim >= np.maximum(kth, least - 1e-6)[:, None])
                    else:
                        i, j = np.nonzero(sim >= max(least - 1e-6, -8))
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column("model")[int(a)].as_py()] * len(i), pa.string()), pa.array(own[i]), pa.array(e[j])], ["model", "rep", "near"])

    met = lined.mapInArrow(rank, "model string, rep long, near long").distinct()
    # exact cosines in double of what was met, from the stored single-precision values
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, p: acc + p)
    full = entries.select("model", "rep", "v", "ids")
    scored = met.join(full.select("model", "rep", F.col("v").alias("qv")), ["model", "rep"]).join(full.select("model", F.col("rep").alias("near"), F.col("v").alias("ev"), F.col("ids").alias("near_ids")), ["model", "near"])
    scored = scored.withColumn("similarity", dot("qv", "ev") / F.sqrt(dot("qv", "qv") * dot("ev", "ev"))).where(F.col("similarity") >= least)
    others = scored.select("model", "rep", F.explode("near_ids").alias("near_id"), "similarity")
    own = full.where(F.size("ids") > 1).select("model", "rep", F.explode("ids").alias("near_id"), F.lit(1.0).alias("similarity"))
    if queries is not None:
        own = own.join(asked.select("model", "rep"), ["model", "rep"], "left_semi")
    ranked = others.unionByName(own).groupBy("model", "rep").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("d"), F.col("near_id")))), 1, k + 1).alias("near"))
    members = points.join(full.select("model", "v", "rep"), ["model", "v"]).select("model", "id", "rep")
    if queries is not None:
        members = members.join(queries.select("id", "model"), ["id", "model"], "left_semi")
    out = members.join(ranked, ["model", "rep"]).select("model", "id", F.posexplode(F.slice(F.filter("near", lambda n: n["near_id"] != F.col("id")), 1, k)).alias("p", "n"))
    return out.select("model", "id", F.col("n.near_id").alias("near_id"), (-F.col("n.d")).alias("similarity"), (F.col("p") + 1).alias("rank"))
