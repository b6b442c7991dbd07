"""Near-duplicate texts by the generalised pigeonhole principle on minwise codes.

A text's code has 2 * PARTS symbols of 32 bits, one per minwise hash. The bits of one symbol are fully correlated (they agree
or not as one), so a symbol is never divided and distance is counted in symbols. Two symbols make a partition: those whose
crowding is most correlated in a sample of texts, so that what is crowded falls together. For
texts of similarity s the distance is binomial with mean 2 * PARTS * (1 - s).

If thresholds t_i of the partitions, -1 for 'skip', satisfy sum(t_i + 1) >= PARTS, every pair within PARTS - 1 symbols agrees
in some partition up to t_i symbols; for each one skipped more is asked of the others. Every text chooses its thresholds by dynamic programming over estimated candidate counts:
crowded partitions are skipped and rare ones widened instead. The estimates are hashed counts of fixed size over all
texts; they steer the cost only. At similarity 0.6 a pair beyond that distance is still met with probability 1 - 0.64 ** PARTS.
Candidates are verified on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shingles import mix, shingle_sets
from corpusloom.runtime import cut, let_workers_import

PARTS = 16
CELLS = 1 << 15  # hashed counts of symbols, and of signatures; what the driver and a broadcast hold of them is fixed by it
SKIP = 1  # further symbols to be covered for each partition skipped
SAMPLE = 4096  # texts, on average, from which the correlation of symbols is measured
_SEEDS = mix(np.arange(1, 2 * PARTS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def _sets(batch: pa.RecordBatch, width: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, set sizes, starts of the sets that have at least `least` members, and all hashes one after another."""
    owner, h = shingle_sets(batch.column(1).to_pylist(), width)
    ids = np.asarray(batch.column(0).to_pylist(), dtype=np.int64)
    sizes = np.bincount(owner, minlength=len(ids))
    keep = sizes >= max(1, least)
    h, ids, sizes = h[keep[owner]], ids[keep], sizes[keep]
    return ids, sizes, np.cumsum(sizes) - sizes, h


def codes(texts: DataFrame, width: int, least: int) -> DataFrame:
    """(id, size, same, code) of (id, text): set size, hash of the whole set, and the minwise symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, starts, h = _sets(batch, width, least)
            if not len(ids):
                continue
            code = np.empty((len(ids), 2 * PARTS), np.uint32)
            for k, seed in enumerate(_SEEDS):
                code[:, k] = np.minimum.reduceat((h * seed) >> np.uint64(32), starts)
            same = mix(np.add.reduceat(mix(h), starts) ^ sizes.astype(np.uint64)).view(np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, code.size + 1, 2 * PARTS), pa.int32()), pa.array(code.view(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sizes.astype(np.int32)), pa.array(same), flat], ["id", "size", "same", "code"])

    return texts.mapInArrow(run, "id long, size int, same long, code array<int>")


def sets(texts: DataFrame, width: int, least: int) -> DataFrame:
    """(id, hashes): the sorted 32-bit shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, starts, h = _sets(batch, width, least)
            short = np.ascontiguousarray((h >> np.uint64(32)).astype("<u4"))
            values = [short[a : a + n].tobytes() for a, n in zip(starts, sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.binary())], ["id", "hashes"])

    return texts.mapInArrow(run, "id long, hashes binary")


def allocate(cost: np.ndarray) -> np.ndarray:
    """Thresholds -1, 0 or 1 per partition with sum(t + 1) >= PARTS + (SKIP + 1) * skipped, at the least total of estimated candidates.

    cost: (rows, PARTS, 2) counts of candidates at threshold 0 and 1; skipping costs nothing. Pigeonholes alone would do with
    sum(t + 1) = PARTS; texts that share a crowded partition agree there and less so elsewhere, so more is asked where one is skipped.
    """
    rows, parts = cost.shape[:2]
    worth, need = (0, SKIP + 2, SKIP + 3), (SKIP + 2) * parts
    after = np.array([[max(0, k - w) for k in range(need + 1)] for w in worth])
    best = np.full((rows, need + 1), np.inf)  # least cost at which the partitions so far are worth k or more
    best[:, 0] = 0
    pick = np.empty((parts, rows, need + 1), np.int8)
    for i in range(parts):
        options = np.stack([best[:, after[0]], best[:, after[1]] + cost[:, i, 0, None], best[:, after[2]] + cost[:, i, 1, None]])
        pick[i], best = options.argmin(0), options.min(0)
    out, left, r = np.empty((rows, parts), np.int8), np.full(rows, need), np.arange(rows)
    for i in range(parts - 1, -1, -1):
        o = pick[i, r, left]
        out[:, i] = o - 1
        left = after[o, left]
    return out


def pair_up(crowding: np.ndarray) -> np.ndarray:
    """(PARTS, 2): symbols in pairs, the most correlated first; crowding: (texts, 2 * PARTS)."""
    n = 2 * PARTS
    spread = crowding.std(0) if len(crowding) else np.zeros(n)
    z = (crowding - crowding.mean(0)) / np.where(spread > 0, spread, 1) if len(crowding) else np.zeros((1, n))
    together = z.T @ z / len(z)
    left, pairs = list(range(n)), []
    i, j = np.triu_indices(n, 1)
    for k in np.argsort(-np.round(together[i, j], 9), kind="stable"):
        if i[k] in left and j[k] in left:
            pairs.append((i[k], j[k]))
            left = [x for x in left if x not in pairs[-1]]
    return np.array(pairs)


def _codes_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("code").flatten().to_numpy().reshape(-1, 2 * PARTS)


def _keys(code: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (texts, PARTS) and symbols (texts, PARTS, 2) as 64-bit keys."""
    symbols = code[:, pairs].astype(np.int64)
    return (symbols[..., 0] << 32) ^ (symbols[..., 1] & 0xFFFFFFFF), symbols


def _cell(key: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Cell of a key of a partition or symbol; the salt tells which."""
    return (mix(key.astype(np.uint64) + salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(CELLS)).astype(np.int64)


def _counted(reps: DataFrame, cells) -> np.ndarray:
    """How many texts fall into each cell; cells: codes -> cells of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(cells(_codes_of(batch)).ravel(), minlength=CELLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    rows = reps.select("code").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(CELLS, np.int64)
    out[rows["cell"]] = rows["n"]
    return out


def candidates(reps: DataFrame, least_similarity: float) -> DataFrame:
    """(a, b) with a < b: pairs of (id, size, code) that the allocated thresholds let meet and whose sizes allow it."""
    spark, every = reps.sparkSession, np.arange(2 * PARTS)
    symbol_counts = _counted(reps, lambda code: _cell(code, every))
    n = max(1, int(symbol_counts.sum()) // (2 * PARTS))
    sample = reps.where(F.pmod(F.xxhash64("id"), F.lit(n)) < SAMPLE).select("code").toPandas()  # about SAMPLE rows of n, whatever n is
    codes_ = np.array(sample["code"].tolist(), np.int32).reshape(-1, 2 * PARTS)
    pairs = pair_up(np.log(symbol_counts[_cell(codes_, every)] + 1.0))
    parts = np.arange(PARTS)
    signature_counts = _counted(reps, lambda code: _cell(_keys(code, pairs)[0], parts))
    known = spark.sparkContext.broadcast((symbol_counts, signature_counts))

    def thresholds(signatures: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        by_symbol, by_signature = known.value
        one = by_signature[_cell(signatures, parts)] - 1.0
        wide = by_symbol[_cell(symbols, pairs)].sum(2) - 2.0
        return allocate(np.stack([one, np.maximum(wide, one) + 1e-3], 2))  # on a tie the narrower probe

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, bool)
        for batch in batches:
            if batch.num_rows:
                signatures, symbols = _keys(_codes_of(batch), pairs)
                cells[_cell(symbols, pairs)[thresholds(signatures, symbols) == 1]] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(cells))], ["cell"])

    # symbols that some text probes for, as cells: only these are put into the index beside the signatures
    probed = np.zeros(CELLS, bool)
    probed[reps.select("code").mapInArrow(ask, "cell long").distinct().toPandas()["cell"]] = True
    probed = spark.sparkContext.broadcast(probed)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            signatures, symbols = _keys(_codes_of(batch), pairs)
            t = thresholds(signatures, symbols)
            text, part, which = np.nonzero(probed.value[_cell(symbols, pairs)])
            owner = np.concatenate([np.repeat(np.arange(len(t)), PARTS), text])
            slot = np.concatenate([np.tile(parts, len(t)) * 3, part * 3 + which + 1]).astype(np.int8)
            key = np.concatenate([signatures.ravel(), symbols[text, part, which]])
            asks = np.concatenate([t.ravel() == 0, t[text, part] == 1])
            owners = pa.array(owner)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(key), batch.column("id").take(owners), batch.column("size").take(owners), pa.array(asks)], ["slot", "sig", "id", "size", "asks"])

    met = reps.select("id", "size", "code").mapInArrow(rows, "slot byte, sig long, id long, size int, asks boolean")
    some = met.groupBy("slot", "sig").agg(F.count("*").alias("n"), F.max("asks").alias("asked")).where("n > 1 and asked").select("slot", "sig")
    shared = cut(met.join(some, ["slot", "sig"], "left_semi"))  # what nobody else has, or nobody probes for, meets nobody
    q, x = shared.where("asks").alias("q"), shared.alias("x")
    fits = (F.least("q.size", "x.size") >= F.ceil(F.greatest("q.size", "x.size") * (least_similarity - 1e-9))) & ((F.col("q.id") < F.col("x.id")) | (~F.col("x.asks") & (F.col("q.id") != F.col("x.id"))))
    return q.join(x, ["slot", "sig"]).where(fits).select(F.least("q.id", "x.id").alias("a"), F.greatest("q.id", "x.id").alias("b")).distinct()


def verify(pairs: DataFrame, members: DataFrame, least_similarity: float) -> DataFrame:
    """(a, b, similarity) of the pairs whose shingle sets (id, hashes) reach the similarity."""
    left = pairs.join(members.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), "a")
    both = left.join(members.select(F.col("id").alias("b"), F.col("hashes").alias("hb")), "b").select("a", "b", "ha", "hb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ha, hb = ([np.frombuffer(x, "<u4") for x in batch.column(k).to_pylist()] for k in (2, 3))
            if not len(a):
                continue
            la, lb = np.array([len(x) for x in ha]), np.array([len(x) for x in hb])
            row = np.repeat(np.arange(len(a), dtype=np.uint64), la + lb) << np.uint64(32)
            both = np.concatenate([y for x in zip(ha, hb) for y in x]).astype(np.uint64) | row
            both.sort()
            twice = (both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64)
            common = np.bincount(twice, minlength=len(a))
            similarity = common / (la + lb - common)
            ok = similarity >= least_similarity - 1e-12
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok]), pa.array(similarity[ok])], ["a", "b", "similarity"])

    return both.mapInArrow(run, "a long, b long, similarity double")


def near_duplicates(texts: DataFrame, width: int = 5, least_similarity: float = 0.8, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of (id, text).

    members: (id, rep, size), one row per id whose shingle set has at least `least` members; texts with equal sets share the
    smallest id as rep. pairs: (a, b, similarity) between reps at or above the similarity, a < b. Null, blank and
    short texts are left out; repeated rows of an id count once (they are expected to hold the same text).
    """
    let_workers_import(texts.sparkSession)
    rows = texts.select(F.col("id").cast("long"), "text").where("id is not null and text is not null")
    coded = cut(codes(rows, width, least))
    # one representative per set; repeated rows of an id fall together here
    groups = cut(coded.groupBy("same", "size").agg(F.min(F.struct("id", "code")).alias("r")).select("same", "size", F.col("r.id").alias("id"), F.col("r.code").alias("code")))
    members = coded.select("id", "same", "size").distinct().join(groups.select("same", "size", F.col("id").alias("rep")), ["same", "size"]).select("id", "rep", "size")
    reps = groups.select("id", "size", "code")
    pairs = cut(candidates(reps, least_similarity))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    full = sets(rows, width, least).join(wanted, "id", "left_semi").dropDuplicates(["id"])
    return verify(pairs, full, least_similarity), members


def all_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b): every pair of different ids whose sets are equal or linked, copies included, smaller id first."""
    ids = members.select("id", "rep")
    many = ids.join(ids.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1"), "rep", "left_semi")
    copies = many.alias("x").join(many.alias("y"), "rep").where("x.id < y.id").select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"))
    one = ids.select(F.col("rep").alias("a"), F.col("id").alias("x"))
    two = ids.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    linked = pairs.select("a", "b").join(one, "a").join(two, "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return copies.unionByName(linked)


def classes(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, class_id, n_links): connected components of the links, one row per member; n_links counts other texts linked to its rep.

    Labels spread to neighbours and then to the label's own label, so a component of diameter d settles in about log d rounds.
    """
    edges = cut(pairs.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")).select("e.v", "e.w"))
    label, changed = cut(edges.select("v").distinct().withColumn("c", F.col("v"))), 1
    while changed:
        near = edges.join(label.select(F.col("v").alias("w"), F.col("c").alias("cw")), "w").groupBy("v").agg(F.min("cw").alias("cw"))
        spread = label.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "cw").alias("c"))
        hop = spread.select(F.col("v").alias("c"), F.col("c").alias("cc"))
        step = cut(spread.join(hop, "c", "left").select("v", "old", F.least(F.col("c"), F.coalesce("cc", "c")).alias("c")))
        changed = step.where("c <> old").count()
        label = step.select("v", "c")
    links = edges.groupBy("v").agg(F.count("*").alias("n_links"))
    return members.join(label.withColumnRenamed("v", "rep"), "rep", "left").join(links.withColumnRenamed("v", "rep"), "rep", "left").select("id", F.coalesce("c", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
