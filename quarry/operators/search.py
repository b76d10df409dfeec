"""Search of the index: probe the nearest clusters, then search exactly where the vote is ambiguous."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.vectors import box_bound, box_columns, columns
from quarry.operators.kmeans import float_distances
from quarry.operators.knn import FOUND, QUERY_BLOCK, SPREAD, candidates, merge, pack, packed_candidates, ranged_best
from quarry.schemas import AMBIGUOUS, DIM, HI, LO, MAX_CLUSTERS, NEIGHBOURS, NPROBE, C, Q, V
from quarry.sources.shared import stash


def load_centroids(clusters: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(cluster ids, centroids) on the driver; an index has at most MAX_CLUSTERS clusters, more are refused."""
    rows = sorted(clusters.select("cluster_id", *C).limit(MAX_CLUSTERS + 1).collect())
    if len(rows) > MAX_CLUSTERS:
        raise ValueError(f"more than {MAX_CLUSTERS} clusters")
    return np.array([r[0] for r in rows], "i4"), np.array([r[1:] for r in rows], "f4").reshape(-1, DIM)


def _prober(ids: np.ndarray, centroids: np.ndarray, nprobe: int):
    def run(batches):
        for b in batches:
            x = np.stack([b.column(c).to_numpy() for c in V], 1).astype("f4") if b.num_rows else np.empty((0, DIM), "f4")
            d = float_distances(x, centroids)
            order = np.argsort(d, axis=1, kind="stable")[:, :nprobe]
            n, k = order.shape
            again = pa.array(np.repeat(np.arange(n), k))
            rank = np.tile(np.arange(1, k + 1, dtype="i4"), n)
            yield pa.RecordBatch.from_arrays([b.column("id").take(again), *(b.column(c).take(again) for c in Q), pa.array(ids[order.ravel()]), pa.array(rank), pa.array(np.take_along_axis(d, order, 1).ravel())], names=["id", *Q, "cluster_id", "probe", "centroid_dist"])

    return run


def probes(queries: DataFrame, clusters: DataFrame, nprobe: int = NPROBE) -> DataFrame:
    """queries (id, v0.., q0..) -> a row for each of the nprobe nearest clusters: id, q0.., cluster_id, probe, centroid_dist.

    nprobe of 0 or less means NPROBE, and no more than there are clusters. Equal distances go to the lower cluster. An
    empty cluster takes a probe like any other.
    """
    return _probes(queries, *load_centroids(clusters), nprobe)


def _visited(nprobe: int, clusters: int) -> int:
    return min(NPROBE if nprobe <= 0 else nprobe, max(1, clusters))


def _probes(queries: DataFrame, ids: np.ndarray, centroids: np.ndarray, nprobe: int) -> DataFrame:
    nprobe = _visited(nprobe, len(ids))
    schema = "id long, " + ", ".join(f"{q} int" for q in Q) + ", cluster_id int, probe int, centroid_dist float"
    return queries.select("id", *V, *Q).mapInArrow(_prober(ids, centroids, nprobe), schema)


def scan(probed: DataFrame, rows: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """Candidates of each (query, cluster) pair: the best k of each query in each block of the cluster."""
    return candidates(pack(probed, "id", by="cluster_id", block=QUERY_BLOCK), pack(rows, "orig_id", "label", by="cluster_id"), k, by_cluster=True)


def refinements(queries: DataFrame, fast: DataFrame, near: DataFrame, probed: DataFrame, clusters: DataFrame) -> DataFrame:
    """(id, q0.., cluster_id, bound, worst): clusters not yet visited that may hold a neighbour of an ambiguous query.

    worst is the fifth distance so far, or null (no bound) with fewer neighbours; a cluster stays while bound <= worst.
    """
    unsure = fast.filter(F.col("fraud_count").isin(*AMBIGUOUS)).select("id")
    worst = near.groupBy("id").agg(F.max("dist").alias("worst"), F.count("*").alias("found"))
    worst = worst.select("id", F.when(F.col("found") >= NEIGHBOURS, F.col("worst")).alias("worst"))
    unsure = queries.select("id", *Q).join(unsure, "id").join(worst, "id", "left")
    lo, hi = box_columns()
    # MAX_CLUSTERS rows at most
    boxes = F.broadcast(clusters.filter("n > 0").select("cluster_id", *[f"lo{i}" for i in range(DIM)], *[f"hi{i}" for i in range(DIM)]))
    pairs = unsure.join(boxes, F.col("worst").isNull() | (box_bound(columns(Q), lo, hi) <= F.col("worst"))).withColumn("bound", box_bound(columns(Q), lo, hi))
    return pairs.select("id", *Q, "cluster_id", "bound", "worst").join(probed.select("id", "cluster_id"), ["id", "cluster_id"], "left_anti")


#: Pairs of a query and a cluster that a task looks at together.
_LOOKED_AT = 1 << 20


def _unvisited(boxes: DataFrame, ids: np.ndarray, centroids: np.ndarray, nprobe: int):
    """(id, v0.., q0.., worst) -> (id, q0.., cluster_id): the pairs of refinements(), told without a join: boxes come to the driver as centroids do."""
    box = {r[0]: r[1:] for r in boxes.filter("n > 0").select("cluster_id", *LO, *HI).limit(MAX_CLUSTERS + 1).collect()}
    full = np.array([i in box for i in ids.tolist()], bool)
    lo, hi = np.array([box.get(i, (0,) * (2 * DIM)) for i in ids.tolist()], "i8").reshape(-1, 2, DIM).transpose(1, 2, 0)
    nprobe, step = _visited(nprobe, len(ids)), max(1, _LOOKED_AT // max(1, len(ids)))

    def run(batches):
        for whole in batches:
            for b in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                x, q = (np.stack([b.column(c).to_numpy() for c in names], 1).astype(t) for names, t in ((V, "f4"), (Q, "i8")))
                visited = np.argsort(float_distances(x, centroids), axis=1, kind="stable")[:, :nprobe]
                bound = np.zeros((len(x), len(ids)), "i8")
                for i in range(DIM):
                    bound += np.maximum(np.maximum(lo[i] - q[:, i, None], q[:, i, None] - hi[i]), 0) ** 2
                near = full & (bound <= b.column("worst").fill_null(np.iinfo("i8").max).to_numpy()[:, None])
                np.put_along_axis(near, visited, False, 1)
                row, col = np.nonzero(near)
                again = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column("id").take(again), *(b.column(c).take(again) for c in Q), pa.array(ids[col])], names=["id", *Q, "cluster_id"])

    return run


def _runs(batches):
    """Rows in order of a hash -> (id, vector, first, v0.., q0..): neighbours with equal values have one vector number."""
    start, count, last = TaskContext.get().partitionId() << 40, -1, None
    for b in batches:
        if not b.num_rows:
            continue
        x = np.concatenate([np.stack([b.column(c).to_numpy() for c in names], 1).astype(t).view("i4") for names, t in ((V, "f4"), (Q, "i4"))], 1)
        first = np.ones(len(x), bool)
        first[1:] = (x[1:] != x[:-1]).any(1)
        first[0] = last is None or (x[0] != last).any()
        numbers, last = count + np.cumsum(first), x[-1].copy()
        count = int(numbers[-1])
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(start + numbers), pa.array(first), *(b.column(c) for c in (*V, *Q))], names=["id", "vector", "first", *V, *Q])


def distinct(queries: DataFrame) -> DataFrame:
    """queries (id, v0.., q0..) with `vector`, a number that only rows with equal values share, and `first`, true for one row of each number.

    Equal rows come together by a hash, so nearly all of them share a number; numbers of a partition have no gaps. They
    depend on the plan: write them before use.
    """
    hashed = queries.select("id", *V, *Q, F.xxhash64(*V, *Q).alias("hash")).repartition("hash").sortWithinPartitions("hash")
    schema = "id long, vector long, first boolean, " + ", ".join([*(f"{v} float" for v in V), *(f"{q} int" for q in Q)])
    return hashed.drop("hash").mapInArrow(_runs, schema)


def _tasks(queries: DataFrame, clusters: int) -> int:
    """Tasks of a scan: one for each group of a cluster or for a block of queries, whichever are more. A Python task without work takes as long as some ten million distances."""
    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # of fewer, Spark would make so many
    return max(n, min(4 * n, max(SPREAD * clusters, queries.count() // QUERY_BLOCK)))


def _scan_packed(probed: DataFrame, rows: DataFrame, first: bool, tasks: int) -> DataFrame:
    """scan(), with candidates packed."""
    found = packed_candidates(pack(probed, "id", by="cluster_id", block=QUERY_BLOCK), pack(rows, "orig_id", "label", by="cluster_id"), tasks)
    return found.select("range", F.lit(first).alias("first"), "found")


def _per_id(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, place of its first candidate, number of frauds) of candidates in order of ids."""
    ids, at = np.unique(x["id"], return_index=True)
    return ids, at, np.add.reduceat(x["label"], at, dtype="i4") if len(ids) else np.empty(0, "i4")


def _doubtful(batches):
    """Packed best -> (id, worst) of ambiguous counts."""
    for b in batches:
        for x in b.column("found").to_pylist():
            x = np.frombuffer(x, FOUND)
            ids, at, frauds = _per_id(x)
            found = np.diff(np.append(at, len(x)))
            unsure = np.isin(frauds, AMBIGUOUS)
            worst = pa.array(x["dist"][at + found - 1][unsure], mask=(found < NEIGHBOURS)[unsure])
            yield pa.RecordBatch.from_arrays([pa.array(ids[unsure]), worst], names=["id", "worst"])


def _counted(first: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    ids, _, frauds = _per_id(best)
    early, _, fast = _per_id(first)  # an ambiguous count has candidates, so both have the same ids
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(fast[np.searchsorted(early, ids)]), pa.array(frauds)], names=["vector", "fast", "final"])


def search(queries: DataFrame, clusters: DataFrame, rows: DataFrame, nprobe: int = NPROBE, refine: bool = True) -> DataFrame:
    """(id, fast_count, refined, fraud_count) of every query; without a refinement fraud_count is the fast count.

    Probing all clusters is the exact search. No clusters or no rows give counts of 0. Equal queries are searched once;
    numbered queries and fast neighbours are used again, so both are written to the shared folder first.
    """
    # values of equal queries are written once
    numbered = stash(distinct(queries).select("id", "vector", "first", *(F.when(F.col("first"), F.col(c)).alias(c) for c in (*V, *Q))), "queries")
    asked = numbered.filter("first").select(F.col("vector").alias("id"), *V, *Q)
    ids, centroids = load_centroids(clusters)
    fast = _scan_packed(_probes(asked, ids, centroids, nprobe), rows, True, _tasks(asked, len(ids)))
    found = stash(merge(fast, ranged_best, "range long, found binary"), "near")
    near = found.withColumn("first", F.lit(True)).select("range", "first", "found")
    if refine:
        doubtful = found.select("found").mapInArrow(_doubtful, "id long, worst long")
        unsure = stash(asked.join(doubtful, "id"), "unsure")
        schema = "id long, " + ", ".join(f"{q} int" for q in Q) + ", cluster_id int"
        more = unsure.mapInArrow(_unvisited(clusters, ids, centroids, nprobe), schema)
        near = near.union(_scan_packed(more, rows, False, _tasks(unsure, len(ids))))
    counts = merge(near, _counted, "vector long, fast int, final int")
    out = numbered.select("id", "vector").join(counts, "vector", "left")
    fast = F.coalesce("fast", F.lit(0))
    return out.select("id", fast.alias("fast_count"), (F.lit(refine) & fast.isin(*AMBIGUOUS)).alias("refined"), F.coalesce("final", F.lit(0)).alias("fraud_count"))
