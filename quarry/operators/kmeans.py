"""k-means: seeded ++ initialisation on a bounded sample, assignment and update as DataFrame passes, early stop."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.prng import SEED, Generator
from quarry.schemas import DIM, MAX_CLUSTERS, C, V
from quarry.sources.shared import delete, new_path

#: Rows, drawn with replacement, that the initialisation sees at most.
INIT_SAMPLE = 65_536
FAR = np.float32(1e30)
#: Training stops when fewer than one row in so many changed its cluster.
STOP_SHARE = 1000


def float_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances in single precision, each summed from left to right."""
    out = np.zeros((len(x), len(centroids)), "f4")
    for j in range(DIM):
        gap = x[:, j : j + 1] - centroids[:, j]
        out += gap * gap
    return out


def nearest(x: np.ndarray, centroids: np.ndarray, cells: int = 1 << 21) -> np.ndarray:
    """Number of the nearest centroid, the lowest among equals; 0 where none is nearer than FAR."""
    out, step = np.zeros(len(x), "i4"), max(1, cells // max(1, len(centroids)))
    for i in range(0, len(x), step):
        d = float_distances(x[i : i + step], centroids)
        best = d.argmin(1)
        out[i : i + step] = np.where(d[np.arange(len(d)), best] < FAR, best, 0)
    return out


def sample_ids(n: int, generator: Generator) -> list[int]:
    """Row numbers 0 to n - 1, drawn with replacement."""
    return [generator.below(n) for _ in range(min(n, INIT_SAMPLE))]


def plus_plus(rows: np.ndarray, k: int, generator: Generator) -> np.ndarray:
    """k centroids from sampled rows, each next one drawn by squared distance to the nearest before it."""
    chosen = [rows[generator.below(len(rows))]]
    low = np.full(len(rows), FAR, "f4")
    while len(chosen) < k:
        low = np.minimum(low, float_distances(rows, chosen[-1][None])[:, 0])
        upto = np.cumsum(low.astype("f8"))
        if upto[-1] <= 0:
            chosen.append(rows[generator.below(len(rows))])
            continue
        chosen.append(rows[min(int(np.searchsorted(upto, generator.unit() * upto[-1], side="left")), len(rows) - 1)])
    return np.stack(chosen)


def initial(vectors: DataFrame, n: int, k: int, seed: int = SEED) -> np.ndarray:
    """Centroids for vectors (orig_id, v0..v13) whose orig_id are the row numbers 0 to n - 1."""
    generator = Generator(seed)
    ids = sample_ids(n, generator)
    wanted = vectors.sparkSession.createDataFrame([(i,) for i in set(ids)], "orig_id long")  # INIT_SAMPLE rows at most
    rows = vectors.select("orig_id", *V).join(F.broadcast(wanted), "orig_id").toPandas().set_index("orig_id")
    return plus_plus(rows.loc[ids, V].to_numpy("f4"), k, generator)


def _assigner(centroids: np.ndarray):
    def run(batches):
        for b in batches:
            x = np.stack([b.column(c).to_numpy() for c in V], 1).astype("f4") if b.num_rows else np.empty((0, DIM), "f4")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nearest(x, centroids))], names=[*b.schema.names, "cluster_id"])

    return run


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vectors (with v0..v13) with cluster_id. At most MAX_CLUSTERS centroids travel with the tasks."""
    if len(centroids) > MAX_CLUSTERS:
        raise ValueError(f"{len(centroids)} centroids; at most {MAX_CLUSTERS}")
    vectors = vectors.drop("cluster_id")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields), "cluster_id int"])
    return vectors.mapInArrow(_assigner(centroids), schema)


def _means() -> list:
    return [F.avg(F.col(v).cast("double")).cast("float").alias(c) for v, c in zip(V, C, strict=True)]


def means(assigned: DataFrame) -> DataFrame:
    """(cluster_id, n, c0..c13): means in double precision, as floats."""
    return assigned.groupBy("cluster_id").agg(F.count("*").alias("n"), *_means())


def changed(assigned: DataFrame, old: str = "old_cluster", new: str = "cluster_id") -> DataFrame:
    """One row: rows, and how many of them changed."""
    return assigned.agg(F.count("*").alias("n"), F.count_if(~F.col(old).eqNullSafe(F.col(new))).alias("changed"))


def train(vectors: DataFrame, k: int, iterations: int, seed: int = SEED) -> tuple[np.ndarray, DataFrame]:
    """vectors (orig_id 0.., v0..v13, any others) -> (centroids, vectors with cluster_id).

    The assignments are those before the last update of the centroids; clusters without rows keep their centroids. A
    round is one scan that finds the clusters, writes them beside the vectors, and one small aggregation of what it wrote;
    the next round reads the clusters before from there, and the table before that is deleted. The last one is returned.
    """
    n = vectors.count()
    if not n:
        raise ValueError("no vectors")
    if not 0 < k <= MAX_CLUSTERS:
        raise ValueError(f"k must be from 1 to {MAX_CLUSTERS}")
    if iterations <= 0:
        raise ValueError("iterations must be positive")
    spark, centroids, path = vectors.sparkSession, initial(vectors, n, k, seed), None
    rows = vectors.drop("cluster_id").withColumn("old_cluster", F.lit(None).cast("int"))
    for _ in range(iterations):
        last, path = path, new_path(spark, "assigned")
        assign(rows, centroids).write.parquet(path)
        if last:
            delete(spark, last)
        assigned = spark.read.parquet(path)
        moved = F.count_if(~F.col("old_cluster").eqNullSafe(F.col("cluster_id"))).alias("moved")
        found = assigned.groupBy("cluster_id").agg(moved, *_means()).collect()  # a row for each cluster
        centroids = centroids.copy()
        for r in found:
            centroids[r["cluster_id"]] = [r[c] for c in C]
        if sum(r["moved"] for r in found) * STOP_SHARE < n:
            break
        rows = assigned.drop("old_cluster").withColumnRenamed("cluster_id", "old_cluster")
    return centroids, assigned.drop("old_cluster")
