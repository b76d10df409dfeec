"""The index: quantised rows by cluster, with counts, offsets, boxes and places in blocks of eight."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.vectors import quantize
from quarry.schemas import DIM, HI, LO, C, Q, V

LANES = 8
HEADER_BYTES = 32


def centroid_table(spark, centroids: np.ndarray) -> DataFrame:
    """(cluster_id, c0..c13)."""
    return spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(centroids)], "cluster_id int, " + ", ".join(f"{c} float" for c in C))


def counts(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster_id, n) of every cluster, empty ones too."""
    return clusters.select("cluster_id").join(rows.groupBy("cluster_id").agg(F.count("*").alias("n")), "cluster_id", "left").select("cluster_id", F.coalesce("n", F.lit(0)).alias("n"))


def offsets(sizes: DataFrame) -> DataFrame:
    """(cluster_id, n, row_offset, blocks, block_offset): exclusive running sums over clusters, a few thousand rows at most."""
    before = Window.orderBy("cluster_id").rowsBetween(Window.unboundedPreceding, -1)
    blocks = F.expr(f"(n + {LANES - 1}) div {LANES}")
    exclusive = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0)).cast("long")
    return sizes.select("cluster_id", "n", exclusive("n").alias("row_offset"), blocks.alias("blocks"), exclusive(blocks).alias("block_offset"))


def boxes(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster_id, lo0.., hi0..) of quantised rows; 0 for an empty cluster."""
    found = rows.groupBy("cluster_id").agg(*(F.min(q).alias(x) for q, x in zip(Q, LO, strict=True)), *(F.max(q).alias(x) for q, x in zip(Q, HI, strict=True)))
    return clusters.select("cluster_id").join(found, "cluster_id", "left").select("cluster_id", *(F.coalesce(x, F.lit(0)).alias(x) for x in [*LO, *HI]))


def places(rows: DataFrame) -> DataFrame:
    """rows with position (in the cluster, by orig_id), block and lane.

    A sort by cluster and id with exclusive offsets would need one task for a hot cluster; the rows of a cluster are
    ranked in ranges of the id, whose counts give the ranks their start.
    """
    width = 1 << 20
    part = F.expr(f"orig_id div {width}")
    ranged = rows.withColumn("part", part)
    starts = ranged.groupBy("cluster_id", "part").agg(F.count("*").alias("m"))
    starts = starts.select("cluster_id", "part", F.coalesce(F.sum("m").over(Window.partitionBy("cluster_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    ranked = ranged.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id", "part").orderBy("orig_id")) - 1)
    position = F.col("rank") + F.col("first")
    return ranked.join(starts, ["cluster_id", "part"]).select(*rows.columns, position.alias("position"), F.expr(f"(rank + first) div {LANES}").alias("block"), (position % LANES).cast("int").alias("lane"))


def build(assigned: DataFrame, centroids: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """assigned (orig_id, label, cluster_id, v0..v13), any assignment -> (clusters, rows).

    clusters: cluster_id, n, row_offset, blocks, block_offset, lo, hi, c0..c13; rows: cluster_id, orig_id, label, q0..q13.
    """
    rows = quantized(assigned)
    return describe(rows, centroids), rows


def quantized(assigned: DataFrame) -> DataFrame:
    """(cluster_id, orig_id, label, q0..q13) of assigned vectors."""
    return assigned.select("cluster_id", "orig_id", "label", *(quantize(F.col(v)).alias(q) for v, q in zip(V, Q, strict=True)))


def describe(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The clusters of quantised rows: read twice, so they had better be written before."""
    table = centroid_table(rows.sparkSession, centroids)
    return offsets(counts(rows, table)).join(boxes(rows, table), "cluster_id").join(table, "cluster_id")


def estimate_bytes(clusters: DataFrame) -> DataFrame:
    """One row: rows, clusters, blocks, and the bytes of the binary file."""
    sums = clusters.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("k"), F.coalesce(F.sum(F.expr(f"(n + {LANES - 1}) div {LANES}")), F.lit(0)).alias("blocks"))
    k, n, blocks = F.col("k"), F.col("n"), F.col("blocks")
    size = HEADER_BYTES + k * DIM * 4 + k * DIM * 2 * 2 + (k + 1) * 4 * 2 + blocks * DIM * LANES * 2 + n + n * 4
    return sums.withColumn("bytes", size.cast("long"))


def validate(clusters: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of checks: offsets, blocks and block offsets follow from the counts, counts from the rows, every row's cluster is there, and every row has an id, a label of 0 or 1 and whole values."""
    sound = reduce(lambda a, b: a & b, (F.col(q).isNotNull() for q in Q), F.col("orig_id").isNotNull() & F.col("label").isin(0, 1))
    real = rows.groupBy("cluster_id").agg(F.count("*").alias("found"), F.count_if(~F.coalesce(sound, F.lit(False))).alias("unsound"))
    both = clusters.select("cluster_id", "n", "row_offset", "blocks", "block_offset").join(real, "cluster_id", "full")
    upto = Window.orderBy("cluster_id").rowsBetween(Window.unboundedPreceding, -1)  # a row for each cluster, a few thousand
    need = F.expr(f"(n + {LANES - 1}) div {LANES}")
    both = both.withColumns({"due": F.coalesce(F.sum("n").over(upto), F.lit(0)), "need": need, "block_due": F.coalesce(F.sum(need).over(upto), F.lit(0))})
    return both.agg(
        F.count_if(F.col("n").isNull()).alias("unknown_clusters"),
        F.count_if(F.coalesce("n", F.lit(0)) != F.coalesce("found", F.lit(0))).alias("wrong_counts"),
        F.count_if(F.col("row_offset") != F.col("due")).alias("wrong_offsets"),
        F.count_if(F.col("blocks") != F.col("need")).alias("wrong_blocks"),
        F.count_if(F.col("block_offset") != F.col("block_due")).alias("wrong_block_offsets"),
        F.coalesce(F.sum("unsound"), F.lit(0)).alias("unsound_rows"),
        F.coalesce(F.sum("found"), F.lit(0)).alias("rows"),
    )
