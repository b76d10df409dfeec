"""The offline job that builds an index and the scoring of requests against it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.features import vectorize
from quarry.operators import kmeans, layout, search
from quarry.operators.score import decision, response
from quarry.plans.config import BuildConfig
from quarry.schemas import Q, V
from quarry.sources import index_files
from quarry.sources.shared import scratch, small_methods, stash


def build_index(references: DataFrame, path: str, config: BuildConfig | None = None) -> dict:
    """references (orig_id 0.., label, v0..) -> an index under path. Returns the checks and sizes; raises if a check fails."""
    config, spark = config or BuildConfig(), references.sparkSession
    with scratch(spark):  # assignments are computed once, written, and described as they were written
        centroids, assigned = kmeans.train(references, config.clusters, config.iterations, config.seed)
        index_files.write_rows(layout.quantized(assigned), path)
    index_files.write_clusters(layout.describe(index_files.read_rows(spark, path), centroids), path)
    clusters, rows = index_files.read(spark, path)
    checks = layout.validate(clusters, rows).first().asDict()
    if any(n for name, n in checks.items() if name != "rows"):
        raise ValueError(f"the index is not whole: {checks}")
    return checks | layout.estimate_bytes(clusters).first().asDict()


Vectorizer = Callable[[DataFrame], DataFrame]
Searcher = Callable[[DataFrame], DataFrame]


def index_searcher(clusters: DataFrame, rows: DataFrame, nprobe: int, refine: bool = True) -> Searcher:
    return lambda queries: search.search(queries, clusters, rows, nprobe, refine)


@dataclass(frozen=True)
class Scorer:
    """requests -> decisions, with any vectorizer (adds status, v0.., q0..) and searcher ((id, v0.., q0..) -> id, fraud_count)."""

    searcher: Searcher
    vectorizer: Vectorizer = vectorize

    def __post_init__(self):
        if self.searcher is None or self.vectorizer is None:
            raise ValueError("a searcher and a vectorizer are needed")

    def score(self, requests: DataFrame, key: str = "request_key") -> DataFrame:
        """requests with a unique long `key` -> key, id, status, fraud_count, approved, fraud_score, body; nulls unless status is 200.

        A valid request for which the searcher has no answer gets status 500.
        """
        with small_methods(requests.sparkSession):
            df = stash(self.vectorizer(requests).select(key, "id", "status", *V, *Q), "vectors")  # read twice, so requests are made once
        valid = df.filter("status = 200").select(F.col(key).alias("id"), *V, *Q)
        counts = self.searcher(valid).select(F.col("id").alias(key), F.col("fraud_count").alias("__count"))
        out = df.select(key, "id", "status").join(counts, key, "left")
        status = F.when((F.col("status") == 200) & F.col("__count").isNull(), 500).otherwise(F.col("status")).alias("status")
        return out.select(key, "id", status, *decision(F.col("__count")), response(F.col("__count")).alias("body"))
