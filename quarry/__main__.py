"""python -m quarry build REFERENCES INDEX
python -m quarry score BODIES OUT

REFERENCES: a JSON array (.json, .json.gz) of {vector, label}, or Parquet with orig_id (0 to n - 1), vector and label.
BODIES: Parquet with request_key and body, or text with a body on each line. Settings come from QUARRY_CLUSTERS,
QUARRY_ITERATIONS and QUARRY_SEED, or QUARRY_INDEX, QUARRY_NPROBE and QUARRY_REFINE. Exit status 2: wrong use; 1: failure.
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.plans.config import BuildConfig, ScoreConfig
from quarry.plans.jobs import Scorer, build_index, index_searcher
from quarry.sources import index_files, references, requests


def build(spark: SparkSession, source: str, index: str) -> None:
    config, began = BuildConfig.from_env(), time.perf_counter()
    if source.endswith((".json", ".json.gz")):
        refs = references.read_json(spark, source)
    else:
        refs = references.from_table(spark.read.parquet(source), "orig_id", "vector", references.encode_label(F.col("label")))
    facts = build_index(refs, index, config)
    print(f"{facts} in {time.perf_counter() - began:.1f} s", file=sys.stderr)


def score(spark: SparkSession, source: str, out: str) -> None:
    config = ScoreConfig.from_env()
    if source.endswith((".txt", ".jsonl", ".json")):
        bodies = spark.read.text(source).select(F.monotonically_increasing_id().alias("request_key"), F.col("value").alias("body"))
    else:
        bodies = spark.read.parquet(source)
    searcher = index_searcher(*index_files.read(spark, config.index_path), config.nprobe, config.refine)
    Scorer(searcher).score(requests.decode(bodies)).write.parquet(out)


def main(args: list[str]) -> int:
    if len(args) != 3 or args[0] not in ("build", "score"):
        print(__doc__, file=sys.stderr)
        return 2
    try:
        {"build": build, "score": score}[args[0]](SparkSession.builder.appName("quarry").getOrCreate(), *args[1:])
    except Exception as e:
        print(f"failed: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
