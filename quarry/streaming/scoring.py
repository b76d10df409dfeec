"""Scoring a stream of requests. Each request is scored alone, so every micro-batch is scored as a batch; no state is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quarry.plans.jobs import Scorer
from quarry.sources.shared import scratch


def score_stream(requests: DataFrame, scorer: Scorer, write: Callable[[DataFrame, int], None], checkpoint: str, key: str = "request_key", **trigger) -> StreamingQuery:
    """Score a streaming DataFrame and hand each batch's decisions to `write(decisions, batch_id)`.

    A batch may come again after a failure, with the same batch_id: write so that it replaces what it wrote before. Tables
    that scoring a batch stashes are deleted when `write` returns.
    """

    def each(batch: DataFrame, number: int) -> None:
        with scratch(batch.sparkSession):
            write(scorer.score(batch, key), number)

    started = requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (started.trigger(**trigger) if trigger else started).start()


def parquet_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch to its own folder, replacing it if the batch comes again."""
    return lambda decisions, number: decisions.write.mode("overwrite").parquet(f"{path}/batch={number}")
