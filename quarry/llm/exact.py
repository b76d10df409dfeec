"""Exact dedup by content sort.

Sampled splitters range-partition the normalised texts (leading characters, digest, length, id: bounded keys, so the
sample stays small and a large group of copies spreads over many partitions), each partition is sorted externally, and
neighbouring rows are compared in full. A run of equals that crosses a partition's edge is joined to its other parts by
a full comparison of one text for each edge.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SPACE, pick, stash, text_settings, trimmed

#: Leading characters of the normalised text in the sort key.
LEADING = 64


def _runs(batches):
    """Sorted rows (doc_id, at, norm, sha, n_cp) -> the same rows with their run. Holds one run's ids and one text at a time."""
    part, run, norm, ids, head = TaskContext.get().partitionId(), -1, None, [], None
    names = ["part", "run", "pos", "doc_id", "at", "sha", "head", "head_cp", "size", "edge", "norm"]

    def rows(run, ids, at, sha, head, cp, edge, text):
        n = len(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, part, "int32")), pa.array(np.full(n, run, "int64")), pa.array(np.arange(n)), ids.cast(pa.int64()), at, pa.array([sha] * n, pa.string()), pa.array([head] * n, pa.int64()), pa.array(np.full(n, cp, "int64")), pa.array(np.full(n, n, "int64")), pa.array([edge] + [None] * (n - 1), pa.bool_()), pa.array([text] + [None] * (n - 1), pa.string())],
            names=names,
        )

    def close(last):
        edge = run == 0 or last
        return rows(run, pa.concat_arrays([x for x, _ in ids]), pa.concat_arrays([x for _, x in ids]), head[0], head[1], head[2], True if edge else None, norm if edge else None)

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        text, id_, place, sha, cp = (b.column(c) for c in ("norm", "doc_id", "at", "sha", "n_cp"))
        new = np.ones(n, bool)
        new[1:] = ~pc.equal(text.slice(1), text.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = norm is None or text[0].as_py() != norm
        starts = np.flatnonzero(new)
        first = int(starts[0]) if len(starts) else n
        if first:
            ids.append((id_.slice(0, first), place.slice(0, first)))
        if not len(starts):
            continue
        if norm is not None:
            yield close(False)
        last = int(starts[-1])
        if run < 0 and last > first:  # the first run of the partition may have its other part in the one before
            second = int(starts[1])
            run = 0
            yield rows(0, id_.slice(first, second - first), place.slice(first, second - first), sha[first].as_py(), id_[first].as_py(), cp[first].as_py(), True, text[first].as_py())
            first, starts = second, starts[1:]
        if last > first:  # runs that lie inside this batch
            at = starts[:-1]
            length = np.diff(starts)
            which = np.repeat(np.arange(len(at)), length)
            k = last - first
            heads = pa.array(np.repeat(at, length))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, part, "int32")), pa.array(run + 1 + which), pa.array(np.arange(first, last) - at[which]), id_.slice(first, k).cast(pa.int64()), place.slice(first, k), sha.slice(first, k), id_.take(heads).cast(pa.int64()), cp.take(heads).cast(pa.int64()), pa.array(length[which]), pa.nulls(k, pa.bool_()), pa.nulls(k, pa.string())],
                names=names,
            )
            run += len(at)
        run, norm, ids, head = run + 1, text[last].as_py(), [(id_.slice(last), place.slice(last))], (sha[last].as_py(), id_[last].as_py(), cp[last].as_py())
    if norm is not None:
        yield close(True)


RUNS = "part int, run long, pos long, doc_id long, at string, sha string, head long, head_cp long, size long, edge boolean, norm string"


def content_sort(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """(doc_id, text, perhaps `at`) -> doc_id, at, keep_id, group_size, kept, text_sha256: one row for each row of docs.

    `at` is any further name of a row, a string; it is null if docs has none, and the last to break ties.
    Texts are equal when identical without ASCII white space; null counts as empty, so null, empty and blank texts are
    one group. Of a group the row with the most code points in its original text stays, then the smallest doc_id (a null
    id is the smallest). Exactly one row of a group is kept, also where rows repeat. An empty table gives an empty one.
    """
    text = F.coalesce("text", F.lit(""))
    norm = F.regexp_replace(text, SPACE, "")
    place = F.col("at") if "at" in docs.columns else F.lit(None).cast("string").alias("at")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), place, norm.alias("norm"), F.length(text).cast("long").alias("n_cp"))
    keyed = keyed.withColumn("sha", F.sha2("norm", 256)).withColumn("lead", F.substring("norm", 1, LEADING)).withColumn("less", -F.col("n_cp"))
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(partitions, "lead", "sha", "less", "doc_id", "at").sortWithinPartitions("lead", "sha", "norm", "less", "doc_id", "at")
    with text_settings(docs):
        runs = stash(ordered.select("doc_id", "at", "norm", "sha", "n_cp").mapInArrow(trimmed(_runs), RUNS), "exact")
    edges = runs.filter("edge")
    whole = edges.groupBy("norm").agg(F.sum("size").alias("all_size"), F.min(F.struct((-F.col("head_cp")).alias("less"), F.col("head"), F.col("part"), F.col("run"))).alias("first"))
    joined = edges.select("part", "run", "norm").join(whole, "norm").select("part", "run", "all_size", F.col("first.head").alias("all_head"), F.col("first.part").alias("first_part"), F.col("first.run").alias("first_run"))
    # two rows at most for each partition
    out = runs.select("part", "run", "pos", "doc_id", "at", "sha", "head", "size").join(F.broadcast(joined), ["part", "run"], "left")
    inside = F.col("first_part").isNull()
    return out.select(
        "doc_id",
        "at",
        F.when(inside, F.col("head")).otherwise(F.col("all_head")).alias("keep_id"),
        F.coalesce("all_size", "size").alias("group_size"),
        ((F.col("pos") == 0) & (inside | ((F.col("first_part") == F.col("part")) & (F.col("first_run") == F.col("run"))))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return content_sort(pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", text="text")).drop("at")


OP8_SQL = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
