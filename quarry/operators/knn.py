"""Nearest neighbours in blocks.

Queries and references are packed, where they lie, into rows that hold many vectors; an equi join of such rows (by group of
references for the exact search, where queries go to every group; by cluster for the indexed one) meets each pair of
blocks once, and a numpy kernel keeps the best of each query in the pair. What is left to shuffle and rank is a few candidates a query and block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.schemas import DIM, NEIGHBOURS, Q

#: Vectors of a packed row; queries and references whose distances the kernel holds at once.
QUERY_BLOCK, REFERENCE_BLOCK, ROWS, TILE = 4096, 32_768, 256, 2048
#: Parts of the first tile whose least distances bound the nearest ones.
PARTS = 64
#: A squared distance of two vectors of 16-bit numbers fits.
DISTANCE_BITS = 36
#: Candidates as they are packed, those of so many neighbouring ids (as bits) in a row.
FOUND, RANGE_BITS = np.dtype([("id", "i8"), ("dist", "i8"), ("orig_id", "i8"), ("label", "i1")]), 12
#: Groups that share the queries of a cluster; its references go to each of them.
SPREAD = 8
#: Vectors that a packing task holds of all values of `by` together.
HELD = 1 << 19


def _packer(id_col: str, label_col: str | None, by: str | None, block: int):
    names = ["by", "ids", "labels", "data"]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([k for k, *_ in rows], pa.int64()), *(pa.array([r[i].tobytes() for r in rows], pa.binary()) for i in (1, 2, 3))], names=names)

    def run(batches):
        held: dict[int, list] = {}
        count: dict[int, int] = {}
        total = 0

        def whole(keys):
            nonlocal total
            for k in keys:
                total -= count.pop(k)
                yield (k, *(np.concatenate(x) for x in zip(*held.pop(k), strict=True)))

        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(id_col).to_numpy().astype("i8")
            q = np.stack([b.column(c).to_numpy() for c in Q], 1).astype("i2")
            labels = b.column(label_col).to_numpy().astype("i1") if label_col else np.zeros(len(ids), "i1")
            keys = b.column(by).to_numpy().astype("i8") if by else np.zeros(len(ids), "i8")
            order = np.argsort(keys, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1):
                k = int(keys[part[0]])
                while len(part):
                    now, part = np.split(part, [block - count.get(k, 0)])
                    held.setdefault(k, []).append((ids[now], labels[now], q[now]))
                    count[k] = count.get(k, 0) + len(now)
                    total += len(now)
                    if count[k] == block:
                        yield out(list(whole([k])))
            if total > HELD:
                yield out(list(whole(list(held))))
        if held:
            yield out(list(whole(list(held))))

    return run


def pack(df: DataFrame, id_col: str, label_col: str | None = None, by: str | None = None, block: int = REFERENCE_BLOCK) -> DataFrame:
    """(by, ids, labels, data): up to `block` vectors of one partition and one value of `by` in a row, whatever the size of Arrow batches. No shuffle."""
    return df.select(*dict.fromkeys(c for c in (id_col, label_col, by, *Q) if c)).mapInArrow(_packer(id_col, label_col, by, block), "by long, ids binary, labels binary, data binary")


def _least(d: np.ndarray, k: int) -> np.ndarray:
    """Least distance of each of PARTS parts of a row: k of them are k different distances, so the k-th is no less than that of the row."""
    n = d.shape[1] // PARTS
    return d[:, : n * PARTS].reshape(len(d), n, PARTS).min(1) if n > 1 and k <= PARTS else d


def _nearest(x: np.ndarray, ref: np.ndarray, tiles: list[tuple[np.ndarray, np.ndarray]], reach: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of ref, distance): the k nearest of each row of x by (distance, row of ref), in that order.

    Distances of a tile are taken in single precision, within an error that is known; only those that may be among the k
    nearest so far are computed again, in whole numbers.
    """
    bits = max(1, (len(ref) - 1).bit_length())
    rows = np.arange(len(x), dtype="i8") << (DISTANCE_BITS + bits)
    best = np.repeat((rows | ((1 << (DISTANCE_BITS + bits)) - 1))[:, None], k, 1)  # no neighbour yet: the largest key of the row
    square = (x.astype("i8") ** 2).sum(1)
    slack = (np.sqrt(square.astype("f8")) + reach) ** 2 * 2.0**-18  # several times the error of a sum of 15 products
    asked = np.concatenate([x.astype("f4") * -2, np.ones((len(x), 1), "f4")], 1)
    for i, (at, tile) in enumerate(tiles):
        d = asked @ tile
        if i == 0:
            limit = np.partition(_least(d, k), k - 1, axis=1)[:, k - 1] + 2 * slack if len(at) > k else np.full(len(x), np.inf)
        else:
            limit = ((best[:, -1] >> bits) & ((1 << DISTANCE_BITS) - 1)) - square + slack
        found = np.flatnonzero(d <= limit.astype("f4")[:, None])
        if not len(found):
            continue
        row, col = np.divmod(found, len(at))
        col = at[col]
        exact = ((x[row].astype("i4") - ref[col]).astype("i8") ** 2).sum(1)
        keys = np.sort(np.concatenate([best.ravel(), rows[row] | (exact << bits) | col]))
        best = keys[np.searchsorted(keys, rows)[:, None] + np.arange(k)]
    row, col, dist = np.repeat(np.arange(len(x)), k), (best & ((1 << bits) - 1)).ravel(), ((best >> bits) & ((1 << DISTANCE_BITS) - 1)).ravel()
    there = dist < (1 << DISTANCE_BITS) - 1
    return row[there], col[there], dist[there]


def _tiles(ref: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """References in tiles, each a sample of all, as (rows, values with the square below)."""
    n = -(-len(ref) // TILE)
    values = np.concatenate([ref.astype("f4"), (ref.astype("i8") ** 2).sum(1).astype("f4")[:, None]], 1)
    return [(np.arange(i, len(ref), n), np.ascontiguousarray(values[i::n].T)) for i in range(n)]


def _met(batches, k: int):
    """A table of FOUND for each pair of blocks: the best k of each query in the block of references."""
    for b in batches:
        for r in b.to_pylist():
            ids, ref_ids = np.frombuffer(r["ids"], "i8"), np.frombuffer(r["ref_ids"], "i8")
            q, ref = (np.frombuffer(r[c], "i2").reshape(-1, DIM) for c in ("data", "ref_data"))
            order = np.argsort(ref_ids, kind="stable")
            ref, ref_ids, labels = ref[order], ref_ids[order], np.frombuffer(r["ref_labels"], "i1")[order]
            tiles, reach = _tiles(ref), float(np.sqrt((ref.astype("f8") ** 2).sum(1).max()))
            for i in range(0, len(q), ROWS):
                row, col, dist = _nearest(q[i : i + ROWS], ref, tiles, reach, k)
                out = np.empty(len(row), FOUND)
                out["id"], out["dist"], out["orig_id"], out["label"] = ids[i : i + ROWS][row], dist, ref_ids[col], labels[col]
                yield out


def _kernel(k: int):
    def run(batches):
        for x in _met(batches, k):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[c])) for c in FOUND.names[:3]] + [pa.array(x["label"].astype("i4"))], names=list(FOUND.names))

    return run


def _by_range(x: np.ndarray):
    """Rows (range, found) of a table of FOUND, one for each range of ids."""
    x = x[np.argsort(x["id"], kind="stable")]
    ranges = x["id"] >> RANGE_BITS
    return [(int(p["id"][0] >> RANGE_BITS), p.tobytes()) for p in np.split(x, np.flatnonzero(np.diff(ranges)) + 1) if len(p)]


def _ranged(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["range", "found"])


def _packed_kernel(k: int):
    def run(batches):
        for x in _met(batches, k):
            yield _ranged(_by_range(x))

    return run


def best_of(x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """The k smallest (dist, orig_id) of each id, in order of ids."""
    x = x[np.lexsort((x["orig_id"], x["dist"], x["id"]))]
    return x[np.arange(len(x)) - np.searchsorted(x["id"], x["id"]) < k]


def _merger(k: int, out):
    """Merges rows (range, first, found) in order of ranges; out(first candidates, best k) is called for each range."""

    def run(batches):
        now, first, held, size = None, [], [], 0
        none = np.empty(0, FOUND)

        def whole():
            return out(np.concatenate([none, *first]), best_of(np.concatenate([none, *held]), k))

        for b in batches:
            for r, early, x in zip(b.column("range").to_pylist(), b.column("first").to_pylist(), b.column("found").to_pylist(), strict=True):
                if r != now:
                    if now is not None:
                        yield whole()
                    now, first, held, size = r, [], [], 0
                x = np.frombuffer(x, FOUND)
                held.append(x)
                size += len(x)
                if early:
                    first.append(x)
                if size > HELD:
                    held = [best_of(np.concatenate(held), k)]
                    size = 0
        if now is not None:
            yield whole()

    return run


def merge(found: DataFrame, out, schema: str, k: int = NEIGHBOURS) -> DataFrame:
    """found (range, first, found) -> what `out` makes of each range: out(candidates of the first search, best k of all)."""
    return found.select("range", "first", "found").repartition("range").sortWithinPartitions("range").mapInArrow(_merger(k, out), schema)


def ranged_best(_, best: np.ndarray) -> pa.RecordBatch:
    return _ranged(_by_range(best))


def _pairs(queries: DataFrame, references: DataFrame, by_cluster: bool, tasks: int | None = None) -> DataFrame:
    """Packed queries and references in pairs of blocks; those of clusters in so many tasks, or in four for each shuffle partition."""
    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = references.select(F.col("by").alias("ref_by"), F.col("ids").alias("ref_ids"), F.col("labels").alias("ref_labels"), F.col("data").alias("ref_data"))
    if by_cluster:  # few clusters would be few tasks; small blocks are much work, so partitions are not to be made fewer
        q = queries.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(SPREAD)).cast("int"))
        r = r.withColumn("ref_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))).repartition(tasks or 4 * n, "ref_by", "ref_part")
        met = q.join(r.hint("merge"), (F.col("by") == F.col("ref_by")) & (F.col("part") == F.col("ref_part")))
    else:  # each block of references moves once, to one group; the queries go to every group
        r = r.withColumn("ref_group", F.pmod(F.xxhash64("ref_ids"), F.lit(n)).cast("int")).repartition(n, "ref_group")
        met = queries.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(r, F.col("group") == F.col("ref_group"))
    return met.select("ids", "data", "ref_ids", "ref_labels", "ref_data")


def candidates(queries: DataFrame, references: DataFrame, k: int = NEIGHBOURS, by_cluster: bool = False) -> DataFrame:
    """Packed queries and references -> (id, dist, orig_id, label): the best k of each query in each pair of blocks."""
    return _pairs(queries, references, by_cluster).mapInArrow(_kernel(k), "id long, dist long, orig_id long, label int")


def packed_candidates(queries: DataFrame, references: DataFrame, tasks: int | None = None, k: int = NEIGHBOURS) -> DataFrame:
    """The same by cluster, as rows (range, found) of a table of FOUND for a range of ids."""
    return _pairs(queries, references, True, tasks).mapInArrow(_packed_kernel(k), "range long, found binary")


def top(found: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(id, rank, orig_id, dist, label): the k smallest (dist, orig_id) of each id."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy("dist", "orig_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "rank", "orig_id", "dist", "label")


def exact(queries: DataFrame, references: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """queries (id, q0..q13), references (orig_id, label, q0..q13) -> the k nearest references of each query, in blocks of both."""
    return top(candidates(pack(queries, "id", block=QUERY_BLOCK), pack(references, "orig_id", "label"), k), k)
