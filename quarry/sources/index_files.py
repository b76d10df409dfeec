"""The index as Parquet, and as one binary file for exchange."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.layout import HEADER_BYTES, LANES, places
from quarry.schemas import DIM, HI, LO, MAX_CLUSTERS, SCALE, C, Q

#: First bytes and version of a binary file. Fixed values.
MAGIC, VERSION = b"IVFX", 3
#: Value of the empty places of a block.
PADDING = 0x7FFF
#: Rows that a binary file may hold: it is made and read on one machine. The index as Parquet has no such bound.
MAX_ROWS = 10_000_000
_ROWS = "cluster_id int, orig_id long, label int, " + ", ".join(f"{q} int" for q in Q)
_CLUSTERS = "cluster_id int, n long, row_offset long, blocks long, block_offset long, " + ", ".join([*(f"{x} int" for x in [*LO, *HI]), *(f"{c} float" for c in C)])


def _frame(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A pandas frame as a DataFrame of exactly this schema, empty ones too."""
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame(pa.Table.from_pandas(rows[names], preserve_index=False)).selectExpr(*(f"cast({n} as {x.split()[1]}) as {n}" for n, x in zip(names, schema.split(", "), strict=True)))


def write(clusters: DataFrame, rows: DataFrame, path: str) -> None:
    """clusters and rows under path; rows lie together by cluster and id, so that reading some clusters skips the rest."""
    write_rows(rows, path)
    write_clusters(clusters, path)


def write_rows(rows: DataFrame, path: str) -> None:
    small = rows.select("cluster_id", "orig_id", F.col("label").cast("tinyint").alias("label"), *(F.col(q).cast("smallint").alias(q) for q in Q))
    small.repartitionByRange("cluster_id", "orig_id").sortWithinPartitions("cluster_id", "orig_id").write.parquet(f"{path}/rows")


def write_clusters(clusters: DataFrame, path: str) -> None:
    clusters.write.parquet(f"{path}/clusters")


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").select("cluster_id", "orig_id", F.col("label").cast("int").alias("label"), *(F.col(q).cast("int").alias(q) for q in Q))


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/clusters"), read_rows(spark, path)


def write_file(clusters: DataFrame, rows: DataFrame, path: str) -> int:
    """The binary file, in any store that Spark writes; flushed, then moved to its name, so that no reader sees half of it. Returns its bytes."""
    spark, data = rows.sparkSession, to_bytes(clusters, rows)
    to, part = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + x) for x in ("", ".part"))
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    try:
        for i in range(0, len(data), 1 << 24):
            out.write(bytearray(data[i : i + (1 << 24)]))
        out.hsync()
    finally:
        out.close()
    fs.delete(to, False)
    if not fs.rename(part, to):
        raise OSError(f"cannot write {path}")
    return len(data)


def read_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(clusters, rows) of a binary file; ValueError if it is empty or not whole. A file has 2 GB at most, as it is read as one value."""
    found = spark.read.format("binaryFile").load(path).select("content").first()  # Spark leaves out a file without bytes
    return from_bytes(spark, bytes(found["content"]) if found else b"")


def to_bytes(clusters: DataFrame, rows: DataFrame) -> bytes:
    """The binary file: header, centroids, boxes, offsets, blocks of eight (dimension by dimension), labels, ids."""
    if (n := rows.count()) > MAX_ROWS:
        raise ValueError(f"{n} rows; a binary file holds {MAX_ROWS} at most")
    k = clusters.orderBy("cluster_id").toPandas()
    r = places(rows).toPandas().sort_values(["cluster_id", "position"])
    offsets = np.append(k["row_offset"].to_numpy("u4"), np.uint32(n))
    block_offsets = np.append(k["block_offset"].to_numpy("u4"), np.uint32(k["blocks"].sum()))
    blocks = np.full((int(block_offsets[-1]), DIM, LANES), PADDING, "<i2")
    first = dict(zip(k["cluster_id"].tolist(), k["block_offset"].tolist(), strict=True))
    if n:
        blocks[r["cluster_id"].map(first).to_numpy("i8") + r["block"].to_numpy("i8"), :, r["lane"].to_numpy("i8")] = r[Q].to_numpy("<i2")
    head = MAGIC + struct.pack("<IIIIf", VERSION, n, len(k), DIM, float(SCALE))
    parts = [head.ljust(HEADER_BYTES, b"\0"), k[C].to_numpy("<f4"), k[LO].to_numpy("<i2"), k[HI].to_numpy("<i2"), offsets.astype("<u4"), block_offsets.astype("<u4"), blocks, r["label"].to_numpy("u1"), r["orig_id"].to_numpy("<u4")]
    return b"".join(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes() for x in parts)


def parse(data: bytes) -> dict[str, np.ndarray]:
    """The sections of a binary file; ValueError where it is not whole."""
    if not data:
        raise ValueError("empty file")
    if len(data) < HEADER_BYTES:
        raise ValueError("header too short")
    version, n, k, dim, _ = struct.unpack("<IIIIf", data[4:24])
    if data[:4] != MAGIC:
        raise ValueError("not an index file")
    if version != VERSION:
        raise ValueError(f"version {version}")
    if dim != DIM:
        raise ValueError(f"dimension {dim}")
    at, out = HEADER_BYTES, {}

    def take(name, kind, count):
        nonlocal at
        size = np.dtype(kind).itemsize * count
        if at + size > len(data):
            raise ValueError(f"cut off in {name}")
        out[name] = np.frombuffer(data, kind, count, at)
        at += size

    take("centroids", "<f4", k * DIM)
    take("lo", "<i2", k * DIM)
    take("hi", "<i2", k * DIM)
    take("offsets", "<u4", k + 1)
    take("block_offsets", "<u4", k + 1)
    take("blocks", "<i2", int(out["block_offsets"][-1]) * DIM * LANES)
    take("labels", "u1", n)
    take("orig_ids", "<u4", n)
    if at != len(data):
        raise ValueError("bytes after the end")
    if out["offsets"][-1] != n:
        raise ValueError("offsets do not end at the number of rows")
    return out


def from_bytes(spark: SparkSession, data: bytes) -> tuple[DataFrame, DataFrame]:
    """(clusters, rows) of a binary file."""
    import pandas as pd

    x = parse(data)
    k = len(x["offsets"]) - 1
    if k > MAX_CLUSTERS:
        raise ValueError(f"{k} clusters")
    n = np.diff(x["offsets"].astype("i8"))
    blocks = x["blocks"].reshape(-1, DIM, LANES)
    cluster = np.repeat(np.arange(k), n)
    position = np.arange(len(cluster)) - x["offsets"].astype("i8")[cluster]
    q = blocks[x["block_offsets"].astype("i8")[cluster] + position // LANES, :, position % LANES] if len(cluster) else np.empty((0, DIM), "i2")
    rows = pd.DataFrame({"cluster_id": cluster.astype("i4"), "orig_id": x["orig_ids"].astype("i8"), "label": x["labels"].astype("i4")}).join(pd.DataFrame(q.astype("i4"), columns=Q))
    table = pd.DataFrame({"cluster_id": np.arange(k, dtype="i4"), "n": n, "row_offset": x["offsets"][:-1].astype("i8"), "blocks": np.diff(x["block_offsets"].astype("i8")), "block_offset": x["block_offsets"][:-1].astype("i8")})
    for names, key, kind in ((LO, "lo", "i4"), (HI, "hi", "i4"), (C, "centroids", "f4")):
        table = table.join(pd.DataFrame(x[key].reshape(k, DIM).astype(kind), columns=names))
    return _frame(spark, table, _CLUSTERS), _frame(spark, rows, _ROWS)
