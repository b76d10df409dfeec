"""Sharding: a two-pass external shuffle, in DataFrame functions only.

Pass one scatters records by seeded hashes: the shard is the one with the highest hash of (key, shard number), and inside
a shard a second hash deals records evenly into buckets small enough for memory. Pass two shuffles each bucket (a seeded
Fisher-Yates, F.shuffle) and lays the buckets of a shard one after the other. A bucket's number is its partition's, so
that the draws depend on the seed and the bucket alone, however many shuffle partitions a session has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import copies, new_path, pick

SHARDS = 24
SEED = 20_240_117
#: Bytes of records that a bucket holds on average.
BUCKET_BYTES = 16 << 20
#: Partitions of the second pass at most (beyond, one holds several buckets), and buckets whose counts are sent to all tasks.
MAX_PARTS, SENT_BUCKETS = 50_000, 200_000


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """Shard number by highest random weight: a further shard takes records only into itself. Null is a key like others."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    return F.array_max(F.array(*(F.struct(F.xxhash64(key, F.lit(seed), F.lit(k)).alias("h"), F.lit(k).alias("k")) for k in range(shards))))["k"]


def shuffle_into_shards(df: DataFrame, key: str = "doc_id", size: str = "size", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """df's rows with shard, grown_shard (with one more shard), bucket and slot (gapless from 0 in its shard).

    `key` and the number of shards alone decide the shard. `size` (bytes, null as 0) only sets how many buckets a shard
    has. All rows stay, repeated ones too. The bucket is drawn from the whole row and, of equal rows, the number of the
    copy, so neither a common key nor a common row fills one bucket. Ties in the hash are ordered by the row itself, so
    reruns agree. df is read several times and must be the same each time. Columns of df named as the new ones are
    replaced. An empty table gives an empty one. Columns must have an order (no maps).
    """
    made = {"shard", "grown_shard", "bucket", "slot"}
    df = df.select(*(c for c in df.columns if c.lower() not in made))
    keyed = df.withColumn("shard", shard_of(F.col(key), shards, seed)).withColumn(
        "grown_shard", F.when(F.xxhash64(F.col(key), F.lit(seed), F.lit(shards)) > F.array_max(F.array(*(F.xxhash64(F.col(key), F.lit(seed), F.lit(k)) for k in range(shards)))), F.lit(shards)).otherwise(F.col("shard"))
    )
    total = keyed.agg(F.sum(size).alias("n")).first()["n"] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    keyed = copies(keyed.withColumn("__row", F.xxhash64(*df.columns, F.lit(seed + 1))))
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("__row", "__copy", F.lit(seed + 1)), F.lit(buckets)))
    counts = keyed.groupBy("shard", "bucket").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("shard", "bucket", before.alias("before"))
    row = F.struct(F.xxhash64("__row", "__copy", F.lit(seed + 2)).alias("h"), *(F.col(c) for c in df.columns), F.col("grown_shard"))
    parts = min(shards * buckets, MAX_PARTS)
    # no other plan may move a bucket to a partition of another number: each draws from a generator of its own
    dealt = keyed.withColumn("part", ((F.col("shard") * buckets + F.col("bucket")) % parts).cast("int")).repartitionById(parts, "part")
    lists = dealt.groupBy("part", "shard", "bucket").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    lists = lists.sortWithinPartitions("shard", "bucket").withColumn("rows", F.shuffle("rows", seed))
    counts = F.broadcast(counts) if shards * buckets <= SENT_BUCKETS else counts
    out = lists.join(counts, ["shard", "bucket"]).select("shard", "bucket", "before", F.posexplode("rows").alias("pos", "row"))
    return out.select(*(F.col("row")[c].alias(c) for c in df.columns), "shard", F.col("row.grown_shard").alias("grown_shard"), "bucket", (F.col("before") + F.col("pos")).alias("slot"))


def write_shards(df: DataFrame, path: str, **options) -> DataFrame:
    """Shuffle df into shards and write them under path as shard=/bucket= folders, each file in slot order. Returns what was written."""
    out = shuffle_into_shards(df, **options)
    out.sortWithinPartitions("shard", "bucket", "slot").write.partitionBy("shard", "bucket").parquet(path)
    return df.sparkSession.read.schema(out.schema).parquet(path)


def op3_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the law `key`, written and read back. Size: UTF-8 bytes (null: none) plus 8; the CRC of null is that of ''."""
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", text="text")
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 8).cast("long").alias("size")
    out = write_shards(docs.select("doc_id", "text", size), new_path(spark, "written"))
    return out.select("doc_id", size, F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
