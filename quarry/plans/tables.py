"""The engine's inputs made from general test tables: labelled references from `embeddings`, requests from `events`."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.vectors import vector_columns
from quarry.operators.layout import build
from quarry.schemas import MCC_RISK, C, V

#: Codes of the risk table, and one that is not in it.
MCCS = [*MCC_RISK, "0000"]
TIME = "yyyy-MM-dd'T'HH:mm:ss'Z'"
DAY_SECONDS = 86_400


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orig_id, label (an odd one is fraud), cluster_id (the label itself, as a given assignment), v0.., q0.."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("orig_id"), (F.col("label") % 2).cast("int").alias("label"), F.col("label").cast("int").alias("cluster_id"), *vector_columns(F.col("embedding")))


def given_centroids(refs: DataFrame) -> np.ndarray:
    """Means of the given clusters, to four decimals, so that the order of summation does not show. A row for each cluster."""
    rows = refs.groupBy("cluster_id").agg(*(F.round(F.avg(F.col(v).cast("double")), 4).alias(c) for v, c in zip(V, C, strict=True))).collect()
    out = np.zeros((1 + max((r["cluster_id"] for r in rows), default=-1), len(C)), "f4")
    for r in rows:
        out[r["cluster_id"]] = [r[c] for c in C]
    return out


def index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(clusters, rows) of the given assignment."""
    refs = references(spark, sf_dir)
    return build(refs, given_centroids(refs))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each event, with request_key (the event's id).

    The customer's known merchants are those of all their events before, the last transaction is the event before (at
    a distance made from its value), and the average is over all of a customer's events, in whole cents. A customer's
    different merchants are listed once, by first use; an event has as many of them as were used before it.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.select("event_id", "user_id", "event_type", "value", F.col("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    e = e.withColumn("merchant_id", F.concat(F.lit("MERC-"), F.col("k").cast("string"))).withColumn("at", F.date_format("ts", TIME))
    user = Window.partitionBy("user_id")
    before = user.orderBy("us", "event_id")
    day = user.orderBy("us").rangeBetween(-DAY_SECONDS * 1_000_000, 0)
    cents = F.round(F.col("value") * 100).cast("long")
    # one shuffle by customer serves every window
    e = e.repartition("user_id").withColumn("first", F.row_number().over(Window.partitionBy("user_id", "merchant_id").orderBy("us", "event_id")) == 1)
    e = e.select(
        "event_id", "event_type", "value", "k", "merchant_id", "at",
        F.collect_list(F.when(F.col("first"), F.struct("merchant_id"))).over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("uses"),
        F.count_if("first").over(before.rowsBetween(Window.unboundedPreceding, -1)).cast("int").alias("used"),
        (F.sum(cents).over(user) / F.count("*").over(user) / 100).cast("float").alias("average"),
        F.count("*").over(day).alias("n_day"), F.lag("at").over(before).alias("last_at"), F.lag("value").over(before).alias("last_value"),
    )
    e = e.withColumn("known", F.slice("uses.merchant_id", F.lit(1), F.coalesce("used", F.lit(0))))
    mcc = F.element_at(F.array(*map(F.lit, MCCS)), (F.col("k") % len(MCCS) + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("request_key"),
        F.concat(F.lit("tx-"), F.col("event_id").cast("string")).alias("id"),
        F.struct((F.col("value") * 20).cast("float").alias("amount"), (F.col("k") % 13).cast("long").alias("installments"), F.col("at").alias("requested_at")).alias("transaction"),
        F.struct(F.col("average").alias("avg_amount"), F.col("n_day").alias("tx_count_24h"), F.col("known").alias("known_merchants")).alias("customer"),
        F.struct(F.col("merchant_id").alias("id"), mcc.alias("mcc"), (F.col("k") * 25).cast("float").alias("avg_amount")).alias("merchant"),
        F.struct(F.col("event_type").isin("click", "view").alias("is_online"), (F.col("event_type") == "purchase").alias("card_present"), (F.col("value") * 3).cast("float").alias("km_from_home")).alias("terminal"),
        F.when(F.col("last_at").isNotNull(), F.struct(F.col("last_at").alias("timestamp"), F.col("last_value").cast("float").alias("km_from_current"))).alias("last_transaction"),
    )
