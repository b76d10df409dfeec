"""Votes, decisions and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.schemas import NEIGHBOURS, REJECT_FROM


def vote(queries: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(id, fraud_count) of every query; missing neighbours count as no fraud."""
    counts = neighbours.groupBy("id").agg(F.sum("label").cast("int").alias("votes"))
    return queries.select("id").join(counts, "id", "left").select("id", F.least(F.coalesce("votes", F.lit(0)), F.lit(NEIGHBOURS)).alias("fraud_count"))


def _five(count: Column) -> Column:
    """At most five; null stays null, which least() alone would skip."""
    return F.when(count.isNotNull(), F.least(count, F.lit(NEIGHBOURS)))


def decision(count: Column) -> list[Column]:
    """fraud_count (at most five), approved, fraud_score. The denominator is five also where there are fewer neighbours."""
    c = _five(count)
    return [c.alias("fraud_count"), (c < REJECT_FROM).alias("approved"), (c.cast("double") / NEIGHBOURS).alias("fraud_score")]


def response(count: Column) -> Column:
    """The response body."""
    c = _five(count)
    return F.concat(F.lit('{"approved":'), (c < REJECT_FROM).cast("string"), F.lit(',"fraud_score":'), F.format_number(c / NEIGHBOURS, 1), F.lit("}"))


def assess(votes: DataFrame) -> DataFrame:
    return votes.select("id", *decision(F.col("fraud_count")), response(F.col("fraud_count")).alias("body"))
