"""Agreement of decisions with what was expected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, rejected: str, fraud: str) -> DataFrame:
    """One row: true and false positives and negatives, and the rate of wrong decisions."""
    r, f = F.col(rejected), F.col(fraud)
    counts = df.agg(F.count_if(r & f).alias("tp"), F.count_if(~r & ~f).alias("tn"), F.count_if(r & ~f).alias("fp"), F.count_if(~r & f).alias("fn"))
    total = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    return counts.withColumn("failure_rate", F.round(F.when(total > 0, (F.col("fp") + F.col("fn")) / total).otherwise(0.0), 6))
