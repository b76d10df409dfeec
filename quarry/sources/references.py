"""Labelled reference vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.vectors import vector_columns
from quarry.schemas import REFERENCE


def encode_label(label: Column) -> Column:
    """1 for exactly `fraud`, else 0."""
    return F.coalesce((label == "fraud").cast("int"), F.lit(0))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """(orig_id, label, v0.., q0..) of a JSON array of {vector, label} in one file, compressed or not; orig_id is the place in the array.

    Elements are read one by one, as what stands between two closing braces, so that no task holds the array and an
    uncompressed file is read in parts. A file whose elements hold braces of their own is read by Spark's parser for
    documents of many lines, which holds the array in one task. What is no array, or no such element, raises.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    pieces = spark.read.option("lineSep", "}").text(path).select(F.trim(F.translate("value", "\n\r\t", "   ")).alias("value"), at.alias("at"))
    flat = pieces.agg(
        F.coalesce(F.min_by("value", "at"), F.lit("")).startswith("[").alias("array"),
        F.count_if(F.col("value").rlike(r"^\[?\s*,?\s*\{[^{]*$")).alias("elements"),
        F.count_if(F.col("value").rlike(r"^\[?\s*\]?$")).alias("ends"),
        F.count("*").alias("all"),
        F.countDistinct("at.file").alias("files"),
    ).first()
    if not flat["array"]:
        raise ValueError("the references must be a JSON array")
    if flat["files"] > 1:
        raise ValueError("the references must be one file; several come as Parquet with an id")
    if flat["elements"] + flat["ends"] < flat["all"] or flat["ends"] != 1:
        whole = spark.read.schema(REFERENCE).option("multiLine", True).option("mode", "FAILFAST").json(path)
        return whole.select(F.monotonically_increasing_id().alias("orig_id"), encode_label(F.col("label")).alias("label"), *vector_columns(F.col("vector")))
    element = F.concat(F.regexp_replace("value", r"^\[?\s*,?\s*", ""), F.lit("}"))
    rows = pieces.filter(F.col("value").contains("{")).select("at", F.from_json(element, F.lit(f"struct<{_fields()}>"), {"mode": "FAILFAST"}).alias("r"))
    counts = rows.groupBy(F.col("at.block").alias("block")).agg(F.count("*").alias("n"))  # a row for each part of the file
    before = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("at.block").orderBy("at.id"))).withColumn("block", F.col("at.block"))
    rows = rows.join(F.broadcast(counts.select("block", before.alias("before"))), "block")
    return rows.select((F.col("before") + F.col("nth") - 1).alias("orig_id"), encode_label(F.col("r.label")).alias("label"), *vector_columns(F.col("r.vector")))


def _fields() -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (x.split(" ", 1) for x in REFERENCE.split(", ")))


def from_table(df: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(orig_id, label, v0.., q0..) of a table with an id, an array and a 0/1 label."""
    return df.select(F.col(id_col).cast("long").alias("orig_id"), label.cast("int").alias("label"), *vector_columns(F.col(vector_col)))
