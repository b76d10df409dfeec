"""What the operators of this subpackage share: column picking, names of rows, small expressions."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.sources.shared import new_path, purge, scratch, shared_dir, stash  # noqa: F401

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes that an Arrow batch of whole texts holds on its way to Python, and that Python works on at once.
TEXT_BYTES = 2 << 20


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, as new=old; the exact spelling wins where names differ in case or repeat (then the first)."""
    names = df.columns
    flat = df.toDF(*(f"c{i}" for i in range(len(names))))
    out = []
    for new, old in wanted.items():
        at = names.index(old) if old in names else next((i for i, n in enumerate(names) if n.lower() == old.lower()), None)
        if at is None:
            raise ValueError(f"no column {old}: {names}")
        out.append(F.col(f"c{at}").alias(new))
    return flat.select(*out)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names, in any case: an operator makes its own."""
    gone = {n.lower() for n in names}
    keep = [i for i, c in enumerate(df.columns) if c.lower() not in gone]
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).select(*(F.col(f"c{i}").alias(df.columns[i]) for i in keep))


def located(df: DataFrame, name: str = "__at") -> DataFrame:
    """df with a column that tells each row from all others and stays the same when the row is read again: file and row number.

    A df that is not just read from files is written and read first.
    """
    at = F.concat(F.hex(F.xxhash64("_metadata.file_path")), F.lit("-"), F.col("_metadata.row_index").cast("string"))
    try:
        return df.select("*", at.alias(name))
    except AnalysisException:
        return stash(df, "located").select("*", at.alias(name))


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def copies(keyed: DataFrame) -> DataFrame:
    """keyed (__row, the hash of a row) with __copy: equal rows numbered from 0, in parts, so that no task has all of them."""
    repeated = keyed.groupBy("__row").count().filter("count > 1").select("__row")
    if not repeated.take(1):
        return keyed.withColumn("__copy", F.lit(0).cast("long"))
    keyed = stash(keyed.withColumn("__id", F.monotonically_increasing_id()), "keyed")
    rows = keyed.select("__row", "__id", F.shiftright("__id", 33).alias("part")).join(stash(repeated, "repeated"), "__row", "left_semi")
    # a part holds what one task wrote
    rows = rows.select("__row", "__id", "part", F.row_number().over(Window.partitionBy("__row", "part").orderBy("__id")).alias("nth"))
    rows = stash(rows, "nth")
    earlier = F.sum("n").over(Window.partitionBy("__row").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = rows.groupBy("__row", "part").agg(F.count("*").alias("n")).select("__row", "part", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    numbered = rows.join(parts, ["__row", "part"]).select("__id", (F.col("earlier") + F.col("nth") - 1).alias("__copy"))
    return keyed.join(stash(numbered, "copies"), "__id", "left").drop("__id").withColumn("__copy", F.coalesce("__copy", F.lit(0).cast("long")))


def trim() -> None:
    """Give a Python worker's freed memory back: workers live on after a task, beside the next ones."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run):
    """A mapInArrow function that trims when its partition ends."""

    def out(batches):
        yield from run(batches)
        trim()

    return out


def chunks(batches, size: int = TEXT_BYTES, column: str = "text"):
    """The rows of Arrow batches in batches of about `size` bytes of a string column, a longer text alone, whatever the session's batch size is."""
    for b in batches:
        n = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype("i8"))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(n, (n[at - 1] if at else 0) + size, "right")))
            yield b.slice(at, to - at) if to - at < b.num_rows else b
            at = to
        if not b.num_rows:
            yield b


def text_settings(df: DataFrame):
    """Context for plans over whole texts that run inside it: Arrow batches and Parquet vectors of a few MB. Undone at its end."""
    return _Conf(df.sparkSession, {"spark.sql.execution.arrow.maxBytesPerBatch": str(TEXT_BYTES), "spark.sql.parquet.columnarReaderBatchSize": "512"})


def batch_rows(df: DataFrame, rows: int):
    """Context for plans that run inside it: Arrow batches of so many rows. Undone at its end."""
    return _Conf(df.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)})


class _Conf:
    def __init__(self, spark: SparkSession, values: dict[str, str]):
        self.spark, self.values = spark, values

    def __enter__(self):
        self.old = {k: self.spark.conf.get(k, None) for k in self.values}
        for k, v in self.values.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_):
        for k, v in self.old.items():
            self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
