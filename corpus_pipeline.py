"""From documents to token ids, in five stages; each reads what the one before wrote.

The table `labels` of the same folder gives the quality classifier its labels. Every stage takes a table with the columns
doc_id, text, source and any others, in any order; columns are told apart by position, so further ones may have any name.
Nulls: a null text is empty, a null source is a source, rows with a null id take part. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import exact, mixing, pieces, quality, simhash
from quarry.llm.common import located, n_words, new_path, pick
from quarry.llm.tokens import public

#: Near copies: words of a shingle, and the similarity of two copies.
SHINGLE, SIMILARITY = 5, 0.8


def _plain(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with doc_id, text and source by these names and all else as c0, c1, ..., and the names to give back."""
    names = docs.columns
    at = {}
    for want in ("doc_id", "text", "source"):
        found = [i for i, n in enumerate(names) if n == want] or [i for i, n in enumerate(names) if n.lower() == want]
        if found:
            at[found[0]] = want
    return docs.toDF(*(at.get(i, f"c{i}") for i in range(len(names)))), names


def _kept(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of docs (with __at) that rows (at) names."""
    return docs.join(rows.withColumnRenamed("at", "__at"), "__at", "left_semi").drop("__at")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    plain, names = _plain(docs)
    labels = pick(spark.read.parquet(f"{sf_dir}/labels.parquet"), doc_id="doc_id", quality="quality")
    judged = quality.score(plain, labels, keep_text=True).filter("predicted = 1")
    return judged.select(*plain.columns).toDF(*names)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    plain, names = _plain(docs)
    plain = located(plain)
    kept = exact.content_sort(plain.select("doc_id", "text", F.col("__at").alias("at"))).filter("kept").select("at")
    return _kept(plain, kept).toDF(*names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, linked by similar pairs directly or over others: the one with the smallest doc_id."""
    plain, names = _plain(docs)
    plain = located(plain)
    gone = simhash.near_copies(plain.select("doc_id", "text", F.col("__at").alias("at")), SHINGLE, SIMILARITY)
    return plain.join(gone.withColumnRenamed("at", "__at"), "__at", "left_anti").drop("__at").toDF(*names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; one that it does not take goes."""
    plain, names = _plain(docs)
    plain = located(plain)
    sized = plain.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.col("__at").alias("at"))
    copies = mixing.mix(sized).filter("copies > 0").select(F.col("at").alias("__at"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("__copy"))
    return plain.join(copies, "__at").drop("__at", "__copy").toDF(*names)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    return pieces.encode(_plain(docs)[0], public("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", tokenize),
]

#: The classifier, fingerprints and pieces are no SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = new_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
