"""Registered queries over the test tables; quarry.plans.oracle has the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import features, times, vectors
from quarry.operators import evaluate, kmeans, knn, layout, prng, score, search
from quarry.plans import tables
from quarry.plans.config import BuildConfig
from quarry.plans.jobs import Scorer, build_index, index_searcher
from quarry.schemas import MCC_RISK, C, Q, V
from quarry.sources import index_files, requests
from quarry.sources.references import encode_label
from quarry.sources.shared import new_path, small_methods, stash
from quarry.streaming.scoring import parquet_writer, score_stream

#: Decimals of float results.
DIGITS = 5


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, v0.., q0..): every reference's neighbourhood is asked for with its dimensions in reverse, so that no query is a reference."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), *vectors.vector_columns(F.reverse(F.slice("embedding", 1, 14))))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of exact searches: ids divisible by 100, against all references."""
    return _queries(spark, sf_dir).filter("id % 100 = 0")


def _scored_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.vectorize(tables.requests(spark, sf_dir))


# scalar functions


def label_encode(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    text = F.when(F.col("label") % 2 == 1, "fraud").when(F.col("label") == 0, "legit").when(F.col("label") == 2, "Fraud").when(F.col("label") == 4, "fraud ")
    return e.select("vec_id", encode_label(text).alias("encoded"))


def vector_pad14(spark, sf_dir):
    """Vectors of 0 to 19 elements, made 14 long."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    cut = e.select("vec_id", F.slice("embedding", F.lit(1), (F.col("vec_id") % 20).cast("int")).alias("v"))
    return cut.select("vec_id", *(vectors.quantize(x).alias(q) for x, q in zip(vectors.pad(F.col("v")), Q, strict=True)))


def quantize_vectors(spark, sf_dir):
    return tables.references(spark, sf_dir).select("orig_id", *Q)


def quantize_bounds(spark, sf_dir):
    """Values far outside [-1, 1] are clipped, halves go away from zero."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    one = F.get("embedding", F.lit(0))
    return e.select("vec_id", vectors.quantize((one * vectors.f32(10)).cast("float")).alias("wide"), vectors.quantize(((F.col("vec_id") % 400 - 200).cast("double") / 20000).cast("float")).alias("half"))


def iso_parse_valid(spark, sf_dir):
    """Times with every kind of damage."""
    return _damaged(spark, sf_dir).select("event_id", times.is_time(F.col("text")).alias("valid"))


def _damaged(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.date_format("ts", tables.TIME).alias("t"))
    at = F.col("t")
    put = lambda start, text: F.overlay(at, F.lit(text), F.lit(start))
    kinds = [at, F.substring(at, 1, 19), put(11, " "), put(6, "13"), put(6, "00"), put(9, "32"), put(9, "00"), put(12, "24"), put(15, "60"), put(18, "60"), put(20, "+03:00"), put(20, "x"), put(6, "02-31"), put(1, "x"), F.lit(""), F.lit("   "), F.lit(None).cast("string")]
    text = F.element_at(F.array(*kinds), (F.col("event_id") % len(kinds) + 1).cast("int"))
    return e.select("event_id", text.alias("text"))


def civil_days(spark, sf_dir):
    """Day numbers, with day 31 in every month."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM"), F.lit("-31T10:00:00Z"))
    return o.select("o_orderkey", times.civil_days(text).alias("days"), times.weekday(text).alias("weekday"))


def weekday_mon0(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), tables.TIME)
    return o.select("o_orderkey", times.weekday(text).alias("weekday"))


def minutes_between(spark, sf_dir):
    r = tables.requests(spark, sf_dir).filter("last_transaction is not null")
    return r.select("request_key", times.minutes_between(F.col("transaction.requested_at"), F.col("last_transaction.timestamp")).alias("minutes"))


def clamp_norm(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    x = (F.col("value") * 100 - 500).cast("float") * vectors.f32(1 / 10_000)
    return e.select("event_id", F.round(vectors.clamp(x).cast("double"), DIGITS).alias("share"))


def mcc_risk_lookup(spark, sf_dir):
    r = tables.requests(spark, sf_dir)
    return r.select("request_key", F.col("merchant.mcc").alias("mcc"), F.round(features.mcc_risk(F.col("merchant.mcc")).cast("double"), 2).alias("risk"))


def mcc_risk_join(spark, sf_dir):
    """The same lookup as an outer join with the dimension table, ten fixed rows."""
    table = F.broadcast(spark.createDataFrame(list(MCC_RISK.items()), "code string, risk double"))
    r = tables.requests(spark, sf_dir).select("request_key", F.col("merchant.mcc").alias("mcc"))
    return r.join(table, F.col("mcc") == F.col("code"), "left").groupBy("mcc").agg(F.count("*").alias("requests"), F.round(F.max(F.coalesce("risk", F.lit(0.5))), 2).alias("risk"))


def known_merchant_flag(spark, sf_dir):
    r = tables.requests(spark, sf_dir)
    return r.select("request_key", features.is_known(F.col("merchant.id"), F.col("customer.known_merchants")).alias("known"))


# distances


def int_l2_pairs(spark, sf_dir):
    """Distances between all references and the first of each label, which is ten rows."""
    r = tables.references(spark, sf_dir)
    first = r.groupBy("cluster_id").agg(F.min("orig_id").alias("first_id"))
    seeds = r.join(first, F.col("orig_id") == F.col("first_id")).select(F.col("orig_id").alias("seed_id"), *(F.col(q).alias(f"s{q}") for q in Q))
    return r.join(F.broadcast(seeds)).select("orig_id", "seed_id", vectors.int_distance(vectors.columns(Q), [F.col(f"s{q}") for q in Q]).alias("dist"))


def float_l2_centroids(spark, sf_dir):
    """Distances of all references to the ten centroids."""
    r = tables.references(spark, sf_dir)
    table = layout.centroid_table(spark, tables.given_centroids(r)).withColumnRenamed("cluster_id", "centroid")
    return r.join(F.broadcast(table)).select("orig_id", "centroid", F.round(vectors.float_distance(vectors.columns(V), vectors.columns(C)).cast("double"), DIGITS).alias("dist"))


def bbox_lower_bound(spark, sf_dir):
    clusters, _ = tables.index(spark, sf_dir)
    lo, hi = vectors.box_columns()
    return _queries(spark, sf_dir).join(F.broadcast(clusters)).select("id", "cluster_id", vectors.box_bound(vectors.columns(Q), lo, hi).alias("bound"))


# requests


def request_validate_status(spark, sf_dir):
    """Every event's time, damaged in turn, as the time of a request and of its last transaction."""
    d = _damaged(spark, sf_dir)
    r = tables.requests(spark, sf_dir).join(d, F.col("request_key") == F.col("event_id"))
    odd = F.col("request_key") % 2 == 1
    r = r.withColumn("transaction", F.when(odd, F.col("transaction").withField("requested_at", F.col("text"))).otherwise(F.col("transaction")))
    r = r.withColumn("last_transaction", F.when(~odd, F.struct(F.col("text").alias("timestamp"), F.lit(1.0).cast("float").alias("km_from_current"))))
    return r.select("request_key", features.request_status().alias("status"))


def request_decode(spark, sf_dir):
    """Bodies of every kind: whole, cut off, with wrong types, too large."""
    r = tables.requests(spark, sf_dir)
    body = F.to_json(F.struct("id", "transaction", "customer", "merchant", "terminal", "last_transaction"))
    k = F.col("request_key") % 8
    body = (
        F.when(k == 1, F.substring(body, 1, 40))
        .when(k == 2, F.concat(body, F.lit(" {}")))
        .when(k == 3, F.regexp_replace(body, '"installments":[0-9]+', '"installments":1.5'))
        .when(k == 4, F.regexp_replace(body, '"installments":[0-9]+', '"installments":-1'))
        .when(k == 5, F.concat(body, F.substring(F.repeat(F.lit(" "), F.lit(65_537)), F.lit(1), 65_537 - F.length(body))))
        .when(k == 6, F.lit("{}"))
        .when(k == 7, F.regexp_replace(body, '"transaction"', '"TRANSACTION"'))
        .otherwise(body)
    )
    out = requests.decode(r.select("request_key", body.alias("body")))
    return out.select("request_key", "status", F.when(F.col("status") == 200, F.col("transaction.installments")).alias("installments"))


def feature_vector(spark, sf_dir):
    return _scored_requests(spark, sf_dir).select("request_key", *(F.round(F.col(v).cast("double"), DIGITS).alias(v) for v in V))


def feature_vector_quantized(spark, sf_dir):
    return _scored_requests(spark, sf_dir).select("request_key", *Q)


# layout


def cluster_counts(spark, sf_dir):
    """Counts of twelve clusters, two of them empty."""
    return layout.counts(tables.references(spark, sf_dir), spark.range(12).select(F.col("id").cast("int").alias("cluster_id")))


def cluster_offsets(spark, sf_dir):
    return layout.offsets(cluster_counts(spark, sf_dir)).select("cluster_id", "n", "row_offset")


def block_offsets(spark, sf_dir):
    return layout.offsets(cluster_counts(spark, sf_dir)).select("cluster_id", "blocks", "block_offset")


def block_lane_position(spark, sf_dir):
    return layout.places(tables.references(spark, sf_dir).select("cluster_id", "orig_id")).select("orig_id", "cluster_id", "position", "block", "lane")


def cluster_bbox(spark, sf_dir):
    return layout.boxes(tables.references(spark, sf_dir), spark.range(12).select(F.col("id").cast("int").alias("cluster_id")))


def cluster_centroids(spark, sf_dir):
    m = kmeans.means(tables.references(spark, sf_dir))
    return m.select("cluster_id", "n", *(F.round(F.col(c).cast("double"), DIGITS).alias(c) for c in C))


def index_size_estimate(spark, sf_dir):
    return layout.estimate_bytes(tables.index(spark, sf_dir)[0]).select("n", "k", "blocks", "bytes")


def layout_validate(spark, sf_dir):
    return layout.validate(*tables.index(spark, sf_dir))


# search


def nearest_centroid(spark, sf_dir):
    r = tables.references(spark, sf_dir)
    return kmeans.assign(r.select("orig_id", *V), tables.given_centroids(r)).select("orig_id", "cluster_id")


def top_nprobe_clusters(spark, sf_dir):
    clusters, _ = tables.index(spark, sf_dir)
    return search.probes(_queries(spark, sf_dir), clusters, 3).select("id", "probe", "cluster_id")


def knn_exact_top5(spark, sf_dir):
    return knn.exact(_asked(spark, sf_dir), tables.references(spark, sf_dir))


def knn_vote(spark, sf_dir):
    q = _asked(spark, sf_dir)
    return score.vote(q, knn.exact(q, tables.references(spark, sf_dir)))


def fraud_assessment(spark, sf_dir):
    return score.assess(knn_vote(spark, sf_dir)).drop("body")


def score_response_json(spark, sf_dir):
    return score.assess(knn_vote(spark, sf_dir)).select("id", "body")


def _searched(spark, sf_dir, nprobe, refine=True):
    clusters, rows = tables.index(spark, sf_dir)
    return search.search(_queries(spark, sf_dir), clusters, rows, nprobe, refine)


def ivf_fast_vote_nprobe1(spark, sf_dir):
    return _searched(spark, sf_dir, 1, False).select("id", "fraud_count")


def ivf_fast_vote_nprobe8(spark, sf_dir):
    return _searched(spark, sf_dir, 8, False).select("id", "fraud_count")


def ivf_refined_vote(spark, sf_dir):
    return _searched(spark, sf_dir, 2)


def bbox_prune_candidates(spark, sf_dir):
    """Clusters that the refinement of each ambiguous query still has to read."""
    clusters, rows = tables.index(spark, sf_dir)
    q = _queries(spark, sf_dir)
    probed = search.probes(q, clusters, 2)
    near = knn.top(search.scan(probed, rows))
    return search.refinements(q, score.vote(q, near), near, probed, clusters).select("id", "cluster_id", "bound", "worst")


def ivf_visited_anti(spark, sf_dir):
    """Clusters not probed, for each query: those with a rank beyond three."""
    clusters, _ = tables.index(spark, sf_dir)
    q = _queries(spark, sf_dir)
    every = q.select("id").join(F.broadcast(clusters.select("cluster_id")))
    return every.join(search.probes(q, clusters, 3).select("id", "cluster_id"), ["id", "cluster_id"], "left_anti")


def ivf_recall_vs_exact(spark, sf_dir):
    """Share of the exact neighbours that three probes find."""
    clusters, rows = tables.index(spark, sf_dir)
    q = _asked(spark, sf_dir)
    near = knn.top(search.scan(search.probes(q, clusters, 3), rows)).select("id", "orig_id")
    exact = knn.exact(q, rows).select("id", "orig_id")
    found = exact.join(near.withColumn("hit", F.lit(1)), ["id", "orig_id"], "left")
    return found.agg(F.count("*").alias("neighbours"), F.sum(F.coalesce("hit", F.lit(0))).alias("found"))


def confusion_matrix(spark, sf_dir):
    """Decisions of two probes, refined, against those of the exact search."""
    quick = _searched(spark, sf_dir, 2).select("id", (F.col("fraud_count") >= 3).alias("rejected"))
    return evaluate.confusion(quick.join(knn_vote(spark, sf_dir).select("id", (F.col("fraud_count") >= 3).alias("fraud")), "id"), "rejected", "fraud")


def score_requests(spark, sf_dir):
    """Every event as a request, scored against the index with eight probes: the whole way from fields to a decision."""
    clusters, rows = tables.index(spark, sf_dir)
    return Scorer(index_searcher(clusters, rows, 8)).score(tables.requests(spark, sf_dir)).select("request_key", "status", "fraud_count", "approved", "body")


def stream_score(spark, sf_dir):
    """The same requests as a stream in up to four batches, scored and written by batch.

    Files are written where requests are made, several a batch: to deal them into four would move every list of merchants.
    """
    given, out, progress = (new_path(spark, x) for x in ("stream", "streamed", "progress"))
    r = tables.requests(spark, sf_dir)
    share = -(-spark.read.parquet(f"{sf_dir}/events.parquet").count() // 4)
    with small_methods(spark):
        r.write.option("maxRecordsPerFile", max(1, share)).parquet(given)
    files = -(-len(spark.read.parquet(given).inputFiles()) // 4)
    clusters, rows = (stash(x, "index") for x in tables.index(spark, sf_dir))
    source = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", max(1, files)).parquet(given)
    query = score_stream(source, Scorer(index_searcher(clusters, rows, 8)), parquet_writer(out), progress, availableNow=True)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.parquet(out).select("request_key", "status", "fraud_count", "approved", "body")


# training


def lcg_sequence(spark, sf_dir):
    g = prng.Generator()
    return spark.createDataFrame([(i + 1, format(g.word(), "d")) for i in range(1000)], "draw long, state string")


def kmeans_sample_ids(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    return spark.createDataFrame(list(enumerate(kmeans.sample_ids(n, prng.Generator()))), "place long, orig_id long")


def kmeans_lloyd_1(spark, sf_dir):
    """One round from given centroids: cluster sizes and means after it."""
    r = tables.references(spark, sf_dir)
    m = kmeans.means(kmeans.assign(r.select("orig_id", *V), tables.given_centroids(r)))
    return m.select("cluster_id", "n", *(F.round(F.col(c).cast("double"), 4).alias(c) for c in C))


def kmeans_change_count(spark, sf_dir):
    r = tables.references(spark, sf_dir)
    moved = kmeans.assign(r.select("orig_id", F.col("cluster_id").alias("old_cluster"), *V), tables.given_centroids(r))
    return kmeans.changed(moved)


def kmeanspp_init(spark, sf_dir):
    """Sixteen initial centroids."""
    r = tables.references(spark, sf_dir)
    found = kmeans.initial(r, r.count(), 16)
    return layout.centroid_table(spark, found)


def kmeans_train(spark, sf_dir):
    """Sizes of sixteen clusters after training."""
    _, assigned = kmeans.train(tables.references(spark, sf_dir).select("orig_id", "label", *V), 16, 10)
    return assigned.groupBy("cluster_id").agg(F.count("*").alias("n"))


def index_roundtrip(spark, sf_dir):
    """Rows of an index that was written, read, packed into one file and parsed again."""
    path = new_path(spark, "index")
    index_files.write(*tables.index(spark, sf_dir), path)
    return index_files.from_bytes(spark, index_files.to_bytes(*index_files.read(spark, path)))[1]


def index_build(spark, sf_dir):
    """The whole offline job: training, layout, files, checks."""
    path = new_path(spark, "build")
    facts = build_index(tables.references(spark, sf_dir).select("orig_id", "label", *V), path, BuildConfig(16, 5))
    return spark.createDataFrame([(k, int(v)) for k, v in sorted(facts.items())], "fact string, value long")


QUERIES = {
    f.__name__: f
    for f in (
        label_encode, vector_pad14, quantize_vectors, quantize_bounds, iso_parse_valid, civil_days, weekday_mon0, minutes_between,
        clamp_norm, mcc_risk_lookup, mcc_risk_join, known_merchant_flag, int_l2_pairs, float_l2_centroids, bbox_lower_bound,
        request_validate_status, request_decode, feature_vector, feature_vector_quantized, cluster_counts, cluster_offsets,
        block_offsets, block_lane_position, cluster_bbox, cluster_centroids, index_size_estimate, layout_validate,
        nearest_centroid, top_nprobe_clusters, knn_exact_top5, knn_vote, fraud_assessment, score_response_json,
        ivf_fast_vote_nprobe1, ivf_fast_vote_nprobe8, ivf_refined_vote, bbox_prune_candidates, ivf_visited_anti,
        ivf_recall_vs_exact, confusion_matrix, score_requests, stream_score, lcg_sequence, kmeans_sample_ids, kmeans_lloyd_1,
        kmeans_change_count, kmeanspp_init, kmeans_train, index_roundtrip, index_build,
    )
}
