"""What scoring many requests does only once, and that its shortcuts change nothing."""

import numpy as np
from pyspark.sql import functions as F
from test_search import ROW, ask, brute

from quarry.operators import knn, layout, search
from quarry.plans import tables
from quarry.plans.jobs import Scorer
from quarry.schemas import DIM, Q, V


def test_kernel_over_many_tiles():
    """Ties across tiles go to the lower row; far and near vectors are exact."""
    rng = np.random.default_rng(4)
    for spread, n in ((2, 9000), (10_000, 9000), (10_000, 3), (32_767, 5000)):
        ref, x = (rng.integers(-spread, spread + 1, (m, DIM)).astype("i2") for m in (n, 40))
        row, col, dist = knn._nearest(x, ref, knn._tiles(ref), float(np.sqrt((ref.astype("f8") ** 2).sum(1).max())), 5)
        for i, q in enumerate(x):
            assert list(zip(col[row == i].tolist(), dist[row == i].tolist(), strict=True)) == brute(q.astype("i8"), ref, np.arange(n))


def test_merged_ranges():
    rng = np.random.default_rng(5)
    x = np.empty(4000, knn.FOUND)
    for name, most in (("id", 10_000), ("dist", 6), ("orig_id", 10**12), ("label", 2)):
        x[name] = rng.integers(0, most, len(x))
    parts = [p for half in np.split(x, 2) for p in knn._by_range(half)]
    got = np.concatenate([knn.best_of(np.concatenate([np.frombuffer(p, knn.FOUND) for r, p in parts if r == n])) for n in sorted({r for r, _ in parts})])
    assert got.tolist() == [r for i in sorted(set(x["id"].tolist())) for r in sorted(x[x["id"] == i].tolist(), key=lambda r: r[1:3])[:5]]


def test_equal_queries_are_searched_once(spark):
    values = [0.1 * (i % 3) for i in range(60)]
    got = search.distinct(ask(spark, *values)).collect()
    assert sum(r["first"] for r in got) == 3 == len({r["vector"] for r in got})
    assert all((a["vector"] == b["vector"]) == (a["q0"] == b["q0"]) for a in got for b in got)
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, (300, DIM)).astype("f4")
    index = layout.build(spark.createDataFrame([(int(i % 4), i, i % 2, *map(float, v)) for i, v in enumerate(x)], ROW), np.stack([x[i::4].mean(0) for i in range(4)]))
    found = {r["id"]: tuple(r)[1:] for r in search.search(ask(spark, *values), *index, 2).collect()}
    assert sorted(found) == list(range(60)) and len(set(found.values())) <= 3
    assert all(found[i] == found[i % 3] for i in found)


def test_few_queries_are_few_tasks(spark):
    """Python tasks follow the work, not the number of shuffle partitions."""
    n = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        assert search.distinct(ask(spark, 0.1, 0.2, 0.3)).rdd.getNumPartitions() < 10
        found = spark.createDataFrame([(0, True, bytearray())], "range long, first boolean, found binary")
        assert knn.merge(found, knn.ranged_best, "range long, found binary").rdd.getNumPartitions() < 10
        assert search._tasks(ask(spark, 0.1, 0.2, 0.3), 2) == 50 and search._tasks(spark.range(90 * 4096), 2) == 90 and search._tasks(spark.range(3), 1000) == 200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)


def test_clusters_left_to_search(spark):
    """The clusters that a doubtful query still has to read are told alike with and without joins, also where one is empty or no bound is known."""
    rng = np.random.default_rng(6)
    x = rng.uniform(-1, 1, (200, DIM)).astype("f4")
    centroids = np.concatenate([np.stack([x[i::4].mean(0) for i in range(4)]), np.zeros((1, DIM), "f4")])
    clusters, _ = layout.build(spark.createDataFrame([(int(i % 4), i, i % 2, *map(float, v)) for i, v in enumerate(x)], ROW), centroids)
    queries = ask(spark, *np.linspace(-1, 1, 40).tolist()).cache()
    votes = queries.select("id", F.when(F.col("id") % 3 > 0, 2).otherwise(0).alias("fraud_count"))
    each = F.explode(F.sequence(F.lit(1), F.when(F.col("id") % 5 == 0, 4).otherwise(5)))
    near = queries.select("id", (F.col("id") * 20_000_000).alias("dist"), each)
    for nprobe in (1, 3):
        want = search.refinements(queries, votes, near, search.probes(queries, clusters, nprobe), clusters)
        unsure = queries.filter("id % 3 > 0").withColumn("worst", F.when(F.col("id") % 5 > 0, F.col("id") * 20_000_000))
        got = unsure.mapInArrow(search._unvisited(clusters, *search.load_centroids(clusters), nprobe), "id long, " + ", ".join(f"{q} int" for q in Q) + ", cluster_id int")
        want, got = (sorted(map(tuple, d.select("id", *Q, "cluster_id").collect())) for d in (want, got))
        assert got == want and 0 < len(got) < 26 * (4 - nprobe + 1)


def test_least_of_parts():
    rng = np.random.default_rng(7)
    for n in (3, 64, 127, 128, 1000):
        d = rng.uniform(0, 1, (20, n)).astype("f4")
        k = min(5, n)
        assert (np.sort(knn._least(d, k), 1)[:, k - 1] >= np.sort(d, 1)[:, k - 1]).all()


def test_requests_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    def vectorizer(requests):
        df = requests.select("request_key", "id", F.lit(200).alias("status"), *(F.lit(0.0).cast("float").alias(v) for v in V), *(F.lit(0).alias(q) for q in Q))
        return df.mapInArrow(count, df.schema)

    requests = spark.range(20).select(F.col("id").alias("request_key"), F.col("id").cast("string").alias("id"))
    assert Scorer(lambda q: q.select("id", F.lit(1).alias("fraud_count")), vectorizer).score(requests).count() == 20
    assert made.value == 20


def test_requests_of_events(spark, tmp_path):
    """Events without a customer or a merchant are requests too; known merchants are those used before, in order of use."""
    events = [(0, 10, 1, 5), (1, 20, 1, 5), (2, 20, 1, 7), (3, 30, 1, None), (4, 40, 1, 7), (5, 5, None, 9), (6, 6, None, 9), (7, 1, 1, 8), (8, 50, 1, None)]
    e = spark.createDataFrame(events, "event_id long, at long, user_id long, k int")
    e.select("event_id", F.timestamp_seconds("at").cast("timestamp_ntz").alias("ts"), "user_id", F.lit("click").alias("event_type"), F.lit(1.5).alias("value"), F.when(F.col("k").isNotNull(), F.format_string('{"k": %d}', "k")).otherwise("{}").alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    r = tables.requests(spark, str(tmp_path))
    known = {x[0]: x[1] for x in r.select("request_key", "customer.known_merchants").collect()}
    m = [f"MERC-{i}" for i in range(10)]
    assert known == {7: [], 0: [m[8]], 1: [m[8], m[5]], 2: [m[8], m[5]], 3: [m[8], m[5], m[7]], 4: [m[8], m[5], m[7], None], 8: [m[8], m[5], m[7], None], 5: [], 6: [m[9]]}
