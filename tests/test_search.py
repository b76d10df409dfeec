import numpy as np
import pytest
from helpers import REQUEST_A, REQUEST_B
from pyspark.sql import functions as F

from quarry.operators import evaluate, knn, layout, search
from quarry.operators.score import assess, decision, response
from quarry.plans.jobs import Scorer, index_searcher
from quarry.schemas import DIM, Q, V

ROW = ", ".join(["cluster_id int", "orig_id long", "label int", *(f"{v} float" for v in V)])


def make_index(spark, clusters, centroids):
    """clusters: for each, its rows as (quantised first dimension, label), with ids in listed order."""
    rows, at = [], 0
    for c, members in enumerate(clusters):
        for value, label in members:
            rows.append((c, at, label, value / 10_000, *[0.0] * (DIM - 1)))
            at += 1
    centres = np.zeros((len(centroids), DIM), "f4")
    centres[:, 0] = centroids
    return layout.build(spark.createDataFrame(rows, ROW), centres)


def ask(spark, *values):
    rows = [(i, *[x, *[0.0] * 13], *[int(round(x * 10_000)), *[0] * 13]) for i, x in enumerate(values)]
    return spark.createDataFrame(rows, ", ".join(["id long", *(f"{v} float" for v in V), *(f"{q} int" for q in Q)]))


def counts(spark, index, values=(0.0,), nprobe=1, **more):
    return [tuple(r) for r in search.search(ask(spark, *values), *index, nprobe, **more).orderBy("id").select("fast_count", "refined", "fraud_count").collect()]


def cases(text):
    return [(int(x[:-1]), int(x[-1] == "F")) for x in text.split()]


def test_two_clusters(spark):
    index = make_index(spark, [[(i, 1) for i in range(5)], [(1000 + i, 0) for i in range(10)]], [0, 0.1])
    assert counts(spark, index, (0.0, 0.1)) == [(5, False, 5), (0, False, 0)]


@pytest.mark.parametrize(
    ("first", "second", "fast", "refined", "final"),
    [
        ("10F 20F 30L 40L 50L", "25F 1000L 1000L", 2, True, 3),
        ("10F 20L 30L 40L 50L", "11F 12F 13F", 1, False, 1),
        ("10L 10F 10F 10F 10F 10F", "", 4, False, 4),
        ("10F 20F", "", 2, True, 2),
        ("10F 20F", "30F 40F 50F", 2, True, 5),
    ],
)
def test_refinement(spark, first, second, fast, refined, final):
    index = make_index(spark, [cases(first), cases(second)], [0, 0.1])
    assert counts(spark, index) == [(fast, refined, final)]
    assert counts(spark, index, refine=False) == [(fast, False, fast)]


def test_empty_index(spark):
    index = make_index(spark, [[], []], [0, 0.1])
    assert counts(spark, index) == [(0, False, 0)]


def brute(q, refs, ids, k=5):
    d = ((refs.astype("i8") - q) ** 2).sum(1)
    return [(int(ids[i]), int(d[i])) for i in np.lexsort((ids, d))[:k]]


@pytest.mark.parametrize("spread", [3, 10_000])
def test_exact_against_brute_force(spark, spread):
    rng = np.random.default_rng(spread)
    refs, qs = rng.integers(-spread, spread + 1, (700, DIM)), rng.integers(-spread, spread + 1, (60, DIM))
    ids = rng.permutation(5000)[:700]
    r = spark.createDataFrame([(int(i), int(i) % 2, *map(int, x)) for i, x in zip(ids, refs, strict=True)], ", ".join(["orig_id long", "label int", *(f"{q} int" for q in Q)]))
    q = spark.createDataFrame([(i, *map(int, x)) for i, x in enumerate(qs)], ", ".join(["id long", *(f"{q} int" for q in Q)]))
    got = {}
    for x in knn.exact(q, r).orderBy("id", "rank").collect():
        got.setdefault(x["id"], []).append((x["orig_id"], x["dist"]))
    assert got == {i: brute(x, refs, ids) for i, x in enumerate(qs)}


def test_all_probes_are_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (400, DIM)).astype("f4")
    rows = spark.createDataFrame([(int(i % 7), i, i % 2, *map(float, v)) for i, v in enumerate(x)], ROW)
    index = layout.build(rows, np.stack([x[i::7].mean(0) for i in range(7)]))
    q = index[1].select(F.col("orig_id").alias("id"), *Q).join(rows.select(F.col("orig_id").alias("id"), *V), "id").filter("id < 40")
    exact = {r["id"]: r["n"] for r in knn.exact(q, index[1]).groupBy("id").agg(F.sum("label").alias("n")).collect()}
    for nprobe in (7, 50):
        assert {r["id"]: r["fraud_count"] for r in search.search(q, *index, nprobe).collect()} == exact
    for r in search.search(q, *index, 1).filter("refined").collect():
        assert r["fraud_count"] == exact[r["id"]]


def test_probes_break_ties_and_count_empty_clusters(spark):
    index = make_index(spark, [[], [(1, 1)], [(2, 0)]], [0.1, 0.1, 0.5])
    assert [(r["probe"], r["cluster_id"]) for r in search.probes(ask(spark, 0.0), index[0], 2).orderBy("probe").collect()] == [(1, 0), (2, 1)]
    assert search.probes(ask(spark, 0.0), index[0], 0).count() == 3


def test_decisions(spark):
    df = spark.createDataFrame([(i,) for i in [0, 1, 2, 3, 4, 5, 9]], "c int")
    got = [tuple(r) for r in df.select(*decision(F.col("c")), response(F.col("c"))).collect()]
    assert got == [
        (0, True, 0.0, '{"approved":true,"fraud_score":0.0}'),
        (1, True, 0.2, '{"approved":true,"fraud_score":0.2}'),
        (2, True, 0.4, '{"approved":true,"fraud_score":0.4}'),
        (3, False, 0.6, '{"approved":false,"fraud_score":0.6}'),
        (4, False, 0.8, '{"approved":false,"fraud_score":0.8}'),
        (5, False, 1.0, '{"approved":false,"fraud_score":1.0}'),
        (5, False, 1.0, '{"approved":false,"fraud_score":1.0}'),
    ]
    assert assess(spark.createDataFrame([(1, 4)], "id long, fraud_count int")).first()["approved"] is False


def test_confusion(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, False), (False, False)], "r boolean, f boolean")
    assert tuple(evaluate.confusion(df, "r", "f").first()) == (1, 2, 1, 0, 0.25)
    assert tuple(evaluate.confusion(df.limit(0), "r", "f").first()) == (0, 0, 0, 0, 0.0)


def test_scorer_reports_invalid_requests(spark):
    from test_features import bodies

    from quarry.sources import requests

    index = make_index(spark, [[(i, 1) for i in range(5)], [(1000 + i, 0) for i in range(10)]], [0, 0.1])
    scorer = Scorer(index_searcher(*index, 1))
    got = scorer.score(requests.decode(bodies(spark, REQUEST_A, "{}", REQUEST_B))).orderBy("request_key").collect()
    assert [r["status"] for r in got] == [200, 400, 200]
    assert got[1]["body"] is None and got[0]["body"] is not None
    with pytest.raises(ValueError, match="needed"):
        Scorer(None)


def test_requests_without_an_answer_are_errors(spark):
    from test_features import bodies

    from quarry.sources import requests

    some = Scorer(lambda q: q.filter("id = 0").select("id", F.lit(4).alias("fraud_count")))
    got = some.score(requests.decode(bodies(spark, REQUEST_A, REQUEST_B, "{}"))).orderBy("request_key").collect()
    assert [(r["status"], r["fraud_count"]) for r in got] == [(200, 4), (500, None), (400, None)] and got[1]["body"] is None


def test_top_five_by_sorted_lists(spark):
    """The same five by sorting all candidates of a query in one list."""
    rng = np.random.default_rng(11)
    rows = [(int(q), int(d), int(i), int(i) % 2) for q in range(30) for d, i in zip(rng.integers(0, 9, q + 1), rng.permutation(500)[: q + 1], strict=True)]
    found = spark.createDataFrame(rows, "id long, dist long, orig_id long, label int")
    lists = found.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "orig_id", "label"))), 1, 5).alias("five"))
    want = lists.select("id", F.posexplode("five").alias("at", "r")).select("id", (F.col("at") + 1).alias("rank"), "r.orig_id", "r.dist", "r.label")
    assert sorted(map(tuple, knn.top(found).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("n", [1, 2, 8, 23])
def test_nearest_clusters_by_repeated_minima(spark, n):
    """The same probes by taking the nearest cluster, the lowest among equals, n times."""
    rng = np.random.default_rng(n)
    centres = rng.integers(-2, 3, 23) / 4
    index = make_index(spark, [[(1, 1)]] * 23, centres)
    asked = (0.0, 0.25, -0.3)
    got = {(r["id"], r["probe"]): r["cluster_id"] for r in search.probes(ask(spark, *asked), index[0], n).collect()}
    for i, x in enumerate(asked):
        left = {c: (np.float32(x) - np.float32(v)) ** 2 for c, v in enumerate(centres)}
        for k in range(n):
            best = min(left, key=lambda c: (left[c], c))
            assert got[i, k + 1] == best
            del left[best]


def test_blocks_do_not_depend_on_arrow_batches(spark):
    rows = spark.range(0, 5000, 1, 2).select(F.col("id"), (F.col("id") % 3).cast("int").alias("c"), *(F.lit(1).alias(q) for q in Q))
    before, seen = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), []
    try:
        for size in ("10000", "100"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            packed = knn.pack(rows, "id", by="c", block=700).collect()
            seen.append(sorted((r["by"], len(r["ids"]) // 8) for r in packed))
            assert sorted(np.frombuffer(b"".join(r["ids"] for r in packed), "i8").tolist()) == list(range(5000))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert seen[0] == seen[1] and len(seen[0]) == 12 and max(n for _, n in seen[0]) == 700
