import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import kmeans, layout
from quarry.operators.prng import Generator
from quarry.plans.config import BuildConfig, ScoreConfig
from quarry.plans.jobs import build_index
from quarry.schemas import DIM, V
from quarry.sources import index_files
from quarry.sources.references import encode_label, read_json


def vectors(spark, x, labels=None):
    rows = [(i, int(labels[i]) if labels is not None else i % 2, *map(float, v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, ", ".join(["orig_id long", "label int", *(f"{v} float" for v in V)]))


def test_generator():
    g = Generator()
    assert [g.word() for _ in range(4)] == [11168841808386496181, 17908038078831184416, 4943492530845968623, 1718140749318456402]
    g, h = Generator(), Generator()
    assert [g.below(15) for _ in range(4)] == [13, 11, 8, 3]
    assert [h.unit() for _ in range(4)] == [0.6054641276399784, 0.9707966895010954, 0.2679872670804532, 0.09314059665234709]
    assert Generator().below(0) == 0


def plain_training(x, k, iterations):
    """The same training, row by row."""
    g = Generator()
    ids = [g.below(len(x)) for _ in range(len(x))]
    sample = x[ids]
    dist = lambda a, b: sum(np.float32(0) + (a[:, j] - b[j]) * (a[:, j] - b[j]) for j in range(DIM))
    centres, low = [sample[g.below(len(sample))]], np.full(len(sample), 1e30, "f4")
    while len(centres) < k:
        low = np.minimum(low, dist(sample, centres[-1]))
        total = 0.0
        for d in low:
            total += float(d)
        r, upto, chosen = g.unit() * total, 0.0, len(sample) - 1
        for i, d in enumerate(low):
            upto += float(d)
            if upto >= r:
                chosen = i
                break
        centres.append(sample[chosen])
    centres, old = np.stack(centres), np.full(len(x), -1)
    for _ in range(iterations):
        new = np.array([int(np.argmin([dist(v[None], c)[0] for c in centres])) for v in x])
        for c in range(k):
            if (new == c).any():
                centres[c] = x[new == c].astype("f8").mean(0)
        changed, old = (new != old).sum(), new
        if changed * 1000 < len(x):
            break
    return centres, old


def test_training(spark):
    x = np.random.default_rng(3).uniform(-1, 1, (150, DIM)).astype("f4")
    want, cluster = plain_training(x, 6, 4)
    got, assigned = kmeans.train(vectors(spark, x), 6, 4)
    np.testing.assert_allclose(got, want, atol=1e-6)
    assert [r["cluster_id"] for r in assigned.orderBy("orig_id").collect()] == cluster.tolist()


def test_training_stops_and_keeps_empty_clusters(spark):
    x = np.zeros((8, DIM), "f4")
    centres, assigned = kmeans.train(vectors(spark, x), 3, 50)
    assert (centres == 0).all() and assigned.select("cluster_id").distinct().collect() == [(0,)]


def test_training_refuses(spark):
    x = vectors(spark, np.zeros((2, DIM), "f4"))
    for k, iterations in ((0, 1), (4097, 1), (1, 0)):
        with pytest.raises(ValueError):
            kmeans.train(x, k, iterations)
    with pytest.raises(ValueError, match="no vectors"):
        kmeans.train(x.limit(0), 1, 1)


def test_far_vectors_go_to_cluster_zero():
    assert kmeans.nearest(np.full((1, DIM), 1e16, "f4"), np.zeros((2, DIM), "f4")).tolist() == [0]


def built(spark, n=75, k=4):
    rng = np.random.default_rng(n)
    x = rng.uniform(-1, 1, (n, DIM)).astype("f4")
    rows = vectors(spark, x).withColumn("cluster_id", (F.col("orig_id") % 3).cast("int"))  # cluster 3 stays empty
    return layout.build(rows, rng.uniform(-1, 1, (k, DIM)).astype("f4"))


def test_layout(spark):
    clusters, rows = built(spark)
    got = {r["cluster_id"]: r for r in clusters.collect()}
    assert [got[c]["n"] for c in range(4)] == [25, 25, 25, 0]
    assert [got[c]["row_offset"] for c in range(4)] == [0, 25, 50, 75]
    assert [got[c]["block_offset"] for c in range(4)] == [0, 4, 8, 12]
    assert (got[3]["lo0"], got[3]["hi13"]) == (0, 0)
    place = layout.places(rows).filter("cluster_id = 1").orderBy("orig_id").collect()
    assert [(r["position"], r["block"], r["lane"]) for r in place] == [(i, i // 8, i % 8) for i in range(25)]
    assert layout.validate(clusters, rows).first().asDict() == {"unknown_clusters": 0, "wrong_counts": 0, "wrong_offsets": 0, "wrong_blocks": 0, "wrong_block_offsets": 0, "unsound_rows": 0, "rows": 75}


def test_validation_finds_damage(spark):
    clusters, rows = built(spark)
    assert layout.validate(clusters.filter("cluster_id <> 2"), rows).first()["unknown_clusters"] == 1
    assert layout.validate(clusters, rows.filter("orig_id <> 4")).first()["wrong_counts"] == 1
    assert layout.validate(clusters.withColumn("row_offset", F.col("row_offset") + 1), rows).first()["wrong_offsets"] == 4
    assert layout.validate(clusters.withColumn("blocks", F.col("blocks") + 1), rows).first()["wrong_blocks"] == 4
    assert layout.validate(clusters.withColumn("block_offset", F.col("block_offset") + 1), rows).first()["wrong_block_offsets"] == 4
    odd = F.when(F.col("orig_id") % 10 == 0, 2).when(F.col("orig_id") % 10 == 1, None).otherwise(F.col("label"))
    assert layout.validate(clusters, rows.withColumn("label", odd)).first()["unsound_rows"] == 16


def test_round_trips(spark, tmp_path):
    clusters, rows = built(spark)
    index_files.write(clusters, rows, f"{tmp_path}/index")
    clusters2, rows2 = index_files.read(spark, f"{tmp_path}/index")
    data = index_files.to_bytes(clusters2, rows2)
    assert len(data) == layout.estimate_bytes(clusters).first()["bytes"]
    clusters3, rows3 = index_files.from_bytes(spark, data)
    assert sorted(rows3.select(rows.columns).collect()) == sorted(rows.collect())
    assert sorted(clusters3.select(clusters.columns).collect()) == sorted(clusters.collect())


def test_binary_file(spark, tmp_path):
    clusters, rows = built(spark)
    assert index_files.write_file(clusters, rows, f"{tmp_path}/index.bin") == layout.estimate_bytes(clusters).first()["bytes"]
    index_files.write_file(clusters, rows, f"{tmp_path}/index.bin")  # again, over the first
    clusters2, rows2 = index_files.read_file(spark, f"{tmp_path}/index.bin")
    assert sorted(rows2.select(rows.columns).collect()) == sorted(rows.collect())
    assert sorted(clusters2.select(clusters.columns).collect()) == sorted(clusters.collect())
    (tmp_path / "empty").write_bytes(b"")
    with pytest.raises(ValueError, match="empty"):
        index_files.read_file(spark, f"{tmp_path}/empty")


def test_empty_round_trip(spark):
    clusters, rows = built(spark)
    empty = layout.build(spark.createDataFrame([], ", ".join(["orig_id long", "label int", "cluster_id int", *(f"{v} float" for v in V)])), np.zeros((2, DIM), "f4"))
    assert index_files.from_bytes(spark, index_files.to_bytes(*empty))[1].count() == 0
    assert layout.estimate_bytes(clusters.limit(0)).first()["n"] == 0


def test_broken_files(spark):
    data = index_files.to_bytes(*built(spark))
    broken = [b"", data[:10], b"XXXX" + data[4:], data[:4] + b"\x09" + data[5:], data[:16] + b"\x0d" + data[17:], data[:-1], data + b"\0", data[:8] + b"\x01" + data[9:]]
    for x in broken:
        with pytest.raises(ValueError):
            index_files.parse(x)


def test_build_job(spark, tmp_path):
    x = np.random.default_rng(9).uniform(-1, 1, (120, DIM)).astype("f4")
    facts = build_index(vectors(spark, x), f"{tmp_path}/index", BuildConfig(5, 3))
    assert facts["n"] == facts["rows"] == 120 and facts["k"] == 5


def test_references_from_json(spark, tmp_path):
    rows = [{"vector": [0.5] * 14, "label": "fraud"}, {"vector": [1.0], "label": "legit"}, {"vector": [0.1] * 20, "label": "Fraud"}]
    with gzip.open(f"{tmp_path}/refs.json.gz", "wt") as f:
        json.dump(rows, f)
    got = read_json(spark, f"{tmp_path}/refs.json.gz").orderBy("orig_id").collect()
    assert [(r["orig_id"], r["label"], r["q0"], r["q13"]) for r in got] == [(0, 1, 5000, 5000), (1, 0, 10000, 0), (2, 0, 1000, 1000)]
    with open(f"{tmp_path}/one.json", "w") as f:
        json.dump(rows[0], f)
    with pytest.raises(Exception, match="must be a JSON array"):
        read_json(spark, f"{tmp_path}/one.json").collect()
    assert spark.createDataFrame([("fraud",), ("x",), (None,)], "l string").select(encode_label(F.col("l"))).collect() == [(1,), (0,), (0,)]


def test_references_in_parts_and_with_nested_fields(spark, tmp_path):
    rows = [{"vector": [i / 3000], "label": "fraud" if i % 7 == 0 else 'le"g[i],t'} for i in range(3000)]
    want = [(i, int(i % 7 == 0), round(i / 3000 * 10000)) for i in range(3000)]
    (tmp_path / "wide.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "nested.json").write_text(json.dumps([r | {"more": {"a": 1}} for r in rows]))
    (tmp_path / "none.json").write_text(" [ ]\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        for name in ("wide", "nested"):
            got = read_json(spark, f"{tmp_path}/{name}.json")
            assert [tuple(r) for r in got.orderBy("orig_id").select("orig_id", "label", "q0").collect()] == want
        assert spark.read.option("lineSep", "}").text(f"{tmp_path}/wide.json").rdd.getNumPartitions() > 1
        assert read_json(spark, f"{tmp_path}/none.json").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "cut.json").write_text(json.dumps(rows)[:-30])
    with pytest.raises(Exception):
        read_json(spark, f"{tmp_path}/cut.json").count()


def test_configs():
    assert BuildConfig.from_env({}) == BuildConfig(512, 10) and BuildConfig.from_env({"QUARRY_CLUSTERS": "7"}).clusters == 7
    for bad in ({"QUARRY_CLUSTERS": "0"}, {"QUARRY_CLUSTERS": "4097"}, {"QUARRY_ITERATIONS": "x"}, {"QUARRY_SEED": "-1"}):
        with pytest.raises(ValueError):
            BuildConfig.from_env(bad)
    assert ScoreConfig.from_env({}).nprobe == 8
    for bad in ({"QUARRY_NPROBE": "0"}, {"QUARRY_INDEX": " "}):
        with pytest.raises(ValueError):
            ScoreConfig.from_env(bad)
