import json
import os

from helpers import REQUEST_A, REQUEST_B, REQUEST_C
from test_search import make_index

from quarry.plans.jobs import Scorer, index_searcher
from quarry.sources import requests
from quarry.sources.shared import scratch, shared_dir, stash
from quarry.streaming.scoring import parquet_writer, score_stream


def tables(spark):
    path = f"{shared_dir(spark)}/quarry".removeprefix("file:")
    return sorted(os.listdir(path)) if os.path.isdir(path) else []


def test_scopes(spark):
    left = tables(spark)
    with scratch(spark):
        first = stash(spark.range(3), "x")
        with scratch(spark):
            assert stash(first, "y").count() == 3
        assert first.count() == 3 and len(tables(spark)) == len(left) + 1
    assert tables(spark) == left


def test_stream_equals_batch(spark, tmp_path):
    bodies = [(i, json.dumps(x)) for i, x in enumerate([REQUEST_A, REQUEST_B, {}, REQUEST_C])]
    df = spark.createDataFrame(bodies, "request_key long, body string")
    for i in range(2):
        df.filter(f"request_key % 2 = {i}").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    left = tables(spark)
    index = make_index(spark, [[(i, 1) for i in range(5)], [(1000 + i, 0) for i in range(10)]], [0, 0.1])
    scorer = Scorer(index_searcher(*index, 1))
    source = spark.readStream.schema("request_key long, body string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = score_stream(requests.decode(source), scorer, parquet_writer(f"{tmp_path}/out"), f"{tmp_path}/checkpoint", availableNow=True)
    q.awaitTermination(120)
    assert q.exception() is None
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    assert tables(spark) == left  # batches leave nothing behind
    assert sorted(map(str, got.collect())) == sorted(map(str, scorer.score(requests.decode(df)).collect()))
