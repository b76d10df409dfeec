import json

from helpers import REQUEST_A, REQUEST_B

from quarry.__main__ import main


def test_build_and_score(spark, tmp_path, monkeypatch):
    refs = [{"vector": [i / 40] * 14, "label": "fraud" if i % 3 else "legit"} for i in range(40)]
    (tmp_path / "refs.json").write_text(json.dumps(refs))
    (tmp_path / "bodies.jsonl").write_text("\n".join([json.dumps(REQUEST_A), "{}", json.dumps(REQUEST_B)]))
    monkeypatch.setenv("QUARRY_CLUSTERS", "4")
    monkeypatch.setenv("QUARRY_INDEX", f"{tmp_path}/index")
    assert main(["build", f"{tmp_path}/refs.json", f"{tmp_path}/index"]) == 0
    assert main(["score", f"{tmp_path}/bodies.jsonl", f"{tmp_path}/out"]) == 0
    assert sorted(r["status"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [200, 200, 400]
    assert main(["build"]) == 2 and main(["score", "nothing.jsonl", "out"]) == 1
