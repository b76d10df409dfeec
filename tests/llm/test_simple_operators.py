"""Sharding, exact dedup, token files, mixing: against brute force on odd rows and on the small tables."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pyarrow.dataset as ds
import pytest

from quarry.llm import exact, mixing, shards, tokens

LONG = "word " * 60_000
ODD = [
    (1, "a b", "en", "s2"), (2, "ab", "en", "s1"), (3, " a\tb\n", "en", None), (3, " a\tb\n", "en", None), (4, None, None, None), (5, "", "en", "s1"),
    (6, " \n ", "en", "s1"), (None, "ab", "en", "s1"), (None, None, None, None), (7, LONG, "en", "s1"), (8, LONG + "x", "de", "Ä"), (9, "ß é", "de", "s1"),
    (10, "ß é", "de", "s1"), (11, "ßé", "de", "s1"), (12, "日本 語", "ja", "s2"), (13, "a\x00b", "en", "s2"), (14, "Ab", "en", "s2"),
]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def strip(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def exact_brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(strip(r[1]), []).append(r)
    out = []
    for norm, g in groups.items():
        first = sorted(g, key=lambda r: (-len(r[1] or ""), r[0] is not None, r[0] or 0))[0]
        out += [(r[0], first[0], len(g), hashlib.sha256(norm.encode()).hexdigest()) for r in g]
    return sorted(out, key=str)


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_exact_dedup(docs, partitions):
    got = exact.content_sort(docs(ODD).toDF("doc_id", "text", *"bcdef"), partitions).collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=str) == exact_brute(ODD)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in got}) == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_dedup_of_one_large_group_over_many_partitions(spark):
    rows = [(i, "same text " * (1 + i % 3)) for i in range(3000)] + [(9000 + i, f"own {i}") for i in range(300)]
    got = exact.content_sort(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), 30).collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=str) == exact_brute(rows)
    assert sum(r["kept"] for r in got) == 303


def test_exact_dedup_query(spark, sf):
    documents = ds.dataset(f"{sf}/documents.parquet").to_table()  # noqa: F841
    got = exact.op8_exact_dedup(spark, sf)
    want = duckdb.sql(exact.OP8_SQL)
    assert sorted(map(tuple, got.collect())) == sorted(want.select(", ".join(got.columns)).fetchall())


def test_queries_on_odd_and_empty_tables(spark, folder):
    sf = folder(ODD)
    for run in (exact.op8_exact_dedup, shards.op3_shards, mixing.op1_mixing, tokens.op10_token_files):
        assert run(spark, sf).count() == len(ODD)
    sf = folder([])
    for run in (exact.op8_exact_dedup, shards.op3_shards, mixing.op1_mixing, tokens.op10_token_files):
        assert run(spark, sf).count() == 0


def test_shards(spark, folder):
    got = shards.op3_shards(spark, folder(ODD)).collect()
    text = {}
    for r in ODD:
        text.setdefault(r[0], []).append((len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())))
    for r in got:
        assert (r["size"], r["text_crc32"]) in text[r["doc_id"]] and r["law"] == "key"
        assert r["grown_shard"] in (r["shard"], 24)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert len({r["shard"] for r in got if r["doc_id"] == 3}) == 1


def test_shards_are_even_shuffled_and_repeatable(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "id % 100 as size", "cast(id as string) as shard")
    a = shards.shuffle_into_shards(df, bucket_bytes=8000).orderBy("doc_id").collect()
    b = shards.shuffle_into_shards(df.repartition(3), bucket_bytes=8000).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["shard"], r["slot"]) for r in a] == [(r["doc_id"], r["shard"], r["slot"]) for r in b]
    n = np.bincount([r["shard"] for r in a], minlength=24)
    assert abs(n / n.mean() - 1).max() < 0.15
    moved = [r for r in a if r["grown_shard"] != r["shard"]]
    assert all(r["grown_shard"] == 24 for r in moved) and 0.025 < len(moved) / len(a) < 0.06
    for s in range(24):
        order = [r["doc_id"] for r in sorted((r for r in a if r["shard"] == s), key=lambda r: r["slot"])]
        assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.15


def test_slots_do_not_depend_on_partitions(spark):
    """Many shuffle partitions or few, coalesced or not, rows in any order: the same slots; one more shard takes what grown_shard says."""
    rows = [(i, i % 100, str(i)) for i in range(1500)] + [(None, 5, str(i)) for i in range(400)] + [(7, 50, "same")] * 100
    df = spark.createDataFrame(rows, "doc_id long, size long, text string")
    seen, names = [], ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(k, None) for k in names]
    try:
        for n, together in ((4, "true"), (9, "false"), (200, "true"), (200, "false")):
            spark.conf.set(names[0], str(n))
            spark.conf.set(names[1], together)
            got = shards.shuffle_into_shards(df.repartition(n % 7 + 1), shards=6, bucket_bytes=2500)
            seen.append(sorted(map(str, got.select("doc_id", "text", "shard", "bucket", "slot").collect())))
    finally:
        for k, v in zip(names, before, strict=True):
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert seen[0] == seen[1] == seen[2] == seen[3] and len(seen[0]) == len(rows)
    as_said = {(r["doc_id"], r["text"], r["grown_shard"]) for r in got.collect()}
    assert as_said == {(r["doc_id"], r["text"], r["shard"]) for r in shards.shuffle_into_shards(df, shards=7).collect()}


def test_the_shard_is_the_highest_of_seeded_hashes(spark):
    """Recomputed with another implementation of the hash, chained over key, seed and shard as Spark chains it."""
    import xxhash

    def h(value, size, seed):
        return xxhash.xxh64_intdigest(value.to_bytes(size, "little", signed=True), seed)

    got = shards.shuffle_into_shards(spark.range(300).selectExpr("id as doc_id", "id as size"), shards=5).collect()
    for r in got:
        hashes = [h(k, 4, h(shards.SEED, 4, h(r["doc_id"], 8, 42))) for k in range(5)]
        signed = [x - (1 << 64) if x >> 63 else x for x in hashes]
        assert r["shard"] == signed.index(max(signed))


def test_written_shards_hold_whole_records_in_slot_order(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}", i + 9) for i in range(300)], "doc_id long, text string, size long")
    back = shards.write_shards(df, f"{tmp_path}/s", shards=4)
    assert sorted((r["doc_id"], r["text"]) for r in back.collect()) == sorted((i, f"text {i}") for i in range(300))
    one = [r["slot"] for r in spark.read.parquet(f"{tmp_path}/s/shard=2/bucket=0").collect()]
    assert one == list(range(len(one)))


def test_a_common_key_or_row_does_not_fill_a_bucket(spark):
    rows = [(None, f"text {i}", 100) for i in range(600)] + [(7, "same", 100)] * 600 + [(i, f"t {i}", 100) for i in range(100, 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size long")
    runs = [shards.shuffle_into_shards(x, shards=2, bucket_bytes=9_000).collect() for x in (df, df.repartition(7))]
    assert sorted(map(tuple, runs[0]), key=str) == sorted(map(tuple, runs[1]), key=str)
    for doc in (None, 7):
        at = [(r["shard"], r["bucket"]) for r in runs[0] if r["doc_id"] == doc]
        assert len(at) == 600 and len({s for s, _ in at}) == 1
        assert max(at.count(x) for x in set(at)) < 150
    for s in (0, 1):
        assert sorted(r["slot"] for r in runs[0] if r["shard"] == s) == list(range(sum(r["shard"] == s for r in runs[0])))


def test_the_shard_query_reads_what_it_wrote(spark, folder, monkeypatch):
    wrote = []
    write = shards.write_shards
    monkeypatch.setattr(shards, "write_shards", lambda df, path, **o: (wrote.append(path), write(df, path, **o))[1])
    got = shards.op3_shards(spark, folder(ODD))
    back = spark.read.parquet(wrote[0])
    assert sorted((r["text"] for r in back.collect()), key=str) == sorted((r[1] for r in ODD), key=str)
    assert {f.rsplit("/shard=", 1)[0].removeprefix("file://") for f in got.inputFiles()} == {wrote[0].removeprefix("file:")}


def test_packing():
    rng = np.random.default_rng(0)
    for bits in (1, 2, 7, 8, 13, 16, 17, 31, 32):
        ids = rng.integers(0, 2**bits, 777).astype("u4")
        data = tokens.pack(ids, bits)
        assert len(data) == -(-777 * bits // 8)
        assert (tokens.unpack(data, 777, bits) == ids).all() and (tokens.unpack(data, 50, bits, 701) == ids[701:751]).all()
    assert [tokens.bits_for(n) for n in (1, 2, 3, 49_408, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]


TRICKY = ["It's we'll 'S 12½ ª¹ Straße ŉ ſ İx Σας <|endoftext|> é", "日本 áb \x85 \xa0 x", "''s 're're don't!'s --'d", "a\x1cb\x00c", "ÀÉ ﬁ K Å ǅ", "x" * 3000, "$$$'s ... '"]


def test_encoder_is_the_library():
    e = tokens.Encoder(tokens.public("word_bpe_49k.json"))
    assert e.by_word
    for t, got in zip(TRICKY, e(TRICKY), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == e.of.encode(t, add_special_tokens=False).ids
    other = tokens.Encoder(tokens.public("byte_bpe_50k.json"))
    assert not other.by_word and np.frombuffer(other(["Hello  World"])[0], "<u4").tolist() == other.of.encode("Hello  World", add_special_tokens=False).ids


def test_token_files(spark, folder):
    rows = ODD + [(100 + i, t) for i, t in enumerate(TRICKY)]
    got = sorted(tokens.op10_token_files(spark, folder(rows)).collect(), key=lambda r: r["start"])
    of = tokens.Encoder(tokens.public("word_bpe_49k.json")).of
    start = 0
    for r, (doc, text, *_) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())), strict=True):
        ids = np.array([*of.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert tuple(r) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_blocks_and_random_access(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text number {i} " * (i % 5)) for i in range(200)], "doc_id long, text string")
    model = tokens.public("word_bpe_49k.json")
    tokens.write_tokens(df, f"{tmp_path}/t", model, block_ids=64, partitions=3)
    of = tokens.Encoder(model).of
    assert spark.read.parquet(f"{tmp_path}/t").count() > 10
    got = {r["doc_id"]: r["ids"] for r in tokens.read_tokens(spark, f"{tmp_path}/t", [7, 123, 9999]).collect()}
    assert got == {i: [*of.encode(f"text number {i} " * (i % 5), add_special_tokens=False).ids, 1] for i in (7, 123)}
    assert tokens.read_tokens(spark, f"{tmp_path}/t").count() == 200
    assert tokens.read_tokens(spark, f"{tmp_path}/t", []).count() == 0
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = tokens.read_tokens(spark, f"{tmp_path}/t", [7])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "LessThanOrEqual(first_id,7)" in plan and "GreaterThanOrEqual(last_id,7)" in plan


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    assert mixing.targets([10, 1000], [1, 1]) == pytest.approx([30, 980])
    assert mixing.targets([1, 1, 100], [3, 3, 1]) == pytest.approx([3, 3, 96])
    assert mixing.targets([0, 5], [1, 1]) == pytest.approx([0, 5]) and mixing.targets([], []) == []


def test_mix(spark, folder):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(0, 400)), "en", ["a", "b", None, "zz", "Ä"][min(4, int(rng.integers(0, 12)))]) for i in range(1500)]
    got = mixing.op1_mixing(spark, folder(rows)).collect()
    again = mixing.op1_mixing(spark, folder(rows)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    text = {r[0]: r for r in rows}
    order = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(len(words(r[1])) for r in rows if r[3] == s) for s in order}
    want = dict(zip(order, mixing.targets([size[s] for s in order], [i % 3 + 1 for i in range(len(order))]), strict=True))
    taken = dict.fromkeys(order, 0)
    for r in got:
        s = text[r["doc_id"]][3]
        assert r["size"] == len(words(text[r["doc_id"]][1])) and r["source_size"] == size[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in order:
        assert taken[s] == pytest.approx(want[s], rel=0.01, abs=3)


def test_rates_are_the_solution_of_the_dual(spark):
    """Each source's lambda by plain bisection, and copies within what rounding moves of the tilted rates."""
    rng = np.random.default_rng(8)
    rows = [(i, s, int(x)) for s, n in (("a", 900), ("b", 500), ("c", 300)) for i, x in enumerate(rng.integers(1, 60, n))]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).toPandas()
    sizes = {s: np.array([r[2] for r in rows if r[1] == s], "f8") for s in "abc"}
    whole, left = sum(x.sum() for x in sizes.values()), 6
    for i, s in enumerate("abc"):
        want = whole * (i + 1) / left
        assert want < 3 * sizes[s].sum()  # no source is at its cap here
        low, high = -5.0, 5.0
        for _ in range(200):
            lam = (low + high) / 2
            taken = (sizes[s] * np.minimum(3, np.exp(lam * sizes[s] / sizes[s].mean()))).sum()
            low, high = (lam, high) if taken < want else (low, lam)
        part = got[got.source == s]
        assert part.target.iloc[0] == pytest.approx(want) and part.taken.sum() == pytest.approx(want, abs=1.5)
        rate = part.groupby("size").copies.agg(["sum", "count"])
        ideal = rate["count"] * np.minimum(3, np.exp(lam * rate.index / sizes[s].mean()))
        off = abs(rate["sum"] - ideal)  # a stratum is rounded, and takes over what the one above it could not
        assert (off <= 0.5 + 0.5 * (rate.index + 1) / rate.index + 1e-9).all()


def test_what_does_not_converge_is_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_STEPS", 1)
    with pytest.raises(ArithmeticError):
        mixing.mix(spark.createDataFrame([(i, s, 1 + i % 9) for i in range(90) for s in "abc"], "doc_id long, source string, size long"))


def test_mix_of_a_common_id_and_clashing_names(spark):
    rows = [(None, "a", 4, 1, "x", 9)] * 900 + [(i, "b", 5, i, "y", 9) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, n long, rank string, Taken int")
    runs = [mixing.mix(x) for x in (df, df.repartition(5))]
    assert runs[0].columns == ["doc_id", "source", "size", "n", "rank", "source_size", "target", "copies", "taken"]
    a, b = (sorted(map(str, x.collect())) for x in runs)
    assert a == b and len(a) == 1200
    taken = {s: sum(r["taken"] for r in runs[0].collect() if r["source"] == s) for s in "ab"}
    assert taken["a"] == pytest.approx(1700, abs=5) and taken["b"] == pytest.approx(3400, abs=5)


def test_mix_tilts_by_size(spark):
    """Rates follow exp(lambda * size): a source to shrink gives up its long documents first."""
    df = spark.createDataFrame([(i, s, 1 + i % 50) for i in range(6000) for s in ("a", "b", "c")], "doc_id long, source string, size long")
    got = mixing.mix(df).toPandas()
    a = got[got.source == "a"]
    assert a[a["size"] <= 10].copies.mean() > a[a["size"] > 40].copies.mean() + 0.2
    rate = a.groupby("size").copies.mean()
    assert np.corrcoef(np.log(rate), rate.index)[0, 1] < -0.999


def test_mix_at_the_cap_and_hot_stratum(spark):
    df = spark.createDataFrame([(i, "a", 3) for i in range(40)] + [(i, "b", 5) for i in range(20_000)], "doc_id long, source string, size long")
    got = mixing.mix(df).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert {r["source"]: r["sum(taken)"] for r in got} == {"a": 360, "b": pytest.approx(100_120 - 360, abs=5)}
