"""SimHash near-dedup by covering locality-sensitive hashing.

Each of the 64 bits has a non-zero vector of radius + 1 bits; for each non-zero vector v a mask keeps the bits whose
vector is at odds with v. At most `radius` differing bits give at most `radius` linear conditions on v, so some v fulfils
them all and its mask hides every differing bit: each pair within the radius meets in some table. Equal fingerprints are
one node. A bucket yields a spanning forest, never all pairs; buckets of more than SPLIT fingerprints are split by a
second and a third family of masks, which keep the same guarantee.

Near copies by similarity (`near_copies`) differ in more bits than one set of masks can cover. There the fingerprint has
128 bits; masks cover five bits of each half of the first 64 (126 tables), so that every pair meets of which one half
differs in at most five, which holds for all pairs within 11 bits and for most beyond; all 128 bits then decide which
pairs are candidates, and whole shingle sets which candidates are copies.
"""

from __future__ import annotations

import random
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import batch_rows, chunks, pick, stash, text_settings, trimmed, without
from quarry.llm.components import components

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42
#: Distinct fingerprints of a bucket that one task compares.
SPLIT = 1 << 13
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_CHUNK = 1 << 16


def _hashes(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """Hash of each shingle of a text, repeats included; one for fewer words than a shingle, none without words."""
    words = _WORDS((text or "").encode().translate(_LOWER))
    if not words:
        return np.empty(0, "u8")
    line = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(line, seed)], "u8")
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    pieces = (line[a:z] for a, z in zip(starts, stops, strict=True))
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), "u8", n)


def _again(h: np.ndarray) -> np.ndarray:
    """Further 64 bits of each hash, mixed from it."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes; 0 for none."""
    ones = np.zeros(BITS, "i8")
    for i in range(0, len(h), _CHUNK):
        ones += np.unpackbits(h[i : i + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype="i8")
    return int(np.packbits(ones * 2 > len(h)).view(">u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of the whole text; 0 for null or no words."""
    return _majority(_hashes(text, shingle, seed))


def wide_fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> tuple[int, int]:
    """The fingerprint, and 64 further bits from other bits of the same shingles."""
    h = _hashes(text, shingle, seed)
    return _majority(h), _majority(_again(h))


def _prints(shingle: int, seed: int, wide: bool):
    def run(batches):
        for b in chunks(batches):
            texts = b.column("text").to_pylist()
            if wide:
                both = np.array([wide_fingerprint(t, shingle, seed) for t in texts], "u8").reshape(-1, 2).T
            else:
                both = np.fromiter((fingerprint(t, shingle, seed) for t in texts), "u8", len(texts))[None]
            names = [c for c in b.schema.names if c != "text"]
            made = [pa.array(np.ascontiguousarray(x).view("i8")) for x in both]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *made], names=[*names, *("fp", "more")[: len(made)]])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, wide: bool = False) -> DataFrame:
    """docs with fp (the fingerprint as a signed long), and with `wide` more (its further bits), in place of text."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    return docs.mapInArrow(trimmed(_prints(shingle, seed, wide)), f"{schema}, fp long" + ", more long" * wide)


def _spread(radius: int, top: int) -> list[int]:
    """Vectors of which no mask keeps few bits: a Reed-Muller code (32 bits and more) for radius 6, with a bent function (28 and more) for 7."""
    if radius > 7:
        return random.Random(0).sample(range(1, top + 1), BITS)
    bent = [(i & i >> 1 & 1) ^ (i >> 2 & i >> 3 & 1) ^ (i >> 4 & i >> 5 & 1) for i in range(BITS)]
    return [64 + i + (128 * bent[i] if radius > 6 else 0) for i in range(BITS)]


def covering_masks(radius: int = RADIUS, family: int = 0) -> list[int]:
    """2^(radius+1) - 1 masks of 64 bits; any `radius` bits are outside at least one of them. Families differ in the bits' vectors."""
    top = (1 << (radius + 1)) - 1
    vectors = [i % top + 1 for i in range(BITS)] if top < BITS else _spread(radius, top)
    if family:
        random.Random(family).shuffle(vectors)
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, top + 1)]


#: Half a fingerprint's bits, and how many of them may differ.
HALF, HALF_RADIUS = 32, 5
#: Of all 128 bits, those in which candidates may differ. A similarity of 0.8 differs in 19 on average, seldom in more than 28.
WIDE_RADIUS = 28


def half_masks(family: int = 0) -> list[int]:
    """126 masks: any HALF_RADIUS bits of a half are outside at least one mask of that half. Each keeps 16 bits or the whole half."""
    vectors = [HALF + i for i in range(HALF)]  # with a leading one, so that every other vector is at odds with half of them, or all
    if family:
        random.Random(family).shuffle(vectors)
    masks = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, 2 * HALF)]
    return [m << shift for shift in (0, HALF) for m in masks]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(nodes: DataFrame, masks: list[int], within: Column | None) -> DataFrame:
    """nodes with key: one for each table; what shares a key only by a hash collision is told apart by the comparison."""
    keys = F.array(*(F.xxhash64(*([within] if within is not None else []), F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for t, m in enumerate(masks)))
    return nodes.select(F.explode(keys).alias("key"), *(c for c in nodes.columns if c != "key"))


def _near(radius: int):
    """Whether fingerprints (arrays of one column) are within the radius of others."""

    def close(x, y):
        return np.bitwise_count(x[:, 0] ^ y[..., 0]) <= radius

    return close


def _near_half(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether wide fingerprints (arrays of two columns) have a near half and are near over all bits."""
    d, more = x[:, 0] ^ y[..., 0], x[:, 1] ^ y[..., 1]
    low, high = np.bitwise_count(d & np.uint64(0xFFFFFFFF)), np.bitwise_count(d >> np.uint64(HALF))
    return (np.minimum(low, high) <= HALF_RADIUS) & (low + high + np.bitwise_count(more) <= WIDE_RADIUS)


def _forest(ids: np.ndarray, bits: np.ndarray, close) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges (id, smallest of its component) that connect rows, sorted by id, as all close pairs would."""
    a, b, left = [], [], np.arange(len(ids))
    while len(left) > 1:
        root, front, left = left[0], [left[0]], left[1:]
        while front and len(left):
            near = close(bits[left], bits[front.pop()])
            if near.any():
                found, left = left[near], left[~near]
                front.extend(found)
                a.append(ids[found])
                b.append(np.full(len(found), ids[root]))
    return a, b


#: Rows of a bucket whose pairs are compared for many buckets at once.
SMALL = 64


def _bucket_edges(key, ids, bits, close) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges of whole buckets, rows sorted by key and id."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(starts, len(key)))
    bucket = np.repeat(np.arange(len(starts)), size)
    some, low, high = size > SMALL, [], []
    at = np.flatnonzero(~some[bucket])
    for k in range(1, int(size[~some].max(initial=0))):
        i = at[: len(at) - k] if k < len(at) else at[:0]
        i = i[(i + k < len(key)) & (bucket[i] == bucket[np.minimum(i + k, len(key) - 1)])]
        if not len(i):
            break
        i = i[close(bits[i + k], bits[i])]
        low.append(i)
        high.append(i + k)
    low, high = (np.concatenate(x) if x else np.empty(0, "i8") for x in (low, high))
    pairs = np.bincount(bucket[low], minlength=len(starts)) if len(low) else np.zeros(len(starts), "i8")
    few = pairs[bucket[low]] < 3 if len(low) else np.empty(0, bool)
    a, b = [ids[high[few]]], [ids[low[few]]]
    for i in np.flatnonzero(some | (pairs > 2)):
        part = slice(starts[i], starts[i] + size[i])
        x, y = _forest(ids[part], bits[part], close)
        a += x
        b += y
    return a, b


def _compared(names: list[str], close, split: int | None):
    """Rows (key, id, bits), sorted: edges (a, b) of each bucket, or, of a bucket of more than `split`, its rows (a, null, key, bits)."""

    def out(a, b, big):
        a, b = (np.concatenate(x) if x else np.empty(0, "i8") for x in (a, b))
        key, ids, bits = (np.concatenate(x) for x in zip(*big, strict=True)) if big else (np.empty(0, "i8"), np.empty(0, "i8"), np.empty((0, len(names)), "u8"))
        n, m = len(b), len(key)
        later = lambda x: pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(np.ascontiguousarray(x).view("i8"))])
        columns = [pa.array(np.concatenate([a, ids])), pa.concat_arrays([pa.array(b), pa.nulls(m, pa.int64())]), later(key), *(later(x) for x in bits.T)]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "key", *names])

    def run(batches):
        held = None  # rows of the bucket that may go on in the next batch
        large = None  # the bucket already found too large
        for batch in batches:
            if not batch.num_rows:
                continue
            key, ids = batch.column("key").to_numpy(), batch.column("id").to_numpy()
            bits = np.stack([batch.column(c).to_numpy() for c in names], 1).view("u8")
            if held is not None:
                key, ids, bits = np.concatenate([held[0], key]), np.concatenate([held[1], ids]), np.concatenate([held[2], bits])
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(starts[1:], len(key))
            if split is None:
                big = np.zeros(len(starts), bool)
            else:
                big = (ends - starts > split) | (key[starts] == large if large is not None else False)
            held = None
            if big[-1]:
                large = key[-1]
            else:
                held = tuple(x[starts[-1] :].copy() for x in (key, ids, bits))
            size = ends - starts
            whole = ~np.repeat(big, size)
            whole[starts[-1] :] = False
            gone = np.repeat(big, size)
            a, b = _bucket_edges(key[whole], ids[whole], bits[whole], close) if whole.any() else ([], [])
            yield out(a, b, [(key[gone], ids[gone], bits[gone])] if gone.any() else [])
        if held is not None:
            yield out(*_bucket_edges(*held, close), [])

    return run


def links(nodes: DataFrame, masks, close, split: int = SPLIT) -> DataFrame:
    """(id, fp, perhaps further bits), ids distinct longs -> (a, b): edges that connect exactly what close pairs connect.

    `masks(family)` gives the tables. Keys travel once, sorted by bucket; a task reads its buckets as a stream and holds at most `split` rows of one. Larger
    buckets go through further families of masks inside the bucket; what three families leave together is compared as it is.
    """
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [c for c in nodes.columns if c != "id"]
    schema = "a long, b long, key long, " + ", ".join(f"{c} long" for c in names)
    # a small table that grows by the number of tables: spread before it is exploded
    members, edges = nodes.repartition(n), None
    for family in range(3):
        keys = _keys(members, masks(family), F.col("key") if family else None)
        ordered = keys.repartition(n, "key").sortWithinPartitions("key", "id")
        with batch_rows(nodes, 1 << 16):
            found = stash(ordered.select("key", "id", *names).mapInArrow(trimmed(_compared(names, close, split if family < 2 else None)), schema), "links")
        some = found.filter("b is not null").select("a", "b")
        edges = some if edges is None else edges.union(some)
        members = found.filter("b is null").select(F.col("a").alias("id"), *names, "key")
        if family == 2 or not members.take(1):
            return edges.distinct()
    raise AssertionError


def near_links(prints: DataFrame, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """(fp) distinct -> (a, b): edges between fingerprints that connect what pairs within the radius connect."""
    return links(prints.select(F.col("fp").alias("id"), "fp"), lambda family: covering_masks(radius, family), _near(radius), split)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text, further columns) -> doc_id, further columns, fp, root, component_id: one row for each row.

    root is the smallest fingerprint of a component (as a signed long) and so names it; component_id is the smallest doc_id reachable over fingerprints that differ in at most `radius` bits. Null, empty and
    blank texts have fingerprint 0 and are linked like any other. A text of fewer words than a shingle is one shingle.
    Rows with a null doc_id take part and stay; component_id is null where no row of the component has an id. Repeated
    rows stay. Columns named as the new ones are replaced. An empty table gives an empty one.
    """
    docs = without(docs, "fp", "root", "component_id")
    with text_settings(docs):
        prints = stash(fingerprints(docs, shingle, seed), "prints")
    reps = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "reps")
    linked = components(near_links(reps.select("fp"), radius)).withColumnRenamed("node", "fp").join(reps, "fp")
    linked = stash(linked, "linked")
    lowest = stash(linked.groupBy("root").agg(F.min("first").alias("component_id")), "lowest")
    named = reps.join(linked.join(lowest, "root").select("fp", "root", "component_id"), "fp", "left")
    named = stash(named.select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first").alias("component_id")), "named")
    return prints.join(named, "fp").select(*(c for c in prints.columns if c != "fp"), "fp", "root", "component_id")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", text="text")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# near copies: candidates within a radius, verified by their shingles

#: Rows and bytes of shingle sets that a block of a candidate group holds on average.
BLOCK_ROWS, BLOCK_BYTES = 1 << 10, 1 << 20


def shingle_set(text: str | None, shingle: int, seed: int = SEED) -> np.ndarray:
    """Sorted hashes of the different shingles of a text; one for fewer words than a shingle, none without words."""
    return np.unique(_hashes(text, shingle, seed))


def _sets(shingle: int):
    def run(batches):
        for b in chunks(batches):
            sets = [shingle_set(t, shingle).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "text"), pa.array(sets, pa.binary())], names=[*(c for c in b.schema.names if c != "text"), "set"])

    return run


def similar(a: list[np.ndarray], b: list[np.ndarray] | None, least: float) -> list[tuple[int, int]]:
    """Pairs of sets with a Jaccard similarity of at least `least` (1 for two empty ones) that connect what all such pairs do.

    Pairs of a set of a and one of b, numbered on from a; without b, pairs inside a. Every pair is looked at, through an
    inverted index.
    """
    sizes = np.array([len(x) for x in (a if b is None else b)], "i8")
    values = np.concatenate(a if b is None else b)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = 0 if b is None else len(a)
    label, out = np.arange(first + len(sizes)), []
    for i, x in enumerate(a):
        low = np.searchsorted(values, x, "left")
        n = np.searchsorted(values, x, "right") - low
        at = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
        both = np.bincount(owner[at], minlength=len(sizes))
        union = len(x) + sizes - both
        alike = first + np.flatnonzero((union == 0) | (both / np.maximum(union, 1) >= least))
        alike = alike[label[alike] != label[i]]
        if len(alike):
            merged, one = np.unique(label[alike], return_index=True)
            out += [(i, int(j)) for j in alike[one]]
            label[np.isin(label, merged)] = label[i]
    return out


def _verified(least: float):
    """Rows (a, b), lists of (id, set), b null for pairs inside a -> edges (a, b) of similar rows."""

    def lists(rows):
        return [r["id"] for r in rows or ()], [np.frombuffer(r["set"], "u8") for r in rows or ()]

    def run(batches):
        for batch in batches:
            x, y = [], []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                (ids, sets), (more, others) = lists(a.as_py()), lists(b.as_py())
                ids = ids + more
                for i, j in similar(sets, others if b.is_valid else None, least):
                    x.append(ids[i])
                    y.append(ids[j])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return run


def candidate_groups(docs: DataFrame, shingle: int) -> DataFrame:
    """(text, at) -> (at, root): rows linked, directly or over others, by wide fingerprints with a near half. Equal ones are one node."""
    with text_settings(docs):
        prints = stash(fingerprints(docs.select("at", "text"), shingle, wide=True), "prints")
    reps = stash(prints.select("fp", "more").distinct().withColumn("id", F.monotonically_increasing_id()), "reps")
    linked = stash(components(links(reps.select("id", "fp", "more"), half_masks, _near_half)).toDF("id", "root"), "linked")
    named = reps.join(linked, "id", "left").select("fp", "more", F.coalesce("root", "id").alias("root"))
    return prints.join(named, ["fp", "more"]).select("at", "root")


def near_copies(docs: DataFrame, shingle: int, least: float) -> DataFrame:
    """(doc_id, text, at), at naming the row -> (at): the rows to drop.

    Inside a group of candidates every pair is held against `least` by its shingle sets, whatever its bits; rows linked by
    similar pairs, directly or over others, are one group of copies, of which the one with the smallest doc_id stays (a
    null one last, then the smallest `at`). So nothing goes that no similar pair links; a similar pair may be missed only
    if both halves of its fingerprints differ in more than HALF_RADIUS bits, or all bits in more than WIDE_RADIUS, and no
    other rows link it. Large groups are dealt into blocks, and each pair of blocks is one row of work. Null, empty and
    blank texts have no shingles and are copies of each other.
    """
    found = stash(candidate_groups(docs, shingle), "found")
    groups = stash(found.groupBy("root").count().filter("count > 1").select("root"), "groups")
    rows = docs.select("at", "doc_id", "text").join(found.join(groups, "root", "left_semi"), "at")
    rows = rows.select(F.monotonically_increasing_id().alias("id"), "at", "doc_id", "root", "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    with text_settings(docs):
        rows = stash(rows.mapInArrow(trimmed(_sets(shingle)), f"{schema}, set binary"), "sets")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum(F.octet_length("set")) / BLOCK_BYTES)).cast("int")
    sized = stash(rows.groupBy("root").agg(blocks.alias("blocks")), "sized")
    dealt = rows.join(sized, "root").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    packed = stash(dealt.groupBy("root", "blocks", "block").agg(F.collect_list(F.struct("id", "set")).alias("a")), "blocks")
    inside = packed.select("a", F.lit(None).cast(packed.schema["a"].dataType).alias("b"))
    many = packed.filter("blocks > 1")
    low = many.select("root", F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "a").filter("i < j")
    high = many.select("root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.col("block").alias("j"), F.col("a").alias("b")).filter("i < j")
    with batch_rows(docs, 8):
        pairs = stash(inside.union(low.join(high, ["root", "i", "j"]).select("a", "b")).mapInArrow(trimmed(_verified(least)), "a long, b long"), "similar")
    linked = components(pairs).withColumnRenamed("node", "id").withColumnRenamed("root", "copies")
    linked = stash(rows.select("id", "at", "doc_id").join(linked, "id"), "copies")
    first = linked.groupBy("copies").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at")).alias("first"))
    return linked.select("at").join(first.select("first.at"), "at", "left_anti")
