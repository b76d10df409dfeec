"""Token ids in a fixed-width, bit-packed file format.

Documents are range-partitioned and sorted by id, encoded, and packed in blocks of whole documents. A block is a row of
a Parquet table (part, block, part_start, first_id, last_id, doc_ids, n_tokens, bits, payload): `payload` holds the ids of the block in the
fewest bits that hold every id of the vocabulary, least significant bit first; `part_start` is the block's offset in its
part in ids; `first_id` and `last_id` (null for null ids alone) let a reader skip other blocks. Offsets of whole parts follow from the table, so any block can be read alone. Parquet carries the blocks to
any store that Spark can write.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import chunks, new_path, pick, text_settings, trimmed

END_ID = 1
#: A block is closed when it holds so many ids; one longer document makes one longer block.
BLOCK_IDS = 1 << 16
#: Encoded words that a worker remembers, as Arrow and numpy arrays; beyond, the half not met for longest is forgotten.
KEEP_WORDS = 600_000
#: Bytes of text that are encoded at once.
CHUNK_BYTES = 4 << 20


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids (unsigned) in `bits` bits each, least significant bit first."""
    ids = np.ascontiguousarray(ids, "<u4")
    if bits == 16:
        return ids.astype("<u2").tobytes()
    return np.packbits(np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int, start: int = 0) -> np.ndarray:
    """n ids from the start-th on, without touching what lies before."""
    if bits == 16:
        return np.frombuffer(data, "<u2", n, start * 2).astype("<u4")
    first, last = start * bits // 8, -(-(start + n) * bits // 8)
    flat = np.unpackbits(np.frombuffer(data, np.uint8, last - first, first), bitorder="little")[start * bits - first * 8 :][: n * bits]
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = flat.reshape(n, bits)
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


#: Byte-level files write bytes that are no visible characters as letters from U+0100 on, in order.
_LETTER_OF = {b: chr(256 + i) for i, b in enumerate([*range(33), *range(127, 161), 173])}


def _classes() -> np.ndarray:
    """Of each byte: 0 white space, 1 a letter or part of a longer character, 2 a digit, 3 anything else."""
    out = np.full(256, 3, "u1")
    out[[*range(9, 14), 32]] = 0
    out[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    out[48:58] = 2
    return out


_CLASS = _classes()
_LOWER = np.array([x + 32 if 65 <= x <= 90 else x for x in range(256)], "u1")
#: Bytes that no plain text holds: controls, and first bytes of all characters but U+00C0 to U+017F.
_ODD = np.array([x < 9 or 13 < x < 32 or x == 127 or x >= 0x80 and not 0x80 <= x < 0xC0 and not 0xC3 <= x <= 0xC5 for x in range(256)])
#: The same for single words, with the three characters among those that are no letters or grow in lower case, and starts of special tokens.
_odd = re.compile(rb"<\||[\x00-\x08\x0e-\x1f\x7f\xc0-\xc2\xc6-\xff]|\xc3[\x97\xb7]|\xc4\xb0").search


def cut(data: np.ndarray) -> pa.Array:
    """Words of UTF-8 bytes as an Arrow array of binaries, in order, as SPLIT finds them after lower-casing A-Z, and where each starts.

    Runs between white space that hold anything but letters U+00C0 to U+017F beyond ASCII, or a control, or "<|", are
    one word each and left as they are: the library splits them.
    """
    kind = _CLASS[data]
    before = np.concatenate([[0], kind[:-1]]).astype("u1")
    some = kind != 0
    start = some & ((kind != before) | (kind == 2))
    after = np.concatenate([data[1:], [32, 32]]).astype("u1") | 32  # the next byte, A-Z in lower case
    quote = np.flatnonzero(start & (data == 39))
    if len(quote):
        one, two = after[quote], after[np.minimum(quote + 1, len(data))]
        short = quote[np.isin(one, [115, 116, 109, 100])]
        long = quote[((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))]
        for at, n in ((short, 1), (long, 2)):
            start[at + 1] = False
            at = at[at + n + 1 < len(data)] + n + 1
            start[at] = some[at]
    at = np.flatnonzero(start)
    odd = _ODD[data]
    odd[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)) | (data[:-1] == 0xC4) & (data[1:] == 0xB0) | (data[:-1] == 60) & (data[1:] == 124)
    odd, lower = np.flatnonzero(odd), _LOWER[data]
    if len(odd):
        runs = np.flatnonzero(some & (before == 0))
        ends = np.append(np.flatnonzero(~some[1:] & some[:-1]) + 1, len(data))[: len(runs)]
        whole = np.zeros(len(runs), bool)
        whole[np.searchsorted(runs, odd, "right") - 1] = True
        run = np.searchsorted(runs, at, "right") - 1
        at = at[~whole[run] | (at == runs[run])]
        edge = np.zeros(len(data) + 1, "i1")
        edge[runs[whole]], edge[ends[whole]] = 1, -1
        lower = np.where(np.cumsum(edge[:-1], dtype="i1") > 0, data, lower)
    offsets = np.append(np.cumsum(some, dtype="i4")[at] - 1, some.sum()).astype("i4")
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(lower[some])]), at


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from first[i] on, n[i] of them, for each i in a row."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + n, n)


class Encoder:
    """A tokenizers file, with the ids of single words remembered.

    Only for files that lower-case, drop white space and split as SPLIT does can words be encoded one by one: a batch of
    texts is cut with numpy, its different words are encoded once, and ids are gathered. Words of no plain Latin letters,
    and all texts of other files, go to the library whole. Both ways give the same ids: no word reaches over white space,
    and no character composes with it.
    """

    SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.of = Tokenizer.from_file(path)
        self.size = self.of.get_vocab_size()
        spec = json.loads(self.of.to_str())
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and split.get("pattern", {}).get("Regex") == self.SPLIT and split.get("invert") is True and spec["pre_tokenizer"]["pretokenizers"][1:] == [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}] and array("I").itemsize == 4
        # remembered words, their ids in a row, the number of ids of each, and the call that met it last
        self.words, self.ids = pa.array([], pa.binary()), np.empty(0, "<u4")
        self.n, self.met, self.calls = np.empty(0, "i8"), np.empty(0, "i8"), 0

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """(ids of all words in a row, number of ids of each) by the library's model, to which the file's steps before it would hand the words as these letters."""
        line = b"\n".join(words)
        letters = line.decode() if line.isascii() else line.decode().lower().encode().decode("latin-1").translate(_LETTER_OF)
        ids, n, search, whole = [], [], self.of.model.tokenize, _odd(line) is not None
        for word, x in zip(words, letters.split("\n" if line.isascii() else _LETTER_OF[10]), strict=True):
            if whole and _odd(word):
                found = self.of.encode(word.decode(), add_special_tokens=False).ids
            else:
                found = [t.id for t in search(x)]
            ids += found
            n.append(len(found))
        return np.array(ids, "<u4"), n

    def _look_up(self, words: pa.Array) -> np.ndarray:
        """Numbers of different words among the remembered ones; new ones are encoded first."""
        self.calls += 1
        if len(self.words) > KEEP_WORDS:
            self._forget(np.flatnonzero(self.met > np.partition(self.met, len(self.met) // 2)[len(self.met) // 2]))
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype("i8")
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = words.take(pa.array(new))
            edge, raw = np.frombuffer(fresh.buffers()[1], "i4")[fresh.offset :][: len(new) + 1].tolist(), fresh.buffers()[2].to_pybytes()
            ids, n = self._encode_words([raw[a:z] for a, z in pairwise(edge)])
            at[new] = len(self.words) + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, fresh])
            self.ids = np.concatenate([self.ids, ids])
            self.n = np.concatenate([self.n, np.array(n, "i8")])
            self.met = np.concatenate([self.met, np.zeros(len(new), "i8")])
        self.met[at] = self.calls
        return at

    def _forget(self, keep: np.ndarray) -> None:
        n = self.n[keep]
        self.ids = self.ids[_ranges((np.cumsum(self.n) - self.n)[keep], n)]
        self.words, self.n, self.met = self.words.take(pa.array(keep)), n, self.met[keep]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, unsigned 32-bit; number of ids of each text). Null counts as empty."""
        if not self.by_word:
            found = [self.of.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]
            return np.fromiter((x for ids in found for x in ids), "<u4"), np.fromiter(map(len, found), "i8", len(found))
        if not len(texts):
            return np.empty(0, "<u4"), np.empty(0, "i8")
        lines = pc.binary_join_element_wise(pc.fill_null(texts, ""), "", "\n").cast(pa.binary())  # a line each
        first = np.frombuffer(lines.buffers()[1], "i4")[lines.offset : lines.offset + len(lines) + 1]
        words, at = cut(np.frombuffer(lines.buffers()[2] or b"", "u1")[first[0] : first[-1]])
        coded = words.dictionary_encode()
        word = self._look_up(coded.dictionary)[coded.indices.to_numpy()]
        n = self.n[word]
        out = self.ids[_ranges((np.cumsum(self.n) - self.n)[word], n)]
        ends = np.cumsum(n)
        upto = np.concatenate([[0], ends])[np.searchsorted(at, first - first[0])]
        return out, np.diff(upto)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, n = self.encode(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(n)[:-1])] if len(texts) else []


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


BLOCKS = "part int, block long, part_start long, first_id long, last_id long, doc_ids array<long>, n_tokens array<int>, bits int, payload binary"
_BLOCKS = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("part_start", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())), ("bits", pa.int32()), ("payload", pa.binary())])


def _packed(path: str, end: int | None, block_ids: int):
    def run(batches):
        part, enc = TaskContext.get().partitionId(), encoder(path)
        bits = bits_for(max(enc.size, (end or 0) + 1))
        block = start = held = 0
        docs: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        parts: list[np.ndarray] = []

        def flush():
            nonlocal block, start, held, docs, sizes, parts
            ends = pc.min_max(pa.chunked_array(docs))
            row = [[part], [block], [start], [ends["min"].as_py()], [ends["max"].as_py()], [pa.concat_arrays(docs)], [np.concatenate(sizes)], [bits], [pack(np.concatenate(parts), bits)]]
            block, start, held, docs, sizes, parts = block + 1, start + held, 0, [], [], []
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _BLOCKS, strict=True)], schema=_BLOCKS)

        for b in chunks(batches, CHUNK_BYTES):
            ids, n = enc.encode(b.column("text"))
            if end is not None:
                ids, n = np.insert(ids, np.cumsum(n), end), n + 1
            upto = np.cumsum(n)
            doc = low = 0
            while doc < len(n):  # documents until the block is full, the one that fills it included
                due = block_ids - held + (upto[doc - 1] if doc else 0)
                to = min(int(np.searchsorted(upto, due)) + 1, len(n))
                docs.append(b.column("doc_id").slice(doc, to - doc))
                sizes.append(n[doc:to].astype("i4"))
                parts.append(ids[low : upto[to - 1]])
                held += int(upto[to - 1]) - low
                doc, low = to, int(upto[to - 1])
                if held >= block_ids:
                    yield flush()
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int | None = END_ID, block_ids: int = BLOCK_IDS, partitions: int | None = None) -> None:
    """Encode (doc_id, text) and write the packed blocks under path, documents in ascending doc_id order.

    Null texts count as empty (only the end id). A null doc_id comes first; rows with the same doc_id follow each other in
    the order of their texts. Texts are never cut. An empty table writes an empty table.
    """
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = docs.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    with text_settings(docs):
        ordered.mapInArrow(trimmed(_packed(tokenizer, end, block_ids)), BLOCKS).write.parquet(path)


def _unpacked(batches):
    for b in chunks(batches, column="payload"):
        for r in b.to_pylist():
            n = np.array(r["n_tokens"], "int64")
            at = np.concatenate([[0], np.cumsum(n)])
            raw = memoryview(unpack(r["payload"], int(at[-1]), r["bits"])).cast("B")
            k = len(n)
            crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, r["part"], "int32")), pa.array(r["doc_ids"], pa.int64()), pa.array(r["part_start"] + at[:-1]), pa.array(n), pa.array(crc, pa.int64())], names=["part", "doc_id", "at", "n_tokens", "ids_crc32"])


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, first): ids in all parts before. One row for each part that was written."""
    parts = spark.read.parquet(path).select("part", "part_start", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.max(F.col("part_start") + F.col("n")).alias("n"))
    return parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("first"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Unpack every block: (doc_id, start, n_tokens, ids_crc32) for each document."""
    blocks = spark.read.parquet(path)
    rows = blocks.mapInArrow(trimmed(_unpacked), "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    # one row for each part: the table of parts is as small as the number of written files
    return rows.join(F.broadcast(part_starts(spark, path)), "part").select("doc_id", (F.col("at") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def _ids(batches):
    for b in chunks(batches, column="payload"):
        for r in b.to_pylist():
            at = np.concatenate([[0], np.cumsum(r["n_tokens"])]).astype("int64")
            ids = [unpack(r["payload"], int(z - a), r["bits"], int(a)).astype("int64") for a, z in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, ids) of all documents, or of some: then only blocks that may hold one of them are read, and only those that do are unpacked."""
    blocks = spark.read.parquet(path)
    if doc_ids is not None:
        # a range that Parquet's own statistics are held against, then each block's list
        low, high = min(map(int, doc_ids), default=0), max(map(int, doc_ids), default=-1)
        blocks = blocks.filter((F.col("first_id") <= high) & (F.col("last_id") >= low)).filter(F.arrays_overlap("doc_ids", F.array(*(F.lit(int(x)) for x in doc_ids)).cast("array<long>")))
    out = blocks.mapInArrow(_ids, "doc_id long, ids array<long>")
    return out if doc_ids is None else out.filter(F.col("doc_id").isin([int(x) for x in doc_ids]))


def public(name: str) -> str:
    """Path of a public vocabulary file that is installed beside the libraries."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", text="text")
    path = new_path(spark, "tokens")
    write_tokens(docs, path, public("word_bpe_49k.json"))
    return read_index(spark, path)
