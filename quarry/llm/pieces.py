"""SentencePiece encoding and decoding with a unigram search.

An Aho-Corasick automaton over the pieces walks the text once; at each position the output links name every piece that
ends there, and each relaxes the best score of the prefix that ends there (Viterbi). A character that no one-character
piece covers costs as much as the worst piece and UNKNOWN more, and is written as its bytes. Scores are those of the
given model file; a file of merge pieces is thus searched for its best total score, where the library replays the merges:
over half of all different words come out otherwise. With the file's model type set to unigram, the library differs in
about one word of 200, and its total score is then the worse one.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import chunks, pick, trimmed
from quarry.llm.tokens import public

#: What a character without a piece costs beyond the worst score.
UNKNOWN = 10.0
MARK = "▁"
#: Encoded chunks that a worker remembers before it forgets those not met since as many others, and the longest of them.
KEEP, KEEP_LENGTH = 100_000, 48
BYTE_TYPE, NORMAL_TYPES = 6, (1, 4)
_NEVER = float("-inf")


class Pieces:
    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.normalizer_spec.name != "identity" or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only files that leave the text as it is are supported")
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.pieces = [p.piece for p in model.pieces]
        self.of_byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE_TYPE}
        self.byte_of = {i: b for b, i in self.of_byte.items()}
        self.silent = {i for i, p in enumerate(model.pieces) if p.type == 3}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        automaton, least, inside = ahocorasick.Automaton(), 0.0, False
        for i, p in enumerate(model.pieces):
            if p.type in NORMAL_TYPES:
                automaton.add_word(p.piece, (len(p.piece), p.score, i))
                least = min(least, p.score)
                inside |= bool(re.search(f"[^{MARK}]{MARK}", p.piece))
        automaton.make_automaton()
        self.automaton, self.penalty = automaton, least - UNKNOWN
        self.single = frozenset(p.piece for p in model.pieces if p.type in NORMAL_TYPES and len(p.piece) == 1)
        #: No piece reaches over the start of a marked run, so that the best path of a text is that of its chunks in a row.
        held = {c for p in self.pieces for c in p}
        alone = "".join(c for c in "\n\t\r\v\f" if c not in held)  # nor over a character that is in no piece
        self.chunks = re.compile(".+" if inside else f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]+" if alone else ""), re.S).findall
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def search(self, chunk: str) -> list[int]:
        """Ids of the best path. Among equal scores the one with the longest last piece, and so on backwards."""
        if not self.single.issuperset(chunk):
            return self._with_unknown(chunk)
        n = len(chunk)
        best, last = [_NEVER] * n + [0.0], [(0, 0)] * n  # best[-1] is the empty prefix
        for end, (size, score, i) in self.automaton.iter(chunk):  # at each end the longest first: its own output, then the output links
            now = best[end - size] + score
            if now > best[end]:
                best[end], last[end] = now, (size, i)
        out, at = [], n - 1
        while at >= 0:
            size, i = last[at]
            out.append(i)
            at -= size
        return out[::-1]

    def _with_unknown(self, chunk: str) -> list[int]:
        """The same where some characters have no piece of their own and may stand for themselves."""
        n, ends = len(chunk), {}
        for end, found in self.automaton.iter(chunk):
            ends.setdefault(end, []).append(found)
        best, last = [0.0] * (n + 1), [(1, -1)] * (n + 1)
        for end in range(n):
            now, way = _NEVER, (1, -1)
            for size, score, i in ends.get(end, ()):
                if best[end + 1 - size] + score > now:
                    now, way = best[end + 1 - size] + score, (size, i)
            if chunk[end] not in self.single and best[end] + self.penalty > now:
                now, way = best[end] + self.penalty, (1, -1)
            best[end + 1], last[end + 1] = now, way
        out, at = [], n
        while at:
            size, i = last[at]
            if i >= 0:
                out.append(i)
            elif self.of_byte:
                out.extend(self.of_byte[x] for x in reversed(chunk[at - 1].encode("utf-8", "surrogatepass")))
            else:
                out.append(self.unknown)
            at -= size
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, "i4")
        marked = (MARK if self.prefix else "") + text.replace(" ", MARK)
        if len(self.known) > KEEP:
            self.before, self.known = self.known, {}
        known, chunks = self.known, self.chunks(marked)
        out = list(map(known.get, chunks))
        if None in out:
            for k, c in enumerate(chunks):
                if out[k] is None:
                    ids = known.get(c) or self.before.get(c) or np.array(self.search(c), "i4").tobytes()
                    if len(c) <= KEEP_LENGTH:
                        known[c] = ids
                    out[k] = ids
        return np.frombuffer(b"".join(out), "i4")

    @property
    def raw(self) -> list[bytes]:
        """The bytes that each id stands for."""
        if not hasattr(self, "_raw"):
            self._raw = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.silent else " ⁇ ".encode() if i == self.unknown else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        return self._raw

    def decode(self, ids) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


_OUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("decoded_crc32", pa.int64()), ("exact", pa.bool_())])


def _encoded(path: str):
    def run(batches):
        model = pieces(path)
        for b in chunks(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            ids = [model.encode(t) for t in texts]
            at = np.cumsum([0, *map(len, ids)]).astype("i4")
            back = [model.decode(x.tolist()) for x in ids]
            columns = [b.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids) if ids else np.empty(0, "i4"))), pa.array(np.diff(at).astype("i8")), pa.array([zlib.crc32(x.encode()) for x in back], pa.int64()), pa.array([x == t.replace(MARK, " ") for x, t in zip(back, texts, strict=True)])]
            yield pa.RecordBatch.from_arrays(columns, schema=_OUT)

    return run


def _decoded(path: str):
    def run(batches):
        model = pieces(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([model.decode(x or []) for x in b.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return run


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) -> doc_id, ids, n_tokens, decoded_crc32 (of the ids decoded again), exact (whether that is the text).

    Whole texts of any length. Null and empty texts have no ids. A mark of the vocabulary (U+2581) in a text cannot be
    told from a space; it decodes to a space, and `exact` takes it as one. Repeated rows and null ids stay.
    """
    return docs.select("doc_id", "text").mapInArrow(trimmed(_encoded(model)), "doc_id long, ids array<int>, n_tokens long, decoded_crc32 long, exact boolean")


def decode(ids: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text). Null ids give an empty text."""
    return ids.select("doc_id", "ids").mapInArrow(_decoded(model), "doc_id long, text string")


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", text="text")
    return encode(docs, public("piece_bpe_32k.model"))
