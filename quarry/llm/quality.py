"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

A word's index vector is the sum of sparse ternary random vectors of the word, its first and last letters and its form,
found by hash, so that every word has one. A frequent word also has a context vector: the sum of the index vectors of its
neighbours. Counts of words and context vectors are those of all documents, labelled or not. A document is the mean of both
over all its words, with how much it repeats itself. A numpy network is fitted on a bounded sample of labelled rows; part of them sets the temperature of its probabilities.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import chunks, pick, scratch, stash, text_settings, trimmed, without
from quarry.llm.words import FIT_ROWS, Words, held_out, labelled_ids

DIM, TABLE, SEED = 32, 1 << 13, 5
#: Words with a context vector, and how far a context reaches.
VOCABULARY, REACH = 4096, 2
HIDDEN, EPOCHS, RATE, DECAY = 24, 400, 0.02, 1e-3
#: One in so many fit rows sets the temperature only.
CALIBRATION = 5
#: Words whose vectors are gathered at once.
BLOCK = 1 << 16


def _table() -> np.ndarray:
    rng = np.random.default_rng(SEED)
    t = np.zeros((TABLE, DIM), "i1")
    for _ in range(4):
        t[np.arange(TABLE), rng.integers(0, DIM, TABLE)] += rng.choice(np.array([-1, 1], "i1"), TABLE)
    return t


_RANDOM = _table()


def _places(parts) -> np.ndarray:
    """Rows of the random table, by the CRC-32 of each string; every different string is hashed once."""
    coded = parts.dictionary_encode()
    crc = np.fromiter(map(zlib.crc32, coded.dictionary.cast(pa.binary()).to_pylist()), "i8", len(coded.dictionary))
    return (crc % TABLE)[coded.indices.to_numpy()] if len(crc) else np.empty(0, "i8")


def index_vectors(words: pa.Array | list[str]) -> np.ndarray:
    """Index vectors of words: whole numbers from -16 to 16, so that four of them add up in a byte."""
    words = pa.array(words, pa.string())
    say = lambda x: pc.if_else(x, "True", "False")
    cut = pc.utf8_slice_codeunits
    first, last, length = cut(words, 0, 1), cut(words, -1), pc.utf8_length(words)
    capitals = pc.and_(pc.greater(length, 1), pc.utf8_is_upper(words))
    mark = pc.if_else(pc.utf8_is_alnum(last), "", last)
    size = pc.min_element_wise(length, pa.scalar(12, pa.int32())).cast(pa.string())
    form = pc.binary_join_element_wise("=", say(pc.utf8_is_upper(first)), say(capitals), mark, say(pc.utf8_is_alpha(words)), size, "")
    start, end = pc.binary_join_element_wise("<", cut(words, 0, 3), ""), pc.binary_join_element_wise(cut(words, -3), ">", "")
    out = _RANDOM[_places(pc.utf8_lower(words))]
    for part in (start, end, form):
        out += _RANDOM[_places(part)]
    return out


class Vectors:
    """Context vectors of the words of a vocabulary."""

    def __init__(self, context: dict[str, np.ndarray]):
        self.vocabulary = pa.array(list(context), pa.string())
        self.matrix = np.zeros((len(context) + 1, DIM), "f4")
        for i, v in enumerate(context.values()):
            self.matrix[i] = v

    def places(self, words: pa.Array) -> np.ndarray:
        """Rows of `matrix`; the last one, zeros, for a word without a context vector."""
        return pc.fill_null(pc.index_in(words, self.vocabulary), len(self.vocabulary)).to_numpy()


FEATURES = 2 * DIM + 4


def pooled(texts: pa.Array, vectors: Vectors) -> np.ndarray:
    """A row of FEATURES for each text; zeros for one without words."""
    words = Words(texts)
    out = np.zeros((len(words.n), FEATURES))
    index, place = index_vectors(words.unique), vectors.places(words.unique)
    for a in range(0, len(words.codes), BLOCK):
        doc, codes = words.doc[a : a + BLOCK], words.codes[a : a + BLOCK]
        starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        out[doc[starts], :DIM] += np.add.reduceat(index[codes], starts, axis=0, dtype="i4")
        out[doc[starts], DIM : 2 * DIM] += np.add.reduceat(vectors.matrix[place[codes]], starts, axis=0, dtype="f8")
    n = np.maximum(words.n, 1)[:, None]
    out[:, : 2 * DIM] /= n
    out[:, 2 * DIM] = words.doubled() / n[:, 0]
    out[:, 2 * DIM + 1] = words.repeated() / n[:, 0]
    out[:, 2 * DIM + 2] = np.sqrt((out[:, :DIM] ** 2).sum(1))
    out[:, 2 * DIM + 3] = np.log1p(words.n) / 10
    return out


def _counted(batches):
    for b in chunks(batches):
        words = Words(b.column("text"))
        yield pa.RecordBatch.from_arrays([words.unique, pa.array(np.bincount(words.codes, minlength=len(words.unique)))], names=["word", "n"])


#: A row of sums that a partition sends on for a word of the vocabulary.
SUMS = [f"d{i}" for i in range(DIM)]


def _contexts(vocabulary: list[str]):
    """A mapInArrow function: for each word of the vocabulary that a partition holds, its number and the sums of its context."""

    def run(batches):
        total, known = np.zeros((len(vocabulary), DIM), "i8"), pa.array(vocabulary, pa.string())
        for b in chunks(batches):
            words = Words(b.column("text"))
            vector, of = index_vectors(words.unique), pc.fill_null(pc.index_in(words.unique, known), -1).to_numpy().astype("i2")
            for a in range(0, len(words.codes), BLOCK):
                low, high = max(0, a - REACH), min(len(words.codes), a + BLOCK + REACH)
                codes, doc = words.codes[low:high], words.doc[low:high]
                # two neighbours on each side: at most 64 from zero, which a byte holds
                v, near = vector[codes], np.zeros((high - low, DIM), "i1")
                for k in range(1, REACH + 1):
                    apart = np.flatnonzero(doc[k:] != doc[:-k])
                    for to, by, edge in ((near[k:], v[:-k], apart + k), (near[:-k], v[k:], apart)):
                        kept = near[edge]
                        to += by
                        near[edge] = kept
                to = of[codes]
                to[: a - low] = to[a + BLOCK - low :] = -1
                order = np.argsort(to, kind="stable")
                order = order[np.searchsorted(to[order], 0) :]
                if len(order):
                    starts = np.flatnonzero(np.concatenate([[True], np.diff(to[order]) != 0]))
                    total[to[order[starts]]] += np.add.reduceat(near[order], starts, axis=0, dtype="i4")
        use = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(use, pa.int32()), *(pa.array(x) for x in total[use].T)], names=["word", *SUMS])

    return run


def contexts(docs: DataFrame) -> dict[str, np.ndarray]:
    """Context vectors, of length 1 or 0, of the VOCABULARY most frequent words of all texts (ties: by code point).

    Two passes over the texts. What a partition sends on are its different words with counts, then VOCABULARY rows of
    sums at most. Words are counted by level, an eighth of a power of two, first: the driver gets those of the levels that
    hold the VOCABULARY most frequent, not as many of every partition.
    """
    texts = docs.select("text")
    with scratch(docs.sparkSession):
        counted = texts.mapInArrow(trimmed(_counted), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
        counted = stash(counted.withColumn("level", F.floor(8 * F.log2("n")).cast("int")), "words")
        levels = sorted(counted.groupBy("level").count().collect(), reverse=True)  # 8 * 63 rows at most
        above = np.cumsum([r["count"] for r in levels])
        least = levels[min(int(np.searchsorted(above, VOCABULARY)), len(levels) - 1)]["level"] if levels else 0
        frequent = counted.filter(F.col("level") >= least).orderBy(F.desc("n"), "word").limit(VOCABULARY)
        vocabulary = [r["word"] for r in frequent.collect()]
    sums = texts.mapInArrow(trimmed(_contexts(vocabulary)), ", ".join(["word int", *(f"{c} long" for c in SUMS)]))
    total = np.zeros((len(vocabulary), DIM))
    for r in sums.groupBy("word").agg(*(F.sum(c) for c in SUMS)).collect() if vocabulary else ():
        total[r[0]] = r[1:]
    length = np.sqrt((total**2).sum(1, keepdims=True))
    return dict(zip(vocabulary, (total / np.maximum(length, 1)).astype("f4"), strict=True))


class Network:
    """Two layers, fitted with Adam on standardised rows; `temperature` divides the logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = SEED):
        self.mean, self.std = x.mean(0), x.std(0) + 1e-6
        rng = np.random.default_rng(seed)
        p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.p, self.temperature = p, 1.0
        hold = np.arange(len(x)) % CALIBRATION == 0
        fit, z, t = ~hold, self._scaled(x), y.astype("f8")
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        for step in range(1, EPOCHS + 1):
            h = np.tanh(z[fit] @ p[0] + p[1])
            off = (_sigmoid(h @ p[2] + p[3]) - t[fit]) / fit.sum()
            back = np.outer(off, p[2]) * (1 - h * h)
            grads = [z[fit].T @ back + DECAY * p[0], back.sum(0), h.T @ off + DECAY * p[2], np.array([off.sum()])]
            for a, g, m1, v1 in zip(p, grads, m, v, strict=True):
                m1 += 0.1 * (g - m1)
                v1 += 0.001 * (g * g - v1)
                a -= RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(v1 / (1 - 0.999**step)) + 1e-8)
        logit = self.logit(x[hold])
        loss = lambda k: np.mean(np.logaddexp(0, logit / k) - t[hold] * logit / k)
        self.temperature = float(min(np.geomspace(0.25, 8, 101), key=loss)) if hold.any() else 1.0

    def _scaled(self, x):
        return np.clip((x - self.mean) / self.std, -8, 8)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self._scaled(x) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logit(x) / self.temperature)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Constant:
    """What is said of every document when the labels hold one class only, or none."""

    def __init__(self, share: float):
        self.share = share

    def probability(self, x):
        return np.full(len(x), self.share)


def _pooled(context):
    def run(batches):
        vectors = Vectors(context.value)
        for b in chunks(batches):
            x = pooled(b.column("text"), vectors)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    return run


def _scored(context, model, keep_text: bool):
    def run(batches):
        vectors = Vectors(context.value)
        for b in chunks(batches):
            names = [c for c in b.schema.names if keep_text or c != "text"]
            p = np.clip(np.round(model.probability(pooled(b.column("text"), vectors)), 6), 0, 1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(p), pa.array((p >= 0.5).astype("i4"))], names=[*names, "score", "predicted"])

    return run


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS):
    """(broadcast context vectors, model): contexts from all documents, the network from at most `fit_rows` labelled rows that are not held out."""
    spark = docs.sparkSession
    # fit_rows rows at most
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(labelled_ids(labels, fit_rows)), "doc_id")
    with scratch(spark), text_settings(docs):
        sample = stash(sample, "sample")
        shares = sample.groupBy("quality").count().collect()
        if len(shares) < 2:  # nothing to tell apart
            return spark.sparkContext.broadcast({}), Constant(float(shares[0]["quality"]) if shares else 0.5)
        # VOCABULARY vectors of DIM numbers
        shared = spark.sparkContext.broadcast(contexts(docs))
        rows = sample.mapInArrow(_pooled(shared), "doc_id long, quality int, x array<double>").toPandas()
    # repeated ids have several texts: the order must not depend on partitions
    x = np.stack(rows["x"].to_list())
    order = np.lexsort((*x.T[::-1], rows["doc_id"].to_numpy()))
    return shared, Network(x[order], rows["quality"].to_numpy()[order])


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, keep_text: bool = False) -> DataFrame:
    """docs (doc_id, text, further columns) -> doc_id, further columns, score, predicted: one row for each row.

    The text stays only with keep_text.
    Whole texts are read, four times in all: write docs first where they are costly to make. Null and empty texts are scored like a text without words. Labels, languages, sources and ids
    are no inputs of a score. Repeated rows and null ids stay. With labels of one class, or none, every score is the share
    of label 1, or 0.5. Columns named score or predicted are replaced.
    """
    docs = without(docs, "score", "predicted")
    context, model = fit(docs, labels, fit_rows)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if keep_text or f.name != "text")
    return docs.mapInArrow(trimmed(_scored(context, model, keep_text)), f"{schema}, score double, predicted int")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", text="text")
    labels = pick(spark.read.parquet(f"{sf_dir}/labels.parquet"), doc_id="doc_id", quality="quality")
    return score(docs, labels).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
