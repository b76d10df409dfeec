"""Quality rules, and an isolation forest over their statistics.

Random trees split a subsample at random values; a document that few splits set apart is an anomaly. The threshold on the
anomaly score is the one that serves the labelled rows best, where turning a good document away costs as much as keeping
GOOD_COST bad ones.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import chunks, pick, stash, text_settings, trimmed
from quarry.llm.words import FIT_ROWS, Words, labelled_ids

TREES, SUBSAMPLE, DEPTH, SEED = 200, 256, 14, 11
GOOD_COST = 5
#: Bins of the anomaly score in which labelled rows are counted.
BINS = 1 << 14
SYMBOLS = "#*$%&|<>"
_LINE_WORD = re.compile(r"[^\x20\x09-\x0D]").search

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = ["word_length", "symbol_share", "dup_line_share", "repeat_share", "doubled_share", "capital_share", "bare_share", "marked_share"]


def _duplicate_lines(text: str) -> tuple[int, int]:
    seen: set[str] = set()
    n = again = 0
    for line in text.split("\n"):
        if _LINE_WORD(line):
            n += 1
            again += line in seen
            seen.add(line)
    return n, again


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts and shares of each text; null counts as empty, for which all are 0."""
    words = Words(texts)
    n = words.n
    plain = pc.fill_null(texts, "").to_pylist()
    lines = np.array([_duplicate_lines(t) for t in plain], "i8").reshape(-1, 2)
    flag = lambda x: x.to_numpy(zero_copy_only=False).astype("f8")
    u = words.unique
    out = {
        "n_words": n,
        "word_chars": words.sums(pc.utf8_length(u).to_numpy()).astype("i8"),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in plain], "i8"),
        "n_dup_lines": lines[:, 1],
        "n_repeat_words": words.repeated(),
    }
    some = np.maximum(n, 1)
    capital = flag(pc.and_(pc.utf8_is_upper(u), pc.greater(pc.utf8_length(u), 1)))
    bare = flag(pc.invert(pc.match_substring_regex(u, r"[\p{L}\p{N}]")))
    marked = flag(pc.match_substring_regex(u, r"[^\p{L}\p{N}.,;:'’-]"))
    return out | {
        "word_length": out["word_chars"] / some,
        "symbol_share": out["n_symbols"] / np.maximum(out["word_chars"], 1),
        "dup_line_share": lines[:, 1] / np.maximum(lines[:, 0], 1),
        "repeat_share": out["n_repeat_words"] / some,
        "doubled_share": words.doubled() / some,
        "capital_share": words.sums(capital) / some,
        "bare_share": words.sums(bare) / some,
        "marked_share": words.sums(marked) / some,
    }


def _measured(batches):
    for b in chunks(batches):
        s = statistics(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array(s[k], pa.int64()) for k in COUNTS), *(pa.array(s[k], pa.float64()) for k in SHARES)], names=["doc_id", *COUNTS, *SHARES])


class IsolationForest:
    """Trees as arrays; a leaf's children are the leaf itself.

    Grown from good rows, with splits drawn from the whole range that a node covers (all fitted rows give the range of the
    root): bad rows of one kind are many, and splits between the values of a sample would not set them apart.
    """

    def __init__(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, depth: int = DEPTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.size, self.depth = min(subsample, len(rows)), depth
        self.trees = [self._grow(rows[rng.choice(len(rows), self.size, replace=False)], low, high, rng) for _ in range(trees if len(rows) else 0)]

    def _grow(self, rows, low, high, rng):
        feature, value, down, length = [], [], [], []

        def node(x, low, high, depth):
            me = len(feature)
            feature.append(0), value.append(np.inf), down.append([me, me]), length.append(depth + mean_path(len(x)))
            if depth < self.depth and len(x) > 1:
                f = rng.integers(x.shape[1])
                v = rng.uniform(low[f], high[f])
                right = x[:, f] > v
                feature[me], value[me] = f, v
                to, since = high.copy(), low.copy()
                to[f] = since[f] = v
                down[me] = [node(x[~right], low, to, depth + 1), node(x[right], since, high, depth + 1)]
            return me

        node(rows, low, high, 0)
        return np.array(feature), np.array(value), np.array(down), np.array(length)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 to the power of minus mean path length over its expectation: near 1 for anomalies, below 0.5 for the ordinary."""
        if not self.trees or not len(rows):
            return np.zeros(len(rows))
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, value, down, length in self.trees:
            at = np.zeros(len(rows), "i8")
            for _ in range(self.depth):
                at = down[at, (rows[every, feature[at]] > value[at]).astype("i1")]
            total += length[at]
        return 2.0 ** (-total / len(self.trees) / max(mean_path(self.size), 1e-9))


def mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def threshold(scores: np.ndarray, good: np.ndarray, good_cost: float = GOOD_COST, n: np.ndarray | None = None) -> float:
    """The score from which on to reject, at the least cost on labelled rows; without bad rows nothing is rejected.

    With n, scores are the lower ends of bins that hold n rows each, and the threshold is one of them.
    """
    if not good.any() or good.all():
        return np.inf
    order = np.argsort(-scores, kind="stable")
    s, g = scores[order], good[order]
    cost = np.concatenate([[0], np.cumsum(np.where(g, good_cost, -1) * (1 if n is None else n[order]))])
    last = np.concatenate([[True], s[1:] != s[:-1], [True]])  # rows of one score go together
    cost = np.where(last, cost, np.inf)
    k = int(np.argmin(cost))
    return float("inf") if k == 0 else float(s[k - 1] if k == len(s) or n is not None else (s[k - 1] + s[k]) / 2)


def _binned(forest: IsolationForest):
    def run(batches):
        for b in batches:
            score = forest.score(np.stack([b.column(k).to_numpy() for k in SHARES], 1)) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([pa.array((score * BINS).astype("i4")), b.column("quality")], names=["bin", "quality"])

    return run


def _judged(forest: IsolationForest, limit: float):
    def run(batches):
        for b in batches:
            score = forest.score(np.stack([b.column(k).to_numpy() for k in SHARES], 1)) if b.num_rows else np.empty(0)
            failed = (b.column("n_words").to_numpy() < 50) | (100 * b.column("n_repeat_words").to_numpy() > 50 * b.column("n_words").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ["doc_id", *COUNTS]] + [pa.array(failed), pa.array(~failed & (score < limit)), pa.array(score)], names=["doc_id", *COUNTS, "base_failed", "kept", "anomaly"])

    return run


def judge(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text) and labels (doc_id, quality) -> doc_id, the counts, base_failed, kept, anomaly: one row for each row.

    The forest is grown from the good ones of at most `fit_rows` labelled rows that pass the base rules; the range of its
    splits and its threshold (by a histogram of BINS scores) come from all such rows. Where there are none, or none that
    are good, the base rules alone decide. Null and empty texts have no words and fail. Repeated rows and null ids
    stay. Whole texts are read.
    """
    with text_settings(docs):
        measured = stash(docs.select("doc_id", "text").mapInArrow(trimmed(_measured), ", ".join(["doc_id long", *(f"{k} long" for k in COUNTS), *(f"{k} double" for k in SHARES)])), "rules")
    passed = measured.filter("n_words >= 50 and 100 * n_repeat_words <= 50 * n_words").select("doc_id", *SHARES)
    labelled = stash(passed.join(labelled_ids(labels, None), "doc_id").distinct(), "labelled")
    # fit_rows rows at most
    sample = labelled.filter("quality = 1").join(F.broadcast(labelled_ids(labels, fit_rows).select("doc_id")), "doc_id").toPandas().sort_values(["doc_id", *SHARES])
    ends = labelled.agg(*(f(k) for f in (F.min, F.max) for k in SHARES)).first()
    low, high = np.array(ends[: len(SHARES)], "f8"), np.array(ends[len(SHARES) :], "f8")
    forest = IsolationForest(sample[SHARES].to_numpy("f8"), low, high)
    counted = labelled.mapInArrow(_binned(forest), "bin int, quality int").groupBy("bin", "quality").count().collect()  # two rows a bin at most
    bins = np.array([(r["bin"], r["quality"], r["count"]) for r in sorted(counted)], "i8").reshape(-1, 3)
    limit = threshold(bins[:, 0] / BINS, bins[:, 1] == 1, n=bins[:, 2]) if len(sample) else np.inf
    return measured.mapInArrow(_judged(forest, limit), ", ".join(["doc_id long", *(f"{k} long" for k in COUNTS), "base_failed boolean", "kept boolean", "anomaly double"]))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", text="text")
    labels = pick(spark.read.parquet(f"{sf_dir}/labels.parquet"), doc_id="doc_id", quality="quality")
    return judge(docs, labels)
