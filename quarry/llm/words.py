"""Words of a batch of texts as numbers, and rows of a bounded labelled sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACES = " \t\n\x0b\x0c\r"
#: Labelled rows that a model is fitted on, at most.
FIT_ROWS = 8000
#: Rows whose CRC has this remainder by 3 are held out of every fit.
HELD_OUT = 1


class Words:
    """codes: each word of the batch as an index into `unique`; doc: its text; n: words of each text."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        trimmed = pc.ascii_trim(texts, _SPACES)
        split = pc.ascii_split_whitespace(trimmed)
        flat = split.flatten()
        self.doc = split.value_parent_indices().to_numpy()
        some = pc.binary_length(trimmed).to_numpy() > 0
        if not some.all():  # an empty text splits into one empty word
            keep = some[self.doc]
            flat, self.doc = flat.filter(pa.array(keep)), self.doc[keep]
        coded = flat.dictionary_encode()
        self.codes = coded.indices.to_numpy()
        self.unique = coded.dictionary
        self.n = np.bincount(self.doc, minlength=len(texts)).astype("i8")

    def sums(self, of_unique: np.ndarray) -> np.ndarray:
        """Sum of a number of each unique word over the words of each text."""
        return np.bincount(self.doc, of_unique[self.codes], len(self.n))

    def repeated(self) -> np.ndarray:
        """Words of each text that stand in a three-word window found twice or more in it."""
        c, doc = self.codes.astype("i8"), self.doc
        if len(c) < 4:
            return np.zeros(len(self.n), "i8")
        size = len(self.unique)
        pair = c[:-2] * size + c[1:-1]
        if size >= 1 << 21:
            pair = np.unique(pair, return_inverse=True)[1]
        key = np.where(doc[:-2] == doc[2:], pair * size + c[2:], -1)
        order = np.argsort(key, kind="stable")
        k, d = key[order], doc[order]
        same = (k[1:] == k[:-1]) & (d[1:] == d[:-1]) & (k[1:] >= 0)
        found = np.zeros(len(key), bool)
        found[order[1:][same]] = True
        found[order[:-1][same]] = True
        word = np.zeros(len(c), bool)
        for i in range(3):
            word[i : i + len(found)] |= found
        return np.bincount(doc[word], minlength=len(self.n)).astype("i8")

    def doubled(self) -> np.ndarray:
        """Words of each text that equal the word before them."""
        same = (self.codes[1:] == self.codes[:-1]) & (self.doc[1:] == self.doc[:-1])
        return np.bincount(self.doc[1:][same], minlength=len(self.n)).astype("i8")


def held_out(doc_id):
    """Whether the CRC-32 of the id as text leaves the remainder HELD_OUT by 3. A null id counts as empty text: it does not."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == HELD_OUT


def labelled_ids(labels: DataFrame, rows: int | None = FIT_ROWS) -> DataFrame:
    """(doc_id, quality) of at most `rows` labelled documents that are not held out, chosen by hash; of all without `rows`.

    Null ids and labels other than 0 and 1 are left out; a document with both labels counts as 0.
    """
    use = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    use = use.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    return use if rows is None else use.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
