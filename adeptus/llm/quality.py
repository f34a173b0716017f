"""Quality classifier: hashed word n-grams, logistic regression trained by FTRL.

Tokens are words and runs of symbols, so both vocabulary and junk marks
count.  A document's features are its distinct unigrams and bigrams (a word and
the same word again is one bigram for all words) hashed into
``2**bits`` dimensions, each with the value ``sqrt(count)``, scaled to unit
length.  Training is follow-the-regularised-leader (per-coordinate rates, L1
and L2), one document at a time; scoring is a sparse dot product, for many
documents at once.

Training takes a bounded sample of the labelled rows (``max_train``, a
parameter, chosen by a hash of the id); scoring reads every whole text.
Labels, ids and other columns are never inputs.  A null or empty text has no
features and gets the score of the intercept.  Null labels and ids aren't
learnt from; of a repeated label the smallest counts; without any labelled row
every score is 0.5.  Repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adeptus.llm.shared import by_batches
from adeptus.llm.textblock import POWER, TextBlock, column_bytes, mix, slices, sums_by

BITS = 18
#: The bigram of a word and itself, one feature whichever word it is.
REPEAT = np.uint64(0x5851F42D4C957F2D)


@dataclass
class Model:
    """Weights by hashed feature, and the intercept."""

    weights: np.ndarray
    bias: float


def features(block: TextBlock, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, value, first): the features of row d are ``first[d]:first[d+1]``."""
    n = len(block.hash)
    pair = np.zeros(0, np.uint64)
    pair_doc = np.zeros(0, np.int64)
    if n > 1:
        same = block.doc[1:] == block.doc[:-1]
        left, right = block.hash[:-1][same], block.hash[1:][same]
        pair = np.where(left == right, REPEAT, mix(left * POWER + right))
        pair_doc = block.doc[1:][same]
    index = np.concatenate((block.hash, pair)) >> np.uint64(64 - bits)
    key = (np.concatenate((block.doc, pair_doc)).astype(np.uint64) << np.uint64(bits)) | index
    key, count = np.unique(key, return_counts=True)
    row = (key >> np.uint64(bits)).astype(np.int64)
    first = np.searchsorted(row, np.arange(block.rows + 1))
    value = np.sqrt(count)
    norm = np.sqrt(np.maximum(sums_by(value * value, first), 1e-12))
    return (key & np.uint64((1 << bits) - 1)).astype(np.int64), value / norm[row], first


def train(texts: pa.Array, labels: np.ndarray, bits: int, steps: int = 25_000, alpha: float = 0.5,
          beta: float = 1.0, l1: float = 0.05, l2: float = 0.01) -> Model:
    """FTRL-proximal over the rows in order, again and again for about ``steps`` rows, at most 50 times."""
    epochs = min(50, max(1, round(steps / max(len(labels), 1))))
    z, n, w = (np.zeros(1 << bits) for _ in range(3))
    z0 = n0 = w0 = 0.0
    offsets, raw = column_bytes(texts)
    rows = []
    for lo, hi in slices(offsets):
        index, value, first = features(TextBlock(offsets, raw, lo, hi, symbols=True), bits)
        rows += [(index[a:b].astype(np.int32), value[a:b]) for a, b in zip(first[:-1], first[1:])]
    for _ in range(epochs if len(set(labels.tolist())) > 1 else 0):
        for (index, value), y in zip(rows, labels):
            zi, ni = z[index], n[index]
            wi = np.where(np.abs(zi) <= l1, 0.0,
                          -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            w0 = -z0 / ((beta + np.sqrt(n0)) / alpha + l2)
            p = 1 / (1 + np.exp(-np.clip(wi @ value + w0, -35, 35)))
            g = (p - y) * value
            z[index] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * wi
            n[index] = ni + g * g
            g0 = p - y
            z0 += g0 - (np.sqrt(n0 + g0 * g0) - np.sqrt(n0)) / alpha * w0
            n0 += g0 * g0
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return Model(w, float(-z0 / ((beta + np.sqrt(n0)) / alpha + l2)))


def scores(model: Model, offsets: np.ndarray, raw: np.ndarray, bits: int) -> np.ndarray:
    out = np.empty(len(offsets) - 1)
    for lo, hi in slices(offsets):
        index, value, first = features(TextBlock(offsets, raw, lo, hi, symbols=True), bits)
        margin = sums_by(model.weights[index] * value, first) + model.bias
        out[lo:hi] = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, learn: Column, max_train: int,
                    id_col: str = "doc_id", text_col: str = "text", by_label: bool = False) -> DataFrame:
    """(text, label, place): at most ``max_train`` labelled texts, those of smallest id hash.

    ``by_label`` takes up to ``max_train`` of each label 0 and 1.  The ids are
    bounded by that parameter before the texts are joined to them.
    """
    kept = (labels.select(F.col(id_col).alias("k"), F.col(label_col).alias("label"))
            .filter("k IS NOT NULL AND label IS NOT NULL").groupBy("k").agg(F.min("label").alias("label"))
            .filter(learn).withColumn("place", F.xxhash64("k")))
    if by_label:
        parts = [kept.filter(F.col("label") == v).orderBy("place", "k").limit(max_train) for v in (0, 1)]
        kept = parts[0].unionAll(parts[1])
    else:
        kept = kept.orderBy("place", "k").limit(max_train)
    texts = docs.select(F.col(id_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(kept), "k").select("text", F.col("label").cast("double"), "place", "k")


def fit(sample: DataFrame, bits: int = BITS) -> Model:
    """Train on a bounded sample, in one task; the model comes back to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        model = train(table.column("text").combine_chunks(), np.array(table.column("label")), bits)
        at = np.flatnonzero(model.weights)
        yield pa.RecordBatch.from_arrays(
            [pa.array([at.astype("<i4").tobytes()]), pa.array([model.weights[at].astype("<f8").tobytes()]),
             pa.array([model.bias])], names=["at", "weights", "bias"])

    ordered = sample.repartition(1).sortWithinPartitions("place", "k", "text")
    rows = by_batches(ordered, run, "at binary, weights binary, bias double").collect()
    weights = np.zeros(1 << bits)
    if not rows:
        return Model(weights, 0.0)
    weights[np.frombuffer(rows[0]["at"], "<i4")] = np.frombuffer(rows[0]["weights"], "<f8")
    return Model(weights, rows[0]["bias"])


def score(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] = ("doc_id",),
          out: str = "score") -> DataFrame:
    """The columns ``carry`` of every row of ``docs``, and its score as ``out``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    bits = int(np.log2(len(model.weights)))
    names = [*carry] if text_col in carry else [*carry, text_col]
    at, n = names.index(text_col), len(carry)
    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scores(shipped.value, *column_bytes(batch.column(at)), bits)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(found)], names=[*carry, out])

    return by_batches(docs.select(*names), run, schema)
