"""Language identification by language-bitmask n-gram filters.

For every language the n-grams (``GRAM`` bytes of lower-cased words, borders
included) that occur in enough of its training documents are put into one
bit-sliced Bloom filter: rows of 64-bit masks in which bit l % 64 of a slot of row
l // 64 belongs to language l.  Looking an n-gram up at ``HASHES`` slots and AND-ing the masks
returns all languages that have it, at once.

A text's n-grams give a count per language (population counts of each bit
over all its masks).  A filter of fill ``f`` answers yes by chance with
``f ** HASHES``; counts are corrected for that, and the largest decides.  The score is
the winner's share of the corrected counts above the runner-up's, scaled to 0-1.

Training reads a bounded sample (``max_train`` documents a language, by a hash
of the id), each language in a task of its own; the n-grams kept come to the
driver.  The number of languages isn't bounded.  Prediction reads every whole
text.  Null languages and ids aren't learnt from.  A text that is null or has
no letter is ``und`` with score 0, and so is every text if nothing was learnt;
a text whose n-grams no language knows gets the most frequent language, score
0.  Ties go to the more frequent language, then by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adeptus.llm.shared import written
from adeptus.llm.textblock import BYTE_KEY, CLASS, LOWER, POWER, WORD, column_bytes, mix, slices, sums_by

GRAM = 4
HASHES = 3
SLOT_BITS = 20
#: Part of a language's training documents that an n-gram must occur in.
LEAST_SHARE = 0.04
#: Languages in one mask.
MASK = 64


@dataclass
class Model:
    """The languages, most frequent first, the table of masks (a row for 64 languages), and each language's chance hits."""

    languages: list[str]
    table: np.ndarray
    chance: np.ndarray


def grams(offsets: np.ndarray, raw: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first): the n-grams of row d are ``first[d]:first[d+1]``.

    Bytes that aren't part of a word count as one border, and so do a row's
    start and end; an n-gram has at least two bytes of words and no border inside.
    """
    base = offsets[lo]
    size = np.diff(offsets[lo:hi + 1])
    offsets = offsets[lo:hi + 1] - base + 2 * np.arange(hi - lo + 1)
    n = int(offsets[-1])
    buf = np.zeros(n, np.uint8)                        # a border before and after each row
    buf[np.arange(n - 2 * len(size)) + np.repeat(2 * np.arange(len(size)) + 1, size)] = LOWER[raw[base:base + n - 2 * len(size)]]
    if n < GRAM:
        return np.zeros(0, np.uint64), np.zeros(hi - lo + 1, np.int64)
    word = CLASS[buf] == WORD
    word &= (buf < 48) | (buf > 57)                    # digits tell nothing
    key = np.where(word, BYTE_KEY[buf], np.uint64(1))
    m = n - GRAM + 1
    h = np.zeros(m, np.uint64)
    for k in range(GRAM):
        h = h * POWER + key[k:m + k]
    good = word[1:m + 1].copy()
    for k in range(2, GRAM - 1):
        good &= word[k:m + k]
    at = np.flatnonzero(good)
    return mix(h[at]), np.searchsorted(at, offsets)


def slots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """``HASHES`` places of each n-gram, from disjoint parts of its hash."""
    mask = np.uint64((1 << bits) - 1)
    return [((h >> np.uint64(k * (64 - bits) // max(1, HASHES - 1))) & mask).astype(np.int64) for k in range(HASHES)]


def kept_grams(texts: pa.Array) -> np.ndarray:
    """Hashes of the n-grams that occur in enough of one language's texts."""
    offsets, raw = column_bytes(texts)
    seen = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for lo, hi in slices(offsets):
        h, first = grams(offsets, raw, lo, hi)
        doc = np.repeat(np.arange(hi - lo, dtype=np.uint64), np.diff(first))
        pairs = np.unique(np.stack((h, doc)), axis=1) if len(h) else np.zeros((2, 0), np.uint64)
        seen.append(np.unique(pairs[0], return_counts=True))
    h, back = np.unique(np.concatenate([s[0] for s in seen]), return_inverse=True)
    docs = np.bincount(back, weights=np.concatenate([s[1] for s in seen]), minlength=len(h))
    return h[docs >= max(1, LEAST_SHARE * len(texts))]


def build(kept: list[tuple[str, int, np.ndarray]], bits: int = SLOT_BITS) -> Model:
    """Filters from (language, number of documents, n-grams kept)."""
    kept = sorted(kept, key=lambda k: (-k[1], k[0]))
    table = np.zeros((-(-len(kept) // MASK), 1 << bits), np.uint64)
    chance = np.zeros(len(kept))
    for i, (_, _, h) in enumerate(kept):
        mask, bit = table[i // MASK], np.uint64(i % MASK)
        for s in slots(h, bits):
            mask[s] |= np.uint64(1) << bit
        chance[i] = float(np.mean((mask >> bit) & np.uint64(1))) ** HASHES
    return Model([name for name, _, _ in kept], table, chance)


def predict(model: Model, offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the language, score) of each row."""
    bits = int(np.log2(model.table.shape[1]))
    n = len(offsets) - 1
    best, score = np.zeros(n, np.int64), np.zeros(n)
    for lo, hi in slices(offsets):
        h, first = grams(offsets, raw, lo, hi)
        places = slots(h, bits)
        total = np.diff(first)
        hits = np.zeros((len(model.languages), hi - lo))
        for k, masks in enumerate(model.table):
            mask = masks[places[0]]
            for s in places[1:]:
                mask &= masks[s]
            for i in range(k * MASK, min((k + 1) * MASK, len(hits))):
                hits[i] = sums_by(((mask >> np.uint64(i % MASK)) & np.uint64(1)).astype(np.float64), first)
        fair = np.maximum(hits - total * model.chance[:, None], 0) / (1 - np.minimum(model.chance, 0.99))[:, None]
        best[lo:hi] = fair.argmax(axis=0)
        ranked = np.sort(fair, axis=0)
        second = ranked[-2] if len(ranked) > 1 else np.zeros(hi - lo)
        with np.errstate(divide="ignore", invalid="ignore"):
            score[lo:hi] = np.where(ranked[-1] > 0, (ranked[-1] - second) / ranked[-1], 0.0)
    return best, score


def training_rows(docs: DataFrame, learn: Column, max_train: int, id_col: str = "doc_id",
                  text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(text, lang, k): at most ``max_train`` documents of each language.

    Ids are chosen first; their number is bounded by the parameter times the
    number of languages, and only they are joined with texts.
    """
    known = docs.select(F.col(id_col).alias("k"), F.col(lang_col).alias("lang")).filter(
        "k IS NOT NULL AND lang IS NOT NULL").filter(learn)
    place = Window.partitionBy("lang").orderBy(F.xxhash64("k"), "k")
    chosen = (known.withColumn("place", F.row_number().over(place))
              .filter(F.col("place") <= max_train).groupBy("k").agg(F.min("lang").alias("lang")))
    texts = docs.select(F.col(id_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(written(chosen, "language-sample"), "k").select("text", "lang", "k")


def fit(rows: DataFrame, bits: int = SLOT_BITS) -> Model:
    """Build the filters from a bounded sample, a task for each language; the n-grams kept come to the driver."""

    def run(table: pa.Table) -> pa.Table:
        texts = table.column("text").combine_chunks()
        return pa.table({"lang": table.column("lang").slice(0, 1).cast(pa.string()), "docs": pa.array([len(texts)], pa.int64()),
                         "grams": pa.array([kept_grams(texts).astype("<u8").tobytes()], pa.binary())})

    out = (rows.select("text", F.col("lang").cast("string").alias("lang")).groupBy("lang")
           .applyInArrow(run, "lang string, docs bigint, grams binary").collect())
    return build([(r.lang, r.docs, np.frombuffer(r.grams, "<u8")) for r in out], bits)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row of ``docs``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType),
                           T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            n = batch.num_rows
            lettered = pc.fill_null(pc.match_substring_regex(batch.column(1), r"\p{L}"), False)
            if m.languages:
                best, score = predict(m, *column_bytes(batch.column(1)))
                names = pa.array([m.languages[i] for i in best], pa.string())
            else:
                names, score, lettered = pa.nulls(n, pa.string()), np.zeros(n), pa.array([False] * n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.if_else(lettered, names, pa.scalar("und")),
                 pc.if_else(lettered, pa.array(score), pa.scalar(0.0))], names=[id_col, "lang_pred", "score"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
