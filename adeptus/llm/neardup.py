"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles.

1. ``word_weights`` counts in how many documents each word occurs, over all
   documents, in ``2**IDF_BITS`` hashed word classes: a table of fixed size.  A
   word's IDF is ``1 + ln(1 + documents / frequency) / ln(1 + documents)``, from
   1 to 2, so that a rare word counts at most twice a common one.
2. A document is a bag of shingles of five words.  A shingle weighs
   ``1 + ln(occurrences)`` times the mean IDF of its words.  (The IDF is the words', not
   the shingle's own: a group of copies would otherwise make just the shingles
   that its members share weigh little.)
3. Improved consistent weighted sampling draws ``BANDS * ROWS`` samples of a
   bag, such that two bags draw alike with the probability of their weighted
   Jaccard similarity.  ``ROWS`` samples make the key of a band.
4. Texts with equal words are one entry from here on.  Entries that share a
   band's key are compared: their weighted Jaccard similarity is computed from
   the whole texts and must reach ``threshold``.  Buckets of equal members are
   compared once.  A bucket of more than ``BLOCK`` members is cut into blocks and
   every pair of blocks is a unit of its own, so no task holds a whole group.
   A unit yields only the links that join what wasn't joined in it, never all pairs.
5. Linked entries are joined to classes by alternating star contraction, with
   checkpoints in the shared folder.

Equal texts always share a class; so do null and empty texts (nothing to tell
them apart).  Texts without words are compared as they are.  Repeated rows are
equal texts.  The class id is the smallest id in the class; rows with a null id
belong to the class of their text, which has a null id if it has no other.
No rows: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adeptus.llm.shared import by_batches, written
from adeptus.llm.textblock import POWER, TextBlock, column_bytes, mix, slices

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 4
IDF_BITS = 18
#: Members of a bucket that are compared in one unit.
BLOCK = 256
#: Tasks that the links of one entry are dealt over.
SALTS = 8
#: Bytes of text sketched at once; small, so that the arrays stay in cache.
SLICE_BYTES = 1 << 18

# Tables of the random draws that ICWS needs, made by rule: r and c are Gamma(2, 1).
_rng = np.random.Generator(np.random.PCG64(8675309))
R_TABLE = _rng.gamma(2.0, 1.0, 1 << 12).astype(np.float32).clip(1e-3)
INVERSE_R = (1 / R_TABLE).astype(np.float32)
LOG_C = np.log(_rng.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)
SEEDS = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def word_weights(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """IDF of each hashed word class, counted over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, rows = np.zeros(1 << IDF_BITS, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            offsets, raw = column_bytes(batch.column(0))
            for lo, hi in slices(offsets):
                block = TextBlock(offsets, raw, lo, hi)
                key = (block.doc.astype(np.uint64) << np.uint64(IDF_BITS)) | (block.hash >> np.uint64(64 - IDF_BITS))
                seen = np.unique(key) & np.uint64((1 << IDF_BITS) - 1)
                count += np.bincount(seen.astype(np.int64), minlength=1 << IDF_BITS)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(count[at], rows))],
                                         names=["word", "docs"])

    rows = by_batches(docs.select(text_col), run, "word bigint, docs bigint").groupBy("word").agg(F.sum("docs").alias("docs"))
    # at most 2**IDF_BITS + 1 rows, whatever the input
    table = rows.toPandas()
    n = float(table.loc[table.word == -1, "docs"].sum())
    idf = np.full(1 << IDF_BITS, 2.0)
    table = table[table.word >= 0]
    idf[table.word.to_numpy(np.int64)] = 1 + np.log1p(n / table.docs.to_numpy(float)) / np.log1p(max(n, 1.0))
    return idf.astype(np.float32)


def bags(block: TextBlock, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hash, count, mean IDF, first) of each row's distinct shingles, sorted by hash."""
    h, row, at = block.shingles(SHINGLE)
    own = np.concatenate(([0.0], np.cumsum(idf[(block.hash >> np.uint64(64 - IDF_BITS)).astype(np.int64)], dtype=np.float64)))
    end = np.minimum(at + SHINGLE, block.first[row + 1])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(h)))
    some = order[start]
    # rounded, so that the running sum's place in the block can't tell equal shingles apart
    mean = np.round((own[end[some]] - own[at[some]]) / (end[some] - at[some]), 4)
    return h[start], count, mean, np.searchsorted(row[start], np.arange(block.rows + 1))


def band_keys(h: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of each row from its weighted shingles; rows without shingles get 0."""
    rows = len(first) - 1
    keys = np.zeros((rows, BANDS), np.uint64)
    full = np.flatnonzero(np.diff(first))
    if not len(full):
        return keys
    cut = first[full]
    size = np.diff(np.append(cut, len(h)))
    log_w = np.log(weight).astype(np.float32)
    for k, seed in enumerate(SEEDS):
        u = (h ^ seed) * SEEDS[(k * 7 + 3) % len(SEEDS)]
        u ^= u >> np.uint64(31)
        u *= np.uint64(0x9FB21C651E98DF25)
        r = ((u >> np.uint64(16)) & np.uint64(0xFFF)).astype(np.int32)
        beta = ((u >> np.uint64(28)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(log_w * INVERSE_R[r] + beta)
        # ln a = ln c - ln y - r with y = exp(r * (t - beta))
        a = LOG_C[(u >> np.uint64(48)).astype(np.int32)] - R_TABLE[r] * (t - beta + 1)
        least = np.repeat(np.minimum.reduceat(a, cut), size)
        hit = np.flatnonzero(a == least)
        own = np.searchsorted(hit, cut)               # the first of each row
        drawn = mix(h[hit[own]] ^ (t[hit[own]].astype(np.int64).astype(np.uint64) * POWER))
        band = k // ROWS
        keys[full, band] = keys[full, band] * POWER + drawn + np.uint64(1)
    return mix(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) * (keys > 0)


def sketch(docs: DataFrame, idf, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, content, keys): a digest of each text's words and its band keys; no keys without words."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("text_hash", T.LongType()),
                           T.StructField("content", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, raw = column_bytes(batch.column(1))
            for lo, hi in slices(offsets, SLICE_BYTES):
                block = TextBlock(offsets, raw, lo, hi)
                h, count, mean, first = bags(block, idf.value)
                keys = band_keys(h, (1 + np.log(count)) * mean, first).view(np.int64)
                content = []
                for r in range(hi - lo):
                    a, b = block.first[r], block.first[r + 1]
                    body = b"w" + block.hash[a:b].tobytes() if b > a else b"t" + raw[offsets[lo + r]:offsets[lo + r + 1]].tobytes()
                    content.append(hashlib.blake2b(body, digest_size=16).digest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(content, pa.binary()),
                     pa.array([k.tolist() if k[0] else None for k in keys], pa.list_(pa.int64()))],
                    names=["id", "text_hash", "content", "keys"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    return by_batches(docs.select(F.col(id_col), text.alias("text"), F.xxhash64(text).alias("text_hash")), run, schema)


def units(entries: DataFrame) -> DataFrame:
    """(unit, left, entry): what has to be compared together.

    ``entries`` has (entry, keys).  Members of a unit whose ``left`` is null are
    compared with each other, else each left one with each right one.
    """
    rows = entries.select("entry", F.explode("keys").alias("key"))
    sets = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("entry").cast("decimal(38,0)")).alias("mark")).filter("n > 1")
    sets = sets.groupBy("n", "mark").agg(F.min("key").alias("key"))        # equal members: compared once
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.join(sets, "key").withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64(F.lit("block"), "entry"), F.col("blocks")).cast("int"))
    alone = rows.filter("blocks = 1").select(F.struct("key", F.lit(0).alias("i"), F.lit(0).alias("j")).alias("unit"),
                                             F.lit(None).cast("boolean").alias("left"), "entry")
    many = rows.filter("blocks > 1").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    many = many.select(
        F.struct("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).alias("unit"),
        F.when(F.col("block") != F.col("other"), F.col("block") < F.col("other")).alias("left"), "entry")
    return alone.unionAll(many)


def _links(h: np.ndarray, count: np.ndarray, mean: np.ndarray, first: np.ndarray, members: np.ndarray,
           left: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links of one unit that join members not yet joined, by exact weighted Jaccard similarity.

    A shingle that occurs ``c`` times is ``c`` features, which weigh what each
    occurrence adds, so the shared weight of two bags is a sum over common features.
    """
    at = np.concatenate([np.arange(first[m], first[m + 1]) for m in members])
    who = np.repeat(np.arange(len(members)), first[members + 1] - first[members])
    times = count[at]
    level = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    who, feature = np.repeat(who, times), mix(np.repeat(h[at], times) + level.astype(np.uint64) * POWER)
    weight = np.repeat(mean[at], times) * np.where(level, np.log1p(1 / np.maximum(level, 1)), 1.0)
    total = np.bincount(who, weights=weight, minlength=len(members))
    feature, number = np.unique(feature, return_inverse=True)
    often = np.bincount(number) > 1                    # what one member has alone is never shared
    shared = np.zeros((len(members), len(members)))
    column = np.cumsum(often) - 1
    keep = often[number]
    who, number, weight = who[keep], column[number[keep]], weight[keep]
    order = np.argsort(number, kind="stable")
    who, number, weight = who[order], number[order], weight[order]
    step = min(max(1, (1 << 22) // len(members)), int(often.sum()))    # a matrix of 32 MB at most
    for lo in range(0, int(often.sum()), max(1, step)):
        a, b = np.searchsorted(number, (lo, lo + step))
        x = np.zeros((len(members), step))
        x[who[a:b], number[a:b] - lo] = np.sqrt(weight[a:b])
        shared += x @ x.T
    likeness = shared / np.maximum(total[:, None] + total[None, :] - shared, 1e-12)
    if left.any():
        likeness[left[:, None] == left[None, :]] = 0
    root = list(range(len(members)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(likeness >= threshold - 1e-9, 1))):
        a, b = find(int(i)), find(int(j))
        if a != b:
            root[b] = a
            out.append((int(members[i]), int(members[j])))
    return out


def verified(pairs: DataFrame, idf, threshold: float) -> DataFrame:
    """(a, b) linked entries, from (unit, left, entry, text) dealt and sorted by unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def units_of():
            rest = None
            for batch in batches:
                table = pa.Table.from_batches([batch])
                table = pa.concat_tables([rest, table]) if rest is not None else table
                unit = np.array(table.column("u"))
                cut = np.append(np.flatnonzero(np.diff(unit, prepend=unit[0] - 1)), len(unit))
                yield table.slice(0, int(cut[-2])), cut[:-1]
                rest = table.slice(int(cut[-2])).combine_chunks()
            if rest is not None:
                yield rest, np.array([0, rest.num_rows])

        for table, cut in units_of():
            if not table.num_rows:
                continue
            entry, left = table.column("entry").to_pylist(), table.column("left").fill_null(False).to_numpy().astype(bool)
            offsets, raw = column_bytes(table.column("text"))
            links = []
            at = 0
            while at < len(cut) - 1:                   # several small units share a block of tokens
                to = at + 1
                while to < len(cut) - 1 and offsets[cut[to + 1]] - offsets[cut[at]] < SLICE_BYTES:
                    to += 1
                bag = bags(TextBlock(offsets, raw, int(cut[at]), int(cut[to])), idf.value)
                for k in range(at, to):
                    members = np.arange(cut[k], cut[k + 1])
                    links += [(entry[a + cut[at]], entry[b + cut[at]]) for a, b in
                              _links(*bag, members - cut[at], left[members], threshold)]
                at = to
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.binary()),
                                                  pa.array([x[1] for x in links], pa.binary())], names=["a", "b"])

    dealt = pairs.select(F.xxhash64("unit").alias("u"), "left", "entry", "text").repartition("u").sortWithinPartitions("u")
    return by_batches(dealt, run, "a binary, b binary")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(entry, root) of every linked entry: the smallest entry that it is joined with.

    Large star: every entry's higher neighbours are linked to its smallest
    neighbour.  Small star: every entry and its lower neighbours are linked to the
    smallest of them.  Alternating, the links become stars in a number of rounds
    that grows with the logarithm of the longest chain.
    """
    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        # a hub's rows are dealt over several tasks
        salted = both.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
        joined = salted.join(least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["a", "salt"])
        if large:
            return joined.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        return joined.select("b", "low").unionAll(least.select(F.col("a"), "low")).toDF("a", "b").filter("a <> b").distinct()

    edges = written(links.filter("a <> b").distinct(), "links")
    before = None
    for _ in range(rounds):
        edges = written(star(star(edges, True), False), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("links didn't become stars")
    stars = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "entry")
    return stars


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows, and (entry, row_id, row_hash, id, root) of all entries."""
    idf = docs.sparkSession.sparkContext.broadcast(word_weights(docs, text_col))
    seen = sketch(docs, idf, id_col, text_col)
    seen = written(seen, "sketches")
    # an entry is a text, named by the digest of its words; one row of it stands for it
    entries = seen.groupBy("content").agg(
        F.min("id").alias("id"), F.first("keys").alias("keys"),
        F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("text_hash"))).alias("row")).select(
        F.col("content").alias("entry"), "id", "keys", F.col("row.id").alias("row_id"), F.col("row.text_hash").alias("row_hash"))
    entries = written(entries, "entries")
    compared = written(units(entries.filter("keys IS NOT NULL")), "units")
    wanted = entries.join(compared.select("entry").distinct(), "entry").select("entry", "row_id", "row_hash")
    texts = docs.select(F.col(id_col).alias("row_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("row_hash", F.xxhash64("text")).alias("t").join(
        wanted.alias("w"), F.col("t.row_id").eqNullSafe(F.col("w.row_id")) & (F.col("t.row_hash") == F.col("w.row_hash")))
    texts = texts.select("entry", "text").dropDuplicates(["entry"])
    roots = components(verified(compared.join(texts, "entry"), idf, threshold))
    return seen, written(entries.drop("keys").join(roots, "entry", "left").withColumn(
        "root", F.coalesce("root", "entry")), "rooted")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD) -> DataFrame:
    """(id, class_id) of every row; see the module's docstring."""
    seen, rooted = _classes(docs, id_col, text_col, threshold)
    classes = rooted.groupBy("root").agg(F.min("id").alias("class_id"))
    of = written(rooted.join(classes, "root").select(F.col("entry").alias("content"), "class_id"), "classes")
    return seen.select(F.col("id").alias(id_col), "content").join(of, "content").select(id_col, "class_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 threshold: float = THRESHOLD) -> DataFrame:
    """One row of ``docs`` from each class: that of the smallest id (nulls last)."""
    _, rooted = _classes(docs, id_col, text_col, threshold)
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("row_id").isNull(), "row_id", "row_hash")).alias("row"))
    keys = ["__dd_id", "__dd_null", "__dd_hash"]

    def keyed(df: DataFrame, row_id, text_hash) -> DataFrame:
        return df.select("*", F.coalesce(row_id, F.lit(0)).alias(keys[0]), row_id.isNull().alias(keys[1]), text_hash.alias(keys[2]))

    first = keyed(first, F.col("row.row_id"), F.col("row.row_hash")).select(*keys)
    rows = keyed(docs, F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    # repeated rows are dropped in the partitions that the join has made
    return rows.join(first, keys).dropDuplicates(keys).select(*docs.columns)
