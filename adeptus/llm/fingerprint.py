"""Document fingerprints: one-permutation MinHash in DataFrame functions only.

Every shingle of ``SHINGLE`` words is hashed once.  The hash's high bits choose
one of ``BINS`` bins, each bin keeps its smallest hash.  An empty bin is filled
by optimal densification: it draws other bins in an order of its own, the same
for all documents, until it meets a filled one.  (After ``DRAWS`` draws one pass
finds the filled bin that comes first in a further order.)  A bin's hash is
hashed with the bin's number before its bits are cut, so that bins filled from
one bin agree by chance each by itself.
The ``BITS`` low bits of every bin are stored packed, four to a byte half, as
hexadecimal digits; ``unhex`` gives the bytes.

Two fingerprints agree in a bin by chance with ``2**-BITS``; ``likeness``
corrects for that: ``(agreement - c) / (1 - c)``, cut to 0..1.

A word is a run of letters and digits, lower-cased.  A text of fewer words
than a shingle has one shingle, all its words; a null, empty or wordless text
has the empty shingle.  So equal texts have equal fingerprints, always.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adeptus.llm.shared import written

SHINGLE = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
BITS = 4
DIGITS = "0123456789abcdef"
#: Draws that an empty bin makes one by one; after them it takes the filled bin of smallest draw.
DRAWS = 8
#: Ids that share all but so many low bits are put in order together.
BUCKET_BITS, GROUP_BITS = 11, 18
LEAST = -(1 << 63)


def _bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BIN_BITS).cast("int")


def shingle_hashes(text: Column) -> Column:
    """Hashes of all shingles of a text, repeats included."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return _bound(F.transform(words, lambda x: F.xxhash64(x)), lambda w: F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(w) - SHINGLE, F.lit(0))),
        lambda i: F.xxhash64(*(F.get(w, i + k if k else i) for k in range(SHINGLE)))))


def smallest_by_bin(hashes: Column) -> Column:
    """The smallest hash of every filled bin, in the order of the bins."""
    return _bound(F.sort_array(hashes), lambda s: F.filter(
        s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1)))))


def fingerprint(text: Column) -> Column:
    """The packed fingerprint as ``BINS`` hexadecimal digits."""
    every = F.sequence(F.lit(0), F.lit(BINS - 1))

    def drawn(dense: Column, kept: Column, j: Column) -> Column:
        draws = [F.get(dense, F.xxhash64(j, F.lit(a)).bitwiseAND(F.lit(BINS - 1).cast("long")).cast("int"))
                 for a in range(DRAWS)]
        last = F.array_min(F.transform(kept, lambda x: F.struct(F.xxhash64(j, _bin(x)).alias("draw"), x.alias("h"))))
        return F.coalesce(F.get(dense, j), *draws, last["h"])

    def filled(kept: Column) -> Column:
        by_bin = F.map_from_arrays(F.transform(kept, _bin), kept)
        dense = _bound(by_bin, lambda m: F.transform(every, lambda j: F.element_at(m, j)))
        return _bound(dense, lambda d: F.transform(every, lambda j: drawn(d, kept, j)))

    bins = _bound(smallest_by_bin(shingle_hashes(text)), filled)

    def digit(h: Column, j: Column) -> Column:
        low = F.xxhash64(h, j).bitwiseAND(F.lit((1 << BITS) - 1).cast("long")).cast("int")
        return F.substring(F.lit(DIGITS), low + 1, F.lit(1))

    return F.concat_ws("", F.transform(bins, digit))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingles behind two fingerprints."""
    chance = 2.0 ** -BITS
    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(BINS)),
                           lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))))
    return F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))


def next_higher(values: DataFrame, col: str, levels: int = 2) -> DataFrame:
    """(col, higher): each distinct value with the next higher one; null for the highest.

    Values are put in order within groups of equal high bits; the groups, one
    row each, are put in order the same way.  After the last level at most
    ``2**17`` groups are left for one task, whatever the input.
    """
    values = values.select(col).distinct()
    if levels == 0:
        return values.withColumn("higher", F.lead(col).over(Window.orderBy(col)))
    grouped = values.withColumn("grp", F.shiftright(col, GROUP_BITS))
    groups = grouped.groupBy("grp").agg(F.min(col).alias("lowest"))
    after = (next_higher(groups, "grp", levels - 1).withColumnRenamed("higher", "next_grp")
             .join(groups.select(F.col("grp").alias("next_grp"), F.col("lowest").alias("next_lowest")), "next_grp", "left")
             .select("grp", "next_lowest"))
    inner = F.lead(col).over(Window.partitionBy("grp").orderBy(col))
    return (grouped.withColumn("inner", inner).join(after, "grp", "left")
            .select(col, F.coalesce("inner", "next_lowest").alias("higher")))


def with_next(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """``docs`` with ``next_<c>`` for each of ``columns``: the values of the next document.

    The next one is that of the next lower id; after the lowest comes the
    highest, and a lone document follows itself.  Null ids come after all others,
    repeated ids in the order of their ``columns``.  Rows of near ids are put in
    order together, ``2**BUCKET_BITS`` ids to a bucket; the first row of each
    bucket is also sent to the bucket before whose last row it follows.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), *columns).withColumn(
        "bucket", F.shiftright("key", BUCKET_BITS))
    heads = rows.groupBy("bucket").agg(F.max("key").alias("key"))
    ends = written(heads.join(next_higher(heads.select("bucket"), "bucket"), "bucket"), "bucket-heads")
    lowest = F.broadcast(ends.agg(F.min("bucket").alias("lowest")))        # one row
    guests = ends.crossJoin(lowest).select("key", F.coalesce("higher", "lowest").alias("goes_to"))
    guests = rows.join(guests, "key").select("id", "key", *columns, F.col("goes_to").alias("bucket"), F.lit(True).alias("guest"))
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("key"), *columns)
    return (rows.withColumn("guest", F.lit(False)).unionByName(guests)
            .select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns))
            .filter(~F.col("guest")).select(F.col("id").alias(id_col), *columns, *(f"next_{c}" for c in columns)))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text and its edited one, their fingerprints, and how alike they are.

    The edited text has its last ``floor(n/2)`` code points replaced by as
    many first ones, or all, of the next document's text.
    """
    own = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("whole"))
    own = own.withColumn("print", fingerprint(F.col("whole")))
    half = F.floor(F.length("whole") / 2).cast("int")
    pairs = with_next(own, id_col, ["whole", "print"]).select(
        F.col(id_col), F.length("whole").cast("long").alias("n_chars"), F.col("print"), F.col("next_print"),
        F.concat(F.substring("whole", F.lit(1), F.length("whole") - half),
                 F.substring("next_whole", F.lit(1), half)).alias("edited"))
    pairs = pairs.select("*", fingerprint(F.col("edited")).alias("edited_print"))
    return pairs.select(
        F.col(id_col), "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        F.col("print").alias("fingerprint"), F.col("edited_print").alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"))
