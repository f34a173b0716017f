"""Salts from measured skew, for joins in which few keys hold very many rows.

``heavy_keys`` counts rows by key and lists those with more rows than one task
should get, with the number of tasks each needs.  ``salted`` deals the rows of
these keys to that many tasks by a hash of another column; ``replicated`` gives the
other side's rows of these keys once for each of them.  All other keys keep one
salt, so nothing of theirs is copied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adeptus.session import written

#: Rows of one key that one task gets.
ROWS_PER_TASK = 1_000_000
#: Heavy keys at most; with more rows than this many times ``ROWS_PER_TASK`` a task gets more rows instead.
MOST_KEYS = 10_000


def heavy_keys(rows: DataFrame, key: str, per_task: int = ROWS_PER_TASK, most: int = MOST_KEYS) -> DataFrame:
    """(key, salts) of every key with more than ``per_task`` rows, and more than a share 1/``most`` of all rows.

    So there are fewer than ``most`` of them, whatever the input; the table is
    written, and Catalyst picks the joins with it by its size.  Counting combines
    on the map side.  Null keys join nothing and are left out.
    """
    sizes = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    limit = rows.agg(F.greatest(F.lit(int(per_task)), F.ceil(F.count(F.lit(1)) / F.lit(int(most)))).alias("limit"))
    sizes = sizes.withColumn("_limit", limit.scalar()).where(F.col("_rows") > F.col("_limit"))
    return written(sizes.select(key, F.ceil(F.col("_rows") / F.col("_limit")).cast("long").alias("_salts")), f"heavy-{key}")


def salted(rows: DataFrame, key: str, by: str, heavy: DataFrame) -> DataFrame:
    """The rows with a ``salt``: by a hash of column ``by`` for a heavy key, else 0."""
    return (rows.join(heavy, key, "left")
            .withColumn("salt", F.pmod(F.xxhash64(by), F.coalesce("_salts", F.lit(1).cast("long")))).drop("_salts"))


def replicated(rows: DataFrame, key: str, heavy: DataFrame) -> DataFrame:
    """The rows with a ``salt``: each row of a heavy key once for every salt of the key, the others once with 0."""
    return (rows.join(heavy, key, "left")
            .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1).cast("long")) - 1))).drop("_salts"))
