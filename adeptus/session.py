"""Session helpers: sensible defaults, tables in the shared folder, dealing of texts.

No join side is hinted for broadcast after a count: a table that several jobs
read is written, so that Catalyst knows its bytes and compares them with
``spark.sql.autoBroadcastJoinThreshold``; AQE decides the rest at run time.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Session setting: number of partitions that texts are dealt to before CPU-heavy work on each (unset: as read).
TEXT_PARTITIONS = "spark.adeptus.textPartitions"

#: Spark's setting that deletes a query's shuffle files at its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows that one task gets of a table that is dealt by :func:`spread`.
SPREAD_ROWS = 500_000


def build_session(master: str | None = None, app: str = "adeptus",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with AQE, UTC time and the UI off."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master (as in tests) gets a temporary folder;
    on a cluster that is an error, since a folder of the driver's machine
    can't be read by the executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="adeptus-shared-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` as a Parquet table of the shared folder, under a name of its own.

    Computed once, whatever reads it later; it cuts the lineage, survives lost
    executors, holds no executor memory, and its size is known to Catalyst.  The shuffle files
    that it was made from are deleted as soon as it is complete, not whenever the driver's
    objects are collected.  ``compression``: for large rows that are read once (default: the session's).
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    own = conf.get(CLEAN_UP, None)
    conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        conf.unset(CLEAN_UP) if own is None else conf.set(CLEAN_UP, own)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int, *keys: str, per_task: int | None = None) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as ``rows`` rows need, at ``per_task`` (``SPREAD_ROWS``) rows each.

    AQE joins shuffle partitions up to a number of compressed bytes, in which rows that
    compress well are many; a partition number that is given stays.
    """
    return df.repartition(max(1, -(-rows // (per_task or SPREAD_ROWS))), *keys)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` in ``TEXT_PARTITIONS`` partitions where the session sets that number, else as it is.

    For texts in a few large files; input of many splits needs no shuffle.
    """
    n = df.sparkSession.conf.get(TEXT_PARTITIONS, None)
    return df.repartition(int(n)) if n else df
