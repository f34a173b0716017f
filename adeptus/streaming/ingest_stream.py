"""Continuous ingest: new paper files appended to a store as they arrive.

The reference appends one input file at a time to its database, continuing
document ids from the stored maximum.  Here a Structured Streaming file
source picks up new files; each micro-batch goes through the batch ingest
(:func:`adeptus.operators.ingest.build_corpus`) and is written to the store
as batch ``<stream_id>-<epoch>`` in overwrite mode.  A replayed epoch (after
a failure the stream re-reads the same files from its checkpoint) excludes
its own earlier partial output when it computes the next document id and
then overwrites it, so the store never holds an epoch twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adeptus.operators import ingest
from adeptus.sources import readers
from adeptus.sources.store import Store

TU_SCHEMA = readers.csv_schema(readers.TU_FIELDS)

def tu_papers(batch: DataFrame) -> DataFrame:
    """A2 rows of one micro-batch -> paper rows with input order."""
    return ingest.papers_from_documents(batch.withColumn("ordinal", F.monotonically_increasing_id()),
                                        "input_file", "ordinal")


def ingest_batch(spark: SparkSession, papers: DataFrame, store_path: str, batch: str, annotator,
                 min_year: int | None = None, max_year: int | None = None) -> None:
    """Append one batch of papers to the store (idempotent per batch id).

    Texts that an earlier batch annotated aren't annotated again.
    """
    st = Store(spark, store_path)
    start = st.next_document_id(exclude_batch=batch)
    corpus = ingest.build_corpus(papers, st.remembering(annotator, batch), min_year, max_year, start_id=start)
    st.write(corpus, batch=batch)


def start_tu_ingest(spark: SparkSession, input_dir: str, store_path: str, checkpoint: str, annotator,
                    stream_id: str = "s", min_year: int | None = None, max_year: int | None = None,
                    max_files_per_trigger: int | None = None, trigger_once: bool = False):
    """Start the stream: ``doc_id,author_id,text`` CSV files of ``input_dir`` -> store.

    ``checkpoint`` must be on shared storage (the stream's progress).  Records
    with another number of fields go to the store's table ``rejects``.
    """
    reader = readers.csv_options(spark.readStream.schema(TU_SCHEMA))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    src = reader.csv(input_dir).withColumn("input_file", F.col("_metadata.file_path"))

    def each(batch_df: DataFrame, epoch_id: int) -> None:
        batch, bad = f"{stream_id}-{epoch_id:06d}", F.col(readers.BAD)
        rejected = batch_df.where(bad.isNotNull()).select("input_file", "doc_id", bad.alias("record"))
        Store(spark, store_path).add("rejects", rejected, batch)
        ingest_batch(spark, tu_papers(batch_df.where(bad.isNull())), store_path, batch, annotator, min_year, max_year)

    w = src.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="10 seconds")
    return w.start()
