"""Fixed, explicit schemas of the store tables (never inferred)."""

from pyspark.sql import types as T

AUTHORS = T.StructType([
    T.StructField("author_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("institution", T.StringType()),
])

DOCUMENTS = T.StructType([
    T.StructField("document_id", T.LongType()),
    T.StructField("author_id", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("body", T.StringType()),
    T.StructField("institution", T.StringType()),
])

MENTIONS = T.StructType([
    T.StructField("entity", T.StringType()),
    T.StructField("author_id", T.StringType()),
    T.StructField("document_id", T.LongType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("rho", T.DoubleType()),
])

RELATEDNESS = T.StructType([
    T.StructField("entity_a", T.StringType()),
    T.StructField("entity_b", T.StringType()),
    T.StructField("rel", T.DoubleType()),
])

ENTITIES = T.StructType([
    T.StructField("entity", T.StringType()),
    T.StructField("institution", T.StringType()),
    T.StructField("frequency", T.LongType()),
])

INSTITUTIONS = T.StructType([
    T.StructField("institution", T.StringType()),
    T.StructField("document_count", T.LongType()),
])

REJECTS = T.StructType([
    T.StructField("input_file", T.StringType()),
    T.StructField("doc_id", T.StringType()),
    T.StructField("record", T.StringType()),
])

# annotations by the text's SHA-256; a null entity marks a text without any
ANNOTATION_MEMO = T.StructType([
    T.StructField("text_hash", T.StringType()),
    T.StructField("begin", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("entity", T.StringType()),
    T.StructField("rho", T.DoubleType()),
])

# per author a HyperLogLog sketch of the batch's documents
PAPER_SKETCHES = T.StructType([
    T.StructField("author_id", T.StringType()),
    T.StructField("papers", T.BinaryType()),
])

# entities whose related entities the relatedness memo has all
RELATEDNESS_SOURCES = T.StructType([
    T.StructField("entity", T.StringType()),
])
