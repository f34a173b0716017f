"""Registered queries of the training-data operators, one per operator."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adeptus.llm import (
    archive, bpe, fingerprint, language, licenses, merkle, mixing, neardup, quality, search, toxicity, turns, urls)
from adeptus.llm.shared import scratch_path, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of the ids and of the decoded bytes."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe.decode(encoded, path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as ARC files, converted to WARC files, and read back.

    The ARC files are the stand-in for a legacy crawl; conversion, revisit
    records and both readers are the operator's.
    """
    pages = _table(spark, sf_dir, "pages")
    arc = archive.write_arc(pages, scratch_path(spark, "arc"), "page_id", "url", "html")
    seen = written(archive.read_arc(spark, arc, with_blocks=False).drop("block"), "arc-records")
    total = seen.agg(F.sum("payload_bytes")).first()[0] or 0
    refers = archive.revisits(seen, F.col("key").cast("long"))
    warc = archive.convert(archive.read_arc(spark, arc), refers, total, scratch_path(spark, "warc"))
    back = written(archive.read_warc(spark, warc).drop("block"), "warc-records").filter(
        F.col("type").isin("response", "revisit"))
    original = back.filter("type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"),
        F.col("payload_digest").alias("full_digest"), F.col("key").alias("full_key"))
    again = F.col("type") == "revisit"
    return back.join(original, "refers_to", "left").select(
        F.col("key").cast("long").alias("page_id"),
        F.when(again, F.col("full_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(again, F.col("full_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(again, F.col("full_key").cast("long")).alias("refers_to"))


def fold(key: str, parts: int):
    """crc32 of an id as text, modulo ``parts``: the folds that the labels are held out by."""
    return F.crc32(F.col(key).cast("string")) % parts


#: Bounds of the training samples: labelled documents; documents of each label; documents of each language.
QUALITY_TRAIN, TOXICITY_TRAIN, LANGUAGE_TRAIN = 6000, 2500, 1000


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; learnt from labels of the folds 0 and 2 of 3."""
    docs = _table(spark, sf_dir, "documents")
    sample = quality.labelled_sample(docs, _table(spark, sf_dir, "labels"), "quality", fold("k", 3) != 1, QUALITY_TRAIN)
    return quality.score(docs, quality.fit(sample)).select(
        "doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and fuzzy notices in every document."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learnt from labels of the folds 1 to 4 of 5."""
    docs = _table(spark, sf_dir, "documents")
    sample = quality.labelled_sample(docs, _table(spark, sf_dir, "labels"), "toxic", fold("k", 5) != 0,
                                     TOXICITY_TRAIN, by_label=True)
    return toxicity.score(docs, toxicity.fit(sample)).select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learnt from the folds 0, 1 and 3 of 4."""
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(language.training_rows(docs, fold("k", 4) != 2, LANGUAGE_TRAIN))
    return language.identify(docs, model).select(
        "doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return fingerprint.edited_pairs(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cell, the copies expected after raking to the token budget, and those drawn."""
    docs = _table(spark, sf_dir, "documents")
    p = F.col("__mix.probability")
    return mixing.draw(docs, mixing.chances(docs, budget=mixing.BUDGET, power=mixing.POWER)).select(
        "doc_id", "__mix.source", "__mix.lang", "__mix.topic", mixing.tokens(F.col("text")).alias("n_tokens"),
        (F.floor(p * 1e6 + 0.5) / 1e6).alias("probability"), "__mix.kept", "__mix.copies")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op1_bm25_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 20, its whole text as the query."""
    docs = _table(spark, sf_dir, "documents")
    index, idf = search.build_index(docs)
    queries = docs.filter(F.col("doc_id") % 20 == 0)
    return search.search(index, search.query_vectors(queries, idf, "doc_id", "text"), 10)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the manifest's root; a third of the texts, lower-cased, are held against it."""
    docs = _table(spark, sf_dir, "documents")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    low = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.when(fold("doc_id", 3) == 0, merkle.leaf(*columns, low))
    found = merkle.manifest(docs, merkle.leaf(*columns, F.col("text")), carry={"tampered": tampered})
    again = merkle.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"),
                        again.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule or the trees' verdict for the URL of every page."""
    return urls.judge(_table(spark, sf_dir, "pages"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, a quarter of whose rows are damaged."""
    return turns.repair(turns.damaged(_table(spark, sf_dir, "conversations")), dropped=F.col("dropped"))


QUERIES = {f.__name__: f for f in (
    op1_bm25_top10, op2_byte_bpe, op3_mixing, op4_arc_to_warc, op5_quality, op6_license_scan, op7_toxicity, op8_language,
    op9_fingerprint, op10_near_dedup, op11_merkle_manifest, op12_url_filter, op13_conversation_repair)}
