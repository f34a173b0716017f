"""The store: a folder of Parquet tables replacing the reference's database.

The base tables authors, documents and entity_occurrences, the counts of D2
(entities) and D3 (institutions), of which a batch holds its own part and a
reader sums them, and sketches of D7 are one *unit* per batch:

* a write puts them in ``<path>/<table>/batch=<id>/attempt=<a>`` and then names the
  attempt in an empty file of ``<path>/_units``.  Readers follow these files alone,
  so a batch appears whole or not at all, and a batch that is written again is
  replaced at once.  What a broken or replaced write left is taken away by ``vacuum``.
* every table is sorted, by ranges, by the key that its lookups use, so that a
  lookup reads few row groups.  A range may end within a key of very many rows.

Rejected input rows and the memos of annotations and relatedness are
``<path>/<table>/batch=<id>``, one table at a time.  A write adds a batch and leaves
the others alone.  The folder should be on shared storage: it is also what cuts
lineage between the build and the query jobs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adeptus import schemas
from adeptus.corpus import Corpus
from adeptus.functions.text import normalize_space
from adeptus.operators import ingest, linking, stats
from adeptus.operators.relatedness import cooccurrence_relatedness, oriented_from_memo, symmetric_pairs
from adeptus.session import written

TABLES = {"authors": schemas.AUTHORS, "documents": schemas.DOCUMENTS, "entity_occurrences": schemas.MENTIONS,
          "entities": schemas.ENTITIES, "institutions": schemas.INSTITUTIONS, "paper_sketches": schemas.PAPER_SKETCHES,
          "rejects": schemas.REJECTS, "annotation_memo": schemas.ANNOTATION_MEMO,
          "relatedness_memo": schemas.RELATEDNESS, "relatedness_sources": schemas.RELATEDNESS_SOURCES}
#: Tables that are a batch's unit, and the order of their rows: the key of their lookups, then what parts its rows.
UNIT = {"authors": ["author_id"], "documents": ["document_id"], "entity_occurrences": ["author_id", "document_id", "entity"],
        "entities": ["entity", "institution"], "institutions": ["institution"], "paper_sketches": ["author_id"]}
#: Tables of counts: each batch holds its part, of which the last column is summed over the batches.
COUNTS = ("entities", "institutions")


class Store:
    """Open (optionally erasing) and write a corpus store.

    Writing the same batch id again (a retried job or stream epoch) replaces the
    batch instead of duplicating rows.
    """

    def __init__(self, spark: SparkSession, path: str, erase: bool = False):
        self.spark = spark
        self.path = path.rstrip("/")
        if erase:
            self._delete(self.path)

    # -- file system helpers (Hadoop API: works for any cluster file system)
    def _fs_path(self, p: str):
        jvm = self.spark.sparkContext._jvm
        hp = jvm.org.apache.hadoop.fs.Path(p)
        return hp, hp.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _delete(self, p: str) -> None:
        hp, fs = self._fs_path(p)
        if fs.exists(hp):
            fs.delete(hp, True)

    def _p(self, table: str) -> str:
        return f"{self.path}/{table}"

    def _names(self, p: str, folders: bool) -> list[str]:
        hp, fs = self._fs_path(p)
        if not fs.exists(hp):
            return []
        return sorted(st.getPath().getName() for st in fs.listStatus(hp) if st.isDirectory() == folders)

    # -- batches as units
    def _marks(self) -> dict[str, tuple[int, str]]:
        """(number, attempt) of the last whole write of each batch."""
        found: dict[str, tuple[int, str]] = {}
        for name in self._names(self._p("_units"), folders=False):
            if name.count("~") >= 2:
                batch, number, attempt = name.rsplit("~", 2)
                found[batch] = max(found.get(batch, (0, "")), (int(number), attempt))
        return found

    def _mark(self, batch: str, attempt: str) -> None:
        """Make an attempt the batch's current one: one file is created, which a reader sees or doesn't."""
        number = self._marks().get(batch, (0, ""))[0] + 1
        hp, fs = self._fs_path(f"{self._p('_units')}/{batch}~{number:09d}~{attempt}")
        fs.create(hp, False).close()

    def vacuum(self) -> None:
        """Delete what no reader sees: attempts without a mark, and replaced ones.

        Not while a write or a reader of a replaced batch is at work.
        """
        marks = self._marks()
        for table in UNIT:
            for folder in self._names(self._p(table), folders=True):
                keep = marks.get(folder.split("=", 1)[1], (0, ""))[1]
                for attempt in self._names(f"{self._p(table)}/{folder}", folders=True):
                    if attempt != f"attempt={keep}":
                        self._delete(f"{self._p(table)}/{folder}/{attempt}")
        for name in self._names(self._p("_units"), folders=False):
            batch, number, attempt = name.rsplit("~", 2)
            if marks[batch] != (int(number), attempt):
                self._delete(f"{self._p('_units')}/{name}")

    def exists(self, table: str = "documents") -> bool:
        return bool(self.batches(table))

    def batches(self, table: str = "documents") -> list[str]:
        if table in UNIT:
            return sorted(self._marks())
        return [n.split("=", 1)[1] for n in self._names(self._p(table), folders=True) if n.startswith("batch=")]

    def _paths(self, table: str, exclude_batch: str | None = None) -> list[str]:
        if table in UNIT:
            return [f"{self._p(table)}/batch={b}/attempt={a}" for b, (_, a) in sorted(self._marks().items()) if b != exclude_batch]
        return [f"{self._p(table)}/batch={b}" for b in self.batches(table) if b != exclude_batch]

    def read(self, table: str, exclude_batch: str | None = None) -> DataFrame:
        """A table over all batches; without rows where nothing has been written yet."""
        schema = TABLES[table]
        paths = self._paths(table, exclude_batch)
        if not paths:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(*paths)
        if table in COUNTS:
            *keys, count = schema.names
            return df.groupBy(*keys).agg(F.sum(count).alias(count))
        return df

    def add(self, table: str, rows: DataFrame, batch: str) -> None:
        """Write a batch of a memo or of the rejects; a batch of that name is replaced."""
        if table in UNIT:
            raise ValueError(f"{table} is part of a batch's unit: use write()")
        rows.select(*TABLES[table].names).write.mode("overwrite").parquet(f"{self._p(table)}/batch={batch}")

    def corpus(self) -> Corpus:
        """The stored corpus; entity popularity (D5) is the sum of the stored D2 over institutions."""
        c = Corpus(self.read("authors"), self.read("documents"), self.read("entity_occurrences"))
        c.memo("popularity", lambda: self.read("entities").groupBy("entity")
               .agg(F.sum("frequency").alias("entity_popularity")))
        return c

    def remembering(self, annotator, batch: str):
        """An annotator that looks texts up in the stored memo first and adds what is new as ``batch``."""
        def run(texts: DataFrame) -> DataFrame:
            memo = self.read("annotation_memo", exclude_batch=batch)
            found, fresh = linking.annotate_with_memo(texts, memo, annotator)
            self.add("annotation_memo", fresh, batch)
            return found
        return run

    def relatedness(self) -> DataFrame:
        """The stored relatedness memo as oriented rows for E7."""
        return oriented_from_memo(self.read("relatedness_memo"))

    def remember_relatedness(self, corpus: Corpus, sources: DataFrame, batch: str) -> DataFrame:
        """:meth:`relatedness` after adding, as ``batch``, what the memo lacks of the ``sources`` (entity).

        The memo lists the sources that it covers, so what is known costs one anti-join
        of entities; pairs are computed for new sources only, without those
        whose other end is covered, which the memo has already.
        """
        covered = self.read("relatedness_sources", exclude_batch=batch)
        fresh = written(sources.select("entity").distinct().join(covered, "entity", "left_anti"), "sources")
        pairs = (cooccurrence_relatedness(corpus, fresh)
                 .join(covered.withColumnRenamed("entity", "other"), "other", "left_anti"))
        self.add("relatedness_memo", symmetric_pairs(pairs), batch)
        self.add("relatedness_sources", fresh, batch)
        return self.relatedness()

    def approx_papers_count(self) -> DataFrame:
        """D7, approximate: (author_id, papers) from the batches' sketches; no mention is read."""
        return stats.approx_papers_count(self.read("paper_sketches"))

    def next_batch(self) -> str:
        nums = [int(b) for b in self.batches() if b.isdigit()]
        return f"{(max(nums) + 1) if nums else 0:06d}"

    def write(self, corpus: Corpus, batch: str | None = None) -> "Store":
        """Write a corpus as one batch (default: the next numbered batch).

        Authors already stored in other batches keep their row (first wins);
        document ids are the caller's (see :meth:`next_document_id`).  D2, D3 and the
        sketches of D7 are those of this batch alone.  Readers see the batch when
        all its tables are written.
        """
        batch, attempt = batch or self.next_batch(), uuid.uuid4().hex
        authors = corpus.authors.join(self.read("authors", exclude_batch=batch).select("author_id"),
                                      "author_id", "left_anti")
        for table, rows in (("authors", authors), ("documents", corpus.documents),
                            ("entity_occurrences", corpus.mentions),
                            ("entities", stats.entity_institution_frequency(corpus.doc_entities(), corpus.documents)),
                            ("institutions", stats.institution_document_count(corpus.documents)),
                            ("paper_sketches", stats.paper_sketches(corpus.doc_entities()))):
            (rows.select(*TABLES[table].names).repartitionByRange(*UNIT[table]).sortWithinPartitions(*UNIT[table])
             .write.parquet(f"{self._p(table)}/batch={batch}/attempt={attempt}"))
        self._mark(batch, attempt)
        return self

    def next_document_id(self, exclude_batch: str | None = None) -> int:
        """D15 (as an int for the next ingest): max stored document id + 1, or 0."""
        if not self.exists():
            return 0
        docs = self.read("documents", exclude_batch=exclude_batch)
        return int(ingest.next_document_id(docs).first()["next_id"])


def open_store(spark: SparkSession, path: str, erase: bool = False) -> Store:
    """Open a store, optionally erasing what is there."""
    return Store(spark, path, erase)


def write_store(store: Store, corpus: Corpus, batch: str | None = None) -> Store:
    """Write a corpus (authors, documents, mentions, counts) as one batch."""
    return store.write(corpus, batch)


def write_lines(df: DataFrame, path: str, column: str = "value") -> None:
    """One text line per row."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_topics(topics: DataFrame, path: str) -> None:
    """``id;text`` topic lines, white space of the text made single spaces."""
    write_lines(topics.select(F.concat_ws(";", "query_id", normalize_space("text")).alias("value")), path)


def write_papers_csv(rows: DataFrame, path: str) -> None:
    """``doc_id,author_id,text`` CSV readable by the A2 reader."""
    (rows.select(F.col("doc_id").cast("string"), F.col("author_id").cast("string"), "text")
     .write.mode("overwrite").option("escape", '"').option("quoteAll", "false").csv(path))


def write_texts(texts: DataFrame, path: str) -> None:
    """(docno, text) as Parquet instead of one small file per document."""
    texts.select("docno", "text").write.mode("overwrite").parquet(path)


def evaluation_report_lines(measures: DataFrame) -> DataFrame:
    """Evaluator-style report lines ``measure<TAB>query<TAB>value``."""
    return measures.select(F.format_string("%-22s\t%s\t%.4f", "measure", "query_id", "value").alias("value"))
