"""File readers: paper CSVs, XML dumps, association lists, topics and qrels.

All readers take explicit schemas and glob paths (several files are read as
one DataFrame).  Input order, where the reference depends on it, is kept as an
``ordinal`` column: file path, start of the split, and a number that grows with
the rows of a split.  Rows that don't fit a format are left out and listed or
counted by a function of their own: ``rejected_papers``, ``broken_xml_files``,
``rejected_topics``, ``rejected_qrels``.
"""

from __future__ import annotations

import sys
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adeptus.functions.text import normalize_author
from adeptus.operators.ingest import papers_from_documents
from adeptus.session import written

# Functions of this module run inside Python workers (mapInPandas); ship
# them by value so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEMICOLON_FIELDS = 20
# Fixed positions of the semicolon format (0-based).
F_AUTHOR_ID, F_LAST_NAME, F_FIRST_NAME, F_INSTITUTION, F_YEAR, F_DOI, F_ABSTRACT = 0, 1, 2, 4, 6, 11, 13


def _windows_1252_fixups() -> dict[str, str]:
    """Characters 0x80-0x9F decoded as ISO-8859-1 -> their windows-1252 meaning.

    Built from Python's codec (bytes undefined in windows-1252 are left alone).
    """
    out = {}
    for b in range(0x80, 0xA0):
        try:
            out[chr(b)] = bytes([b]).decode("cp1252")
        except UnicodeDecodeError:
            pass
    return out


_CP1252 = _windows_1252_fixups()


def fix_windows_1252(col):
    """Re-map C1 control characters read through ISO-8859-1 to windows-1252."""
    src = "".join(_CP1252.keys())
    dst = "".join(_CP1252.values())
    return F.translate(col, src, dst)


def _with_ordinal(df: DataFrame) -> DataFrame:
    """Add input_file and ordinal, a struct that sorts in input order; no join or window is needed."""
    return (df.withColumn("input_file", F.col("_metadata.file_path"))
            .withColumn("ordinal", F.struct(F.col("_metadata.file_path").alias("file"),
                                            F.col("_metadata.file_block_start").alias("block"),
                                            F.monotonically_increasing_id().alias("row"))))


BAD = "_bad"


def csv_schema(names) -> T.StructType:
    """String columns and the record itself where it doesn't have as many."""
    return T.StructType([T.StructField(c, T.StringType()) for c in (*names, BAD)])


def not_blank(records: DataFrame) -> DataFrame:
    """Records with a value in any field, or with a wrong number of fields."""
    return records.where(F.coalesce(*(F.col(c) for c in records.columns)).isNotNull())


def csv_options(reader, multi_line: bool = True):
    """Records with another number of fields are kept apart in the column ``BAD``."""
    return (reader.option("quote", '"').option("escape", '"').option("multiLine", str(multi_line).lower())
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD))


def _is_1252(encoding: str) -> bool:
    return encoding.lower().replace("_", "-") in ("windows-1252", "cp1252")


def quoted_records(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(input_file, ordinal, record): the records of CSV files whose quoted fields may hold line breaks, read in splits.

    A line begins a record where the number of quotes before it in its file is even
    (a doubled quote within a field counts twice).  That number is a sum in two levels:
    over the splits of a file before the line's own, and over the split's lines before
    it.  Lines that go on with a record of an earlier split get its key.  Where a file's
    first line ends with a carriage return and a line feed, all line ends become line feeds.  So many tasks
    read one file; only a record is put together in one place.  A quote within an unquoted
    field counts like any other.
    """
    block = ["file", "block"]
    text = F.decode(F.col("value").cast("binary"), encoding)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("nth"), text.alias("line"))
    lines = lines.withColumn("quotes", F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit(""))))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = lines.groupBy(*block).agg(F.sum("quotes").alias("q"), F.min_by(F.endswith("line", F.lit("\r")), F.col("nth")).alias("crlf"))
    before = sums.select(*block, F.coalesce(F.sum("q").over(earlier), F.lit(0)).alias("q"),
                         F.first("crlf").over(Window.partitionBy("file").orderBy("block")).alias("crlf"))
    own = Window.partitionBy(*block).orderBy("nth")
    inside = F.coalesce(F.sum("quotes").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = lines.join(before, block).withColumn("first", ((F.col("q") + inside) % 2 == 0).cast("long"))
    rows = rows.withColumn("number", F.sum("first").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = written(rows.select(*block, "nth", "number", "line", "crlf"), "csv-lines")
    held = rows.groupBy(*block).agg(F.max("number").alias("n"))
    last = F.last(F.when(F.col("n") > 0, F.struct("block", F.col("n").alias("number"))), ignorenulls=True).over(earlier)
    owners = held.select(*block, last.alias("open"))
    key = F.when(F.col("number") > 0, F.struct("block", "number")).otherwise(F.col("open"))
    keyed = rows.join(owners, block).select("file", "crlf", key.alias("key"), F.struct("block", "nth", "line").alias("part"))
    parts = F.array_sort(F.collect_list("part"))
    whole = keyed.groupBy("file", "crlf", "key").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("record"))
    return whole.select(F.col("file").alias("input_file"),
                        F.struct("file", F.col("key.block").alias("block"), F.col("key.number").alias("row")).alias("ordinal"),
                        F.when(F.col("crlf"), F.regexp_replace(F.regexp_replace("record", "\r\n", "\n"), "\r$", ""))
                        .otherwise(F.col("record")).alias("record"))


def _records(spark: SparkSession, path: str, names, sep: str, encoding: str, multi_line: bool) -> DataFrame:
    """Columns ``names``, ``BAD``, input_file and ordinal of every record that isn't blank."""
    schema = csv_schema(names)
    if not multi_line:
        reader = csv_options(spark.read.schema(schema), False).option("sep", sep).option("encoding", encoding)
        return _with_ordinal(not_blank(reader.csv(path)).select(*schema.names, "_metadata")).drop("_metadata")
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    parsed = quoted_records(spark, path, encoding).where("record <> ''").select(
        "input_file", "ordinal", F.from_csv("record", ", ".join(f"`{c}` STRING" for c in schema.names), options).alias("c"))
    rows = parsed.select("c.*", "input_file", "ordinal")
    return rows.where(F.coalesce(*(F.col(c) for c in schema.names)).isNotNull())


def _semicolon_records(spark: SparkSession, path: str, encoding: str, multi_line: bool) -> DataFrame:
    return _records(spark, path, [f"c{i}" for i in range(SEMICOLON_FIELDS)], ";",
                    "iso-8859-1" if _is_1252(encoding) else encoding, multi_line)


_YEAR = f"try_cast(trim(c{F_YEAR}) AS INT)"


def read_papers_semicolon(spark: SparkSession, path: str, encoding: str = "windows-1252",
                          multi_line: bool = True) -> DataFrame:
    """``;``-separated, no header, exactly 20 fields per record.

    Columns: author_id, name (B3 of first + last), institution, year (int),
    abstract, doi, input_file, ordinal.  Records with another number of fields
    or a year that is no integer are left out (see ``rejected_papers``).
    windows-1252 is read as ISO-8859-1 and the 0x80-0x9F range re-mapped.
    Large files are read in splits, quoted line breaks and all (``quoted_records``);
    ``multi_line=False`` spares the shuffles where no quoted field has a line break.
    """
    raw = _semicolon_records(spark, path, encoding, multi_line)
    fix = fix_windows_1252 if _is_1252(encoding) else (lambda c: c)
    cols = {i: fix(F.col(f"c{i}")) for i in (F_AUTHOR_ID, F_LAST_NAME, F_FIRST_NAME, F_INSTITUTION,
                                             F_YEAR, F_DOI, F_ABSTRACT)}
    papers = raw.where(F.col(BAD).isNull()).select(
        cols[F_AUTHOR_ID].alias("author_id"),
        normalize_author(cols[F_FIRST_NAME], cols[F_LAST_NAME]).alias("name"),
        cols[F_INSTITUTION].alias("institution"),
        F.expr(_YEAR).alias("year"),
        cols[F_ABSTRACT].alias("abstract"),
        cols[F_DOI].alias("doi"), "input_file", "ordinal")
    return papers.where(F.col("year").isNotNull())


TU_FIELDS = ("doc_id", "author_id", "text")


def _tu_records(spark: SparkSession, path: str, encoding: str, multi_line: bool) -> DataFrame:
    return _records(spark, path, TU_FIELDS, ",", encoding, multi_line)


def read_papers_tu(spark: SparkSession, path: str, encoding: str = "utf-8", multi_line: bool = True) -> DataFrame:
    """A2: ``doc_id,author_id,text`` CSV; name 'Name of <id>', institution 'TU', year 2017."""
    raw = _tu_records(spark, path, encoding, multi_line).where(F.col(BAD).isNull())
    return papers_from_documents(raw.select(*TU_FIELDS, "input_file", "ordinal"), "input_file", "ordinal")


def rejected_papers(spark: SparkSession, path: str, fmt: str, encoding: str | None = None,
                    multi_line: bool = True) -> DataFrame:
    """Per input file: non-blank records, those with a wrong number of fields, and those with a year that is no integer."""
    if fmt == "unipi":
        raw, year_ok = _semicolon_records(spark, path, encoding or "windows-1252", multi_line), F.expr(_YEAR).isNotNull()
    else:
        raw, year_ok = _tu_records(spark, path, encoding or "utf-8", multi_line), F.lit(True)
    fits = F.col(BAD).isNull()
    rows = raw.select("input_file", fits.alias("fits"), year_ok.alias("year_ok"))
    return rows.groupBy("input_file").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(~F.col("fits")).alias("bad_fields"),
        F.count_if(F.col("fits") & ~F.col("year_ok")).alias("bad_year"))


def read_papers(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """A3/A4: dispatch on the format name; ``path`` may be a glob."""
    readers = {"unipi": read_papers_semicolon, "tu": read_papers_tu}
    if fmt not in readers:
        raise ValueError(f"unknown paper format {fmt!r}; known: {', '.join(sorted(readers))}")
    return readers[fmt](spark, path)


def _xml_check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ok = []
        for v in pdf["value"]:
            try:
                ET.fromstring(v)
                ok.append(True)
            except ET.ParseError:
                ok.append(False)
        yield pdf.assign(well_formed=ok)


def _xml_files(spark: SparkSession, path: str) -> DataFrame:
    """(value, path, file, well_formed) of every file, read once."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"),
                                                         F.col("_metadata.file_name").alias("file"))
    return files.mapInPandas(_xml_check, "value string, path string, file string, well_formed boolean")


def xml_text(value) -> "F.Column":
    """Direct text nodes of every element except docno and title, joined by one space."""
    return F.array_join(F.xpath(value, F.lit("//*[not(self::docno) and not(self::title)]/text()")), " ")


def xml_docno(value, file_name) -> "F.Column":
    """The root's docno text, else ``NONE_<file name>``."""
    docno = F.nullif(F.xpath_string(value, F.lit("/*/docno/text()")), F.lit(""))
    return F.coalesce(docno, F.concat(F.lit("NONE_"), file_name))


def read_xml_dump(spark: SparkSession, path: str) -> DataFrame:
    """One document per XML file.

    Columns: docno, text, file.  ``text`` = direct text nodes of every element
    except ``docno`` and ``title``, joined by one space; ``docno`` = the
    root's ``docno`` text, else ``NONE_<file name>``.  Files that are not
    well-formed are dropped (listed by :func:`broken_xml_files`).
    """
    return _xml_files(spark, path).where("well_formed").select(
        xml_docno(F.col("value"), F.col("file")).alias("docno"), xml_text(F.col("value")).alias("text"), "file")


def broken_xml_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths of the files that ``read_xml_dump`` leaves out."""
    return _xml_files(spark, path).where(~F.col("well_formed")).select("path", "well_formed")


def read_assoc(spark: SparkSession, path: str) -> DataFrame:
    """A6 input: first two space-separated fields = author, document; with line order."""
    lines = _with_ordinal(spark.read.text(path).select("value", "_metadata")).drop("_metadata")
    parts = F.split(F.trim(F.col("value")), " ")
    return (lines.where(F.size(parts) >= 2)
            .select(parts[0].alias("author_id"), parts[1].alias("document_id"),
                    F.col("ordinal").alias("line_no")))


def read_text_dir(spark: SparkSession, path: str) -> DataFrame:
    """One text per file; ``doc_id`` = file name without extension."""
    df = spark.read.text(path, wholetext=True)
    return df.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("doc_id"),
                     F.col("value").alias("text"))


def _strip(col):
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def _topic_lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(_strip(F.col("value")).alias("line"), F.col("_metadata.file_path").alias("input_file"))
    return lines.where(F.length("line") > 0)


def _topic_fits(sep: str):
    return F.col("line").contains(";") if sep == ";" else F.size(F.split("line", sep)) == 2


def read_topics(spark: SparkSession, path: str, sep: str = "\t", prefix: str = "topic-") -> DataFrame:
    """``id<sep>description`` lines -> (query_id, text).

    Tab form: exactly two fields, id prefixed with ``prefix`` (A9, B21).
    Semicolon form: split at the first ``;`` (A8), id kept as is.
    """
    lines = _topic_lines(spark, path).where(_topic_fits(sep))
    if sep == ";":
        return lines.select(F.regexp_extract("line", r"^([^;]*);(.*)$", 1).alias("query_id"),
                            F.regexp_extract("line", r"^([^;]*);(.*)$", 2).alias("text"))
    parts = F.split("line", sep)
    return lines.select(F.concat(F.lit(prefix), parts[0]).alias("query_id"), parts[1].alias("text"))


def rejected_topics(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Non-empty lines that ``read_topics`` leaves out: (input_file, record)."""
    return _topic_lines(spark, path).where(~_topic_fits(sep)).select("input_file", F.col("line").alias("record"))


_REL = "try_cast(try_element_at(split(line, '\\t'), 4) AS INT)"


def _qrel_fits():
    return (F.size(F.split("line", "\t")) == 4) & F.expr(_REL).isNotNull()


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """A10: ``topic<TAB>ignored<TAB>author<TAB>rel`` -> (query_id, author_id, rel)."""
    parts = F.split("line", "\t")
    return (_topic_lines(spark, path).where(_qrel_fits())
            .select(parts[0].alias("query_id"), parts[2].alias("author_id"), F.expr(_REL).alias("rel")))


def rejected_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines that ``read_qrels`` leaves out: (input_file, record)."""
    return _topic_lines(spark, path).where(~_qrel_fits()).select("input_file", F.col("line").alias("record"))
