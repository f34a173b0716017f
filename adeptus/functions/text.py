"""Column functions for text fields (all JVM-side, no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word characters kept by author-name normalisation: Unicode letters, digits, '_'.
_NON_WORD = r"[^\p{L}\p{N}_]+"
# The reference's whitespace class (space, \t, \n, \v, \f, \r).
_WS = r"[ \t\n\x0B\f\r]"
#: Characters of the parts that annotated spans are cut from, a power of two.
PART_BITS = 8
PART_CHARS = 1 << PART_BITS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def legit_document(text) -> Column:
    """B2: document accepted when non-null and longer than 10 characters."""
    t = _c(text)
    return t.isNotNull() & (F.length(t) > 10)


def normalize_author(first_name, last_name) -> Column:
    """``"first last"``, whitespace runs collapsed, each word capitalised
    (rest lower-case), trimmed; then every run of non-word characters -> one
    space.  Word characters include Unicode letters (accents are kept)."""
    joined = F.concat_ws(" ", _c(first_name), _c(last_name))
    words = F.trim(F.regexp_replace(joined, r"\s+", " "))
    return F.regexp_replace(F.initcap(words), _NON_WORD, " ")


def html_escape(text) -> Column:
    """Escape ``&``, ``<``, ``>`` (text content)."""
    t = _c(text)
    return F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def html_attr_escape(text) -> Column:
    """Escape for a single- or double-quoted attribute value."""
    t = html_escape(text)
    return F.replace(F.replace(t, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))


def plain_decimal(x) -> Column:
    """A number without exponent, up to 12 decimals, at least one."""
    return F.regexp_replace(_c(x).cast("decimal(38,12)").cast("string"), r"(\.\d+?)0+$", "$1")


def annotated_text(text, annotations) -> Column:
    """Text with each annotation wrapped in a span.

    ``annotations``: array<struct<begin, end, entity, rho>> with 0-based
    [begin, end) character offsets.  Annotations are sorted by begin; the
    text between them and the surface are HTML-escaped; each span carries
    the entity (attribute-escaped) and the score.  Unlike the reference,
    the text after the last annotation is escaped too.  Scores are printed in
    plain decimals, 12 at most.

    Each annotation is paired with the previous one's end by ``zip_with``
    so the per-annotation lambda only sees its own arguments (an array
    expression referenced inside a lambda is re-evaluated per element).
    What it cuts from the text comes from the parts of ``PART_CHARS`` characters that it
    touches: a place in the whole text is found by counting from its start, so the work
    would grow with its length times its annotations.
    """
    t = _c(text)
    once = F.struct(F.regexp_extract_all(t, F.lit("(?s).{1,%d}" % PART_CHARS), F.lit(0)).alias("parts"),
                    F.array_sort(F.coalesce(_c(annotations), F.array())).alias("anns"))

    def body(row):
        parts, anns = row["parts"], row["anns"]
        prev_ends = F.concat(F.array(F.lit(0)), F.transform(anns, lambda a: a["end"]))

        def cut(begin, end):
            first, last = (F.shiftright(c, PART_BITS).cast("int") for c in (begin, end - 1))
            near = F.when((first == last) & (first < F.size(parts)), F.get(parts, first)).otherwise(
                F.array_join(F.slice(parts, first + 1, F.greatest(last - first + 1, F.lit(0))), ""))
            return (F.when(begin >= 0, F.substring(near, begin.bitwiseAND(PART_CHARS - 1) + 1, end - begin))
                    .otherwise(F.substring(t, begin + 1, end - begin)))

        def piece(a, prev):
            return F.concat(html_escape(cut(prev, a["begin"])),
                            F.lit("<span class='annotation' entity='"),
                            html_attr_escape(F.coalesce(a["entity"], F.lit(""))),
                            F.lit("' score='"), plain_decimal(a["rho"]), F.lit("'>"),
                            html_escape(cut(a["begin"], a["end"])), F.lit("</span>"))

        last_end = F.element_at(prev_ends, -1)
        tail = F.when(last_end < F.length(t), cut(last_end, F.length(t))).otherwise(F.lit(""))
        return F.concat(F.array_join(F.zip_with(anns, prev_ends, piece), ""), html_escape(tail))

    return F.transform(F.array(once), body)[0]           # bound to a name, so that each is evaluated once a text


def snippet(text, limit: int = 83, keep: int = 80) -> Column:
    """Longer than ``limit`` chars -> first ``keep`` + '...'; each whitespace char -> space."""
    t = _c(text)
    short = F.when(F.length(t) > limit, F.concat(F.substring(t, 1, keep), F.lit("..."))).otherwise(t)
    return F.regexp_replace(short, _WS, " ")


def truncate(text, n: int = 5000) -> Column:
    """First ``n`` characters."""
    return F.substring(_c(text), 1, n)


def normalize_space(text) -> Column:
    """Each whitespace character -> space, then trim."""
    return F.trim(F.regexp_replace(_c(text), _WS, " "))
