"""Language identification by stop-word profiles (replaces a detection library).

Each text is scored per language by the number of its tokens that are
function words of that language; the best score wins (ties: language code
order), no function word at all -> ``broken``.  Everything is a per-row
JVM expression over the token array: no explode, no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adeptus.session import dealt

BROKEN = "broken"

# Common function words per language (public word lists).
STOPWORDS: dict[str, tuple[str, ...]] = {
    "de": ("der", "die", "das", "und", "in", "den", "von", "zu", "mit", "sich", "auf", "des", "für",
           "ist", "nicht", "dem", "im", "ein", "eine", "als", "auch", "es", "an", "werden", "aus", "er",
           "hat", "dass", "sie", "nach", "wird", "bei", "einer", "um", "am", "sind", "noch", "wie"),
    "en": ("the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "be",
           "by", "as", "this", "are", "at", "from", "an", "or", "have", "not", "but", "had", "his",
           "they", "which", "you", "were", "their", "has", "been", "would", "there", "we", "he"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "por", "un", "no", "con",
           "su", "una", "es", "para", "al", "lo", "como", "más", "pero", "sus", "le", "ya", "o",
           "este", "sí", "porque", "esta", "entre", "cuando", "muy", "sin", "sobre", "también"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "pour", "est", "qui",
           "par", "dans", "sur", "au", "pas", "avec", "il", "ce", "ne", "se", "plus", "aux", "son",
           "sont", "mais", "nous", "vous", "ou", "elle", "comme", "cette", "ont", "été", "leur"),
    "it": ("di", "e", "il", "la", "che", "in", "a", "per", "un", "del", "non", "è", "una", "della",
           "con", "sono", "alla", "gli", "le", "si", "da", "nel", "dei", "anche", "più", "ma", "come"),
    "nl": ("de", "en", "van", "het", "een", "in", "is", "dat", "op", "te", "zijn", "met", "voor",
           "niet", "die", "aan", "er", "ook", "als", "bij", "door", "maar", "om", "worden", "naar"),
    "pt": ("de", "a", "o", "que", "e", "do", "da", "em", "um", "para", "com", "não", "uma", "os",
           "no", "se", "na", "por", "mais", "as", "dos", "como", "mas", "ao", "ele", "das", "à", "seu"),
}


LANGS = tuple(sorted(STOPWORDS))


def _word_pattern(words) -> str:
    """Regex matching any of the words as a whole token (a maximal run of letters)."""
    alt = "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
    return rf"(?<!\p{{L}})(?:{alt})(?!\p{{L}})"


def language_scores(text) -> Column:
    """array<struct<n:int, lang:string>>: stop-word hits per language.

    Each language is one regex pass over the lower-cased text counting the
    tokens (maximal letter runs) that are its function words -- JVM regex,
    no explode, no shuffle.
    """
    low = F.lower(text if isinstance(text, Column) else F.col(text))
    return F.array(*[F.struct(F.size(F.regexp_extract_all(low, F.lit(_word_pattern(STOPWORDS[lang])), 0))
                              .alias("n"), F.lit(lang).alias("lang"))
                     for lang in LANGS])


def detect_language(text) -> Column:
    """Best-scoring language code, or ``broken`` when no function word occurs.

    Ties go to the language code that sorts first.
    """
    scores = language_scores(text)
    top = F.aggregate(scores, F.struct(F.lit(0).alias("n"), F.lit(BROKEN).alias("lang")),
                      lambda acc, x: F.when(x["n"] > acc["n"], x).otherwise(acc))
    return top["lang"]


def with_language(docs: DataFrame, text_col: str = "text", out_col: str = "detected") -> DataFrame:
    return dealt(docs).withColumn(out_col, detect_language(F.col(text_col)))


def language_counts(docs: DataFrame, lang_col: str = "detected") -> DataFrame:
    """Documents per detected language."""
    return docs.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("documents"))


def route_non_english(docs: DataFrame, lang_col: str = "detected") -> DataFrame:
    """Documents that would go to translation (detected language is not English)."""
    return docs.where(F.col(lang_col) != F.lit("en"))
