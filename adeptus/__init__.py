"""adeptus — topical expertise analytics on Spark.

A corpus is three DataFrames (authors, documents, entity mentions).  Every
operator is a plain function ``DataFrame -> DataFrame`` that works on all
authors / all queries at once; a single-author or single-query call is just a
filter on the result.
"""

from adeptus.corpus import Corpus, DEFAULT_MIN_RHO

__all__ = ["Corpus", "DEFAULT_MIN_RHO"]
