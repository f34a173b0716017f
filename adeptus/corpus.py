"""The corpus: three base DataFrames plus memoised derived tables.

Base tables (schemas in :mod:`adeptus.schemas`):

* ``authors``   author_id, name, institution
* ``documents`` document_id, author_id, year, body   (every accepted paper)
* ``mentions``  entity, author_id, document_id, year, rho   (one row per mention)

Derived tables are built lazily by the operators and memoised per corpus
object so that one plan that uses a derived table twice shares one
sub-plan (and Spark's exchange reuse can share one shuffle).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from adeptus.session import written

# Confidence threshold for a mention to count for an author (strict ``>``).
DEFAULT_MIN_RHO = 0.20

# derived tables every scoring reads; written together by write_derived()
CORE_DERIVED = ("doc_entities", "author_entity", "papers", "popularity", "total")


@dataclass
class Corpus:
    authors: DataFrame
    documents: DataFrame
    mentions: DataFrame
    min_rho: float = DEFAULT_MIN_RHO
    _memo: dict = field(default_factory=dict, repr=False, compare=False)

    @property
    def spark(self):
        return self.mentions.sparkSession

    def memo(self, key: str, build) -> DataFrame:
        """Build a derived table once per corpus object."""
        if key not in self._memo:
            self._memo[key] = build()
        return self._memo[key]

    def write_derived(self, *keys: str) -> "Corpus":
        """Write the derived tables that several jobs read to the shared folder, each from the ones before.

        Without arguments the core tables.
        """
        for k in keys or CORE_DERIVED:
            self._memo[k] = written(getattr(self, k)(), k)
        return self

    # shortcuts to the most used derived tables --------------------------
    def doc_entities(self) -> DataFrame:
        from adeptus.operators import stats
        return self.memo("doc_entities", lambda: stats.doc_entities(self.mentions, self.min_rho))

    def author_entity(self) -> DataFrame:
        from adeptus.operators import stats
        return self.memo("author_entity", lambda: stats.author_entity_frequency(self.doc_entities()))

    def papers(self) -> DataFrame:
        from adeptus.operators import stats
        return self.memo("papers", lambda: stats.papers_count(self.doc_entities()))

    def popularity(self) -> DataFrame:
        from adeptus.operators import stats
        return self.memo("popularity", lambda: stats.entity_popularity(self.doc_entities()))

    def total(self) -> DataFrame:
        from adeptus.operators import stats
        return self.memo("total", lambda: stats.total_papers(self.documents))
