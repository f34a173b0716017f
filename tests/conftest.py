import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from adeptus.session import build_session
    s = build_session("local[4]", app="adeptus-tests", shuffle_partitions=4,
                      extra={"spark.sql.adaptive.coalescePartitions.enabled": "true"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="adeptus-test-", dir="/tmp")


# A small corpus worked out by hand (see test_scoring.py for the arithmetic).
AUTHORS = [("a1", "Alice", "UniA"), ("a2", "Bob", "UniB"), ("a3", "Carol", "UniA"), ("a4", "Dan", "UniB")]
DOCUMENTS = [(0, "a1", 2010, None, "UniA"), (1, "a1", 2011, None, "UniC"),  # a1 moved
             (2, "a2", 2010, None, "UniB"), (3, "a2", 2012, None, "UniB"),
             (4, "a3", 2011, None, "UniA"), (5, "a3", 2011, None, "UniA")]  # d5: no mentions; a4: no documents
MENTIONS = [
    ("X", "a1", 0, 2010, 0.5), ("X", "a1", 0, 2010, 0.3), ("Y", "a1", 0, 2010, 0.2),  # Y at exactly 0.20
    ("X", "a1", 1, 2011, 0.9), ("Z", "a1", 1, 2011, 0.25),
    ("Y", "a2", 2, 2010, 0.6), ("Z", "a2", 2, 2010, 0.1), (None, "a2", 2, 2010, 0.8),  # null entity
    ("Y", "a2", 3, 2012, 0.7),
    ("X", "a3", 4, 2011, 0.21), ("W", "a3", 4, 2011, 0.4),
]


@pytest.fixture(scope="session")
def corpus(spark):
    from adeptus import schemas
    from adeptus.corpus import Corpus
    return Corpus(spark.createDataFrame(AUTHORS, schemas.AUTHORS),
                  spark.createDataFrame(DOCUMENTS, schemas.DOCUMENTS),
                  spark.createDataFrame(MENTIONS, schemas.MENTIONS))


@pytest.fixture(scope="session")
def qe(spark):
    # q1 = {X, Unknown}; q2 = {Y, Z}; q3 = {Unknown} (no known entity -> no candidates)
    return spark.createDataFrame([("q1", "X"), ("q1", "Unknown"), ("q2", "Y"), ("q2", "Z"), ("q3", "Unknown")],
                                 "query_id string, entity string")
