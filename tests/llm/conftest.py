import pytest

from pagemill.llm.common import ready

WORDS = (
    "amber basin cedar delta ember fjord grove haven inlet jetty kelp ledge marsh north ocean "
    "pebble quarry ridge shore tidal upland valley willow yarrow zephyr".split()
)


@pytest.fixture(autouse=True)
def _ready(spark):
    ready(spark)


@pytest.fixture
def prose():
    """A text of ``n`` words that differs with ``seed``."""
    import random

    def make(seed, n):
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ly"]) for _ in range(n))

    return make


@pytest.fixture
def frame(spark):
    """A table of documents with an extra column under a name the operators use themselves."""

    def make(rows, schema="doc_id bigint, text string"):
        return spark.createDataFrame(rows, schema)

    return make
