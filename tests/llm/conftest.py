import pytest
from pyspark.sql import types as T

#: Extra columns whose names the operators use inside.
CLASHES = ["id", "row", "fp", "place", "pos", "key", "bucket", "digest", "size", "shard", "label", "order", "gone", "begin", "h", "_gone_id", "own_id", "spans", "digest_", "node", "keys", "n", "grams"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASHES]
)


@pytest.fixture(scope="session")
def docs(spark):
    def make(rows):
        """Documents from (doc_id, text) pairs, with extra columns of clashing names."""
        return spark.createDataFrame([(k, t, None, None if k is None else f"src{k % 3}", None if t is None else len(t), *["x"] * len(CLASHES)) for k, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def words():
    """Texts of words from a seed."""
    import random

    def make(seed, n, vocabulary=2000):
        rng = random.Random(seed)
        return " ".join(f"w{w}{'xyz'[w % 3]}" for w in (rng.randrange(vocabulary) for _ in range(n)))

    return make
