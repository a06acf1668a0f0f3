import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
        # names the operators use inside
        *[T.StructField(c, T.StringType()) for c in ("id", "fp", "v", "root", "n", "g", "h", "d", "t",
                                                     "passes", "side", "found", "score", "at")],
    ]
)


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents from (id, text) or (id, text, source) rows, with clashing columns."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "s") + ("x",) * 14 for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make
