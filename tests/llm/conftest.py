import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that results use too
    T.StructField("score", T.StringType()), T.StructField("ids", T.StringType()), T.StructField("id", T.StringType()), T.StructField("fp", T.StringType()),
    T.StructField("spans", T.StringType()), T.StructField("block", T.StringType()), T.StructField("label", T.StringType()), T.StructField("n_tokens", T.StringType()),
])
PASSAGE = "One passage of more than fifty bytes that two of these documents have in common, word for word. "


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns."""
    texts = {
        1: "A plain text, it's short.", 2: "A plain text, it's short.", 3: None, 4: "", 5: "   \n\t ", 6: PASSAGE + "First ending.", 7: "Another start. " + PASSAGE,
        8: "word " * 60_000, 9: "x" * 5_000, 10: "naïve café – “quoted” 中文 Ωmega ́ \U0001f600 <|endoftext|> tail", 11: "ab" * 40 + " " + "ab" * 40, 12: "you IDIOT!!! " * 3,
    }
    rows = [(i, t, "en" if i % 2 else None, "s1" if i % 3 else None, None if t is None else len(t), *["x"] * 8) for i, t in texts.items()]
    rows += [(None, PASSAGE, None, None, None, *[None] * 8), (None, "", "en", "s1", 0, *[None] * 8), rows[0], rows[0]]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)
