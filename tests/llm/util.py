"""Small odd tables shared by these tests."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def docs(spark, texts, sources=None, ids=None):
    sources = sources or ["a"] * len(texts)
    ids = ids or list(range(len(texts)))
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in zip(ids, texts, sources)]
    return spark.createDataFrame(rows, DOCS)


def clashing(df, *names):
    """The table with extra columns of other types under names the operator might use itself."""
    from pyspark.sql import functions as F
    for n in names:
        if n not in df.columns:
            df = df.withColumn(n, F.array(F.lit("x")))
    return df
