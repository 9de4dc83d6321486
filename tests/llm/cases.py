"""Hand-made tables with the cases every operator must take."""

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "The quick brown fox jumps over the lazy dog, again. " * 3000


def edge_rows():
    same = "one two three four five six seven eight nine ten"
    return [(1, None, "en", None, 0), (2, "", None, "s", 0), (3, " \n\t ", "en", "s", 3), (4, "...!!", "fr", "s", 5),
            (5, same, "en", "s", 47), (6, same, "en", "s", 47), (7, same.upper(), "en", "s", 47), (7, same.upper(), "en", "s", 47),
            (8, LONG, "en", "s", len(LONG)), (9, LONG + "x", "en", "s", len(LONG) + 1), (10, "é ñandú\tstraße 日本 <|endoftext|> \x00z", "de", "s", 20),
            (11, "a", "en", "s", 1), (12, "  two   words\r\n", "en", "s", 12), (None, "no id here", "en", "s", 10)]


def edge_docs(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(edge_rows(), DOCS)
    for c in ("piece", "start", "fp", "key", "component_id", "score", "words", "rank"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def sf_rows(name, sf=SF):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()
