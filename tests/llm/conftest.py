import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(__file__))))

#: Texts that every text operator must take: nulls, empty, white space, one very long, ties and repeated rows.
ODD = [None, "", " \n\t ", "a", "Êtes-vous là? ÊTES", "x  \n b \n x  \n\n b", "word " * 60, "don't <|endoftext|> 've  \n y", "　z 12.5 q", "long tail " * 30_000]


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


def docs_frame(spark, texts, extra=True, ids=None):
    """documents with the usual columns, and one whose name an operator might use itself."""
    rows = [(i if ids is None else ids[i], t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumn("n_words", F.lit("clash")).withColumn("hash", F.lit(1.5)).withColumn("n_tokens", F.lit(None).cast("int"))
    return df
