import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    return session


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, key string, h long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, very long and repeated texts, extra columns with clashing names."""
    rows = [
        (1, None, None, None, None, "x", "k", 1), (2, "", "en", "a", 0, None, None, None), (3, " \n\t ", "en", "a", 4, "y", "k", 2),
        (4, "the same text of a few words here", "en", "a", 33, "y", "k", 2), (4, "the same text of a few words here", "en", "a", 33, "y", "k", 2),
        (5, "the same text of a few words here", "en", None, 33, "y", "k", 2), (None, "a row without an id", None, None, None, None, None, None),
        (6, "Word tok, étude ~ \n\n x\x1cy 日本 " * 4000, "fr", "b", 9, "z", "k", 3), (7, "1", "de", "b", 1, "z", "k", 3),
    ]
    return spark.createDataFrame(rows, SCHEMA)
