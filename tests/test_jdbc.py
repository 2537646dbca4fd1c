import pytest

from docengine.sources.jdbc import JdbcVectors


@pytest.fixture()
def store(spark, tmp_path):
    options = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    out = JdbcVectors(spark, f"jdbc:derby:{tmp_path}/vectors;create=true", "chunks", **options)
    rows = spark.createDataFrame([(1, [1.0, 0.0], "one"), (2, [0.0, 2.0], "two"), (3, [3.0, 3.0], None)], "doc_id long, embedding array<float>, content string")
    try:
        out.build(rows)
    except Exception as e:  # the embedded database is not among this Spark's jars
        pytest.skip(str(e)[:200])
    return out


def test_build_upsert_search(spark, store):
    asked = spark.createDataFrame([(7, [0.0, 1.0])], "qid long, embedding array<float>")
    got = [(r.doc_id, round(r.score, 4), r.content) for r in store.search(asked, 2).orderBy("rank").collect()]
    assert got == [(2, 1.0, "two"), (3, 0.7071, "")]
    store.upsert(spark.createDataFrame([(2, [1.0, 0.0], "new"), (4, [0.0, 9.0], "four")], "doc_id long, embedding array<float>, content string"))
    got = [(r.doc_id, r.content) for r in store.search(asked, 2, parts=3, low=1, high=5).orderBy("rank").collect()]
    assert got == [(4, "four"), (3, "")] and store.load().count() == 4


def test_match_query():
    text = JdbcVectors(None, "jdbc:postgresql://h/d", "chunks").match_query([1, 0.5], 3)
    assert "<=> '[1.0,0.5]'" in text and text.endswith("LIMIT 3") and "MAX(o.version)" in text
