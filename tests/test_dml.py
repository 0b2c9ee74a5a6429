import pytest
from pyspark.sql import functions as F

from tesserae.functions import register
from tesserae.operators import dml, health, relational

@pytest.fixture
def now(spark):
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


def test_runs_open_and_finish(spark, now):
    runs = spark.createDataFrame([], "id long, question string, status string, answer_text string, error_message string, started_at timestamp, completed_at timestamp")
    runs = dml.open_runs(runs, spark.createDataFrame([("b",), ("a",)], "question string"), now)
    assert [(r.id, r.question, r.status) for r in runs.orderBy("id").collect()] == [(1, "a", "running"), (2, "b", "running")]
    ended = dml.finish_runs(runs, spark.createDataFrame([(2, "completed", "yes", None)], "id long, status string, answer_text string, error_message string"), ("completed", "failed"), now)
    rows = {r.id: r for r in ended.collect()}
    assert (rows[2].status, rows[2].answer_text, rows[2].question) == ("completed", "yes", "b") and rows[2].completed_at and rows[1].completed_at is None
    with pytest.raises(RuntimeError, match="no run has the id 7"):
        dml.finish_runs(runs, spark.createDataFrame([(7, "failed")], "id long, status string"), ("failed",), now)
    with pytest.raises(Exception, match="Invalid status: odd"):
        dml.finish_runs(runs, spark.createDataFrame([(1, "odd")], "id long, status string"), ("failed",), now).collect()


def test_sessions(spark, now):
    shape = "id long, session_key string, title string, metadata_json string, created_at timestamp, updated_at timestamp"
    first = dml.upsert_sessions(spark.createDataFrame([], shape), spark.createDataFrame([("k", "T", None)], "session_key string, title string, metadata_json string"), now)
    later = F.lit("2027-01-01 00:00:00").cast("timestamp")
    again = dml.upsert_sessions(first, spark.createDataFrame([("k", None, None), ("m", "U", "{}")], "session_key string, title string, metadata_json string"), later)
    rows = {r.session_key: r for r in again.collect()}
    assert rows["k"].title == "T" and rows["k"].updated_at.year == 2026 and (rows["m"].id, rows["m"].updated_at.year) == (2, 2027)
    changed = dml.upsert_sessions(first, spark.createDataFrame([("k", "New", None)], "session_key string, title string, metadata_json string"), later).first()
    assert (changed.title, changed.updated_at.year, changed.created_at.year) == ("New", 2027, 2026)


@pytest.mark.parametrize(
    ("rows", "exists", "status"),
    [
        ([("a", 0, 0, 0, 0), ("b", 0, 0, 0, 0)], False, "empty"),
        ([("a", 2, 2, 2, 0), ("b", 0, 0, 0, 0)], True, "degraded"),
        ([("a", 2, 0, 0, 0), ("b", 0, 0, 0, 0)], False, "building"),
        ([("a", 2, 2, 2, 2), ("b", 3, 2, 2, 2)], True, "building"),
        ([("a", 2, 2, 2, 2), ("b", 3, 3, 3, 3)], True, "healthy"),
    ],
)
def test_health_ladder(spark, rows, exists, status):
    corpora = spark.createDataFrame(rows, "name string, expected long, ready long, records long, points long")
    assert health.index_status(corpora, exists).first().status == status


def test_set_null_and_progress(spark):
    runs = spark.createDataFrame([(1, "m", "c", "indexing", 0), (2, "m", "c", "ready", 5)], "filing_id long, embedding_model string, vector_collection string, status string, indexed_point_count long")
    progress = runs.select("filing_id", "embedding_model", "vector_collection", F.lit(9).cast("long").alias("indexed_point_count"))
    assert {r.filing_id: r.indexed_point_count for r in dml.set_run_progress(runs, progress).collect()} == {1: 9, 2: 5}
    rows = spark.createDataFrame([(1, 7), (2, 8)], "id long, company_id long")
    assert {r.id: r.company_id for r in dml.set_null_reference(rows, spark.createDataFrame([(7,)], "id long"), "id", "company_id").collect()} == {1: None, 2: 8}


def test_limits(spark):
    with pytest.raises(ValueError):
        relational.recent_query_runs(spark.range(1), 0)


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("select single_line(' a  b ') as a, content_hash('x') as h, article_tree_text('<body><p>t</p></body>') as t, size(embed('a b')) as n").first()
    assert row.a == "a b" and row.h.startswith("2d711642") and row.t.strip() == "t" and row.n == 64
