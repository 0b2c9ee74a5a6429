"""Index health: counts of two corpora, their differences, and the state they add up to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_health(corpora: DataFrame) -> DataFrame:
    """corpora(name, expected, ready, records, points) with missing and extra points, and whether it is complete and consistent."""
    return corpora.withColumns(
        {
            "missing": F.greatest(F.lit(0), F.col("records") - F.col("points")),
            "extra": F.greatest(F.lit(0), F.col("points") - F.col("records")),
            "complete": (F.col("expected") == F.col("ready")) & (F.col("expected") == F.col("records")),
            "consistent": F.col("records") == F.col("points"),
        }
    )


def index_status(corpora: DataFrame, collection_exists: bool) -> DataFrame:
    """One row: totals over corpora and the status, by the first rule that holds."""
    status = (
        F.when((F.col("expected") == 0) & (F.col("points") == 0), "empty")
        .when(~F.col("consistent"), "degraded")
        .when(F.lit(not collection_exists) & (F.col("expected") > 0), "building")
        .when(~F.col("complete"), "building")
        .otherwise("healthy")
    )
    totals = corpus_health(corpora).agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("expected", "ready", "records", "points", "missing", "extra")),
        F.coalesce(F.bool_and("complete"), F.lit(True)).alias("complete"),
        F.coalesce(F.bool_and("consistent"), F.lit(True)).alias("consistent"),
    )
    return totals.withColumn("status", status)


def corpora_from_counts(counts: DataFrame, sec_points: int, document_points: int) -> DataFrame:
    """The two corpora from relational.health_counts; documents count as ready when they are recorded."""
    sec = F.struct(F.lit("sec").alias("name"), F.col("sec_expected_points").alias("expected"), F.col("sec_ready_points").alias("ready"), F.col("sec_embedding_records").alias("records"), F.lit(sec_points).cast("long").alias("points"))
    web = F.struct(
        F.lit("documents").alias("name"), F.col("document_expected_points").alias("expected"), F.col("document_embedding_records").alias("ready"),
        F.col("document_embedding_records").alias("records"), F.lit(document_points).cast("long").alias("points"),
    )
    return counts.select(F.explode(F.array(sec, web)).alias("c")).select("c.*")
