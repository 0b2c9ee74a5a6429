"""Column functions, and their registration for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    """Make the functions that need a document tree or an embedder callable from SQL, and plain ones as SQL functions."""
    from ..operators import vectors
    from ..sources.shared import bounded_batches
    from . import text

    bounded_batches(spark)
    for name, udf in (("filing_tree_text", text.filing_tree_text), ("article_tree_text", text.article_tree_text), ("indexed_items", text.indexed_items), ("embed", vectors.embed)):
        spark.udf.register(name, udf)
    spark.udtf.register("chunk_table", text.ChunkTable)
    spark.sql("create or replace temporary function content_hash(x string) returns string return sha2(x, 256)")
    spark.sql(r"create or replace temporary function single_line(x string) returns string return regexp_replace(regexp_replace(x, '(?U)\\s+', ' '), '(?U)^\\s+|\\s+$', '')")
