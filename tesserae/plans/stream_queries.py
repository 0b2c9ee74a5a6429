"""Registered streaming: the same result as the batch form, through a stream's micro-batches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.shared import shared_dir
from ..sources.store import Store
from ..streaming import ingest
from .domain import Domain, sql
from .registry import query

@query(sql(r"""{T} , a AS (SELECT id, source_id, url, content_hash, id % 3 AS batch FROM articles WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 100)
  SELECT id, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY batch, source_id, url) AS r FROM a) WHERE r = 1"""))  # fmt: skip
def stream_ingest_dedup(spark, sf_dir):
    """Articles taken in by the worker from a stream that is started anew for each of three deliveries; what has been seen is the catalog's own tables."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    d = Domain(spark, sf_dir)
    store = Store(spark, f"{root}/catalog")
    approved = {"source_type": F.lit("newsroom"), "discovery_status": F.lit("approved"), "enabled": F.lit(True)}
    store.append("sources", d.sources.select("id", "url", "name").withColumns(approved))
    worker = ingest.Worker(spark, store, f"{root}/vectors")
    entries = ingest.shaped(d.articles)
    for k in range(3):
        entries.where(F.regexp_extract("url", r"(\d+)$", 1).cast("long") % 3 == k).write.mode("append").parquet(f"{root}/inbox")
        stream = spark.readStream.schema(entries.schema).option("maxFilesPerTrigger", 1_000_000).parquet(f"{root}/inbox")
        run = stream.writeStream.foreachBatch(lambda batch, _: worker.ingest(batch)).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    return store.read("documents").select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("id"), "content_hash")


@query(sql(r"""{T} , a AS (SELECT source_id, url, content_hash, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 100 AS long, id FROM articles), k AS (SELECT * FROM a WHERE id % 5 = 0), n AS (SELECT * FROM a WHERE id % 5 <> 0),
  f AS (SELECT source_id, count(*) AS inserted_count FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY source_id, url) AS r FROM n WHERE long AND content_hash NOT IN (SELECT content_hash FROM k)) WHERE r = 1 GROUP BY source_id)
  SELECT n.source_id, count(*) AS discovered_count, CAST(any_value(coalesce(inserted_count, 0)) AS BIGINT) AS inserted_count, count(*) FILTER (NOT long) AS error_count,
  CAST(count(*) - any_value(coalesce(inserted_count, 0)) AS BIGINT) AS skipped_count, CASE WHEN count(*) FILTER (NOT long) > 0 THEN 'partial' ELSE 'completed' END AS status FROM n LEFT JOIN f USING (source_id) GROUP BY n.source_id"""))  # fmt: skip
def worker_cycle_batch(spark, sf_dir):
    """One cycle's counts per source: four fifths of the articles arrive where the others are known."""
    a = Domain(spark, sf_dir).articles
    batch, known = a.where("id % 5 <> 0").drop("content_hash"), a.where("id % 5 = 0")
    return ingest.run_counts(batch, ingest.new_articles(batch, known), known).drop("error_message")
