"""Registered merges, replacements and state changes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import dml
from ..operators import relational as r
from ..sources.index import VectorIndex
from ..sources.shared import shared_dir
from ..sources.store import Store
from ..streaming import ingest
from .domain import COLLECTION, MODEL, Domain, sql
from .registry import query


@query(sql("{T} SELECT min(id) AS id, content_hash, count(*) AS copies FROM articles GROUP BY content_hash"))
def content_hash_dedup(spark, sf_dir):
    """The first article of each content."""
    return Domain(spark, sf_dir).articles.groupBy("content_hash").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))


@query(sql("{T} SELECT a.id, a.url FROM articles a WHERE a.id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM articles b WHERE b.id % 2 = 0 AND b.content_hash = a.content_hash)"))
def url_dedup(spark, sf_dir):
    """Of the odd articles those whose url and content no even one has."""
    a = Domain(spark, sf_dir).articles
    return r.unseen(a.where("id % 2 = 1"), a.where("id % 2 = 0")).select("id", "url")


@query(sql("""{T} , n AS (SELECT id + 5 AS id, 'renamed ' || name AS name, CASE WHEN id % 2 = 0 THEN cik END AS cik FROM companies)
  SELECT coalesce(n.id, c.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.name ELSE c.name END AS name, CASE WHEN n.id IS NOT NULL THEN n.cik ELSE c.cik END AS cik FROM companies c FULL JOIN n ON n.id = c.id"""))  # fmt: skip
def upsert_merge(spark, sf_dir):
    """New rows overwrite those of their key, nulls included, and add new keys."""
    c = Domain(spark, sf_dir).companies.select("id", "name", "cik")
    new = c.select((F.col("id") + 5).alias("id"), F.concat(F.lit("renamed "), "name").alias("name"), F.when(F.col("id") % 2 == 0, F.col("cik")).alias("cik"))
    return dml.merge_upsert(c, new, ["id"])


@query(sql("""{T} SELECT filing_id, section_id, chunk_index, text FROM chunks WHERE filing_id % 10 <> 0 UNION ALL SELECT id, '1', 0, 'new text of ' || accession_number FROM filings WHERE id % 10 = 0"""))
def replace_chunks(spark, sf_dir):
    """All chunks of every tenth filing are exchanged for one."""
    d = Domain(spark, sf_dir)
    new = d.filings.where("id % 10 = 0").select(F.col("id").alias("filing_id"), F.lit("1").alias("section_id"), F.lit(0).alias("chunk_index"), F.concat(F.lit("new text of "), "accession_number").alias("text"))
    return dml.replace_children(d.chunks, new, "filing_id")


@query(sql("""{T} SELECT filing_id, CASE WHEN filing_id % 10 = 0 THEN 'pending' ELSE status END AS status,
  CAST(CASE WHEN filing_id % 10 = 0 THEN (SELECT count(*) FROM chunks c WHERE c.filing_id = e.filing_id) ELSE expected_point_count END AS BIGINT) AS expected_point_count,
  CASE WHEN filing_id % 10 = 0 THEN 0 ELSE indexed_point_count END AS indexed_point_count FROM embedding_runs e"""))  # fmt: skip
def embedding_status_reset(spark, sf_dir):
    """Runs of filings whose chunks were replaced are pending again."""
    d = Domain(spark, sf_dir)
    reset = dml.reset_runs(d.embedding_runs, d.chunks, d.embedding_runs.where("filing_id % 10 = 0"))
    return reset.select("filing_id", "status", "expected_point_count", "indexed_point_count")


@query(sql("""{T} SELECT filing_id, CASE WHEN filing_id % 4 = 0 THEN 'ready' WHEN filing_id % 4 = 1 THEN 'indexing' ELSE status END AS status,
  CASE WHEN filing_id % 4 = 1 THEN 't' END AS started, CASE WHEN filing_id % 4 = 0 THEN 't' END AS completed FROM embedding_runs"""))  # fmt: skip
def embedding_status_change(spark, sf_dir):
    """Only `indexing` sets a start; `ready` and `failed` set the end."""
    runs = Domain(spark, sf_dir).embedding_runs.withColumns({"started_at": F.lit(None).cast("string"), "completed_at": F.lit(None).cast("string")})
    status = F.when(F.col("filing_id") % 4 == 0, "ready").otherwise("indexing")
    changes = runs.where("filing_id % 4 < 2").select("filing_id", "embedding_model", "vector_collection", status.alias("status"))
    changed = dml.set_run_status(runs, changes, F.lit("t"))
    return changed.select("filing_id", "status", F.col("started_at").alias("started"), F.col("completed_at").alias("completed"))


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def obsolete_ids(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return dml.obsolete_ids(d.table("documents").select(F.col("doc_id").alias("id")), d.table("labels").select(F.col("doc_id").alias("id")))


@query("""SELECT doc_id AS id, 'stored' AS side FROM documents WHERE doc_id % 3 <> 0 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)
  UNION ALL SELECT doc_id, 'expected' FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 = 0""")
def id_set_verification(spark, sf_dir):
    """Ids that are stored but not expected, and the other way round."""
    ids = Domain(spark, sf_dir).table("documents").select(F.col("doc_id").alias("id"))
    return dml.id_differences(ids.where("id % 3 <> 0"), ids.where("id % 2 = 0"))


@query("""SELECT * FROM (SELECT 'documents' AS "table", (SELECT count(*) FROM documents) AS source_n, (SELECT count(*) FROM labels) AS target_n
  UNION ALL SELECT 'pages', (SELECT count(*) FROM pages), (SELECT count(*) FROM pages) UNION ALL SELECT 'events', (SELECT count(*) FROM events), NULL) WHERE source_n IS DISTINCT FROM target_n""")
def count_validation(spark, sf_dir):
    """Tables whose counts differ between a copy's source and target."""
    d = Domain(spark, sf_dir)
    count = lambda name, of: d.table(of).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
    source = count("documents", "documents").union(count("pages", "pages")).union(count("events", "events"))
    return dml.count_mismatches(source, count("documents", "labels").union(count("pages", "pages")))


@query(sql("""{T} SELECT id, CASE WHEN id IN (1, 5, 99) THEN 'approved' ELSE discovery_status END AS discovery_status, CASE WHEN id IN (1, 5, 99) THEN true ELSE enabled END AS enabled FROM sources"""))
def approve_sources(spark, sf_dir):
    return dml.decide_sources(Domain(spark, sf_dir).sources, [1, 5, 99], True).select("id", "discovery_status", "enabled")


@query(sql("""{T} SELECT id, CASE WHEN id IN (0, 4) THEN 'rejected' ELSE discovery_status END AS discovery_status, CASE WHEN id IN (0, 4) THEN false ELSE enabled END AS enabled FROM sources"""))
def reject_sources(spark, sf_dir):
    return dml.decide_sources(Domain(spark, sf_dir).sources, [0, 4], False).select("id", "discovery_status", "enabled")


@query(sql("""{T} SELECT url, CASE WHEN discovery_status <> 'candidate' THEN discovery_status ELSE 'candidate' END AS discovery_status, CASE WHEN discovery_status <> 'candidate' THEN enabled ELSE true END AS enabled FROM sources
  UNION ALL SELECT 'https://new.example.com/', 'candidate', true"""))  # fmt: skip
def rediscovery_state(spark, sf_dir):
    """A person's decision on a source stays when it is found again."""
    s = Domain(spark, sf_dir).sources
    found = s.select("url").union(spark.range(1).select(F.lit("https://new.example.com/")))
    return r.discovery_state(found, s).select("url", "discovery_status", "enabled")


@query(sql("""{T} SELECT source_id, count(*) AS documents FROM articles WHERE source_id NOT IN (SELECT id FROM sources WHERE discovery_status = 'rejected') GROUP BY source_id"""))
def cascade_delete(spark, sf_dir):
    """Documents of deleted sources go with them."""
    d = Domain(spark, sf_dir)
    _, left = dml.delete_cascade(d.sources, d.articles, d.sources.where("discovery_status = 'rejected'"), "id", "source_id")
    return left.groupBy("source_id").agg(F.count(F.lit(1)).alias("documents"))


@query(sql("""{T} SELECT id, CASE WHEN confidence_score > 0.6 THEN 'confidence_score' ELSE '' END AS faults FROM sources"""))
def quarantined_rows(spark, sf_dir):
    """Rows with scores outside 0 to 1 or values outside their domain, with what is wrong."""
    s = Domain(spark, sf_dir).sources.withColumn("confidence_score", F.when(F.col("confidence_score") > 0.6, F.col("confidence_score") + 1).otherwise(F.col("confidence_score")))
    return dml.quarantine(s).select("id", F.array_join("faults", ",").alias("faults"))


@query(f"SELECT doc_id AS document_chunk_id, '{MODEL}' AS embedding_model, '{COLLECTION}' AS vector_collection, CASE WHEN doc_id % 2 = 0 THEN 'v' || doc_id ELSE 'old' END AS vector_id FROM labels")
def record_embeddings(spark, sf_dir):
    """Records of embedded chunks, overwritten by key."""
    old = Domain(spark, sf_dir).article_records.withColumn("vector_id", F.lit("old"))
    new = old.where("document_chunk_id % 2 = 0").withColumn("vector_id", F.concat(F.lit("v"), F.col("document_chunk_id").cast("string")))
    return dml.merge_upsert(old, new, ["document_chunk_id", "embedding_model", "vector_collection"])


@query(sql(f"""{{T}} , n AS (SELECT filing_id, count(*) AS n FROM chunks GROUP BY 1) SELECT e.filing_id, CASE WHEN e.filing_id % 5 > 0 THEN 'pending' ELSE e.status END AS status, CASE WHEN e.filing_id % 5 > 0 THEN coalesce(n, 0) ELSE expected_point_count END AS expected_point_count,
  CASE WHEN e.filing_id % 5 > 0 THEN 0 ELSE indexed_point_count END AS indexed_point_count, (SELECT count(*) FROM filing_records WHERE vector_collection <> '{COLLECTION}') AS records_left FROM embedding_runs e LEFT JOIN n ON n.filing_id = e.filing_id"""))
def reset_index(spark, sf_dir):
    """The index of one collection built anew: its runs pending, expecting the chunks there are, its records gone; other collections' stay."""
    d = Domain(spark, sf_dir)
    runs = d.embedding_runs.withColumn("vector_collection", F.when(F.col("filing_id") % 5 == 0, "other").otherwise(COLLECTION))
    runs, records = dml.reset_filing_index(runs, d.chunks, d.filing_records, MODEL, COLLECTION)
    left = records.agg(F.count(F.lit(1)).alias("records_left"))
    return runs.select("filing_id", "status", "expected_point_count", "indexed_point_count").join(F.broadcast(left), F.lit(True))  # one row


@query(sql(f"{{T}} SELECT chunk_id FROM filing_records WHERE vector_collection <> '{COLLECTION}'"))
def reset_document_records(spark, sf_dir):
    return dml.without_records(Domain(spark, sf_dir).filing_records, MODEL, COLLECTION).select("chunk_id")


@query(sql("""{T} SELECT id, accession_number AS owner, 'old' AS version FROM vectors WHERE accession_number NOT IN ('A1', 'A5', 'A7') UNION ALL SELECT id + 1000000, accession_number, 'new' FROM vectors WHERE accession_number IN ('A1', 'A5') AND id % 2 = 0"""))
def replace_vectors(spark, sf_dir):
    """Filings indexed again: their old vectors go, the ones left of them come; one comes without any."""
    stored = Domain(spark, sf_dir).vectors.where("accession_number is not null").select("id", F.col("accession_number").alias("owner"), F.lit("old").alias("version"))
    new = stored.where("owner in ('A1', 'A5') and id % 2 = 0").select((F.col("id") + 1000000).alias("id"), "owner", F.lit("new").alias("version"))
    return dml.replace_vectors(stored, new, stored.where("owner in ('A1', 'A5', 'A7')").select("owner"))


@query(sql("{T} SELECT filing_id, indexed_point_count + CASE WHEN filing_id % 3 = 0 AND filing_id % 2 = 0 AND filing_id % 4 = 0 THEN 100 ELSE 0 END AS indexed_point_count FROM embedding_runs"))
def index_progress(spark, sf_dir):
    """Counts of indexed points: taken only for runs that are indexing."""
    runs = Domain(spark, sf_dir).embedding_runs.withColumn("status", F.when(F.col("filing_id") % 4 == 0, "indexing").otherwise("ready"))
    told = runs.where("filing_id % 6 = 0").select("filing_id", "embedding_model", "vector_collection", (F.col("indexed_point_count") + 100).alias("indexed_point_count"))
    return dml.set_run_progress(runs, told).select("filing_id", "indexed_point_count")


@query("""SELECT conv_id AS id, CASE conv_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'running' END AS status, CASE WHEN conv_id % 3 = 0 THEN 'new' ELSE 'old' END AS answer_text, CASE WHEN conv_id % 3 < 2 THEN 't' END AS completed_at FROM (SELECT DISTINCT conv_id FROM conversations)""")
def finish_query_runs(spark, sf_dir):
    """Runs that end: given values go over stored ones, the others stay."""
    runs = Domain(spark, sf_dir).table("conversations").select(F.col("conv_id").alias("id")).distinct().withColumns({"status": F.lit("running"), "answer_text": F.lit("old"), "completed_at": F.lit(None).cast("string")})
    k = F.col("id") % 3
    changes = runs.where("id % 3 < 2").select("id", F.when(k == 0, "completed").otherwise("failed").alias("status"), F.when(k == 0, "new").alias("answer_text"))
    return dml.finish_runs(runs, changes, dml.DOMAINS["query_status"], F.lit("t"))


@query("""SELECT coalesce(c.id, m.last + row_number() OVER (PARTITION BY c.id IS NULL ORDER BY n.session_key)) AS id, coalesce(c.session_key, n.session_key) AS session_key, CASE WHEN n.title IS NOT NULL THEN n.title ELSE c.title END AS title,
  CASE WHEN c.id IS NULL OR n.title <> c.title THEN '2026-02-02' ELSE '2026-01-01' END AS updated FROM (SELECT conv_id AS id, 's' || conv_id AS session_key, 'title ' || conv_id % 4 AS title FROM conversations WHERE turn = 0) c
  FULL JOIN (SELECT 's' || conv_id + 3 AS session_key, CASE WHEN conv_id % 2 = 0 THEN 'title 0' END AS title FROM conversations WHERE turn = 0) n USING (session_key), (SELECT max(conv_id) AS last FROM conversations WHERE turn = 0) m""")
def upsert_sessions(spark, sf_dir):
    """Sessions that come again: a title changes only where one is given and differs; new ones get the next ids."""
    first = Domain(spark, sf_dir).table("conversations").where("turn = 0")
    at = lambda x: F.lit(f"{x} 00:00:00").cast("timestamp")
    told = F.concat(F.lit("title "), (F.col("conv_id") % 4).cast("string"))
    key = lambda c: F.concat(F.lit("s"), c.cast("string"))
    current = first.select(F.col("conv_id").alias("id"), key(F.col("conv_id")).alias("session_key"), told.alias("title"), F.lit(None).cast("string").alias("metadata_json"), at("2026-01-01").alias("created_at"), at("2026-01-01").alias("updated_at"))
    incoming = first.select(key(F.col("conv_id") + 3).alias("session_key"), F.when(F.col("conv_id") % 2 == 0, "title 0").alias("title"), F.lit(None).cast("string").alias("metadata_json"))
    return dml.upsert_sessions(current, incoming, at("2026-02-02")).select("id", "session_key", "title", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


@query(sql("{T} SELECT id, CASE WHEN id % 4 < 2 THEN NULL ELSE company_id END AS company_id FROM sources"))
def set_null_reference(spark, sf_dir):
    """Sources of deleted companies stay, without a company."""
    s = Domain(spark, sf_dir).sources
    return dml.set_null_reference(s, s.where("id % 4 < 2").select(F.col("company_id").alias("gone")).where("gone is not null"), "gone", "company_id").select("id", "company_id")


@query(sql("{T} SELECT source_id, url, doc FROM (SELECT source_id, url, id AS doc, row_number() OVER (PARTITION BY source_id ORDER BY -id, url) AS k FROM articles) WHERE k <= 3"))
def entries_per_source(spark, sf_dir):
    """The first three entries of each source, in their feed's order."""
    a = Domain(spark, sf_dir).articles.select("source_id", "url", F.col("id").alias("doc"), (-F.col("id")).cast("int").alias("position"))
    return ingest.first_entries(a, 3).drop("position")


def _store(spark):
    return Store(spark, f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex}")


@query("""WITH c AS (SELECT c_custkey % 3 AS k, upper('t' || c_custkey % 40) AS ticker, c_name AS name FROM customer),
  a AS (SELECT ticker, max(name) AS name FROM c WHERE k <> 0 GROUP BY ticker), b AS (SELECT ticker, max(name) AS name FROM c WHERE k <> 1 GROUP BY ticker)
  SELECT ticker, coalesce(b.name, a.name) AS name, CAST(row_number() OVER (ORDER BY a.ticker IS NULL, ticker) AS BIGINT) AS id FROM a FULL JOIN b USING (ticker)""")
def upsert_repeated_keys(spark, sf_dir):
    """Two batches whose keys repeat, in two cases of letters, and a repeat of the second: one row a key, ids in order of arrival."""
    store = _store(spark)
    k = F.col("c_custkey")
    letter = F.when(k % 2 == 0, "t").otherwise("T")
    rows = Domain(spark, sf_dir).table("customer").select((k % 3).alias("k"), F.concat(letter, (k % 40).cast("string")).alias("ticker"), F.col("c_name").alias("name"))
    for part in (rows.where("k <> 0"), rows.where("k <> 1"), rows.where("k <> 1")):
        store.upsert("companies", part.drop("k"))
    return store.read("companies").select("ticker", "name", "id")


@query(sql("""{T} , c AS (SELECT filing_id, section_id, chunk_index, min(text) AS text FROM chunks GROUP BY ALL)
  SELECT filing_id, section_id, chunk_index, CASE WHEN filing_id % 5 = 2 THEN 'upserted ' || text ELSE text END AS text FROM c WHERE filing_id % 7 <> 0 OR filing_id % 5 = 2
  UNION ALL SELECT id, '1', 0, 'new text of ' || accession_number FROM filings WHERE id % 7 = 0 AND id % 2 = 0 AND id NOT IN (SELECT filing_id FROM c WHERE filing_id % 5 = 2 AND section_id = '1' AND chunk_index = 0)"""))  # fmt: skip
def chunks_of_versions(spark, sf_dir):
    """A table of four commits, read without compaction: chunks, an exchange by filing (some of no new chunks), then an upsert by key."""
    d, store = Domain(spark, sf_dir), _store(spark)
    chunks = d.chunks.groupBy("filing_id", "section_id", "chunk_index").agg(F.min("text").alias("text"))
    store.append("chunks", chunks)
    sevenths = d.filings.where("id % 7 = 0")
    new = sevenths.where("id % 2 = 0").select(F.col("id").alias("filing_id"), F.lit("1").alias("section_id"), F.lit(0).alias("chunk_index"), F.concat(F.lit("new text of "), "accession_number").alias("text"))
    store.exchange("chunks", new, ["filing_id"], sevenths.select(F.col("id").alias("filing_id")))
    store.upsert("chunks", chunks.where("filing_id % 5 = 2").withColumn("text", F.concat(F.lit("upserted "), "text")))
    return store.read("chunks").select("filing_id", "section_id", "chunk_index", "text")


@query(sql("""{T} SELECT CAST(id AS VARCHAR) AS id, CAST(label AS VARCHAR) AS owner, 'first' AS text FROM vectors WHERE label % 4 <> 1 UNION ALL SELECT 'n' || id, CAST(label AS VARCHAR), 'second' FROM vectors WHERE label % 4 = 1 AND id % 2 = 0"""))
def vectors_of_versions(spark, sf_dir):
    """Vectors of which some owners were exchanged, read without compaction."""
    d = Domain(spark, sf_dir)
    index = VectorIndex(spark, f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}", COLLECTION)
    made = lambda rows, mark, text: rows.select(F.concat(F.lit(mark), F.col("id").cast("string")).alias("id"), F.col("vector").cast("array<float>").alias("vector"), F.col("label").cast("string").alias("owner"), "ticker", F.lit(text).alias("text"))
    owners = lambda rows: rows.select(F.col("label").cast("string").alias("owner"))
    index.size = len(d.query_vector())
    index.replace("document", made(d.vectors, "", "first"), owners(d.vectors))
    some = d.vectors.where("label % 4 = 1")
    index.replace("document", made(some.where("id % 2 = 0"), "n", "second"), owners(some))
    return index.read().select("id", "owner", "text")
