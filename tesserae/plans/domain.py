"""The domain's relations, made from the provided tables; once as DataFrames and once as SQL.

Orders stand for filings, line items for their chunks, customers for companies, order states for
embedding runs, document sources for web sources, documents for articles, labels for what is
embedded, events for ingestion runs, embeddings for vectors, conversations for query runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL, COLLECTION = "hashed-64", "research"

#: Each relation as SQL; `{T}` in a query's SQL becomes WITH these that it names.
RELATIONS = {
    "companies": "SELECT c_custkey AS id, upper(c_name) AS ticker, c_name AS name, CAST(c_custkey AS VARCHAR) AS cik, 'company' || c_custkey || '.com' AS website_domain FROM customer",
    "filings": """SELECT o_orderkey AS id, 'acc-' || o_orderkey AS accession_number, c_mktsegment AS ticker, CAST(o_custkey AS VARCHAR) AS cik, c_name AS company_name,
  '10-K' AS form_type, strftime(o_orderdate, '%Y-%m-%d') AS filing_date FROM orders JOIN customer ON o_custkey = c_custkey""",
    "chunks": """SELECT l_orderkey AS filing_id, CASE l_returnflag WHEN 'A' THEN '1' WHEN 'N' THEN '1A' ELSE '7' END AS section_id, l_linenumber AS chunk_index,
  CAST(l_partkey AS VARCHAR) || ':' || CAST(l_suppkey AS VARCHAR) AS text FROM lineitem""",
    "embedding_runs": f"""SELECT o_orderkey AS filing_id, '{MODEL}' AS embedding_model, '{COLLECTION}' AS vector_collection, CASE o_orderstatus WHEN 'F' THEN 'ready' ELSE 'failed' END AS status,
  CAST(o_orderkey % 7 AS BIGINT) AS expected_point_count, CAST(CASE o_orderstatus WHEN 'F' THEN o_orderkey % 7 ELSE 0 END AS BIGINT) AS indexed_point_count FROM orders WHERE o_orderstatus <> 'O'""",
    "sources": """SELECT id, name, 'https://' || name || '.example.com/' AS url, CASE WHEN s_suppkey IS NULL THEN NULL ELSE id END AS company_id,
  CASE id % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'candidate' WHEN 2 THEN 'rejected' ELSE 'manual' END AS discovery_status, id % 3 <> 0 AS enabled,
  CASE WHEN id % 5 = 0 THEN NULL ELSE id / 20.0 END AS confidence_score, CASE WHEN id % 2 = 0 THEN 'high' ELSE 'low' END AS trust_level
  FROM (SELECT DISTINCT source AS name, CAST(substr(source, 4) AS BIGINT) AS id FROM documents WHERE source IS NOT NULL) d LEFT JOIN supplier ON s_suppkey = id""",
    "articles": """SELECT doc_id AS id, CAST(substr(source, 4) AS BIGINT) AS source_id, 'https://' || source || '.example.com/' || doc_id AS url, substr(text, 1, 40) AS title, text,
  sha256(text) AS content_hash FROM documents WHERE source IS NOT NULL""",
    "article_chunks": "SELECT doc_id AS id, doc_id AS document_id, 0 AS chunk_index, text FROM documents",
    "article_records": f"SELECT doc_id AS document_chunk_id, '{MODEL}' AS embedding_model, '{COLLECTION}' AS vector_collection FROM labels",
    "filing_records": f"SELECT l_orderkey * 10 + l_linenumber AS chunk_id, '{MODEL}' AS embedding_model, CASE WHEN l_linenumber % 3 = 0 THEN 'other' ELSE '{COLLECTION}' END AS vector_collection FROM lineitem WHERE l_orderkey % 2 = 0",
    "ingestion_runs": """SELECT event_id AS id, user_id % 20 AS source_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'partial' ELSE 'completed' END AS status, ts AS started_at,
  CASE WHEN event_type = 'signup' THEN NULL ELSE ts + INTERVAL 1 HOUR END AS completed_at FROM events""",
    "vectors": """SELECT vec_id AS id, embedding AS vector, label, CASE WHEN vec_id % 3 = 0 THEN 'document' ELSE 'sec_filing' END AS chunk_source, 'T' || (label % 5) AS ticker,
  CASE WHEN vec_id % 3 = 0 THEN NULL ELSE ['1', '1A', '7', '7A'][CAST(label % 4 AS INT) + 1] END AS section_id, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE 'A' || (vec_id % 12) END AS accession_number FROM embeddings""",
    "query_runs": """SELECT conv_id * 1000 + turn AS id, CAST(conv_id AS VARCHAR) AS session_key, text AS answer_text, CASE role WHEN 'assistant' THEN 'completed' ELSE 'running' END AS status,
  TIMESTAMP '2024-01-01' + to_minutes(CAST(conv_id * 10 + turn AS BIGINT)) AS started_at FROM conversations""",
}


def sql(text: str) -> str:
    """`{T}` at the start of text replaced by the relations that text names."""
    used = [k for k in RELATIONS if k in text]
    return text.replace("{T}", "WITH " + ", ".join(f"{k} AS ({RELATIONS[k]})" for k in used))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Domain:
    """The relations as DataFrames, each read when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.table = lambda name: _table(spark, sf_dir, name)

    @property
    def companies(self) -> DataFrame:
        key = F.col("c_custkey").cast("string")
        return self.table("customer").select(
            F.col("c_custkey").alias("id"), F.upper("c_name").alias("ticker"), F.col("c_name").alias("name"), key.alias("cik"), F.concat(F.lit("company"), key, F.lit(".com")).alias("website_domain")
        )

    @property
    def filings(self) -> DataFrame:
        joined = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        return joined.select(
            F.col("o_orderkey").cast("long").alias("id"), F.concat(F.lit("acc-"), F.col("o_orderkey").cast("string")).alias("accession_number"), F.col("c_mktsegment").alias("ticker"),
            F.col("o_custkey").cast("string").alias("cik"), F.col("c_name").alias("company_name"), F.lit("10-K").alias("form_type"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filing_date"),
        )

    @property
    def chunks(self) -> DataFrame:
        section = F.when(F.col("l_returnflag") == "A", "1").when(F.col("l_returnflag") == "N", "1A").otherwise("7")
        text = F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
        return self.table("lineitem").select(F.col("l_orderkey").cast("long").alias("filing_id"), section.alias("section_id"), F.col("l_linenumber").alias("chunk_index"), text.alias("text"))

    @property
    def embedding_runs(self) -> DataFrame:
        n, ready = (F.col("o_orderkey") % 7).cast("long"), F.col("o_orderstatus") == "F"
        return self.table("orders").where("o_orderstatus <> 'O'").select(
            F.col("o_orderkey").cast("long").alias("filing_id"), F.lit(MODEL).alias("embedding_model"), F.lit(COLLECTION).alias("vector_collection"),
            F.when(ready, "ready").otherwise("failed").alias("status"), n.alias("expected_point_count"), F.when(ready, n).otherwise(F.lit(0).cast("long")).alias("indexed_point_count"),
        )

    @property
    def sources(self) -> DataFrame:
        named = self.table("documents").where("source is not null").select(F.col("source").alias("name")).distinct().withColumn("id", F.substring("name", 4, 20).cast("long"))
        joined = named.join(self.table("supplier").select("s_suppkey"), F.col("id") == F.col("s_suppkey"), "left")
        of = lambda k: F.col("id") % k
        status = F.when(of(4) == 0, "approved").when(of(4) == 1, "candidate").when(of(4) == 2, "rejected").otherwise("manual")
        return joined.select(
            "id", "name", F.concat(F.lit("https://"), "name", F.lit(".example.com/")).alias("url"), F.when(F.col("s_suppkey").isNotNull(), F.col("id")).alias("company_id"), status.alias("discovery_status"),
            (of(3) != 0).alias("enabled"), F.when(of(5) != 0, F.col("id") / 20.0).alias("confidence_score"), F.when(of(2) == 0, "high").otherwise("low").alias("trust_level"),
        )

    @property
    def articles(self) -> DataFrame:
        url = F.concat(F.lit("https://"), "source", F.lit(".example.com/"), F.col("doc_id").cast("string"))
        return self.table("documents").where("source is not null").select(
            F.col("doc_id").alias("id"), F.substring("source", 4, 20).cast("long").alias("source_id"), url.alias("url"), F.substring("text", 1, 40).alias("title"), "text", F.sha2("text", 256).alias("content_hash")
        )

    @property
    def article_chunks(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"), "text")

    @property
    def article_records(self) -> DataFrame:
        return self.table("labels").select(F.col("doc_id").alias("document_chunk_id"), F.lit(MODEL).alias("embedding_model"), F.lit(COLLECTION).alias("vector_collection"))

    @property
    def filing_records(self) -> DataFrame:
        collection = F.when(F.col("l_linenumber") % 3 == 0, "other").otherwise(COLLECTION)
        rows = self.table("lineitem").where("l_orderkey % 2 = 0")
        return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("chunk_id"), F.lit(MODEL).alias("embedding_model"), collection.alias("vector_collection"))

    @property
    def ingestion_runs(self) -> DataFrame:
        status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "partial").otherwise("completed")
        end = F.when(F.col("event_type") != "signup", F.col("ts") + F.expr("interval 1 hour"))
        return self.table("events").select(F.col("event_id").alias("id"), (F.col("user_id") % 20).alias("source_id"), status.alias("status"), F.col("ts").alias("started_at"), end.alias("completed_at"))

    @property
    def vectors(self) -> DataFrame:
        web = F.col("vec_id") % 3 == 0
        section = F.get(F.array(*map(F.lit, ("1", "1A", "7", "7A"))), F.col("label") % 4)
        return self.table("embeddings").select(
            F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label", F.when(web, "document").otherwise("sec_filing").alias("chunk_source"),
            F.concat(F.lit("T"), (F.col("label") % 5).cast("string")).alias("ticker"), F.when(~web, section).alias("section_id"), F.when(~web, F.concat(F.lit("A"), (F.col("vec_id") % 12).cast("string"))).alias("accession_number"),
        )

    @property
    def query_runs(self) -> DataFrame:
        start = F.timestamp_seconds(F.lit(1704067200) + 60 * (F.col("conv_id") * 10 + F.col("turn")))
        return self.table("conversations").select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").cast("string").alias("session_key"), F.col("text").alias("answer_text"),
            F.when(F.col("role") == "assistant", "completed").otherwise("running").alias("status"), start.alias("started_at"),
        )

    def query_vector(self, vec_id: int = 0) -> list[float]:
        """One vector of fixed size."""
        return list(self.table("embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])
