"""Incremental ingestion and indexing with Structured Streaming.

Each micro-batch is one worker cycle: take in articles whose url and content are new, repair an
index that disagrees with its records, embed what is pending. What has been seen is the catalog's
own tables, so a restart or a repeated batch adds nothing twice.

An article, document or filing that can't be worked on fails alone: what fails as a whole is tried in halves,
until single owners fail. Failed entries and documents are kept with the number of attempts and tried
again after a while that doubles, MAX_ATTEMPTS times; then they are dead, and stay so until someone looks. A
cycle in which much fails (over MOST_FAILURES owners) is taken for trouble of its surroundings: its batch
is left to the next cycle, and the stream goes on.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import urls as u
from ..operators import dml, health, relational, vectors
from ..sources.index import VectorIndex
from ..sources.store import Store

LEAST_ARTICLE_CHARS = 100
ERRORS_TOLD = 3
MAX_BROADCAST_ROWS = 500_000  #: with a key and a path each, under 50 MB
MAX_ATTEMPTS, FIRST_WAIT, MOST_FAILURES = 5, 60, 32  #: of one owner; seconds; of one cycle
SHAPE = "source_id long, url string, title string, author string, published_at string, text string, error string, position int, metadata map<string,string>"

log = logging.getLogger(__name__)


def shaped(batch: DataFrame) -> DataFrame:
    """batch with all columns of SHAPE; those it lacks are null."""
    empty = batch.sparkSession.createDataFrame([], SHAPE)
    return empty.unionByName(batch.select(*(c for c in empty.columns if c in batch.columns)), allowMissingColumns=True)


def first_entries(batch: DataFrame, limit: int | None) -> DataFrame:
    """Of each source the first `limit` entries, in their feed's order."""
    if limit is None:
        return batch
    order = Window.partitionBy("source_id").orderBy(F.asc_nulls_last("position"), "url")
    return batch.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= limit).drop("_rank")


def _short(rows: DataFrame) -> Column:
    return F.col("_short") if "_short" in rows.columns else F.length(t.strip(F.coalesce("text", F.lit("")))) < LEAST_ARTICLE_CHARS


def new_articles(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Of batch(source_id, url, text, ...) the rows to insert: long enough, of new url and content, the first of each."""
    long = batch.where(~_short(batch))
    long = long if "content_hash" in batch.columns else long.withColumn("content_hash", t.content_hash(F.col("text")))
    fresh = relational.unseen(long, known)
    by_url = F.row_number().over(Window.partitionBy("source_id", "url").orderBy("content_hash"))
    fresh = fresh.withColumn("_rank", by_url).where("_rank = 1")
    by_hash = F.row_number().over(Window.partitionBy("content_hash").orderBy("source_id", "url"))
    return fresh.withColumn("_rank", by_hash).where("_rank = 1").drop("_rank")


def told(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"[:500]


def isolated(owners: DataFrame, run: Callable[[DataFrame], None]) -> list[tuple[str, str]]:
    """run(owners), and where that fails, run on halves of it by a hash; returns the owners that fail alone, with their errors.

    owners(owner) is a written table. One failing owner of n costs about 2 log n runs. Over MOST_FAILURES raise.
    """
    failed: list[tuple[str, str]] = []

    def attempt(part: DataFrame, depth: int) -> None:
        if part.isEmpty():
            return
        try:
            run(part)
        except Exception as e:
            first = [r["owner"] for r in part.select("owner").distinct().limit(2).collect()]
            if len(first) > 1:
                for half in (0, 1):
                    attempt(part.where(F.pmod(F.xxhash64("owner", F.lit(depth)), F.lit(2)) == half), depth + 1)
                return
            log.warning("%s failed: %s", first[0], told(e))
            failed.append((first[0], told(e)))
            if len(failed) > MOST_FAILURES:
                raise

    attempt(owners, 0)
    return failed


def prepared(entries: DataFrame, size: int, overlap: int) -> DataFrame:
    """entries with all that is worked out of an article's text in its place: content_hash, chunks, their number, and whether it is too short."""
    made = entries.withColumns({"content_hash": t.content_hash(F.col("text")), "_short": _short(entries)})
    made = made.withColumn("chunks", F.when(~F.col("_short"), t.chunks(F.col("text"), size, overlap)))
    return made.withColumn("_chunks", F.size("chunks")).drop("text")


def beside(rows: DataFrame) -> DataFrame:
    """rows, a written table of a few short columns, as the side of a join with texts: sent to all tasks if they are few, else hashed, so that texts are moved at most once and never sorted."""
    return F.broadcast(rows) if rows.count() <= MAX_BROADCAST_ROWS else rows.hint("shuffle_hash")


def run_counts(batch: DataFrame, inserted: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Per source what was found, inserted and skipped, and how the run ended: failed if its feed did, partial if some entries did.

    An entry of a known url isn't looked at. Skipped are all that were not inserted, errors among them;
    of the errors the first few are told.
    """
    rows = batch.withColumns({c: F.lit(None).cast(k) for c, k in (("error", "string"), ("position", "int")) if c not in batch.columns})
    if known is not None:
        rows = rows.join(known.select("source_id", "url").distinct().withColumn("_seen", F.lit(True)), ["source_id", "url"], "left")
    seen = F.coalesce("_seen", F.lit(False)) if known is not None else F.lit(False)
    # What is told of an entry.
    wrong = F.when(seen, None).when(F.col("error").isNotNull(), F.concat_ws(": ", "url", "error")).when(_short(rows), F.concat(F.lit("no extractable text: "), F.coalesce("url", F.lit(""))))
    rows = rows.withColumns({"_wrong": wrong, "_feed": F.when(F.col("url").isNull(), F.col("error"))})
    order = Window.partitionBy("source_id", F.col("_wrong").isNull()).orderBy(F.asc_nulls_last("position"), "url", "_wrong")
    rows = rows.withColumn("_rank", F.row_number().over(order))
    told = F.transform(F.sort_array(F.collect_list(F.when((F.col("_rank") <= ERRORS_TOLD) & F.col("_wrong").isNotNull(), F.struct("_rank", "_wrong")))), lambda x: x["_wrong"])
    found = rows.groupBy("source_id").agg(
        F.count_if(F.col("_feed").isNull()).alias("discovered_count"),
        F.count_if(F.col("_wrong").isNotNull() & F.col("_feed").isNull()).alias("error_count"),
        F.max("_feed").alias("_feed"),
        F.array_join(told, "; ").alias("_told"),
    )
    added = inserted.groupBy("source_id").agg(F.count(F.lit(1)).alias("inserted_count"))
    joined = found.join(added, "source_id", "left").withColumn("inserted_count", F.coalesce("inserted_count", F.lit(0)))
    return joined.select(
        "source_id", "discovered_count", "inserted_count", "error_count", (F.col("discovered_count") - F.col("inserted_count")).alias("skipped_count"),
        F.when(F.col("_feed").isNotNull(), "failed").when(F.col("error_count") > 0, "partial").otherwise("completed").alias("status"),
        F.coalesce("_feed", F.nullif("_told", F.lit(""))).alias("error_message"),
    )


class Worker:
    def __init__(self, spark: SparkSession, store: Store, vector_path: str, model: str = "hashed-64", collection: str = "research", size: int = 4000, overlap: int = 500, limit_per_source: int | None = None):
        t.check_chunk_sizes(size, overlap)
        self.spark, self.store, self.model, self.collection, self.size, self.overlap, self.limit = spark, store, model, collection, size, overlap, limit_per_source
        self.index = VectorIndex(spark, vector_path, collection)
        self._retry = f"{store.root}/_retry"

    # --- failures -------------------------------------------------------------------------

    def _failed(self, kind: str, failed: list[tuple[str, str]], entries: DataFrame | None = None) -> None:
        """Keep owners of a kind that failed alone, with their entries, for a later attempt; a bounded number."""
        if not failed:
            return
        before = self.store.read("_failures").select("owner", F.col("attempts").alias("_n"))
        rows = self.spark.createDataFrame(failed, "owner string, error string").withColumn("owner", F.concat(F.lit(f"{kind}:"), "owner"))
        if entries is not None:
            rows = rows.join(entries.select(F.concat(F.lit(f"{kind}:"), "owner").alias("owner"), "entry"), "owner", "left")
        rows = rows.join(before, "owner", "left").withColumn("attempts", F.coalesce("_n", F.lit(0)) + 1)
        wait = FIRST_WAIT * F.pow(F.lit(2), F.col("attempts") - 1)
        rows = rows.withColumns({"next_at": F.timestamp_seconds(F.unix_timestamp(F.current_timestamp()) + wait), "dead": F.col("attempts") >= MAX_ATTEMPTS})
        self.store.upsert("_failures", rows.drop("_n"), keep_if_null=["entry"])

    def _recovered(self, kind: str, owners: DataFrame) -> None:
        known = self.store.read("_failures").select("owner")
        gone = known.join(owners.select(F.concat(F.lit(f"{kind}:"), "owner").alias("owner")), "owner", "left_semi")
        if not gone.isEmpty():
            self.store.exchange("_failures", None, ["owner"], gone)

    def _due(self, kind: str) -> DataFrame:
        """Failed owners of a kind whose time for another attempt has come."""
        rows = self.store.read("_failures").where(F.startswith("owner", F.lit(f"{kind}:")) & ~F.col("dead") & (F.col("next_at") <= F.current_timestamp()))
        return rows.withColumn("owner", F.substring("owner", F.lit(len(kind) + 2), F.length("owner")))

    def dead(self) -> DataFrame:
        """Owners that are not tried any more, with their last errors and entries."""
        return self.store.read("_failures").where("dead")

    # --- articles -------------------------------------------------------------------------

    def ingest(self, batch: DataFrame) -> DataFrame:
        """Take in a batch of entries; a run is recorded for each source that has any, running at first. Returns these runs' counts, kept until store.done()."""
        store = self.store
        eligible = store.read("sources").where(relational.eligible())
        companies = store.read("companies").select(F.col("id").alias("company_id"), "ticker", F.col("name").alias("company_name"))
        own = eligible.join(companies, "company_id", "left").select(F.col("id").alias("source_id"), "source_type", F.col("url").alias("source_url"), "ticker", "company_name")
        batch = shaped(batch)
        again = self._due("entry").select(F.from_json("entry", batch.schema).alias("e")).select("e.*")
        batch = first_entries(batch.unionByName(again).join(own.select("source_id"), "source_id", "left_semi"), self.limit)
        batch = store.kept(batch.withColumn("_row", F.monotonically_increasing_id()))
        start = store.kept(batch.select("source_id").distinct().withColumns({"status": F.lit("running"), "started_at": F.current_timestamp()}))
        if start.isEmpty():
            store.done(batch, start)
            nothing = self.spark.createDataFrame([], batch.schema)
            return run_counts(nothing, nothing)
        first = store.insert("source_ingestion_runs", start, ["source_id"])
        running = dml.numbered(start, ["source_id"], first)
        try:
            counts = self._ingested(batch, own)
        except Exception as e:
            store.upsert("source_ingestion_runs", running.withColumns({"status": F.lit("failed"), "error_message": F.lit(told(e)), "completed_at": F.current_timestamp()}))
            raise
        ended = dml.checked(counts, "status", dml.DOMAINS["ingestion_status"]).join(running.select("source_id", "id", "started_at"), "source_id")
        store.upsert("source_ingestion_runs", ended.withColumn("completed_at", F.current_timestamp()).drop("error_count"))
        store.done(batch, start)
        return counts

    def _ingested(self, batch: DataFrame, own: DataFrame) -> DataFrame:
        """Which entries are new is found on short rows; texts and chunks are read from where they were written once, by the number of their row."""
        store = self.store
        owner = F.concat_ws("|", "source_id", "url")
        owned = batch.withColumn("owner", F.coalesce(owner, F.lit("")))
        good: list[DataFrame] = []
        failed = isolated(owned, lambda part: good.append(store.kept(prepared(part, self.size, self.overlap))))
        if failed:
            told_of = self.spark.createDataFrame(failed, "owner string, told string")
            lost = owned.join(told_of, "owner")
            self._failed("entry", failed, lost.select("owner", F.to_json(F.struct(*(c for c in batch.columns if c != "_row"))).alias("entry")))
            lost = lost.withColumn("error", F.col("told")).drop("told").drop("text")
            nothing = {"content_hash": "string", "chunks": "array<string>", "_chunks": "int"}
            good.append(store.kept(lost.withColumns({"_short": F.lit(True), **{c: F.lit(None).cast(k) for c, k in nothing.items()}})))
        entries = good[0]
        for more in good[1:]:
            entries = entries.unionByName(more.select(*entries.columns))
        before = store.read("documents")
        narrow = entries.drop("chunks")
        fresh = new_articles(narrow, before).drop("position", "owner").join(own, "source_id")
        text_path = F.concat(F.lit("sources/"), F.col("source_id").cast("string"), F.lit("/"), F.substring("content_hash", 1, 16), F.lit(".txt"))
        told_by = F.create_map(F.lit("ticker"), F.col("ticker"), F.lit("company_name"), F.col("company_name"), F.lit("source_url"), F.col("source_url"))
        made = fresh.withColumns(
            {"fetched_at": F.current_timestamp(), "clean_text_path": text_path, "document_type": u.document_type(F.col("source_type")), "metadata_json": F.to_json(F.map_concat(told_by, F.coalesce("metadata", F.create_map().cast("map<string,string>"))))}
        )
        made = store.kept(made)
        counts = store.kept(run_counts(narrow, made, before))  # before its tables change
        store.keep_texts(batch.select("_row", "text").join(beside(made.select("_row", F.col("clean_text_path").alias("path"))), "_row"))
        store.upsert("documents", made)
        if not made.isEmpty():
            ids = store.read("documents").select(F.col("id").alias("document_id"), "source_id", "url").join(made.select("source_id", "url", "_row", "_chunks"), ["source_id", "url"])
            ids = store.counted(ids.select("document_id", "_row", "_chunks"), "document_id", "_chunks")
            placed = store.kept(ids.select("document_id", "_row", "_before"))

            def cut(first: int) -> DataFrame:
                own = entries.select("_row", "chunks").join(beside(placed), "_row").select("document_id", "_before", F.posexplode("chunks").alias("chunk_index", "text"))
                return own.select((F.col("_before") + F.col("chunk_index") + first).alias("id"), "document_id", "chunk_index", "text", F.length("text").alias("char_count"))

            store.exchange("document_chunks", cut, ["document_id"], placed)
            store.done(ids, placed)
        self._recovered("entry", narrow.join(self.spark.createDataFrame(failed, "owner string, told string"), "owner", "left_anti"))
        store.done(*good, made)
        return counts

    # --- vectors --------------------------------------------------------------------------

    def vectorize(self) -> None:
        """Embed what is pending of both corpora."""
        self.vectorize_filings()
        self.vectorize_documents()

    def vectorize_filings(self) -> None:
        """Embed the chunks of filings that are not ready: their runs are indexing, then ready, or failed with the error.

        Filings that failed before go after the others. If none can be embedded, the error is raised.
        """
        s = self.store
        pending = relational.pending_filing_chunks(s.read("chunks").select("filing_id"), s.read("filings").select("id", "accession_number"), s.read("embedding_runs"), self.model, self.collection)
        failed = s.read("embedding_runs").where((F.col("embedding_model") == self.model) & (F.col("vector_collection") == self.collection) & (F.col("status") == "failed")).select("filing_id", F.lit(True).alias("again"))
        counts = pending.groupBy("filing_id", "accession_number").agg(F.count(F.lit(1)).alias("expected_point_count"))
        todo = s.kept(counts.join(failed, "filing_id", "left").select("filing_id", "accession_number", F.col("accession_number").alias("owner"), "expected_point_count", F.coalesce("again", F.lit(False)).alias("again")))
        for again in (False, True):
            part = todo.where(F.col("again") == again)
            wrong = isolated(part, self._embed_filings)
            if wrong:
                told_of = self.spark.createDataFrame(wrong, "owner string, error_message string")
                self._filing_status(todo.join(told_of, "owner"), "failed", error_message=F.col("error_message"))
                if part.count() == len(wrong):
                    raise RuntimeError(wrong[0][1])
        s.done(todo)

    def _filing_status(self, todo: DataFrame, status: str, **more: Column) -> None:
        here = {"embedding_model": F.lit(self.model), "vector_collection": F.lit(self.collection)}
        keys = todo.withColumns({**here, "status": F.lit(status), **more}).select("filing_id", "expected_point_count", *here, "status", *more)
        own = self.store.read("embedding_runs").join(F.broadcast(todo.select("filing_id")) if todo.count() < 100_000 else todo.select("filing_id"), "filing_id", "left_semi")
        self.store.upsert("embedding_runs", dml.set_run_status(own, keys, F.current_timestamp()))

    def _embed_filings(self, todo: DataFrame) -> None:
        s, here = self.store, {"embedding_model": F.lit(self.model), "vector_collection": F.lit(self.collection)}
        self._filing_status(todo, "indexing", indexed_point_count=F.lit(0))
        own = s.read("chunks").join(todo.select("filing_id"), "filing_id", "left_semi").join(s.read("filings").withColumnRenamed("id", "filing_id"), "filing_id")
        key = t.filing_vector_id(F.col("accession_number"), F.col("section_id"), F.col("chunk_index"))
        made = own.select(
            key.alias("id"), vectors.embed(F.col("text")).alias("vector"), F.col("accession_number").alias("owner"), F.col("id").alias("chunk_id"), "filing_id", "ticker", "cik", "company_name", "accession_number", "filing_date",
            "period_of_report", "form_type", "section_id", "section_title", "text", "chunk_index", here["embedding_model"].alias("embedding_model"),
        )
        self.index.replace("sec_filing", made, todo.select("owner"))
        records = own.select(F.col("id").alias("chunk_id"), key.alias("vector_id")).withColumns({**here, "embedded_at": F.current_timestamp()})
        s.upsert("chunk_embeddings", records)
        self._filing_status(todo, "ready", indexed_point_count=F.col("expected_point_count"), error_message=F.lit(None).cast("string"))

    def vectorize_documents(self) -> None:
        """Embed documents of which a chunk has no record, each as a whole, then record all its chunks. Failed ones wait."""
        s = self.store
        args = s.read("document_chunks").select("id", "document_id"), s.read("documents"), s.read("sources"), s.read("document_chunk_embeddings"), self.model, self.collection
        waiting = s.read("_failures").where(F.startswith("owner", F.lit("document:"))).join(self._due("document").select(F.concat(F.lit("document:"), "owner").alias("owner")), "owner", "left_anti")
        todo = relational.pending_document_chunks(*args).select("document_id", F.col("document_id").cast("string").alias("owner")).distinct()
        todo = s.kept(todo.join(waiting.select(F.substring("owner", F.lit(len("document:") + 1), F.length("owner")).alias("owner")), "owner", "left_anti"))
        if not todo.isEmpty():
            failed = isolated(todo, self._embed_documents)
            self._failed("document", failed)
            self._recovered("document", todo.join(self.spark.createDataFrame(failed, "owner string, told string"), "owner", "left_anti"))
        s.done(todo)

    def _embed_documents(self, todo: DataFrame) -> None:
        s = self.store
        companies = s.read("companies").select(F.col("id").alias("company_id"), "ticker", F.col("name").alias("company_name"))
        sources = s.read("sources").select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "source_type", "ownership", "trust_level", "company_id").join(companies, "company_id", "left").drop("company_id")
        documents = s.read("documents").join(sources, "source_id").withColumnRenamed("id", "document_id")
        own = s.read("document_chunks").join(todo.select("document_id"), "document_id", "left_semi").join(documents, "document_id")
        key = t.document_vector_id(F.col("document_id"), F.col("chunk_index"))
        made = own.select(
            key.alias("id"), vectors.embed(F.col("text")).alias("vector"), F.col("document_id").cast("string").alias("owner"), F.col("id").alias("document_chunk_id"), "document_id", "source_id", "source_name", "source_type",
            "ownership", "trust_level", "url", "title", "author", "published_at", "fetched_at", "document_type", "ticker", "company_name", "text", "chunk_index", F.lit(self.model).alias("embedding_model"),
        )
        self.index.replace("document", made, todo.select("owner"))
        records = own.select(F.col("id").alias("document_chunk_id"), key.alias("vector_id"))
        s.upsert("document_chunk_embeddings", records.withColumns({"embedding_model": F.lit(self.model), "vector_collection": F.lit(self.collection), "embedded_at": F.current_timestamp()}))

    # --- health ---------------------------------------------------------------------------

    def corpora(self) -> DataFrame:
        """The two corpora's counts; points are counted where they lie, by corpus.

        Counts are kept with the versions of the tables that they are of, so tables are read again only after one has changed.
        """
        s = self.store
        tables = ("chunks", "embedding_runs", "chunk_embeddings", "document_chunks", "documents", "sources", "document_chunk_embeddings")

        def counted() -> DataFrame:
            counts = relational.health_counts(*map(s.read, tables), self.model, self.collection)
            points = {r["chunk_source"]: r["n"] for r in self.index.points().collect()}  # two rows
            return health.corpora_from_counts(counts, points.get("sec_filing", 0), points.get("document", 0))

        return s.remembered("_health", tables, counted, [self.model, self.collection, self.index.version()])

    def health(self) -> DataFrame:
        return health.index_status(self.corpora(), self.index.exists())

    def repair(self) -> list[str]:
        """Of a degraded index the corpora that disagree with their records, reset so that the same cycle embeds them again.

        The other corpus stays as it is. Vectors of owners that the catalog no longer has are deleted;
        those of the others are exchanged when they are embedded.
        """
        if self.health().first()["status"] != "degraded":
            return []
        s = self.store
        wrong = [r["name"] for r in health.corpus_health(self.corpora()).where("not consistent").collect()]  # two rows at most
        stored = self.index.read().select("chunk_source", "owner").distinct()
        nothing = self.spark.createDataFrame([], "id string, vector array<float>, owner string")
        if "sec" in wrong:
            s.update("embedding_runs", lambda now: dml.reset_filing_index(now, s.read("chunks"), s.read("chunk_embeddings"), self.model, self.collection)[0])
            s.update("chunk_embeddings", lambda now: dml.without_records(now, self.model, self.collection))
            known = s.read("chunks").join(s.read("filings").withColumnRenamed("id", "filing_id"), "filing_id").select(F.col("accession_number").alias("owner"))
            self.index.replace("sec_filing", nothing, stored.where("chunk_source = 'sec_filing'").join(known, "owner", "left_anti"))
        if "documents" in wrong:
            s.update("document_chunk_embeddings", lambda now: dml.without_records(now, self.model, self.collection))
            known = s.read("document_chunks").select(F.col("document_id").cast("string").alias("owner"))
            self.index.replace("document", nothing, stored.where("chunk_source = 'document'").join(known, "owner", "left_anti"))
        return wrong

    # --- cycles ---------------------------------------------------------------------------

    def cycle(self, batch: DataFrame, batch_id: int = 0) -> None:
        counts = self.ingest(batch)
        if hasattr(counts, "_kept_at"):
            self.store.done(counts)
        self.repair()
        self.vectorize()
        self.health().first()  # counted here, so that questions find it kept

    def surviving_cycle(self, batch: DataFrame, batch_id: int = 0) -> None:
        """A cycle over the batch and those left over; if it fails as a whole, the batch is left to the next one. Single failures don't make it fail."""
        left = self.store._names(self._retry)
        whole = shaped(batch)
        for name in left:
            whole = whole.unionByName(self.spark.read.schema(SHAPE).parquet(f"{self._retry}/{name}"))
        try:
            self.cycle(whole, batch_id)
        except Exception:
            log.exception("worker cycle failed")
            shaped(batch).write.mode("overwrite").parquet(f"{self._retry}/batch-{batch_id}")
            return
        for name in left:
            self.store._delete(f"{self._retry}/{name}")

    def stream(self, articles: DataFrame, checkpoint: str, every: str | None = "300 seconds"):
        """Run a cycle for each micro-batch of a stream; with every=None once over what there is."""
        trigger = {"processingTime": every} if every else {"availableNow": True}
        return articles.writeStream.foreachBatch(self.surviving_cycle).option("checkpointLocation", checkpoint).trigger(**trigger).start()
