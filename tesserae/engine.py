"""The engine: questions, searches, plans and the governance of sources over one catalog and one table of vectors."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import answers as a
from .functions import planner as p
from .operators import discovery, dml, relational, vectors
from .sources import filings
from .sources.store import Store
from .streaming.ingest import Worker

TIME_SCOPES = ("latest", "latest_and_previous", "all_available", "specific_years")
INTENTS = ("fact", "summary", "comparison", "trend")


@dataclass(frozen=True)
class SearchPlan:
    tickers: tuple[str, ...] = ()
    sections: tuple[str, ...] = ()
    semantic_queries: tuple[str, ...] = ()
    time_scope: str = "latest"
    filing_years: tuple[int, ...] = ()
    top_k: int = 5
    intent: str = "summary"

    def __post_init__(self):
        if self.time_scope not in TIME_SCOPES or self.intent not in INTENTS:
            raise ValueError(f"time_scope {self.time_scope!r} or intent {self.intent!r} is not known")
        if not 1 <= self.top_k <= 20 or len(self.semantic_queries) > 4:
            raise ValueError("top_k must be from 1 to 20, and at most four queries given")


@dataclass(frozen=True)
class Config:
    root: str
    vector_path: str
    model: str = "hashed-64"
    collection: str = "research"
    chunk_size: int = 4000
    overlap: int = 500
    planner_model: str = "rules"
    answer_model: str = "extractive"
    limit_per_source: int | None = None


@dataclass
class Answer:
    question: str
    plan: SearchPlan
    answer: str
    labels: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    used_fallback: bool = False
    planner_error: str | None = None
    sources: list[dict] = field(default_factory=list)
    query_run_id: int | None = None

    def response(self, include_plan: bool = True, include_source_text: bool = True) -> dict:
        """The answer as a response gives it, without plan or source texts where they aren't asked for."""
        told = asdict(self)
        told["plan"] = told["plan"] if include_plan else None
        told["sources"] = [s if include_source_text else {**s, "text": None} for s in self.sources]
        return told


class Engine:
    """planner: optional `(question, context rows) -> SearchPlan`; writer: optional `(question, plan, labelled quotes) -> str`.
    Both stand for a language model; without them rules plan and quotes answer."""

    def __init__(self, spark: SparkSession, config: Config, planner: Callable | None = None, writer: Callable | None = None):
        self.spark, self.config, self.planner, self.writer = spark, config, planner, writer
        self.store = Store(spark, config.root)
        c = config
        self.worker = Worker(spark, self.store, c.vector_path, c.model, c.collection, c.chunk_size, c.overlap, c.limit_per_source)

    # --- filings --------------------------------------------------------------------------

    def ingest_filings(self, raw_dir: str, ticker: str, form: str = "10-K", limit: int | None = None) -> None:
        """Read downloaded filings, cut them into chunks, store both and the clean texts; their embedding runs are pending again.

        What was recorded of chunks that are gone goes with them; vectors are exchanged when the filing is embedded.
        """
        self._take_in(filings.ingest(filings.scan(self.spark, raw_dir, ticker, form, limit), form).withColumn("ticker", F.lit(ticker.upper())))

    def stream_filings(self, raw_dir: str, checkpoint: str, form: str = "10-K", every: str | None = "300 seconds", **options):
        """The same for filings of this form of all tickers, as they are downloaded; with `every` None for those there are. Options are the data source's.

        A filing without a document of this form fails alone and is among the worker's dead ones.
        """
        rows = filings.source(self.spark, stream=True, path=f"{raw_dir}/sec-edgar-filings", files="true", **options)
        folder = lambda k: F.try_element_at(F.split("path", "/"), F.lit(k))

        def take_in(batch: DataFrame, _: int) -> None:
            own = batch.where((folder(-3) == form) & folder(-4).isNotNull())
            self._take_in(filings.ingest_source(own, form).withColumn("ticker", F.upper(F.try_element_at(F.split("raw_path", "/"), F.lit(-4)))))

        trigger = {"availableNow": True} if every is None else {"processingTime": every}
        return rows.writeStream.foreachBatch(take_in).option("checkpointLocation", checkpoint).trigger(**trigger).start()

    def _take_in(self, read: DataFrame) -> None:
        """Filings, read and with their tickers, into the tables."""
        store = self.store
        path = F.concat_ws("/", F.lit("filings"), "ticker", F.concat("accession_number", F.lit(".txt")))
        read = read.withColumn("clean_text_path", path)
        written = store.kept(dml.one_per_key(read, ["accession_number"], ["raw_path"]))  # read and parsed once; of one filing in two folders the last counts
        read = written
        if "error" in written.columns:
            bad = written.where("error is not null")
            read = written.where("error is null").drop("error")
            if not bad.isEmpty():
                told = {"owner": F.concat(F.lit("submission:"), "raw_path"), "attempts": F.lit(1), "dead": F.lit(True)}
                store.upsert("_failures", bad.withColumns(told).select(*told, "error"))
        store.keep_texts(read.select(F.col("clean_text_path").alias("path"), "text"))
        store.upsert("filings", read.drop("html", "text"))
        chunks = filings.chunk_sections(filings.sections(read), self.config.chunk_size, self.config.overlap)
        ids = store.kept(store.read("filings").select(F.col("id").alias("filing_id"), "accession_number").join(read.select("accession_number"), "accession_number", "left_semi"))
        own = chunks.join(ids, "accession_number").drop("accession_number")
        gone = store.kept(store.read("chunks").join(ids, "filing_id", "left_semi").select(F.col("id").alias("chunk_id")))
        store.exchange("chunks", own, ["filing_id"], ids)
        if not gone.isEmpty():
            store.exchange("chunk_embeddings", None, ["chunk_id"], gone)
        runs = ids.select("filing_id", F.lit(self.config.model).alias("embedding_model"), F.lit(self.config.collection).alias("vector_collection"), F.lit("pending").alias("status"))
        known = store.read("embedding_runs").join(ids.select("filing_id"), "filing_id", "left_semi")
        merged = dml.merge_upsert(known, runs, ["filing_id", "embedding_model", "vector_collection"])
        store.upsert("embedding_runs", dml.reset_runs(merged, store.read("chunks"), ids))
        store.done(written, ids, gone)

    def vectorize_filings(self) -> None:
        self.worker.vectorize_filings()

    # --- questions ------------------------------------------------------------------------

    def vectors(self) -> DataFrame:
        """The stored vectors; each id is stored once."""
        return self.worker.index.read()

    def context(self) -> DataFrame:
        """One row: tickers, sections, years and names that plans may use; one entry a ticker. Filings and chunks are read for it only after they have changed."""
        s = self.store
        per = s.remembered("_context", ("filings", "chunks"), lambda: relational.planner_context(relational.planner_metadata(s.read("filings"), s.read("chunks")), p.SECTIONS))
        entry = F.collect_list(F.struct("ticker", "years", "names", "sections")).alias("all")
        all_ = per.agg(F.sort_array(entry).alias("all"))
        known = F.array(*map(F.lit, p.SECTIONS))
        have = F.array_distinct(F.flatten(F.col("all.sections")))
        return all_.select(
            F.struct(
                F.col("all.ticker").alias("tickers"),
                F.filter(known, lambda s: F.array_contains(have, s)).alias("sections"),
                F.map_from_arrays("all.ticker", "all.years").alias("years"),
                F.map_from_arrays("all.ticker", "all.names").alias("names"),
            ).alias("context")
        )

    def plan(self, question: str) -> SearchPlan:
        return self._planned(question)[0]

    def _planned(self, question: str) -> tuple[SearchPlan, str | None]:
        """A plan, and the error of a planner that failed: then the plan is the fallback."""
        if not question.strip():
            raise ValueError("question must not be empty")
        made, error = p.local_plan(F.lit(question.strip()), F.col("context")), None
        if self.planner:
            try:
                return self.planner(question, self.context()), None
            except Exception as e:  # noqa: BLE001  a model that fails leaves the fallback
                made, error = p.fallback_plan(F.lit(question)), f"{type(e).__name__}: {e}"
        row = self.context().select(made.alias("plan")).first()["plan"]
        return SearchPlan(**{k: tuple(v) if isinstance(v, list) else v for k, v in row.asDict().items()}), error

    def accessions(self, plan: SearchPlan) -> dict[str, list[str]]:
        """Of each planned ticker the ready filings in the plan's years; a handful a ticker."""
        ready = relational.ready_accessions(self.store.read("filings"), self.store.read("embedding_runs"), self.config.model, self.config.collection)
        kept = relational.accessions_in_scope(ready, F.lit(plan.time_scope), F.array(*map(F.lit, plan.filing_years)).cast("array<int>"), plan.tickers)
        found: dict[str, list[str]] = {t: [] for t in plan.tickers}
        for row in kept.orderBy("accession_number").collect():  # filings in scope of one question
            found[row["ticker"]].append(row["accession_number"])
        return found

    def retrieve(self, plan: SearchPlan, question: str) -> DataFrame:
        by_ticker = self.accessions(plan)
        query = self.spark.range(1).select(vectors.embed(F.lit(question)).alias("v")).first()["v"]
        accessions = sorted({x for v in by_ticker.values() for x in v})
        return vectors.retrieve(self.vectors(), query, plan.top_k, plan.tickers, plan.sections, accessions, plan.intent, plan.time_scope, by_ticker)

    def search(self, text: str, ticker: str | None = None, limit: int = 5) -> DataFrame:
        """The best chunks of ready filings; an error if there are none."""
        ready = relational.ready_accessions(self.store.read("filings"), self.store.read("embedding_runs"), self.config.model, self.config.collection, ticker)
        if ready.isEmpty():
            raise RuntimeError("no ready filings")
        query = self.spark.range(1).select(vectors.embed(F.lit(text)).alias("v")).first()["v"]
        return vectors.search(self.vectors().join(ready.select("accession_number"), "accession_number", "left_semi"), query, limit, ticker)

    def ask(self, question: str, session_key: str | None = None, session_title: str | None = None) -> Answer:
        """Plan, retrieve and answer; the run is kept, whether it ends well or not, under the session if one is given."""
        question = question.strip()
        if not 3 <= len(question) <= 1000:
            raise ValueError("a question has 3 to 1000 characters")
        session_key = (session_key or "").strip() or None
        if session_key and len(session_key) > 200:
            raise ValueError("a session's key has at most 200 characters")
        if self.health().first()["status"] == "degraded":
            raise RuntimeError("the index is degraded")
        session = self.session(session_key, session_title) if session_key else None
        run = self._begin(question, session)
        try:
            answer = self._answered(question)
        except Exception as e:
            self._finish(run, "failed", error_message=f"{type(e).__name__}: {e}")
            raise
        told = {k: getattr(answer, k) for k in ("sources", "warnings", "used_fallback", "planner_error")}
        told["sources"] = [{k: v for k, v in x.items() if k != "text"} for x in answer.sources]
        answer.query_run_id = run
        self._finish(run, "completed", answer_text=answer.answer, planned_query_json=json.dumps(asdict(answer.plan)), retrieval_metadata_json=json.dumps(told))
        return answer

    def _answered(self, question: str) -> Answer:
        plan, error = self._planned(question)
        told = {"used_fallback": error is not None, "planner_error": error}
        rows = []
        if plan.tickers:
            hits = self.retrieve(plan, plan.semantic_queries[0] if plan.semantic_queries else question)
            rows = hits.drop("fetched_at").collect()  # at most top_k for each ticker and filing in the plan's scope
        if not rows:
            text = self.context().select(a.no_evidence_answer(_plan_column(plan), F.col("context.years")).alias("x")).first()["x"]
            return Answer(question, plan, text, [], ["no retrieved evidence"], **told)
        labelled = self.spark.createDataFrame(rows, hits.drop("fetched_at").schema).withColumn("i", F.row_number().over(_by_score()))
        payload = F.struct(*labelled.columns)
        lines = labelled.select("i", a.source_chunk(F.col("i"), payload, True).alias("source"), a.quote(F.col("text")).alias("quote")).orderBy("i").collect()
        sources = [x["source"].asDict() for x in lines]
        quotes = [f"{x['source']['label']}: {x['quote']}" for x in lines]
        labels = [x["label"] for x in sources]
        if self.writer:
            return Answer(question, plan, self.writer(question, plan, quotes), labels, sources=sources, **told)
        # The heading and the warning.
        return Answer(question, plan, "\n".join(["Retrieved evidence:", *quotes]), labels, ["llm answer generation unavailable"], sources=sources, **told)

    def _begin(self, question: str, session: int | None) -> int:
        """Add a run that is running; returns its id. One whose driver dies stays so."""
        c = self.config
        row = [(session, question, "running", c.planner_model, c.answer_model, c.model, c.collection)]
        shape = "research_session_id long, question string, status string, planner_model string, answer_model string, embedding_model string, vector_collection string"
        rows = dml.checked(self.spark.createDataFrame(row, shape), "status", dml.DOMAINS["query_status"])
        return self.store.insert("query_runs", rows.withColumns({c: F.current_timestamp() for c in ("started_at", "created_at", "updated_at")}), ["question"])

    def _finish(self, run: int, status: str, **more: str | None) -> None:
        """End a run: what is given goes over what it holds."""
        row = {"id": run, "status": status, **more}
        ended = self.spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'long' if k == 'id' else 'string'}" for k in row))
        ended = dml.checked(ended, "status", dml.DOMAINS["query_status"])
        self.store.upsert("query_runs", ended.withColumns({c: F.current_timestamp() for c in ("completed_at", "updated_at")}))

    def session(self, key: str, title: str | None = None, metadata_json: str | None = None) -> int:
        """The id of a research session, made if there is none; title and metadata change where they are given and differ."""
        own = relational.research_session(self.store.read("research_sessions"), key).first()
        new = {"title": title, "metadata_json": metadata_json}
        if own is None or any(v is not None and v != own[k] for k, v in new.items()):
            row = self.spark.createDataFrame([(key, title, metadata_json, own and own["created_at"])], "session_key string, title string, metadata_json string, created_at timestamp")
            row = row.withColumns({"created_at": F.coalesce("created_at", F.current_timestamp()), "updated_at": F.current_timestamp()})
            self.store.upsert("research_sessions", row, keep_if_null=["title", "metadata_json"])
            own = relational.research_session(self.store.read("research_sessions"), key).first()
        return own["id"]

    def query_run(self, run_id: int):
        """One run, or None."""
        return relational.query_run(self.store.read("query_runs"), run_id).first()

    # --- sources and reports --------------------------------------------------------------

    def sources(self, ticker: str | None = None, status: str | None = None, enabled: bool | str | None = None) -> DataFrame:
        s = self.store
        enabled = relational.enabled_filter(enabled) if isinstance(enabled, str) else enabled
        return relational.list_sources(s.read("sources"), s.read("companies"), s.read("documents"), s.read("source_ingestion_runs"), ticker, status, enabled)

    def add_sources(self, rows: DataFrame) -> None:
        """Sources added by a person: status manual, enabled; bad values raise."""
        rows = rows.withColumns({"discovery_status": F.lit("manual"), "enabled": F.lit(True)})
        for column in ("source_type", "ownership", "trust_level"):
            rows = dml.checked(rows, column, dml.DOMAINS[column])
        self.store.upsert("sources", rows)

    def discover_sources(self, fetched: DataFrame) -> DataFrame:
        """Sources of the catalog's companies among fetch results, with their company; stored without undoing a person's decision.

        A url that several companies lead to is stored once, for the company of the best score; a source that has a company keeps it.
        """
        store = self.store
        companies = discovery.resolve_domains(store.read("companies"), fetched.select(discovery.u.normalize_domain(F.col("url")).alias("domain"), "status_code"))
        found = store.kept(discovery.discover(companies.select("ticker", "website_domain"), fetched))
        rows = found.join(companies.select("ticker", F.col("id").alias("company_id")), "ticker")
        known = store.read("sources").select("url", F.col("company_id").alias("_company"))
        rows = discovery.one_per_url(rows).join(known, "url", "left").withColumn("company_id", F.coalesce("_company", "company_id"))
        store.upsert("sources", relational.discovery_state(rows, store.read("sources")).drop("_company", "ticker", "final_url", "status_code", "feeds"))
        return found

    def decide(self, ids: Sequence[int], approve: bool) -> None:
        self.store.update("sources", lambda s: dml.decide_sources(s, ids, approve))

    def index(self) -> DataFrame:
        s = self.store
        return relational.ticker_rollup(relational.index_metadata(s.read("filings"), s.read("embedding_runs"), self.config.model, self.config.collection))

    def index_summary(self) -> DataFrame:
        s = self.store
        return relational.index_summary(relational.index_metadata(s.read("filings"), s.read("embedding_runs"), self.config.model, self.config.collection), self.sources())

    def health(self) -> DataFrame:
        return self.worker.health()

    def query_runs(self, limit: int = 20) -> DataFrame:
        if not 1 <= limit <= 200:
            raise ValueError("limit must be from 1 to 200")
        return relational.recent_query_runs(self.store.read("query_runs"), limit).withColumn("preview", a.answer_preview(F.col("answer_text")))


def _plan_column(plan: SearchPlan):
    text = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    return F.struct(text(plan.tickers).alias("tickers"), F.lit(plan.time_scope).alias("time_scope"), F.array(*map(F.lit, plan.filing_years)).cast("array<int>").alias("filing_years"))


def _by_score():
    return Window.orderBy(F.desc("score"), F.asc("id"))
