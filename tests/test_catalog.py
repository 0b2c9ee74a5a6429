import json

import pytest
from pyspark.sql import functions as F

from tesserae.engine import Config, Engine, SearchPlan
from tesserae.operators import dml, vectors
from tesserae.sources import feeds
from tesserae.sources.schemas import SCHEMAS
from tesserae.sources.store import Store
from test_text import SUBMISSION


def test_store_versions_and_upsert(spark, tmp_path):
    few = {k: SCHEMAS[k] for k in ("companies", "filings")}
    store = Store(spark, str(tmp_path / "a"), few)
    store.initialize()
    rows = spark.createDataFrame([("NVDA", "Nvidia"), ("AMD", "AMD Inc")], "ticker string, name string")
    store.upsert("companies", rows)
    store.upsert("companies", spark.createDataFrame([("AMD", None), ("MU", "Micron")], "ticker string, name string"))
    assert {(r.id, r.ticker, r.name) for r in store.read("companies").collect()} == {(1, "AMD", None), (2, "NVDA", "Nvidia"), (3, "MU", "Micron")}
    assert store.sql("select name from companies where ticker = ?", ["MU"]).first()[0] == "Micron"
    with pytest.raises(ValueError):
        store.sql("select ? from companies", [1, 2])
    other = Store(spark, str(tmp_path / "b"), few)
    other.initialize()
    assert store.copy_to(other).where("source_n <> target_n").count() == 0
    with pytest.raises(RuntimeError, match="companies"):
        store.copy_to(other)
    with pytest.raises(ValueError):
        Store(spark, "ftp://x")


def test_checked_values_raise(spark):
    rows = spark.createDataFrame([("bad",)], "trust_level string")
    with pytest.raises(Exception, match="Invalid trust_level: bad. Allowed values: high, low, medium"):
        dml.checked(rows, "trust_level", dml.DOMAINS["trust_level"]).collect()


def test_plan_limits():
    for wrong in ({"top_k": 0}, {"top_k": 21}, {"intent": "x"}, {"semantic_queries": tuple("abcde")}):
        with pytest.raises(ValueError):
            SearchPlan(**wrong)


def test_engine_end_to_end(spark, tmp_path):
    folder = tmp_path / "raw" / "sec-edgar-filings" / "EXM" / "10-K" / "0000000000-26-000001"
    folder.mkdir(parents=True)
    (folder / "full-submission.txt").write_text(SUBMISSION.format(business="<p>We make useful things for customers.</p>" * 60, risk="<p>Our supply of things may break.</p>" * 60))
    engine = Engine(spark, Config(str(tmp_path / "catalog"), str(tmp_path / "vectors"), chunk_size=600, overlap=60))
    engine.store.initialize()
    engine.ingest_filings(str(tmp_path / "raw"), "exm")
    engine.vectorize_filings()
    run = engine.store.read("embedding_runs").first()
    assert run.status == "ready" and run.indexed_point_count == engine.store.read("chunks").count() > 5
    plan = engine.plan("What are the latest risk factors of EXM?")
    assert plan.tickers == ("EXM",) and plan.sections == ("1A",) and plan.time_scope == "latest"
    answer = engine.ask("What are the latest risk factors of EXM?")
    assert answer.labels[0].startswith("[1] EXM 2026 10-K Item 1A chunk") and "supply of things" in answer.answer
    assert "Available tickers are EXM" in engine.ask("What about the weather?").answer
    assert engine.search("supply of things", "EXM", 3).count() == 3
    run = engine.query_run(1)
    assert run.status == "completed" and json.loads(run.planned_query_json)["tickers"] == ["EXM"] and json.loads(run.retrieval_metadata_json)["sources"][0]["label"] == answer.labels[0] and engine.query_run(99) is None
    assert answer.response(include_plan=False, include_source_text=False)["sources"][0]["text"] is None and answer.sources[0]["text"]
    assert engine.store.texts().first().path == "filings/EXM/0000000000-26-000001.txt"
    assert engine.query_runs(5).count() == 2
    assert engine.index().first().state == "ready"


def filing(folder, business, risk):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "full-submission.txt").write_text(SUBMISSION.format(business=business, risk=risk))


LONG = "An article about things that are long enough to be kept. " * 10


def mixed_engine(spark, tmp_path):
    filing(tmp_path / "raw" / "sec-edgar-filings" / "EXM" / "10-K" / "0000000000-26-000001", "<p>We make useful things for customers.</p>" * 60, "<p>Our supply of things may break.</p>" * 60)
    engine = Engine(spark, Config(str(tmp_path / "catalog"), str(tmp_path / "vectors"), chunk_size=600, overlap=60))
    engine.store.initialize()
    engine.add_sources(spark.createDataFrame([("https://e.example/", "Example", "newsroom", "official", "high"), ("https://f.example/", "Other", "company_blog", "unknown", "low")], "url string, name string, source_type string, ownership string, trust_level string"))
    engine.ingest_filings(str(tmp_path / "raw"), "exm")
    return engine


def state(engine):
    return {r.name: (r.expected, r.ready, r.records, r.points) for r in engine.worker.corpora().collect()}


def test_mixed_index_stays_whole(spark, tmp_path):
    """Filings and documents through two cycles, damage to one corpus, a filing that comes again with fewer chunks."""
    engine = mixed_engine(spark, tmp_path)
    batch = spark.createDataFrame([(1, "u1", LONG), (1, "u2", "Another article, about other things than the first one. " * 40)], "source_id long, url string, text string")
    engine.worker.cycle(batch)
    assert engine.health().first().status == "healthy"
    first = state(engine)
    assert first["sec"][3] > 5 and first["documents"][3] > 2
    engine.worker.cycle(batch)
    assert state(engine) == first and engine.store.read("embedding_runs").first().status == "ready"
    hits = vectors.search(engine.vectors(), list(range(1, 65)), 3, "EXM")
    plan = hits._jdf.queryExecution().toString()
    assert "EqualTo(ticker,EXM)" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    # one corpus is damaged beside a sound one
    owners = engine.vectors().where("chunk_source = 'document'").select("owner").distinct()
    engine.worker.index.replace("document", spark.createDataFrame([], "id string, vector array<float>, owner string"), owners.limit(1))
    assert engine.health().first().status == "degraded"
    with pytest.raises(RuntimeError, match="degraded"):
        engine.ask("What are the risk factors of EXM?")
    sec = {(r.chunk_id, r.embedded_at) for r in engine.store.read("chunk_embeddings").collect()}
    assert engine.worker.repair() == ["documents"] and engine.worker.repair() != ["sec"]
    engine.worker.vectorize()
    assert state(engine) == first and {(r.chunk_id, r.embedded_at) for r in engine.store.read("chunk_embeddings").collect()} == sec
    # the other corpus: a filing's vectors that no catalog row stands for
    index = engine.worker.index
    stray = engine.vectors().where("chunk_source = 'sec_filing'").limit(1).select(F.concat("id", F.lit("x")).alias("id"), "vector", F.lit("stray").alias("owner"))
    index.replace("sec_filing", stray, spark.createDataFrame([("stray",)], "owner string"))
    assert engine.worker.repair() == ["sec"] and engine.store.read("embedding_runs").first().status == "pending"
    engine.worker.vectorize()
    assert state(engine) == first
    # the filing again, shorter and with another text
    filing(tmp_path / "raw" / "sec-edgar-filings" / "EXM" / "10-K" / "0000000000-26-000001", "<p>We make nothing any more at all now.</p>" * 30, "<p>Nothing of ours may break any more.</p>" * 30)
    engine.ingest_filings(str(tmp_path / "raw"), "exm")
    engine.worker.cycle(batch.limit(0))
    now = state(engine)
    assert now["sec"][3] < first["sec"][3] and len(set(now["sec"])) == 1 and now["documents"] == first["documents"] and engine.health().first().status == "healthy"
    texts = [r.text for r in engine.vectors().where("chunk_source = 'sec_filing'").collect()]
    assert all("more" in x for x in texts) and index.ids_of("sec_filing", "0000000000-26-000001").count() == len(texts) == vectors.vector_ids(engine.vectors(), "0000000000-26-000001").count()


def test_failed_indexing_is_recorded(spark, tmp_path, monkeypatch):
    engine = mixed_engine(spark, tmp_path)
    monkeypatch.setattr(engine.worker.index, "size", 63)
    with pytest.raises(Exception, match="vector size must be 63"):
        engine.vectorize_filings()
    run = engine.store.read("embedding_runs").first()
    assert run.status == "failed" and "vector size" in run.error_message and run.completed_at and run.indexed_point_count == 0
    monkeypatch.setattr(engine.worker.index, "size", 64)
    engine.vectorize_filings()
    run = engine.store.read("embedding_runs").first()
    assert run.status == "ready" and run.error_message is None and run.indexed_point_count == run.expected_point_count > 0
    monkeypatch.setattr(engine.worker.index, "size", 32)
    with pytest.raises(ValueError, match="has vector size 64"):
        engine.worker.index.ensure()


def test_failed_questions_and_planners_are_recorded(spark, tmp_path):
    engine = mixed_engine(spark, tmp_path)
    engine.planner = lambda question, context: 1 / 0
    answer = engine.ask("What are the risk factors of EXM?", " one ", "Title")
    assert answer.used_fallback and answer.planner_error.startswith("ZeroDivisionError") and answer.plan.tickers == () and answer.plan.semantic_queries == ("What are the risk factors of EXM?",)
    engine.planner = lambda question, context: "no plan"
    with pytest.raises(AttributeError):
        engine.ask("What are the risk factors of EXM?", "one")
    runs = {r.id: r for r in engine.query_runs(5).collect()}
    assert (runs[1].status, runs[2].status) == ("completed", "failed") and "AttributeError" in runs[2].error_message and runs[1].research_session_id == runs[2].research_session_id == 1
    assert engine.session("one") == 1 and engine.session("two") == 2


def test_runs_of_sources_and_a_cycle_that_fails(spark, tmp_path, monkeypatch):
    engine = mixed_engine(spark, tmp_path)
    rows = [(1, "u1", LONG, None, 1), (1, "u2", "short", None, 2), (1, "u3", None, "TimeoutError: late", 3), (1, "u4", LONG + "more", None, 4), (2, None, None, "HTTPError: gone", 1), (9, "u9", LONG + "nine", None, 1)]
    batch = spark.createDataFrame(rows, "source_id long, url string, text string, error string, position int")
    engine.worker.limit = 3
    cycle = engine.worker.cycle
    monkeypatch.setattr(engine.worker, "cycle", lambda *x: 1 / 0)
    engine.worker.surviving_cycle(batch)
    assert engine.store.read("documents").count() == 0
    monkeypatch.setattr(engine.worker, "cycle", cycle)
    engine.worker.surviving_cycle(batch.limit(0))  # takes in what the failed cycle had
    runs = {r.source_id: r for r in engine.store.read("source_ingestion_runs").collect()}
    assert (runs[1].status, runs[1].discovered_count, runs[1].inserted_count, runs[1].skipped_count) == ("partial", 3, 1, 2) and runs[1].error_message == "no extractable text: u2; u3: TimeoutError: late"
    assert (runs[2].status, runs[2].discovered_count, runs[2].error_message) == ("failed", 0, "HTTPError: gone") and set(runs) == {1, 2}
    document = engine.store.read("documents").first()
    assert document.url == "u1" and document.document_type == "press_release" and json.loads(document.metadata_json)["source_url"] == "https://e.example/" and document.fetched_at
    assert engine.store.texts().where(F.col("path") == document.clean_text_path).first().text == LONG
    engine.worker.surviving_cycle(batch)
    again = engine.store.read("source_ingestion_runs").where("source_id = 1").orderBy(F.desc("id")).first()
    assert (again.inserted_count, again.skipped_count) == (0, 3) and engine.store.read("documents").count() == 1 and engine.store.read("document_chunks").count() > 0


def test_store_adds_and_compacts(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    row = lambda ticker, name: spark.createDataFrame([(ticker, name)], "ticker string, name string")
    store.upsert("companies", row("a", "one"))
    store.upsert("companies", row("B", "two"))
    assert store.versions("companies") == (2, [1, 2])  # added, nothing rewritten
    store.upsert("companies", row("A", "three"))
    assert store.versions("companies")[1] == [1, 2, 3] and {(r.ticker, r.name) for r in store.read("companies").collect()} == {("A", "three"), ("B", "two")}
    store.upsert("companies", row("C", "four"))
    store.compact("companies")
    store.vacuum("companies")
    assert store.versions("companies") == (5, [5]) and store.read("companies").count() == 3


def test_worker_cycle(spark, tmp_path):
    engine = Engine(spark, Config(str(tmp_path / "catalog"), str(tmp_path / "vectors"), chunk_size=300, overlap=30))
    engine.store.initialize()
    engine.add_sources(spark.createDataFrame([("https://e.example/", "Example", "newsroom", "official", "high")], "url string, name string, source_type string, ownership string, trust_level string"))
    long = "An article about things that are long enough to be kept. " * 10
    batch = spark.createDataFrame([(1, "u1", long), (1, "u2", long), (1, "u3", "short"), (1, "u1", long), (9, "u9", long)], "source_id long, url string, text string")
    engine.worker.cycle(batch)
    assert [(r.url, r.source_id) for r in engine.store.read("documents").collect()] == [("u1", 1)]
    assert engine.health().first().status == "healthy"
    engine.worker.cycle(batch)
    assert engine.store.read("documents").count() == 1 and engine.health().first().points == engine.store.read("document_chunks").count()
    engine.decide([1], False)
    assert not engine.sources(status="rejected").first().enabled


def test_feed_entries(spark):
    rss = """<?xml version="1.0"?><rss><channel><title>t</title><item><title><![CDATA[A & B]]></title><link>HTTPS://E.example/a#x</link><pubDate>Mon, 01 Jun 2026 12:00:00 GMT</pubDate><guid>1</guid></item>
    <item><title>again</title><link>https://e.example/a</link></item><item><title>none</title></item></channel></rss>"""
    atom = '<feed><entry><title>C</title><link rel="alternate" href="/c"/><updated>2026-06-01T12:00:00Z</updated><author><name>Me</name></author></entry></feed>'
    page = '<html><head><link rel="alternate" type="application/rss+xml" href="/feed"><link rel="stylesheet" href="x.css"></head></html>'
    fetched = spark.createDataFrame([(1, "https://e.example/", rss), (2, "https://f.example/x", atom)], "source_id long, base_url string, content string")
    found = {(r.source_id, r.url, r.title, r.author, r.published_at) for r in feeds.entries(fetched).collect()}
    moment = "2026-06-01T12:00:00+00:00"
    assert found == {(1, "https://e.example/a", "A & B", None, moment), (2, "https://f.example/c", "C", "Me", moment)}
    pages = spark.createDataFrame([(3, "https://g.example/news", page)], "source_id long, url string, content string")
    assert feeds.discover_entries(pages, spark.createDataFrame([("https://g.example/feed", rss)], "url string, content string")).count() == 1


def test_embedding_is_deterministic(spark):
    frame = spark.createDataFrame([("same words here",), ("same words here",), (None,)], "x string").select(vectors.embed(F.col("x")).alias("v")).collect()
    assert frame[0].v == frame[1].v and frame[2].v is None and abs(sum(x * x for x in frame[0].v) - 1) < 1e-6


def test_numbers_follow_the_order(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = store.numbered(spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")).repartition(5), ["k"], 10).orderBy("k").collect()
    assert [r.id for r in rows] == list(range(10, 1010))
    assert store.numbered(spark.range(0).select(F.col("id").alias("k")), ["k"], 1).count() == 0


def poisoned(monkeypatch, url):
    """Working out an article's text raises for one url."""
    from tesserae.streaming import ingest

    real = ingest.prepared
    monkeypatch.setattr(ingest, "prepared", lambda entries, *x: real(entries, *x).withColumn("content_hash", F.when(F.col("url") == url, F.raise_error(F.lit("poison")).cast("string")).otherwise(F.col("content_hash"))))
    return lambda: monkeypatch.setattr(ingest, "prepared", real)


def test_one_poisoned_article_fails_alone(spark, tmp_path, monkeypatch):
    """It is told in its source's run, kept with its attempts, tried again when its time has come, and dead after the last one."""
    from tesserae.streaming import ingest

    monkeypatch.setattr(ingest, "FIRST_WAIT", 0)
    monkeypatch.setattr(ingest, "MAX_ATTEMPTS", 2)
    engine = Engine(spark, Config(str(tmp_path / "catalog"), str(tmp_path / "vectors"), chunk_size=300, overlap=30))
    engine.add_sources(spark.createDataFrame([("https://e.example/", "Example", "newsroom", "official", "high")], "url string, name string, source_type string, ownership string, trust_level string"))
    batch = spark.createDataFrame([(1, f"u{k}", f"{LONG} number {k}") for k in range(24)], "source_id long, url string, text string")
    cure = poisoned(monkeypatch, "u7")
    worker = engine.worker
    worker.ingest(batch)
    run = engine.store.read("source_ingestion_runs").first()
    assert (run.status, run.discovered_count, run.inserted_count, run.skipped_count) == ("partial", 24, 23, 1) and run.error_message.startswith("u7: ") and "poison" in run.error_message
    assert engine.store.read("documents").count() == 23 and engine.store.read("_failures").first().attempts == 1
    assert worker.dead().count() == 0
    cure()
    worker.ingest(batch.limit(0))  # its time has come
    assert engine.store.read("documents").count() == 24 and engine.store.read("_failures").count() == 0
    poisoned(monkeypatch, "u900")
    again = batch.limit(1).withColumns({"url": F.lit("u900"), "text": F.lit(LONG + "nine hundred")})
    worker.ingest(again)
    for _ in range(2):
        worker.ingest(batch.limit(0))  # once more, and not again
    dead = worker.dead().first()
    assert dead.owner == "entry:1|u900" and dead.attempts == 2 and json.loads(dead.entry)["url"] == "u900"


def test_one_poisoned_filing_fails_alone(spark, tmp_path, monkeypatch):
    for k in range(1, 4):
        filing(tmp_path / "raw" / "sec-edgar-filings" / "EXM" / "10-K" / f"0000000000-26-00000{k}", f"<p>We make useful things of kind {k} for customers.</p>" * 60, "<p>Our supply of things may break.</p>" * 60)
    text = (tmp_path / "raw" / "sec-edgar-filings" / "EXM" / "10-K" / "0000000000-26-000001" / "full-submission.txt").read_text()
    for k in range(2, 4):
        path = tmp_path / "raw" / "sec-edgar-filings" / "EXM" / "10-K" / f"0000000000-26-00000{k}" / "full-submission.txt"
        path.write_text(text.replace("0000000000-26-000001", f"0000000000-26-00000{k}"))
    engine = Engine(spark, Config(str(tmp_path / "catalog"), str(tmp_path / "vectors"), chunk_size=600, overlap=60))
    engine.ingest_filings(str(tmp_path / "raw"), "exm")
    real = engine.worker.index.replace

    def replace(corpus, rows, owners):
        if not owners.where("owner = '0000000000-26-000003'").isEmpty():
            raise ValueError("bad filing")
        real(corpus, rows, owners)

    monkeypatch.setattr(engine.worker.index, "replace", replace)
    engine.vectorize_filings()
    status = lambda: {r.accession_number: r.status for r in engine.store.read("embedding_runs").join(engine.store.read("filings").select(F.col("id").alias("filing_id"), "accession_number"), "filing_id").collect()}
    assert status() == {f"0000000000-26-00000{k}": "failed" if k == 3 else "ready" for k in range(1, 4)}
    assert "bad filing" in engine.store.read("embedding_runs").where("status = 'failed'").first().error_message
    monkeypatch.setattr(engine.worker.index, "replace", real)
    engine.vectorize_filings()
    assert set(status().values()) == {"ready"} and engine.health().first().status == "healthy"


def test_from_discovery_to_an_answer_that_cites_the_article(spark, tmp_path):
    """A source that is found for a company is its own: listed under its ticker, and its articles answer questions about it."""
    engine = mixed_engine(spark, tmp_path)
    engine.store.upsert("companies", spark.createDataFrame([("EXM", "Example Corp", "exm.example"), ("OTH", "Other", "oth.example")], "ticker string, name string, website_domain string"))
    page = lambda name: f"<html><head><title>{name} Newsroom</title></head><body><article>{'<p>News of the company, told at some length.</p>' * 12}</article></body></html>"
    fetched = spark.createDataFrame([(f"https://{d}.example/newsroom", f"https://{d}.example/newsroom", 200, "text/html", page(d)) for d in ("exm", "oth")], "url string, final_url string, status_code int, content_type string, text string")
    engine.discover_sources(fetched)
    found = engine.sources("EXM").collect()
    assert [(s.url, s.discovery_status, s.ticker) for s in found] == [("https://exm.example/newsroom", "candidate", "EXM")] and engine.sources("OTH").count() == 1
    engine.decide([found[0].id], True)
    engine.discover_sources(fetched)
    assert engine.sources("EXM").first().discovery_status == "approved"
    article = "Our supply of things may break, says the newsroom of the company. " * 8
    engine.worker.cycle(spark.createDataFrame([(found[0].id, "https://exm.example/newsroom/1", "Supply", "2026-03-01T00:00:00+00:00", article)], "source_id long, url string, title string, published_at string, text string"))
    counted = engine.store.version("_health")
    answer = engine.ask("What are the latest risk factors of EXM?")
    cited = [x for x in answer.sources if x["chunk_source"] == "document"]
    assert cited and cited[0]["ticker"] == "EXM" and cited[0]["url"] == "https://exm.example/newsroom/1" and any('2026-03-01, "Supply"' in x for x in answer.labels) and "says the newsroom" in answer.answer
    assert engine.store.version("_health") == counted  # health was kept with the cycle: the question counted nothing
    run = engine.query_run(answer.query_run_id)
    assert run.status == "completed" and run.started_at and run.completed_at


def test_runs_are_running_until_they_end(spark, tmp_path, monkeypatch):
    engine = mixed_engine(spark, tmp_path)
    seen = []
    monkeypatch.setattr(engine, "_answered", lambda q: seen.append([r.status for r in engine.store.read("query_runs").collect()]) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        engine.ask("What are the risk factors of EXM?")
    assert seen == [["running"]] and engine.store.read("query_runs").first().status == "failed"
    monkeypatch.setattr(engine.worker, "_ingested", lambda *x: seen.append([r.status for r in engine.store.read("source_ingestion_runs").collect()]) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        engine.worker.ingest(spark.createDataFrame([(1, "u", LONG)], "source_id long, url string, text string"))
    run = engine.store.read("source_ingestion_runs").first()
    assert seen[1] == ["running"] and run.status == "failed" and run.error_message.startswith("ZeroDivisionError") and run.completed_at
