import random
import threading
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tesserae.operators import dml
from tesserae.sources import store as stores
from tesserae.sources.index import VectorIndex
from tesserae.sources.schemas import SCHEMAS
from tesserae.sources.store import Change, Store


def companies(spark, *rows):
    return spark.createDataFrame(rows, "ticker string, name string")


def names(store):
    return {(r.ticker, r.name) for r in store.read("companies").collect()}


def test_one_row_a_key(spark, tmp_path):
    """Repeated new keys leave one row, whatever their case, and the same batch again changes nothing."""
    store = Store(spark, str(tmp_path))
    batch = companies(spark, ("aa", "N1"), ("AA", "N2"), ("bb", None), ("BB", "M"))
    for _ in range(2):
        store.upsert("companies", batch)
        rows = store.read("companies").collect()
        assert sorted((r.id, r.ticker, r.name) for r in rows) == [(1, "AA", "N2"), (2, "BB", "M")]
    store.upsert("companies", spark.createDataFrame([("cc", "last", 1), ("CC", "first", 2)], "ticker string, name string, created_at int").withColumn("created_at", F.timestamp_seconds("created_at")), order=["created_at"])
    assert ("CC", "first") in names(store)


def test_rows_that_change_are_added_and_hide_the_old(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.upsert("companies", companies(spark, *((f"T{k}", "one") for k in range(50))))
    store.upsert("companies", companies(spark, ("T1", "two"), ("X", "new")))
    store.upsert("companies", companies(spark, ("T1", "three"), ("T2", None)))
    assert store.versions("companies") == (3, [1, 2, 3])
    got = {r.ticker: (r.id, r.name) for r in store.read("companies").collect()}
    assert len(got) == 51 and store.read("companies").count() == 51 and got["T1"][1] == "three" and got["T2"][1] is None and got["X"][0] == 51
    store.upsert("companies", companies(spark, ("T2", None)), keep_if_null=["name"])
    store.compact("companies")
    before = store.versions("companies")
    store.vacuum("companies")
    assert before[1] == [5] and {r.ticker: (r.id, r.name) for r in store.read("companies").collect()} == got
    assert len(list((tmp_path / "companies" / "data").iterdir())) == 1
    store.upsert("companies", companies(spark, ("Y", "later")))
    assert store.read("companies").where("ticker = 'Y'").first().id == 52
    assert not list((tmp_path / "_work").iterdir())  # what commits kept for themselves is gone


def test_children_are_exchanged_by_parent(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    chunk = lambda f, texts: [(f, "1", i, x) for i, x in enumerate(texts)]
    frame = lambda rows: spark.createDataFrame(rows, "filing_id long, section_id string, chunk_index int, text string")
    owners = lambda *ids: spark.createDataFrame([(i,) for i in ids], "filing_id long")
    store.exchange("chunks", frame(chunk(1, "abc") + chunk(2, "xy") + chunk(3, "z")), ["filing_id"], owners(1, 2, 3))
    store.exchange("chunks", frame(chunk(2, "q")), ["filing_id"], owners(2, 3, 9))
    rows = store.read("chunks").orderBy("id").collect()
    assert [(r.id, r.filing_id, r.text) for r in rows] == [(1, 1, "a"), (2, 1, "b"), (3, 1, "c"), (7, 2, "q")]
    store.exchange("chunks", None, ["filing_id"], owners(1))
    assert store.read("chunks").count() == 1
    # rows hidden by owner and rows hidden by key in one table
    store.upsert("chunks", frame([(2, "1", 0, "r"), (4, "1", 0, "s")]))
    assert {(r.filing_id, r.text) for r in store.read("chunks").collect()} == {(2, "r"), (4, "s")}


def test_two_writers_lose_nothing(spark, tmp_path):
    """Threads that add, overwrite and rewrite at once: every batch is there, each key once, each id once."""
    Store(spark, str(tmp_path)).initialize()
    errors = []

    def work(k):
        try:
            own = Store(spark, str(tmp_path))
            for i in range(2):
                own.upsert("companies", companies(spark, (f"T{k}-{i}", f"{k}"), ("SHARED", f"{k}-{i}")))
            own.update("companies", lambda now: now.withColumn("cik", F.concat(F.coalesce("cik", F.lit("")), F.lit(str(k)))))
            own.insert("query_runs", spark.createDataFrame([(f"q{k}",)], "question string"), ["question"])
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    store = Store(spark, str(tmp_path))
    rows = store.read("companies").collect()
    assert sorted(r.ticker for r in rows) == sorted(["SHARED", *(f"T{k}-{i}" for k in range(3) for i in range(2))])
    assert sorted(r.id for r in rows) == list(range(1, 8))
    runs = store.read("query_runs").collect()
    assert sorted(r.id for r in runs) == [1, 2, 3] and {r.question for r in runs} == {"q0", "q1", "q2"}


def test_a_taken_version_is_made_again(spark, tmp_path, monkeypatch):
    store, other = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    store.upsert("companies", companies(spark, ("A", "one")))
    seen = []

    def change(now):
        seen.append(now.count())
        if len(seen) == 1:
            other.upsert("companies", companies(spark, ("B", "two")))
        return Change(now, base=True)

    store.commit("companies", change)
    assert seen == [1, 2] and names(store) == {("A", "one"), ("B", "two")}
    monkeypatch.setattr(stores, "ATTEMPTS", 2)
    monkeypatch.setattr(store, "_claim", lambda *x: False)
    with pytest.raises(stores.Conflict, match="companies"):
        store.append("companies", companies(spark, ("C", "x")))
    assert names(other) == {("A", "one"), ("B", "two")}
    assert not other._claim("companies", 1, {}) and other._entry("companies", 1)["base"] is False


def test_a_reader_keeps_its_version(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.upsert("companies", companies(spark, ("A", "one")))
    then = store.read("companies")
    store.upsert("companies", companies(spark, ("A", "two"), ("B", "x")))
    store.compact("companies")
    assert [r.name for r in then.collect()] == ["one"] and names(store) == {("A", "two"), ("B", "x")}


def test_texts_are_replaced_by_path(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    texts = lambda *rows: spark.createDataFrame(rows, "path string, text string")
    store.keep_texts(texts(("a", "old"), ("b", "x")))
    store.keep_texts(texts(("a", "new"), ("c", "y"), ("c", "y")))
    assert {tuple(r) for r in store.texts().collect()} == {("a", "new"), ("b", "x"), ("c", "y")} and store.texts().count() == 3


def test_copy_checks_columns_and_tells_totals(spark, tmp_path):
    few = {k: SCHEMAS[k] for k in ("companies", "filings", "sources")}
    a, b = Store(spark, str(tmp_path / "a"), few), Store(spark, str(tmp_path / "b"), few)
    a.initialize()
    b.initialize()
    a.upsert("companies", companies(spark, ("A", "one"), ("B", "two")))
    a.upsert("companies", companies(spark, ("A", "three")))
    dry = {r["table"]: r for r in a.copy_to(b, dry_run=True).collect()}
    assert (dry["companies"].source_n, dry["companies"].target_n) == (2, None) and b.read("companies").count() == 0
    told = a.copy_to(b).collect()
    assert [r["table"] for r in told] == ["companies", "filings", "sources"]
    assert {r["table"]: (r.source_n, r.target_n, r.next_id) for r in told}["companies"] == (2, 2, 3) and names(b) == {("A", "three"), ("B", "two")}
    b.upsert("companies", companies(spark, ("C", "after")))
    assert b.read("companies").where("ticker = 'C'").first().id == 3
    with pytest.raises(RuntimeError, match="not empty: companies"):
        a.copy_to(b)
    assert a.copy_to(b, replace=True).where("table = 'companies'").first().target_n == 2
    lacking = Store(spark, str(tmp_path / "c"), {**a.schemas, "companies": "id long, ticker string"})
    with pytest.raises(RuntimeError, match="'companies': columns on one side only: cik, created_at, name"):
        a.copy_to(lacking)
    with pytest.raises(RuntimeError, match="tables on one side only: sources"):
        a.copy_to(Store(spark, str(tmp_path / "d"), {k: v for k, v in a.schemas.items() if k != "sources"}))


def vectors_of(spark, owners, tag, each=4):
    rng = random.Random(5)
    rows = [(f"{o}-{i}", [rng.random() for _ in range(64)], o, f"TICK{int(o[1:]) % 40}", f"{tag} {o} {i}") for o in owners for i in range(each)]
    return spark.createDataFrame(rows, "id string, vector array<float>, owner string, ticker string, text string")


def owners_of(spark, owners):
    return spark.createDataFrame([(o,) for o in owners], "owner string")


def size(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_an_exchange_of_vectors_writes_what_it_brings(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path), "c")
    everyone = [f"o{k}" for k in range(1000)]
    index.replace("document", vectors_of(spark, everyone, "first"), owners_of(spark, everyone))
    base = size(tmp_path)
    some = everyone[:30]
    index.replace("document", vectors_of(spark, some, "second", each=2), owners_of(spark, some + ["o999"]))
    assert size(tmp_path) - base < base / 10
    got = index.read()
    assert got.count() == 4 * (1000 - 31) + 2 * 30 and got.where("owner = 'o999'").count() == 0
    assert index.ids_of("document", "o3").count() == 2 and got.where("owner = 'o3' and text like 'first%'").count() == 0
    plan = got.where("ticker = 'TICK3'").select("id")._jdf.queryExecution().toString()
    assert "EqualTo(ticker,TICK3)" in plan and "Exchange hashpartitioning(owner" not in plan and "SortMergeJoin" not in plan
    index.compact()
    index.vacuum()
    assert index.version() == 3 and index.read().count() == 4 * (1000 - 31) + 2 * 30


def test_a_ticker_is_read_from_few_row_groups(spark, tmp_path):
    """After compaction rows of a ticker lie together: few parts of few files can hold it by their least and greatest values."""
    index = VectorIndex(spark, str(tmp_path), "c")
    everyone = [f"o{k}" for k in range(600)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        index.replace("document", vectors_of(spark, everyone, "x").repartition(16), owners_of(spark, everyone))

        def hit():
            folder = tmp_path / "c" / "data" / index.store._entry("c", index.version())["folder"] / "rows"
            groups = total = 0
            for f in folder.glob("*.parquet"):
                meta = pq.ParquetFile(f).metadata
                at = meta.schema.names.index("ticker")
                for g in range(meta.num_row_groups):
                    s = meta.row_group(g).column(at).statistics
                    total += 1
                    groups += s.min <= "TICK17" <= s.max
            return groups, total

        before = hit()
        index.compact()
        after = hit()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert before[0] == before[1] and after[1] >= 12 and after[0] <= 2


def test_wrong_vectors_change_nothing(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path), "c")
    index.replace("document", vectors_of(spark, ["o1"], "x"), owners_of(spark, ["o1"]))
    twice = vectors_of(spark, ["o2"], "x")
    with pytest.raises(RuntimeError, match="4 occur twice"):
        index.replace("document", twice.union(twice), owners_of(spark, ["o2"]))
    with pytest.raises(RuntimeError, match="4 are of other owners"):
        index.replace("document", twice, owners_of(spark, ["o3"]))
    assert index.read().count() == 4 and index.version() == 1
    assert not list((tmp_path / "_work").iterdir())


def test_best_row_of_a_key(spark):
    rows = spark.createDataFrame([(1, "b", None), (1, "a", 5), (None, "x", 1), (None, "y", 0), (2, None, None)], "k int, x string, n int")
    assert {tuple(r) for r in dml.one_per_key(rows, ["k"]).collect()} == {(1, "b", None), (None, "y", 0), (2, None, None)}
    assert {tuple(r) for r in dml.one_per_key(rows, ["k"], ["n"]).collect()} == {(1, "a", 5), (None, "x", 1), (2, None, None)}
    assert dml.one_per_key(rows.select("k"), ["k"]).count() == 3


def test_time_of_claims(spark, tmp_path):
    """A claim is a link: cheap, and the second one loses."""
    store = Store(spark, str(tmp_path))
    began = time.monotonic()
    assert [store._claim("companies", 1, {"base": True, "n": k}) for k in range(20)] == [True] + [False] * 19
    assert time.monotonic() - began < 5 and store._entry("companies", 1)["n"] == 0


def test_ids_follow_counts(spark, tmp_path):
    """Numbers before a row in the order of one column, over many files; against a plain loop."""
    store = Store(spark, str(tmp_path))
    sizes = {k: k * 7 % 5 for k in range(1, 400)}
    made = store.counted(spark.createDataFrame(sorted(sizes.items(), key=lambda x: x[0] * 37 % 401), "k long, n int").repartition(5), "k", "n")
    assert {r.k: r["_before"] for r in made.collect()} == {k: sum(n for j, n in sizes.items() if j < k) for k in sizes}
    store.done(made)


def test_texts_are_written_and_moved_few_times(spark, tmp_path, monkeypatch):
    """A batch keeps its texts once and their chunks once; what is new is found on short rows. Repeated entries come in once, chunks have ids in the order of documents."""
    from tesserae.streaming import ingest

    store = Store(spark, str(tmp_path / "catalog"))
    store.append("sources", spark.createDataFrame([(1, "https://a.com/", "newsroom", "approved", True)], "id long, url string, source_type string, discovery_status string, enabled boolean"))
    kept, first = [], store.kept

    def told(rows):
        kept.append(set(rows.columns) & {"text", "chunks"})
        return first(rows)

    monkeypatch.setattr(store, "kept", told)
    worker = ingest.Worker(spark, store, str(tmp_path / "vectors"), size=200, overlap=20)
    entries = [(1, f"https://a.com/{k}", f"{k} " + "some words " * (12 + 9 * k)) for k in range(20)]
    worker.ingest(spark.createDataFrame(entries + entries[:5] + [(1, "https://a.com/x", entries[3][2])], "source_id long, url string, text string").repartition(3))
    assert sorted(map(sorted, filter(None, kept))) == [["chunks"], ["text"]]
    documents = {r.url: r for r in store.read("documents").collect()}
    assert sorted(documents) == sorted(e[1] for e in entries)
    texts = {r.path: r.text for r in store.texts().collect()}
    assert all(texts[documents[url].clean_text_path] == text for _, url, text in entries) and len(texts) == 20
    chunks = store.read("document_chunks").orderBy("document_id", "chunk_index").collect()
    assert [c.id for c in chunks] == list(range(1, len(chunks) + 1)) and {c.document_id for c in chunks} == {d.id for d in documents.values()}
    assert worker.ingest(spark.createDataFrame(entries, "source_id long, url string, text string")).first().inserted_count == 0
