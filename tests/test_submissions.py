import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tesserae.engine import Config, Engine
from tesserae.sources import filings, submissions
from test_text import SUBMISSION

HEAD = "<SEC-HEADER>\nACCESSION NUMBER:\t\tacc-{}\n</SEC-HEADER>\n"


def doc(form, text, name="x.htm", tag="DOCUMENT"):
    return f"<{tag}>\n<TYPE>{form}\n<FILENAME>{name}\n<TEXT>\n{text}\n</TEXT>\n</{tag}>\n"


def put(folder, text):
    folder.mkdir(parents=True, exist_ok=True)
    data = text if isinstance(text, bytes) else text.encode()
    (folder / "full-submission.txt").write_bytes(data)
    return data


TEXTS = [
    HEAD.format(1) + doc("EX-1", "one") + doc("10-K", "two é 日本 <DOCUMENT> inside <document>") + doc("GRAPHIC", "three", tag="document"),
    HEAD.format(2) + doc("10-K", "long " * 200) + "</DOCUMENT> stray " + doc("EX-2", "") + "<DOCUMENT>\n<TYPE>X\n</DOCUMENT>" + doc("8-K", "end"),
    HEAD.format(3) + doc("10-K", "closed") + "<DOCUMENT>\n<TEXT>never closed</TEXT>",
    "no documents, é" * 20,
    "<DOCUMENT> alone, never closed <DOCUMENT>",
    "",
    "<DOCUMENT></DOCUMENT>" * 30 + "<DOCUMENT><DOCUMENT></DOCUMENT></DOCUMENT>",
]


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_splits_of_any_size_find_each_document_once(tmp_path, monkeypatch, block):
    """Against the plain pattern over the whole file, with splits and blocks that cut tags, documents and characters."""
    monkeypatch.setattr(submissions, "BLOCK", block)
    for i, text in enumerate(TEXTS):
        data = put(tmp_path / f"f{i}", text)
        want = [(m.start(), m[1].decode()) for m in re.finditer(rb"(?is)<DOCUMENT>(.*?)</DOCUMENT>", data)]
        for size in (1, 5, 64, 1000, 1 << 20) if block > 1 else (50, 1 << 20):
            reader = submissions.Reader({"path": str(tmp_path / f"f{i}"), "split_bytes": str(size), "files": "true"})
            rows = [r for s in reader.partitions() for r in reader.read(s)]
            (file,) = (r for r in rows if r[2] is None)
            assert [(r[2], r[4]) for r in rows if r[2] is not None] == want
            assert file[5] == hashlib.sha256(data).hexdigest() and file[4] == (None if want else text)
            assert len({r[3] for r in rows}) == 1 and file[3] == (text.split("<DOCUMENT>")[0] if "SEC-HEADER" in text else text[:20_000])


def test_a_document_in_many_splits_is_not_searched_again_and_again(tmp_path, monkeypatch):
    """Splits inside one long document read their own bytes and no others."""
    monkeypatch.setattr(submissions, "BLOCK", 1000)
    put(tmp_path / "f", HEAD.format(1) + doc("10-K", "x" * 100_000))
    reader = submissions.Reader({"path": str(tmp_path), "split_bytes": "5000"})
    read = []
    splits = reader.partitions()

    class Counted:
        def __init__(self, file):
            self.file = file

        def read_at(self, n, at):
            read.append(n)
            return self.file.read_at(n, at)

    with open(tmp_path / "f" / "full-submission.txt", "rb") as f:
        import pyarrow as pa

        file = pa.PythonFile(f, mode="r")
        for s in splits[3:10]:
            assert not list(submissions.positions(Counted(file), s.start, s.end, file.size()))
    assert sum(read) < 7 * (5000 + 1000 + 200)


def test_rows_and_options(spark, tmp_path):
    for i, text in enumerate(TEXTS):
        put(tmp_path / "sec-edgar-filings" / "EXM" / ("10-K" if i % 2 == 0 else "8-K") / f"a{i}", text)
    read = lambda **o: filings.source(spark, **{"path": str(tmp_path), **o})
    assert read(ticker="exm", form="8-K").select("path").distinct().count() == 3 and read(ticker="none").count() == 0
    assert read(name="*.htm").count() == 0 and read(path="x").columns == ["path", "modified", "position", "header", "document", "raw_sha256"]
    # the same documents, in the same order, as from whole files
    by_file = filings.scan(spark, str(tmp_path), "exm").union(filings.scan(spark, str(tmp_path), "exm", "8-K"))
    want = by_file.select(F.regexp_extract("path", r"/(a\d+)/", 1).alias("f"), F.posexplode(filings.documents(F.col("submission"))).alias("k", "d")).select("f", "k", "d.*").orderBy("f", "k").collect()
    got = filings.source_documents(read(split_bytes=33)).withColumn("f", F.regexp_extract("path", r"/(a\d+)/", 1)).orderBy("f", "position").collect()
    assert [(r.f, r.form_type, r.filename, r.text) for r in got] == [(r.f, r.form_type, r.filename, r.text) for r in want] and len(got) > 5
    assert {r.accession_number for r in got if r.f == "a0"} == {"acc-1"}
    for wrong in ({"split_bytes": 0}, {"form": "10-K"}, {"path": ""}, {"settle_seconds": -1}):
        with pytest.raises(Exception, match="submissions:"):
            read(**wrong).count()
    put(tmp_path / "bad", b"<DOCUMENT><TEXT>\xff</TEXT></DOCUMENT>")
    with pytest.raises(Exception, match="UnicodeDecodeError"):
        filings.source(spark, path=str(tmp_path / "bad")).collect()


def test_filings_are_the_same_as_from_whole_files(spark, tmp_path):
    folder = tmp_path / "sec-edgar-filings" / "EXM" / "10-K"
    put(folder / "0000000000-26-000001", SUBMISSION.format(business="<p>We make things.</p>" * 100, risk="<p>Things break.</p>" * 100))
    put(folder / "whole", "no documents here")
    put(folder / "second", HEAD.format(7) + doc("EX-1", "x") + doc("10-k", "first") + doc("10-K", "second"))
    columns = ["accession_number", "cik", "company_name", "form_type", "filing_date", "raw_sha256", "html", "text"]
    want = filings.ingest(filings.scan(spark, str(tmp_path), "EXM")).select(*columns)
    rows = filings.source(spark, path=str(tmp_path), ticker="EXM", files="true", split_bytes=100)
    got = filings.ingest_source(rows)
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and got.where("error is not null").count() == 0


def test_stream_takes_filings_in_once_and_goes_on(spark, tmp_path):
    """Two deliveries to streams of one checkpoint; a filing without the form fails alone; one that comes again is replaced."""
    engine = Engine(spark, Config(str(tmp_path / "catalog"), str(tmp_path / "vectors"), chunk_size=600, overlap=60))
    engine.store.initialize()
    raw = tmp_path / "raw" / "sec-edgar-filings"
    filing = lambda n, word: SUBMISSION.replace("0000000000-26-000001", n).format(business=f"<p>We make {word} for customers.</p>" * 60, risk="<p>Our supply may break.</p>" * 60)

    def run():
        engine.stream_filings(str(tmp_path / "raw"), str(tmp_path / "state"), every=None, settle_seconds=0, split_bytes=1500).awaitTermination()
        return {(r.ticker, r.accession_number) for r in engine.store.read("filings").collect()}

    put(raw / "EXM" / "10-K" / "n1", filing("n1", "things"))
    put(raw / "OTH" / "10-K" / "n2", HEAD.format(9) + doc("8-K", "no such form"))
    put(raw / "OTH" / "8-K" / "n3", HEAD.format(10) + doc("8-K", "another form's folder"))
    assert run() == {("EXM", "n1")}
    (dead,) = engine.worker.dead().collect()
    assert dead.owner.endswith("OTH/10-K/n2/full-submission.txt") and dead.error == "No 10-K document found. Available document types: 8-K"
    before = engine.store.version("filings")
    assert run() == {("EXM", "n1")} and engine.store.version("filings") == before  # nothing new, nothing read again
    put(raw / "OTH" / "10-K" / "n4", filing("n4", "tools"))
    put(raw / "EXM" / "10-K" / "n1", filing("n1", "other things"))
    assert run() == {("EXM", "n1"), ("OTH", "n4")}
    texts = {r.path: r.text for r in engine.store.texts().collect()}
    assert "other things" in texts["filings/EXM/n1.txt"] and "tools" in texts["filings/OTH/n4.txt"] and len(texts) == 2
    engine.vectorize_filings()
    assert {r.status for r in engine.store.read("embedding_runs").collect()} == {"ready"}
