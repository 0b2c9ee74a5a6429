import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from tesserae.functions import text as t
from tesserae.operators import discovery
from tesserae.sources import filings


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def packed(text, size, overlap):
    """A plain loop of the chunking rules."""

    def split(x):
        if len(x) <= size:
            return [x.strip()]
        out, start = [], 0
        while True:
            end = min(start + size, len(x))
            if x[start:end].strip():
                out.append(x[start:end].strip())
            if end == len(x):
                return out
            start = end - overlap

    out, now = [], ""
    for p in (q.strip() for q in re.split(r"\n{2,}", text)):
        if not p:
            continue
        if not now or len(now) + 2 + len(p) <= size:
            now = now and f"{now}\n\n{p}" or p
            continue
        out += split(now)
        tail = now[-overlap:].strip() if overlap else ""
        if (k := tail.find("\n\n")) > 0:
            tail = tail[k:].strip()
        now = f"{tail}\n\n{p}" if tail else p
    return out + (split(now) if now else [])


@pytest.mark.parametrize(("size", "overlap"), [(180, 30), (80, 10), (50, 0), (7, 6)])
def test_chunks(spark, size, overlap):
    texts = ["", "one", "word " * 100, "\n\n".join("abc de " * k for k in range(1, 40)), "a\n\n\n\nb\n\n" + "x" * 200, "é" * 333 + "\n\n" + " y " * 50]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    made = {r.i: r.c for r in frame.select("i", t.chunks(F.col("x"), size, overlap).alias("c")).collect()}
    assert made == {i: packed(x, size, overlap) for i, x in enumerate(texts)}


def test_chunk_sizes_are_checked():
    for size, overlap in ((0, 0), (10, -1), (10, 10)):
        with pytest.raises(ValueError):
            t.chunks(None, size, overlap)


def test_vector_id(spark):
    made = one(spark, lambda x: t.vector_id(x), "acc:1A:0")
    assert made == str(uuid.uuid5(uuid.NAMESPACE_URL, "acc:1A:0"))


def test_clean_filing_html(spark):
    html = '<html><style>p{}</style><body><p>Net<b>work</b> “x” – y</p><p>Second&nbsp; one</p><div style="display: none">no<p>no</p></div><ix:header>no</ix:header><!-- no --><br/>end</body></html>'
    assert one(spark, t.clean_filing_html, html) == 'Network "x" - y\n\nSecond one\n\nend'


def test_article_text(spark):
    html = "<html><head><title> A &amp;\n B </title></head><body><nav>no</nav><article><h1>Head</h1><p>Some  text</p><script>no</script></article>out</body></html>"
    assert one(spark, t.article_text, html) == "Head\n\nSome text"
    assert one(spark, t.html_title, html) == "A & B"
    assert one(spark, t.article_text, None) is None


SUBMISSION = """<SEC-HEADER>
ACCESSION NUMBER:\t\t0000000000-26-000001
CONFORMED SUBMISSION TYPE:\t10-K
CONFORMED PERIOD OF REPORT:\t20260125
FILED AS OF DATE:\t\t20260225
COMPANY CONFORMED NAME:\t\tEXAMPLE CORP
CENTRAL INDEX KEY:\t\t0000000001
</SEC-HEADER>
<DOCUMENT>
<TYPE>EX-1
<TEXT>other</TEXT>
</DOCUMENT>
<DOCUMENT>
<TYPE>10-K
<FILENAME>x.htm
<TEXT>
<p>Item 1. Business</p><p>Item 1A. Risk Factors</p><p>Item 1. Business</p>{business}<p>Item 1A. Risk Factors</p>{risk}<p>Item 2. Properties</p>
</TEXT>
</DOCUMENT>"""


def test_filings(spark, tmp_path):
    folder = tmp_path / "sec-edgar-filings" / "EXM" / "10-K" / "0000000000-26-000001"
    folder.mkdir(parents=True)
    (folder / "full-submission.txt").write_text(SUBMISSION.format(business="<p>We make things.</p>" * 100, risk="<p>Things break.</p>" * 100))
    read = filings.ingest(filings.scan(spark, str(tmp_path), "exm"))
    row = read.first()
    assert (row.accession_number, row.cik, row.company_name, row.form_type, row.filing_date, row.period_of_report) == ("0000000000-26-000001", "0000000001", "EXAMPLE CORP", "10-K", "2026-02-25", "2026-01-25")
    found = {r.section_id: r for r in filings.sections(read).collect()}
    assert set(found) == {"1", "1A"} and found["1A"].section_title == "Risk Factors" and found["1"].text.count("We make things.") == 100
    chunks = filings.chunk_sections(filings.sections(read), 500, 50).collect()
    assert all(len(c.text) <= 500 for c in chunks) and {c.chunk_index for c in chunks if c.section_id == "1"} == set(range(len([c for c in chunks if c.section_id == "1"])))


def test_missing_form_raises(spark):
    frame = spark.createDataFrame([(SUBMISSION.replace("10-K", "8-K"),)], "x string").select(filings.primary_text(F.col("x")))
    with pytest.raises(Exception, match="No 10-K document found. Available document types: EX-1, 8-K"):
        frame.collect()


def test_indexed_items(spark):
    html = """<p>Form 10-K Cross-Reference Index</p><table><tr><td>Item Number</td><td>Page</td></tr><tr><td>Item 1.</td><td>Pages <a href="#p1">1</a>-2</td></tr>
    <tr><td>Item 1A.</td><td>Page <a href="#p3">3</a></td></tr></table><a id="p1"></a><p>first page</p><hr style="page-break-after: always"><p>second page</p><hr style="page-break-after: always"><a id="p3"></a><p>third page</p>
    <hr style="page-break-after: always"><p>fourth page</p>"""
    made = {i["item"]: i["html"] for i in one(spark, t.indexed_items, html)}
    assert set(made) == {"1", "1A"} and "second page" in made["1"] and "third" not in made["1"] and "third page" in made["1A"] and "fourth" not in made["1A"]


INDEX = """<h2>Form 10-K Cross-Reference Index</h2><table><tr><th>Item Number</th><th>Item</th></tr>{rows}</table>"""


def indexed(spark, html):
    return {i["item"]: i["html"] for i in one(spark, t.indexed_items, html)}


def test_indexed_items_that_are_not_contiguous(spark):
    """A break right after an anchor begins its page; rows without an item of their own belong to the last one; text between elements is left out."""
    rule = '<hr style="page-break-after: always">'
    page = lambda k, *texts: f'<div id="page-{k}"></div>{rule}' + rule.join(f"<p>{x}</p>" for x in texts) + rule
    rows = """<tr><td>Item 1.</td><td>Business</td></tr><tr><td>Description of business</td><td>Pages <a href="#page-1">1</a> - 2</td></tr><tr><td>Item 1A.</td><td>Risk Factors</td><td>Page <a href="#page-3">3</a></td></tr>
    <tr><td>Item 7.</td><td>Discussion</td></tr><tr><td>Critical estimates</td><td>Page <a href="#page-5"> 5 </a></td></tr><tr><td>Item 7A.</td><td>Market Risk</td><td>None</td></tr>"""
    body = page(1, "first of one", "second of one") + page(3, "risks") + "stray text" + page(5, "estimates")
    made = indexed(spark, f"<html><body>{body}{INDEX.format(rows=rows)}</body></html>")
    assert made == {"1": "<p>first of one</p><p>second of one</p>", "1A": "<p>risks</p>", "7": "<p>estimates</p>"}


ROWS = '<tr><td>Item 1.</td><td>Page <a href="#a">1</a></td></tr><tr><td>Item 2.</td><td>Pages <a href="#b">2</a>, <a href="#c">4</a></td></tr>'


def test_index_is_found_from_the_last_heading_that_has_one(spark):
    """Later mentions without a table, five other tables after one, a table of one item."""
    body = '<a id="a"></a><p>A</p><hr style="page-break-before:always"><a id="b"></a><p>B</p><hr style="page-break-before:always"><hr style="page-break-before:always"><div><a id="c"></a><b>C</b></div><p>beside</p>'
    later = "<p>See the cross reference index above.</p>" + "<table><tr><td>x</td></tr></table>" * 3 + "<p>Cross-Reference Index</p><table><tr><td>Item Number</td></tr><tr><td>Item 9. only</td></tr></table>"
    assert indexed(spark, body + INDEX.format(rows=ROWS) + later) == {"1": "<p>A</p>", "2": "<p>B</p>\n<b>C</b>"}
    between = "<table><tr><td>y</td></tr></table>" * 5
    assert indexed(spark, body + "<p>cross-reference index</p>" + between + INDEX.format(rows=ROWS).replace("Cross-Reference Index", "Contents")) == {}
    assert indexed(spark, body + "<p>cross-reference index</p>" + between[: len(between) // 5 * 4] + INDEX.format(rows=ROWS).replace("Cross-Reference Index", "Contents")).keys() == {"1", "2"}
    assert indexed(spark, None) == {} == indexed(spark, "cross-reference index <table>")


def test_page_ranges_are_merged_by_their_ends():
    assert t._merged([(5, 6, "e"), (1, 2, "a"), (3, 3, "c"), (9, 3_000_000_000, "z"), (10, 12, "y")]) == [(1, 3, "a"), (5, 6, "e"), (9, 3_000_000_000, "z")]
    assert t._page_ranges("1, 3 - 5, x, 1 2-1 3, 9-8, 7") == [(1, 1), (3, 5), (12, 13), (7, 7)]


def test_index_pages_are_read_in_linear_time():
    """Twice the page takes about twice the time: many breaks, headings, open tags, stray end tags and a huge range."""
    import time

    def took(n):
        rows = "".join(f'<tr><td>Item {k % 20}.</td><td>Pages <a href="#p{k}">{k}</a> - 3000000000</td></tr>' for k in range(1, 21))
        body = "".join(f'<a id="p{k}"></a><p>text {k}<b>{"</i>" * 3}<hr style="page-break-after:always">' for k in range(n)) + "<div>" * n + "<p>cross-reference index</p>" * 50
        html = "<table><tr><td>no</td></tr></table>" * n + body.replace("<p>cross", "<p>Cross") + INDEX.format(rows=rows)
        began = time.perf_counter()
        found = t._indexed_items(html)
        return time.perf_counter() - began, found

    (small, _), (large, found) = min(took(2000) for _ in range(2)), took(8000)
    assert found and large < 4 * small * 2.5 + 0.5


def test_table_function_gives_the_same_chunks(spark):
    """In SQL, beside rows, against the column form: paragraphs, long ones, blank ones, other white space, and nothing."""
    import random

    from tesserae.functions import register

    rng = random.Random(4)
    texts = [None, "", " \n\n ", "x" * 95, "\u3000a\u2003\n\n\n\nb\x1c"]
    texts += ["".join(rng.choice(["word ", "\n\n", "\n", "é", "y" * rng.randrange(30), "\u00a0"]) for _ in range(rng.randrange(80))) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    register(spark)
    for size, overlap in ((40, 0), (40, 12), (7, 6)):
        want = {tuple(r) for r in frame.select("i", F.posexplode(t.chunks(F.col("text"), size, overlap))).collect()}
        got = {tuple(r) for r in spark.sql(f"select d.i, c.* from {{d}} as d, lateral chunk_table(d.text, {size}, {overlap}) as c", d=frame).collect()}
        assert got == want and len(want) > 60
    with pytest.raises(Exception, match="overlap must be smaller"):
        spark.sql("select * from chunk_table('x', 5, 5)").collect()


def test_chunk_table_equals_its_sql_on_odd_texts(spark, tmp_path):
    """Empty and blank texts are one empty chunk, null is none; other white space than blanks stays, at ends and where windows end."""
    import duckdb

    from conftest import rows_of
    from tesserae.plans import catalog

    rng = random.Random(4)
    texts = [None, "", "  ", " \n\n ", " " * 1500, "\u00a0\u3000", "\t", "a\r\nb\r\n", "\u3000a\u2003", "x" * 1000 + " ", "x" * 1001, "x" * 900 + " " * 3000 + "y", "w\t" * 2500, "a" * 800 + "\t" * 2200, "\x85\u00e9\x1c" * 700]
    texts += ["".join(rng.choice(["word ", "\n\n", "\t", "\u00e9\r", "y" * rng.randrange(400), "\u00a0", " " * rng.randrange(900)]) for _ in range(rng.randrange(30))) for _ in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    made = catalog.QUERIES["chunk_table"](spark, str(tmp_path)).toPandas()
    assert rows_of(made) == rows_of(db.execute(catalog.ORACLE_SQL["chunk_table"]).df())
    assert set(range(1, 5)) <= set(made.doc_id[made.chunk == ""]) and 0 not in set(made.doc_id)


def test_merged_ranges_with_equal_ranges(spark):
    """Equal ranges of a group are one island, in whatever order and partition they come; against a plain sweep."""
    rng = random.Random(4)
    rows = [(g, a, a + rng.randrange(3)) for g in range(200) for a in rng.choices(range(12), k=9)]
    rows += rng.sample(rows, 400)
    want = []
    for g in range(200):
        merged = []
        for a, b in sorted((a, b) for k, a, b in rows if k == g):
            if merged and a <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        want += [(g, *m) for m in merged]
    frame = spark.createDataFrame(rows, "k long, a long, b long")
    for n in (1, 7):
        assert sorted(map(tuple, t.merged_ranges(frame.repartition(n), "k", "a", "b").collect())) == sorted(want)


@pytest.mark.parametrize("name", ["filing", "article", "index", "discovery"])
def test_pages_are_parsed_once_and_in_small_batches(spark, name):
    """Whatever the session had: the rows of an Arrow batch are bounded, and a filter on what is parsed doesn't parse again."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    pages = spark.range(3).select(F.lit("https://blog.a.com/news").alias("url"), F.lit("<p>t</p>").alias("text"))
    if name == "discovery":
        found = discovery.classify(pages.withColumns({"final_url": F.col("url"), "status_code": F.lit(200), "content_type": F.lit("text/html"), "domain": F.lit("a.com")}))
        assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    else:
        made = {"filing": t.clean_filing_html, "article": t.article_text, "index": lambda x: t.in_small_batches(t.indexed_items, x)}[name]
        assert pages.select(made(F.col("text")).alias("x")).count() == 3
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512
