"""Registered queries read texts to their ends."""

from tesserae.plans import catalog


def test_local_plans_read_whole_texts(spark, tmp_path):
    rows = [(11, 0, "user", "filler words " * 300 + "in 2021 or 2022"), (11, 3, "user", "short")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    made = {r.turn: r for r in catalog.QUERIES["local_plans"](spark, str(tmp_path)).collect()}
    assert made[0].time_scope == "specific_years" and made[0].years == "2021,2022"


def test_normalize_url_keeps_long_urls(spark, tmp_path):
    url = "https://example.com/" + "a" * 3000 + "?q=" + "b" * 2000
    spark.createDataFrame([(1, url, "")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert [tuple(r) for r in catalog.QUERIES["normalize_url"](spark, str(tmp_path)).collect()] == [(1, url)]
