import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from tesserae.llm import winnow as w


def turned(x, by):
    return (x << by | x >> 64 - by) & (1 << 64) - 1 if by else x


def direct(words):
    """A gram's hash from its words alone, without rolling."""
    own = 0
    for j, x in enumerate(words):
        own ^= turned(xxhash.xxh64_intdigest(x.encode(), 42), w.K - 1 - j)
    return own - (1 << 64) if own >> 63 else own


def plain(text):
    """Selected (hash, position) pairs by a loop over windows."""
    lower = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x20\x09-\x0d]+", lower)
    grams = [(direct(words[i : i + w.K]), i) for i in range(max(len(words) - w.K + 1, 1) if words else 0)]
    out = []
    for j in range(max(len(grams) - w.WINDOW + 1, 1) if grams else 0):
        window = grams[j : j + w.WINDOW]
        least = min(h for h, _ in window)
        pick = (least, max(i for h, i in window if h == least))
        if not out or out[-1] != pick:
            out.append(pick)
    return out


def near(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return 1.0 if not a | b else len(a & b) / len(a | b)


def digest(picks):
    return hashlib.sha256(",".join(f"{h & (1 << 64) - 1:X}:{i}" for h, i in picks).encode()).hexdigest()


def test_rolled_hashes_are_the_direct_ones(spark):
    """Over many blocks, at their ends, and for texts of fewer words than a gram."""
    rng = random.Random(12)
    texts = [[f"v{rng.randrange(50)}" for _ in range(size)] for size in (0, 1, 4, 5, 6, 35, 36, 37, 38, 67, 68, 69, 400, 20_000)] + [["same"] * 300]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x array<string>")
    made = {r.i: r.g for r in frame.select("i", w.rolled(F.transform("x", lambda v: F.xxhash64(v))).alias("g")).collect()}
    for i, x in enumerate(texts):
        assert made[i] == [direct(x[k : k + w.K]) for k in range(max(len(x) - w.K + 1, 1) if x else 0)]


def test_query_against_loops(spark, tmp_path):
    rng = random.Random(6)
    texts = ["", None, "one", "a b c d", "a b c d e", "A B c d E", " ".join("x" for _ in range(50)), "é" * 5000, "日本 " * 333]
    texts += [" ".join(rng.choice(["ab", "Cd", "é", "x1"]) for _ in range(rng.randint(0, 300))) for _ in range(150)]
    ids = rng.sample(range(10**12), len(texts) - 1) + [None]
    docs = list(zip(ids, texts, strict=True))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    made = {r.doc_id: r for r in w.op9_winnowing(spark, str(tmp_path)).collect()}
    ordered = sorted(docs, key=lambda d: (d[0] is not None, d[0]))
    for (i, x), (_, y) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        x, y = x or "", y or ""
        half = len(x) // 2
        edited = x[: len(x) - half] + y[:half]
        want = (i, len(x), hashlib.sha256(edited.encode()).hexdigest(), digest(plain(x)), digest(plain(edited)), near(plain(x), plain(edited)), near(plain(x), plain(y)))
        assert tuple(made[i]) == want


def test_match_guarantee(spark):
    rng = random.Random(7)
    shared = [f"s{k}" for k in range(w.K + w.WINDOW - 1)]
    rows = [(" ".join([f"a{rng.random()}" for _ in range(rng.randint(0, 40))] + shared + ["z"]), " ".join(["b"] + shared + [f"c{rng.random()}" for _ in range(rng.randint(0, 40))])) for _ in range(40)]
    frame = spark.createDataFrame(rows, "a string, b string")
    both = frame.select(F.size(F.array_intersect(w.hashes(w.selected(F.col("a"))), w.hashes(w.selected(F.col("b"))))).alias("n"))
    assert both.where("n = 0").count() == 0


def test_clumped_and_repeated_ids(spark, tmp_path):
    docs = [(5, "a b c d e f"), (5, "a b c d e f"), (5, "g"), (10**15, "h i")] + [(k, "same text here for all") for k in range(100, 140)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = w.op9_winnowing(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs) and sum(r.near_next == 1.0 for r in rows) == 40
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none/documents.parquet"))
    assert w.op9_winnowing(spark, str(tmp_path / "none")).count() == 0


def test_common_ids_are_dealt_to_many_ranges(spark, tmp_path, monkeypatch):
    """Ids that hold a third or a twentieth of the rows, and as many rows without one: no range holds many, and each row's next is the right one."""
    monkeypatch.setattr(w, "ROWS_A_RANGE", 10)
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice(["ab", "Cd", "x1", "q", "zz"]) for _ in range(rng.randint(1, 30)))
    ids = [7 << 40] * 700 + [None] * 600 + [3] * 100 + [(7 << 40) + 1] * 100 + rng.sample(range(1 << 45), 500)
    docs = [(i, text()) for i in ids]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    ranged = w.by_range(frame)
    assert ranged.groupBy("_w_range").count().agg(F.max("count")).first()[0] < 60
    # ranges grow with the order of rows
    ordered = [r._w_range for r in ranged.orderBy(F.asc_nulls_first("doc_id"), "_w_mark", "text").collect()]
    assert ordered == sorted(ordered)
    key = lambda d: (d[0] is not None, d[0] or 0, xxhash.xxh64_intdigest(d[1].encode(), 42) & (1 << w.MARK_BITS) - 1, d[1].encode())
    want = sorted(docs, key=key)
    made = w.with_next(frame).select("doc_id", "text", "next_text", "fp", "next_fp").collect()
    assert sorted(((r.doc_id, r.text, r.next_text) for r in made), key=repr) == sorted(((i, x, y) for (i, x), (_, y) in zip(want, want[1:] + want[:1], strict=True)), key=repr)
    by_text = {r.text: r.fp for r in made}
    assert all(r.next_fp == by_text[r.next_text] for r in made)
