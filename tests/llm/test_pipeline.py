"""run() against plain loops. The first stage's decisions are its own (its accuracy is tested elsewhere); the others are done again."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import tiktoken
from conftest import SF
from pyspark.sql import functions as F
from test_mixing import share_out
from test_near_dedup import brute, set_of, words_of

import corpus_pipeline
from tesserae.llm import byte_bpe, line_dedup


def without_boilerplate(docs):
    pages, on = Counter(d["source"] for d in docs), Counter()
    for d in docs:
        for line in {x.strip(" ") for x in (d["text"] or "").split("\n")} - {""}:
            on[d["source"], line] += 1
    drop = {k for k, n in on.items() if n >= line_dedup.LEAST_PAGES and n > line_dedup.RATIO * pages[k[0]]}
    for d in docs:
        lines = d["text"].split("\n")
        kept = [x for x in lines if x.strip(" ") == "" or (d["source"], x.strip(" ")) not in drop]
        d["text"] = "\n".join(kept)


def mixed(docs):
    size = {d["doc_id"]: len(words_of(d["text"])) for d in docs}
    totals = Counter()
    for d in docs:
        totals[d["source"]] += size[d["doc_id"]]
    target, line = share_out(totals), []
    key = lambda i: int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:15], 16)
    by_source = defaultdict(list)
    for d in docs:
        by_source[d["source"]].append(d["doc_id"])
    for source, ids in by_source.items():
        end = 0
        for i in sorted(ids, key=lambda i: (key(i), i)):
            end += size[i]
            if size[i] and target[source]:
                line += [((r * totals[source] + end) / target[source], key(i), i, size[i], r) for r in range(3)]
    taken, total = Counter(), 0
    for _, _, i, n, _ in sorted(line):
        total += n
        if total - n / 2 > sum(totals.values()):
            break
        taken[i] += 1
    return taken


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.keep_quality(spark, docs, SF)
    assert kept.columns == docs.columns
    left = [r.asDict() for r in kept.collect()]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i, x in labels.items() if x.quality == 1 and x.toxic == 0]
    assert sum(d["doc_id"] in set(good) for d in left) > 0.97 * len(good)
    without_boilerplate(left)
    alone = brute([(d["doc_id"], d["text"]) for d in left], corpus_pipeline.NEAR)
    left = [d for d in left if alone[d["doc_id"]][3]]
    copies = mixed(left)
    path, pattern = byte_bpe.production()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    want = Counter()
    for d in left:
        ids = own.encode_ordinary(d["text"])
        row = (d["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(d["text"].encode()).hexdigest())
        if copies[d["doc_id"]]:
            want[row] = copies[d["doc_id"]]
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == want


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, stage):
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (None, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c d e f", None, None, None), (None, "x", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    made = stage(spark, docs, SF)
    last = stage is corpus_pipeline.STAGES[-1][1]
    assert last or made.columns == docs.columns
    ids = sorted(r.doc_id or 0 for r in made.collect())
    if stage is corpus_pipeline.drop_near_duplicates:
        assert ids == [0, 0, 1, 2]
    empty = stage(spark, docs.limit(0), SF)
    assert empty.count() == 0
    assert empty.withColumn("x", F.lit(1)).columns[-1] == "x"


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]])
def test_stages_leave_further_columns_alone(spark, stage):
    """Columns named like the operators' own, in any case, come through unchanged."""
    names = ["keep", "P_ge1", "p_ge2", "Expected_Grade", "N_Lines", "n_dropped", "copies", "Size", "component_id", "rep", "a.b"]
    docs = spark.createDataFrame([(k, f"some words of text number {k} and more of it", "en", f"s{k % 2}", 40) for k in range(8)], "doc_id long, text string, lang string, source string, n_chars long")
    for c in names:
        docs = docs.withColumn(c, F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")))
    made = stage(spark, docs, SF)
    assert made.columns == docs.columns and made.count()
    for r in made.collect():
        assert [r[c] for c in names] == [f"{c} of {r.doc_id}" for c in names]


def test_near_dedup_stage_keeps_the_least_row_of_an_id(spark):
    """Rows of one id that differ, beside columns without an order or of odd names; a third of all rows are one id's."""
    rows = [(k if k % 3 else 0, f"words of text {k} that no other text has", "en", "s", k, f"x{k}", f"y{k}") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, _first string")
    docs = docs.withColumn("m", F.create_map(F.lit("k"), F.col("n_chars")))
    made = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert made.columns == docs.columns
    got = sorted((r.doc_id, r["a.b"], r._first, r.m["k"]) for r in made.collect())
    assert got == [(0, "x0", "y0", 0)] + [(k, f"x{k}", f"y{k}", k) for k in range(30) if k % 3]


def test_near_dedup_stage_links_from_80_percent(spark):
    """Against all pairs at 0.80, with many pairs between 0.80 and op4's 0.85."""
    rng = random.Random(21)
    docs = []
    for k in range(40):
        base = [f"v{rng.randrange(5000)}" for _ in range(104)]  # 100 shingles
        docs += [base, base + [f"t{k}x{i}" for i in range(14 + k % 15)]]  # similarity 100 / (100 + added): 0.78 to 0.88
    texts = [(i, " ".join(w)) for i, w in enumerate(docs)]
    sets = {i: set_of(x) for i, x in texts}
    shares = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, len(texts), 2)]
    assert sum(0.80 <= s < 0.85 for s in shares) >= 10 and sum(s < 0.80 for s in shares) >= 5 and shares.count(0.80) >= 1
    want = set(sets)
    for a in sets:
        want -= {b for b in sets if b > a and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    frame = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in texts], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame, SF).collect()} == want


def test_near_dedup_stage_keeps_no_two_equal_texts(spark):
    """An id with two versions, each copied under another id: the row that stays is the one of the group."""
    a, b = "a b c d e f g", "q r s t u v w x"
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in ((3, a), (5, a), (5, b), (6, b), (7, "own words of seven only"), (7, "own words of seven only"))], shape)
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()) == [(3, a), (7, "own words of seven only")]


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_take_very_long_texts(spark, stage):
    rows = [(1, "word " * 200_000, "en", "s", 1_000_000), (2, "x" * 1_000_000, "en", "s", 1_000_000), (3, "line\n" * 100_000, "en", "t", 500_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in stage(spark, docs, SF).select("doc_id").collect()} <= {1, 2, 3}
