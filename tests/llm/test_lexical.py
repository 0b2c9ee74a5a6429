import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tesserae.llm import lexical

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(lexical.TERM, (text or "").translate(UPPER))


def plain(docs, items, k):
    """Each item's best k documents by scoring all."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    found = []
    for item, own in asked.items():
        scored = []
        for d, c in counts:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if s > 0:
                scored.append((-s, d is not None, d or 0))
        found += [(item, r, d if some else None, -s) for r, (s, some, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(found, key=lambda x: (str(x[0]), x[1]))


def asked_of(spark, docs, items, k):
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in lexical.ranked(d, i, k).collect()), key=lambda x: (str(x[0]), x[1]))


def test_terms():
    text = "Ab_c3 ÄÖ-x y\tZ\x7fq\x00w É" + "".join(map(chr, range(128)))
    assert [t.decode() for t in lexical.terms_of(text)] == terms(text) and lexical.terms_of(None) == []


def test_sums_of_bitmaps_and_the_best_of_them():
    rng = random.Random(1)
    numbers = [[rng.choice([0, rng.randrange(1 << 35)]) for _ in range(200)] for _ in range(6)]
    bits = lambda xs: [sum((x >> b & 1) << i for i, x in enumerate(xs)) for b in range(35)]
    total = []
    for xs in numbers:
        total = lexical.add(total, bits(xs))
    sums = [sum(xs) for xs in zip(*numbers, strict=True)]
    assert [sum((t >> i & 1) << b for b, t in enumerate(total)) for i in range(200)] == sums
    for k in (1, 5, 199, 200, 300):
        want = sorted(i for _, i in sorted((-s, i) for i, s in enumerate(sums) if s)[:k])
        assert lexical.slots_in(lexical.best(total, k)) == want
    assert lexical.slots_in(lexical.best(bits([7] * 9 + [0]), 4)) == [0, 1, 2, 3]  # ties: the lowest slots
    assert lexical.best([], 5) == 0


@pytest.mark.parametrize(("block", "postings"), [(8192, 1 << 21), (16, 1 << 21), (64, 40)])
def test_against_scoring_all(spark, monkeypatch, block, postings):
    """Whatever the blocks, results are those of a plain loop, ties and parts of blocks included."""
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "POSTINGS", postings)
    rng = random.Random(block)
    vocabulary = [f"w{i}" for i in range(30)] + ["Über", "naïve", "X9"]
    docs = [(i, " ".join(rng.choices(vocabulary, range(33, 0, -1), k=rng.randrange(0, 40)))) for i in range(300)]
    docs += [(i, "rare copy") for i in range(1000, 1080)]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices(vocabulary, k=5))) for i in range(12)] + [(50, "rare"), (51, "none here"), (52, "")]
    assert asked_of(spark, docs, items, 20) == plain(docs, items, 20)


def test_odd_rows(spark):
    docs = [(None, "alpha beta"), (1, "alpha beta"), (2, None), (3, ""), (4, "... !"), (5, "gamma " * 300_000 + "alpha"), (6, "beta"), (7, "delta"), (7, "delta eps"), (8, "delta eps")]
    items = [(None, "alpha"), (1, "alpha"), (1, "eps eps"), (2, None), (3, "...")]
    assert asked_of(spark, docs, items, 5) == plain(docs, items, 5)
    assert asked_of(spark, docs, [], 5) == [] == asked_of(spark, [], items, 5)
    frame = spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, TEXT string").withColumn("block", F.lit(1))
    assert lexical.ranked(frame, spark.createDataFrame([(1, "a")], "item_id long, text string")).columns == ["item_id", "rank", "doc_id", "score"]


def test_many_queries_are_taken_in_slices(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SLICE", 10)
    rng = random.Random(8)
    docs = [(i, " ".join(f"t{rng.randrange(20)}" for _ in range(8))) for i in range(60)]
    items = [(i, f"t{i % 20} t{(i * 7) % 20} t{(i * 3) % 20}") for i in range(25)]
    assert asked_of(spark, docs, items, 6) == plain(docs, items, 6)
