import random
import re

import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from tesserae.llm import rule_forest
from tesserae.llm.common import WORD, table


def plain_counts(text):
    """The five counts by their definitions."""
    text = text or ""
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_counts_against_their_definitions():
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a", "é ü x y", "a b c d e f g h " * 2, "x " * 30, "a\n a\na\n\n \na\r\na\r", "#*$%&|<> ^"]
    texts += [" ".join(rng.choice(["p", "q", "r\n"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    for t in texts:
        assert rule_forest.statistics(t)[:5] == plain_counts(t), t


def test_query_has_the_counts_and_rules_of_all_documents(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    got = rule_forest.op12_rule_forest(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        want = plain_counts(docs[r.doc_id])
        assert tuple(r)[1:6] == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)


def plain_path(tree, row, at=0):
    by, split, left, path = tree
    return path[at] if left[at] == at else plain_path(tree, row, left[at] + (row[by[at]] > split[at]))


def test_paths_scores_and_trees():
    rng = np.random.default_rng(5)
    rows = np.vstack([rng.normal(0, 1, (300, 3)), [[9, 9, 9], [0, -8, 0]], np.zeros((40, 3))])
    forest = rule_forest.Forest(rows, trees=50, sample=64, seed=1)
    paths = forest.paths(rows)
    assert all(paths[i, k] == plain_path(forest.trees[k], rows[i]) for i in range(0, len(rows), 17) for k in range(50))
    # the size of a tree's leaves adds up to the sample: each fitted row ends in one of them
    assert all(plain_path(t, rows[i]) <= forest.depth + rule_forest.expected(64) for t, s in zip(forest.trees, forest.seen, strict=True) for i in s[:5])
    scores = forest.scores(rows)
    assert scores[300] > np.percentile(scores[:300], 99)
    held_out = forest.scores(rows, np.arange(len(rows)))
    for i in (0, 300):
        unseen = [k for k in range(50) if i not in forest.seen[k]]
        assert abs(held_out[i] - 2 ** (-paths[i, unseen].mean() / forest.norm)) < 1e-12
    assert (rule_forest.Forest(rows, trees=50, sample=64, seed=1).paths(rows) == paths).all()  # reruns agree
    assert rule_forest.expected(2) == 1 and rule_forest.expected(1) == 0


def test_threshold_is_the_best_of_all():
    rng = np.random.default_rng(6)
    for _ in range(20):
        good = rng.random(60) < 0.8
        scores = np.round(rng.random(60) * 0.4 + (~good) * 0.3, 2)
        gain = lambda t: (scores[~good] > t).sum() / max(1, (~good).sum()) - 5 * (scores[good] > t).sum() / good.sum()  # noqa: B023, E731
        found = rule_forest.threshold(scores, good, 5)
        assert gain(found) >= max(0, *(gain(t) for t in np.r_[scores - 1e-9, scores])) - 1e-12


def held_out(spark, sf):
    """Shares of unseen bad and good rows that pass the rules and are dropped, the forest fitted on half of the labels."""
    labels = table(spark, sf, "labels").withColumn("half", F.pmod(F.hash("doc_id"), F.lit(2)))
    made = rule_forest.judged(table(spark, sf, "documents"), labels.where("half = 0"))
    return {r.quality: r.dropped for r in made.where("not base_failed").join(labels.where("half = 1"), "doc_id").groupBy("quality").agg(F.avg((~F.col("kept")).cast("int")).alias("dropped")).collect()}


def test_unseen_junk_goes_and_good_documents_stay(spark):
    dropped = held_out(spark, "/root/testdata/sf0.1")
    assert dropped[0] > 0.9 and dropped[1] < 0.03


def test_odd_rows(spark):
    good = [(i, f"the quick brown fox number {i} jumps over lazy dogs. " * 1 + " ".join(f"w{(i * k) % 97}" for k in range(1, 40))) for i in range(60)]
    bad = [(100 + i, " ".join(f"w{(i * k) % 89}" + "#" * (3 + 2 * i) for k in range(1, 40))) for i in range(6)]
    odd = [(None, "few"), (None, None), (500, ""), (501, "x " * 400_000), (502, "y" * 1_000_000), (1, good[0][1]), (1, good[0][1])]
    frame = spark.createDataFrame(good + bad + odd, "doc_id long, text string").select("*", *(F.lit("old").alias(c) for c in ("KEPT", "n_words", "Text", "a.b")))
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(6)] + [(3, 1, None), (None, 0, 0), (9999, 0, 0), (4, None, 1), (5, 7, 0)]
    rated = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    made = [r for r in rule_forest.judged(frame, rated).collect()]
    assert len(made) == len(good + bad + odd)
    by_id = {r.doc_id: r for r in made}
    assert all(not r.kept and r.base_failed for r in made if r.doc_id in (None, 500, 501, 502))
    assert sum(by_id[i].kept for i in range(60)) >= 57 and sum(by_id[100 + i].kept for i in range(6)) == 0
    assert len({tuple(r) for r in made if r.doc_id == 1}) <= 2 and sum(r.doc_id == 1 for r in made) == 3
    for none in (rated.limit(0), rated.where("quality = 1")):
        assert all(r.kept != r.base_failed and r.anomaly is None for r in rule_forest.judged(frame, none).collect())
    assert rule_forest.judged(frame.limit(0), rated).count() == 0


def test_fit_is_of_all_labelled_rows(spark):
    """However many labelled rows: trees draw from all of them and all calibrate the threshold; against the same in one array."""
    rng = np.random.default_rng(8)
    good = rng.random(21_000) < 0.9
    values = np.where(good[:, None], rng.normal(0, 1, (21_000, 6)), rng.normal(2, 2, (21_000, 6))).round(3)
    rows = [(i, 100, 0, *map(float, v)) for i, v in enumerate(values)]
    columns = ", ".join(["doc_id long, n_words long, n_repeat_words long", *(f"{c} double" for c in rule_forest.SHARES)])
    stats = spark.createDataFrame(rows, columns)
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(good)], "doc_id long, quality int")
    forest, limit = rule_forest.fit(stats, labels)
    order = [r.doc_id for r in stats.select("doc_id").orderBy(F.xxhash64("doc_id")).collect()]
    want = rule_forest.Forest(values[order])
    assert max(s.max() for s in forest.seen) > 20_500
    assert all((a == b).all() for x, y in zip(forest.trees, want.trees, strict=True) for a, b in zip(x, y, strict=True))
    assert limit == rule_forest.threshold(want.scores(values[order], np.arange(21_000)), good[order])


def test_threshold_of_ranges(spark):
    rng = random.Random(3)
    for cost in (0, 1, 5):
        for odd in ([], [(0.5, True)] * 4 + [(0.5, False)], [(0.9, False)] * 3, [(0.1 * k, k > 5) for k in range(9)], [(rng.random().__round__(2), rng.random() < 0.6) for _ in range(500)]):
            if odd:
                scores, good = np.array([x for x, _ in odd]), np.array([g for _, g in odd])
                assert rule_forest.threshold_of(spark.createDataFrame(odd, "score double, good boolean"), cost) == rule_forest.threshold(scores, good, cost), (cost, odd[:9])
