import random
import re

import numpy as np

from tesserae.llm import near_dedup as n


def words_of(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def set_of(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs, threshold=85):
    """Components by comparing all pairs of full sets."""
    sets = {i: set_of(x) for i, x in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (i, len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(rng):
    vocabulary = [f"w{k}" for k in range(400)]
    docs, text = [], lambda size: [rng.choice(vocabulary) for _ in range(size)]
    shared = text(150)
    for k in range(60):
        docs.append(text(rng.choice([1, 3, 5, 40, 200])))
        docs.append(shared + text(rng.choice([20, 30, 40])))  # near the threshold, below or above
    chain = text(120)
    for k in range(80):  # a chain of near copies whose ends differ
        chain = list(chain)
        chain[rng.randrange(len(chain))] = rng.choice(vocabulary)
        docs.append(chain)
    docs += [docs[k] for k in range(0, 100, 3)] * 3
    return [(i, " ".join(w).replace("w1", "W1") if i % 2 else "\n".join(w)) for i, w in enumerate(docs)]


def test_against_all_pairs(spark):
    docs = corpus(random.Random(3)) + [(900, ""), (901, None), (902, "é É"), (903, "É é"), (904, "one"), (905, "ONE"), (906, "  \x0b\x0c ")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: tuple(r) for r in n.near_duplicates(frame).collect()} == brute(docs)


def test_blocks_give_all_pairs(spark, monkeypatch):
    """A bucket far over one block loses no link."""
    monkeypatch.setattr(n, "BLOCK", 8)
    docs = corpus(random.Random(4))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(n, "_most_shared", lambda members, to: members.select("rep", "rep").toDF("rep", "to").limit(0))
    assert {r.doc_id: tuple(r) for r in n.near_duplicates(frame).collect()} == brute(docs)


def test_edges(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (None, "alone here"), (5, "x"), (5, "x"), (5, "y z")]
    made = sorted((n_.doc_id or -1, n_.n_shingles, n_.component_id or -1, n_.kept) for n_ in n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert made == sorted([(-1, 2, 3, False), (3, 2, 3, True), (-1, 1, -1, True), (5, 1, 5, True), (5, 1, 5, True), (5, 1, 5, True)])
    assert n.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(5)
    for size in (1, 2, 7, 5000):
        h = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        assert n.sketch(h).max() < np.iinfo(np.uint64).max
    base = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    errors = []
    for share in (0.5, 0.8, 0.95):
        k = int(2000 * share)
        other = np.concatenate([base[:k], rng.integers(0, 2**63, 2000 - k, dtype=np.uint64)])
        with np.errstate(over="ignore"):
            errors.append((n.sketch(base) == n.sketch(other)).mean() - k / (4000 - k))
    assert max(map(abs, errors)) < 0.08


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(300, 340)]
    found = {r.id: r.component for r in n.components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert all(found[i] == 100 for i in range(100, 161)) and all(found[i] == 7 for i in [7, *range(300, 340)])


def test_hubs_are_split(spark, monkeypatch):
    """A text that is in hundreds of pairs is compared in shares; versions of one id count each."""
    monkeypatch.setattr(n, "BLOCK", 16)
    base = [f"b{k}" for k in range(100)]
    docs = [(1, " ".join(base))] + [(10 + k, " ".join([*base[:90], *(f"x{k}y{i}" for i in range(k % 20))])) for k in range(150)] + [(7, "other words"), (7, " ".join(base))]
    pairs = [(1, 10 + k) for k in range(150)] + [(7, 10 + k) for k in range(150)] + [(1, 7)]
    made = n.confirmed(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(docs, "doc_id long, text string"))
    sets = {}
    for i, x in docs:
        sets.setdefault(i, []).append(set_of(x))
    want = {(a, b) for a, b in pairs if any(100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b])}
    assert {tuple(r) for r in made.collect()} == want and 1 < len(want) < len(pairs)


def test_versions_of_an_id_are_of_one_component(spark, monkeypatch):
    """Rows of one id link the classes of all its versions, however far apart; against a plain union of classes."""
    a, b = "a b c d e f g", "q r s t u v w x"
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    made = {(r.doc_id, r.component_id) for r in n.near_duplicates(frame([(3, a), (5, a), (5, b), (6, b)])).collect()}
    assert made == {(3, 3), (5, 3), (6, 3)}
    made = sorted((r.doc_id, r.n_shingles, r.component_id) for r in n.near_duplicates(frame([(5, ""), (5, a), (3, a), (5, None)])).collect())
    assert made == [(3, 3, 3), (5, 0, 5), (5, 0, 5), (5, 3, 3)]
    rng = random.Random(17)
    texts = [" ".join(f"t{k}w{i}" for i in range(8)) for k in range(40)]
    rows = [(rng.randrange(60), rng.choice(texts)) for _ in range(90)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i, x in rows:
        root[find(x)] = find(i)
    least = {}
    for i, _ in rows:
        least[find(i)] = min(i, least.get(find(i), i))
    assert {(r.doc_id, r.component_id) for r in n.near_duplicates(frame(rows)).collect()} == {(i, least[find(i)]) for i, _ in rows}


def test_very_long_texts(spark):
    base = " ".join(f"w{k}" for k in range(200_000))
    docs = [(1, base), (2, base + " end"), (3, "w" * 1_000_000), (4, base[: len(base) // 2])]
    assert {r.doc_id: tuple(r) for r in n.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == brute(docs)


def test_tables_of_a_run_are_deleted(spark):
    from pathlib import Path

    from tesserae.llm.common import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    assert n.near_duplicates(spark.createDataFrame(corpus(random.Random(3)), "doc_id long, text string")).count()
    assert sorted(p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before) == ["near-named", "near-sketches"]
