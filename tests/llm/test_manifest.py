import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tesserae.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes):
    """All levels of a tree, by the definition."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_path(levels, at):
    """Left and right siblings of a node, level by level."""
    found = []
    for nodes in levels[:-1]:
        run = at - at % 3
        found.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 3])))
        at //= 3
    return found


def plain(rows):
    """doc_id, leaf, subroot, proof and root of each row by whole trees."""
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append((row[0] is not None, row[0], leaf(row)))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain_tree([x[2] for x in sorted(by_source[s])]) for s in order]
    top = plain_tree([t[-1][0] for t in trees])
    found = []
    for k, s in enumerate(order):
        for at, (_, doc, own) in enumerate(sorted(by_source[s])):
            path = plain_path(trees[k], at) + plain_path(top, k)
            found.append((doc, own, trees[k][-1][0], "".join(a + b for a, b in path)))
    return found, top[-1][0]


def key(row):
    return tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in row)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 80, 81, 82, 243, 500, 729])
def test_traversal_gives_the_paths_of_the_whole_tree(n):
    leaves = [h(str(i)) for i in range(n)]
    levels = plain_tree(leaves)
    found = [list(zip(*x, strict=True)) for x in manifest.traverse(leaves, manifest.levels_of(n))]
    assert found == [plain_path(levels, at) for at in range(n)]
    assert manifest.block_root(leaves, manifest.levels_of(n)) == levels[-1][0]


def test_traversal_holds_few_nodes(monkeypatch):
    """Existing and desired subtrees hold 12 nodes each, whatever the block's size; nothing else is kept but open runs."""
    made = []

    class Counted(manifest.Stack):
        def __init__(self, low, top):
            super().__init__(low, top)
            made.append(self)

    monkeypatch.setattr(manifest, "Stack", Counted)
    leaves = [h(str(i)) for i in range(729)]
    for _ in manifest.traverse(leaves, 6):
        live = made[-12:]
        assert all(sum(map(len, s.kept)) <= 12 and all(len(x) <= 2 for x in s.open[:-1]) for s in live)


def test_blocks_and_tiers_against_whole_trees(spark, monkeypatch):
    """Blocks of nine leaves: one source of some hundred documents needs three tiers, and many sources a second tier at the top."""
    monkeypatch.setattr(manifest, "BLOCK_LEVELS", 2)
    monkeypatch.setattr(manifest, "BLOCK", 9)
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.9 else f"s{rng.randrange(14)}", rng.choice(["en", None]), rng.choice([None, i]), f"text {i}\nü") for i in range(500)]
    rng.shuffle(rows)
    found, root = manifest.manifest(spark.createDataFrame(rows, SCHEMA))
    proof = F.concat_ws("", F.transform(F.arrays_zip("lefts", "rights"), lambda x: F.concat(x["lefts"], x["rights"])))
    got = found.select("doc_id", "leaf", "subroot", proof.alias("p"), manifest.fold(F.col("leaf"), F.col("lefts"), F.col("rights")).alias("folded")).collect()
    want, want_root = plain(rows)
    assert root == want_root and sorted(tuple(r)[:4] for r in got) == sorted(want)
    assert {r.folded for r in got} == {root}


def test_nulls_ties_repeated_rows_and_names(spark):
    rows = [(None, None, None, None, None), (None, None, "", 0, ""), (5, None, "en", 3, "abc"), (5, None, "en", 3, "abc"), (5, None, "en", 3, "abd"), (7, "", "en", 1, "x" * 2_000_000), (8, "é", None, None, "-"), (9, "z", None, None, "0:")]
    frame = spark.createDataFrame(rows, SCHEMA).select("*", F.lit("other").alias("TEXT"), F.lit(1).alias("tree"), F.lit(2).alias("a.b"))
    found, root = manifest.manifest(frame)
    got = [(r.doc_id, r.leaf, r.subroot) for r in found.collect()]
    want, want_root = plain(rows)
    assert root == want_root and sorted(got, key=key) == sorted((w[:3] for w in want), key=key)
    assert leaf(rows[0]) != leaf(rows[1])


def test_lone_document_and_empty_table(spark):
    one = [(1, "s", "en", 1, "a")]
    found, root = manifest.manifest(spark.createDataFrame(one, SCHEMA))
    row = found.first()
    assert row.leaf == row.subroot == root and row.lefts == [] == row.rights
    found, root = manifest.manifest(spark.createDataFrame([], SCHEMA))
    assert root is None and found.count() == 0


def test_tampering_is_found(spark, tmp_path):
    """Only a text with line breaks and an even CRC of its id fails; all others are verified."""
    rows = [(i, f"s{i % 3}", "en", 5, [f"a\nb{i}", f"ab{i}", None][i % 3 if i % 2 else 0]) for i in range(60)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in manifest.op11_fractal_manifest(spark, str(tmp_path)).collect()}
    assert len(got) == 60
    for row in rows:
        broken = zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None and "\n" in row[4]
        assert got[row[0]].verified == (not broken) == (got[row[0]].folded_root == got[row[0]].root)
