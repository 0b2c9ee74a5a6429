import hashlib
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tesserae.llm import mixing as m


def share_out(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, target, free = sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    left = total
    while free:
        whole = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / whole > 3 * sizes[s]}
        if not over:
            for s in free:
                target[s] = left * weight[s] / whole
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def brute(docs):
    """The queue as one sorted list."""
    sizes = Counter()
    for _, source, size in docs:
        sizes[source] += size
    target = share_out(sizes)
    key = lambda d: int(hashlib.md5(f"mix:{'' if d[0] is None else d[0]}".encode()).hexdigest()[:15], 16)
    queues = defaultdict(list)
    for d in docs:
        queues[d[1]].append(d)
    line = []
    for source, own in queues.items():
        end = 0
        for d in sorted(own, key=lambda d: (key(d), -1 if d[0] is None else d[0], d[2])):
            end += d[2]
            if target[source] and d[2]:
                line += [((r * sizes[source] + end) / target[source], key(d), -1 if d[0] is None else d[0], d[2], r, d) for r in range(3)]
    taken, total, budget = Counter(), 0, sum(sizes.values())
    for *_, d in sorted(line, key=lambda x: x[:5]):
        total += d[2]
        if total - d[2] / 2 > budget:
            break
        taken[d] += 1
    return {d: (sizes[d[1]], target[d[1]], d[2] * taken[d]) for d in docs}


def run(spark, docs):
    frame = spark.createDataFrame(docs, "id long, source string, size long")
    return {(r.id, r.source, r.size): (r.source_size, r.target, r.size * r.copies) for r in m.mix(frame).collect()}


def test_against_one_sorted_list(spark):
    rng = random.Random(8)
    docs = [(k, rng.choice(["a", "b", "c", "hot", "hot", "hot", None, "é"]), rng.choice([0, 1, 5, 30, 400])) for k in range(400)] + [(1000, "tiny", 3), (None, "b", 7)]
    made, want = run(spark, docs), brute(docs)
    assert made.keys() == want.keys()
    for d in want:
        assert made[d][0] == want[d][0] and abs(made[d][1] - want[d][1]) < 1e-6 and made[d][2] == want[d][2]
    for source in {d[1] for d in docs}:
        got = sum(v[2] for d, v in made.items() if d[1] == source)
        assert abs(got - share_out_of(docs, source)) <= 800
    assert all(v[2] <= 3 * d[2] for d, v in made.items())


def share_out_of(docs, source):
    sizes = Counter()
    for _, s, size in docs:
        sizes[s] += size
    return share_out(sizes)[source]


def test_edges(spark):
    assert run(spark, [(1, "a", 0), (2, None, 0)]) == {(1, "a", 0): (0, 0.0, 0), (2, None, 0): (0, 0.0, 0)}
    assert run(spark, [(1, "a", 10)]) == {(1, "a", 10): (10, 10.0, 10)}
    assert m.mix(spark.createDataFrame([], "id long, source string, size long")).count() == 0


def test_mixed_documents_repeat(spark):
    docs = [(k, "x " * 10, "a" if k % 10 else "b", 1) for k in range(100)] + [(None, None, "a", 2), (7, "x " * 10, "a", 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, _mix long")
    mixed = m.mixed_documents(frame)
    assert mixed.columns == frame.columns
    counts = {r.source: r.n for r in mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert abs(counts["b"] - 28.9) <= 1 and abs(counts["a"] - 72.1) <= 2 and mixed.where("doc_id is null").count() == 0


def test_rows_of_one_id_are_taken_one_by_one(spark):
    """Rows equal in id, source and size of which some are taken once more than others: the sum is the mix's."""
    docs = [(5, f"{k} " * 4, "a", 1) for k in range(7)] + [(None, "n " * 4, "a", 1)] * 9 + [(100 + k, "y", "b", 1) for k in range(150)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, Copies long").withColumn("a.b", F.lit(1))
    sizes = frame.select(F.col("doc_id").alias("id"), "source", m.words(F.col("text")).alias("size"))
    want = {(r.id, r.source): r.n for r in m.mix(sizes).groupBy("id", "source").agg(F.sum("copies").alias("n")).where("n > 0").collect()}
    copies = {(r.id, r.c) for r in m.mix(sizes).select("id", F.col("copies").alias("c")).collect()}
    assert len({c for i, c in copies if i == 5}) == 2 or len({c for i, c in copies if i is None}) == 2
    mixed = m.mixed_documents(frame)
    assert mixed.columns == frame.columns
    assert {(r.doc_id, r.source): r.n for r in mixed.groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("n")).collect()} == want


def test_hot_and_missing_ids_are_counted_together(spark):
    """Rows equal in id, source and size are one row until ends are known; ends are those of a plain queue."""
    from tesserae.llm import mixing

    rows = [(None, "s", 3)] * 200 + [(None, "s", 5)] * 50 + [(4, "s", 2)] * 100 + [(k, "s", 1 + k % 4) for k in range(50)] + [(k, None, 7) for k in range(20)]
    queued = mixing.queue(spark.createDataFrame(rows, "id long, source string, size long"))
    assert queued.count() == len(rows)
    for source in ("s", None):
        own = sorted((r.hash, r.id is not None, r.id or 0, r.size, r.end) for r in queued.where(F.col("source").eqNullSafe(F.lit(source))).collect())
        end = 0
        for *_, size, at in own:
            end += size
            assert at == end
