import random

import pytest
from pyspark.sql import functions as F

from tesserae.llm import common


@pytest.mark.parametrize("hot", [0, 900])
def test_lowest_rows_by_a_hash(spark, hot):
    """Those of one sort of all rows, also where a key has most of them."""
    rng = random.Random(1)
    rows = [(k, k) for k in range(3000)] + [(7, rng.random().__hash__() % 1000) for _ in range(hot)]
    frame = common.cut(spark.createDataFrame(rows, "k long, v long"), "lowest")
    for most in (0, 1, 50, 700, 2999, 5000):
        want = [tuple(r) for r in frame.orderBy(F.xxhash64("k"), "k", "v").limit(most).collect()]
        assert sorted(map(tuple, common.lowest(frame, most, "k", "v").collect())) == sorted(want)


def test_scratch_deletes_all_but_what_is_kept(spark):
    with common.scratch() as outer:
        with common.scratch() as kept:
            a, b = common.cut(spark.range(3), "a"), common.cut(spark.range(4), "b")
            kept.append(b)
        with pytest.raises(Exception):
            a.count()
        c = common.cut(spark.range(5), "c")
        outer.append(c)
        assert b.count() == 4
    with pytest.raises(Exception):
        b.count()
    assert c.count() == 5
    common.discard(c)


def test_columns_by_their_exact_names(spark):
    frame = spark.createDataFrame([(1, 2, 3)], "a int, A int, `a.b` int")
    assert tuple(common.picked(frame, "A", "a.b").first()) == (2, 3)
    assert common.picked(frame, "A.B").columns == ["A.B"]
