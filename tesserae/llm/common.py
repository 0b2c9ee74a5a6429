"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import bounded_batches, shared_dir  # noqa: F401

#: A word is a maximal run of bytes other than space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII letters only: other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts the lineage and survives lost executors; a later join on the result plans
    from its true size, so Spark's own size checks choose between broadcast and sort-merge.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._cut_to = path
    if _open:
        _open[-1].append(made)
    return made


_open: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables that are cut() inside are deleted at the end, but for those put into the list: what is returned still reads these."""
    kept: list[DataFrame] = []
    _open.append([])
    try:
        yield kept
    finally:
        discard(*(df for df in _open.pop() if not any(df is k for k in kept)))
        if _open:
            _open[-1].extend(kept)


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote, once all that was made of them is written as well."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def named(*columns: str):
    """Columns by their exact names, whatever marks these hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in columns]


def picked(df: DataFrame, *columns: str) -> DataFrame:
    """These columns by their exact names, though others may differ from them in case only; without an exact one, in any case."""
    places, lower = df.toDF(*(f"c{i}" for i in range(len(df.columns)))), [c.lower() for c in df.columns]
    at = lambda c: df.columns.index(c) if c in df.columns else lower.index(c.lower())
    return places.select(*(F.col(f"c{at(c)}").alias(c) for c in columns))


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow by the places of columns: their names may hold dots, which mapInArrow itself doesn't take."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, schema)


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


def lowest(rows: DataFrame, most: int, key: str, *order: str) -> DataFrame:
    """The `most` rows with the lowest 64-bit hashes of the column key, ties in this order of columns; all, if they are fewer. rows is a written table.

    A share of the range of hashes is cut off first, so that what is sorted is not `most` rows of every task but little more than `most` in all.
    """
    n, mark = rows.count(), F.xxhash64(key)
    share = 1.0 if n <= most else min(1.0, (most + 8 * most**0.5 + 64) / n)
    found = rows
    while share < 1.0:
        found = rows.where(mark < F.lit(int(share * 2**64) - 2**63))
        if found.count() >= most:
            break
        found, share = rows, 2 * share  # many rows of few keys
    return found.orderBy(mark, key, *order).limit(most)


#: Rows of a few short columns that may be broadcast: under 100 MB.
MAX_BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """df, a written table of a few short columns, with a broadcast hint if its rows are proven few; else the join shuffles."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df
