"""A training-corpus pipeline: five stages, each on all that the one before kept.

Rejects go, boilerplate lines go, one document of each near-duplicate group stays, sources are mixed
to target weights, and what is left is encoded to token ids. Each stage takes (spark, docs, sf_dir)
with docs in the columns of `documents`, and all but the last return these columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import byte_bpe, line_dedup, mixing, near_dedup, quality
from tesserae.llm.common import cut, named, small, table

#: Percent of shared five-word shingles from which the near-dedup stage takes two documents as near-duplicates (op4's contract has its own).
NEAR = 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It is fitted on the rated ones among docs.

    Rows without an id or text are scored like any other; repeated rows stay or go together; without
    usable ratings all stay; columns stay as they are, whatever their names.
    """
    return quality.classify(docs, table(spark, sf_dir, "labels"), "_quality_").where("_quality_keep").select(*named(*docs.columns))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; n_chars follows the text. All documents stay.

    Null texts stay null, with null n_chars; repeated rows stay repeated; further columns stay as they are.
    """
    cleaned = line_dedup.cleaned(docs, host="source")
    return cleaned.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else named(c)[0] for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id. Of rows with one id one stays; rows without an id stay."""
    kept = near_dedup.near_duplicates(docs, NEAR).where("kept and doc_id is not null").select("doc_id").distinct()
    kept = cut(kept, "pipeline-kept")
    ids = docs.where("doc_id is not null").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("d")).first()
    none = docs.where("doc_id is null")
    if ids["n"] > ids["d"]:
        # the least row of an id, taken in the map tasks first: one id may have very many rows; maps have no order
        ordered = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
        least = F.min_by(F.struct(*named(*docs.columns)), F.struct(*named(*ordered)))
        docs = docs.where("doc_id is not null").groupBy("doc_id").agg(least.alias("_row")).select("_row.*")
    return docs.join(small(kept), "doc_id", "left_semi").unionByName(none)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all if they have no words, up to three times otherwise.

    Rows without an id are documents each; columns stay as they are.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row; a null text counts as empty, repeated rows stay repeated, further columns go."""
    return byte_bpe.digests(docs, *byte_bpe.production())


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_boilerplate),
    ("near-dedup", drop_near_duplicates),
    ("mix", mix_sources),
    ("byte-level BPE", encode),
]

#: SQL can't express the fitted classifier; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
