"""The table of vectors: one row an id, exchanged by owner.

An owner is what is indexed as a whole, a filing or a document. Indexing some owners commits their
vectors and the list of these owners, which hides what they had before; so a batch writes bytes in proportion to
itself, and a search scans the base and what was added, without a shuffle: hidden owners are left out
by a join with their list alone. compact() makes one base, ordered by corpus, ticker and owner, so
that a search for a ticker reads few parts of few files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dml, vectors
from .store import Change, Store

SHAPE = (
    "id string, vector array<float>, owner string, chunk_id long, document_chunk_id long, document_id long, filing_id long, ticker string, cik string, company_name string, accession_number string, filing_date string, "
    "period_of_report string, form_type string, section_id string, section_title string, source_id long, source_name string, source_type string, ownership string, trust_level string, url string, title string, author string, "
    "published_at string, fetched_at timestamp, document_type string, text string, chunk_index int, embedding_model string, collection string, chunk_source string"
)
OWNER = ("chunk_source", "owner")


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str, collection: str, size: int = vectors.DIMENSIONS):
        self.spark, self.collection, self.size = spark, collection, size
        self.store = Store(spark, path, {collection: SHAPE}, {collection: ("chunk_source", "ticker", "owner")})

    def exists(self) -> bool:
        return self.store.version(self.collection) > 0

    def version(self) -> int:
        return self.store.version(self.collection)

    def read(self) -> DataFrame:
        return self.store.read(self.collection)

    def ids_of(self, chunk_source: str, owner: str) -> DataFrame:
        """Ids of one filing (its accession number) or document (its id)."""
        return self.read().where((F.col("chunk_source") == chunk_source) & (F.col("owner") == owner)).select("id")

    def points(self) -> DataFrame:
        """chunk_source and n, the number of vectors, of each corpus."""
        return self.read().groupBy("chunk_source").agg(F.count(F.lit(1)).alias("n"))

    def ensure(self) -> None:
        """Stored vectors of another size than this model's raise."""
        stored = self.read().select(F.size("vector").alias("n")).first()
        if stored and stored["n"] != self.size:
            # Fixed value: the message.
            raise ValueError(f"Collection {self.collection!r} has vector size {stored['n']}, but the model produces {self.size}")

    def replace(self, chunk_source: str, rows: DataFrame, owners: DataFrame) -> None:
        """Exchange the vectors of owners(owner) for rows(id, vector, owner, ...). Raises, with nothing changed, unless exactly rows' ids were written, once each, and all are of these owners."""
        self.ensure()
        named = {"collection": F.lit(self.collection), "chunk_source": F.lit(chunk_source)}
        empty = self.spark.createDataFrame([], SHAPE)
        given = rows.withColumns(named)
        checked = vectors.check_dimensions(given, self.size)
        made = self.store.kept(empty.unionByName(checked.select(*(c for c in empty.columns if c in checked.columns)), allowMissingColumns=True))
        owners = self.store.kept(owners.select("owner").distinct().withColumn("chunk_source", F.lit(chunk_source)))
        try:
            wrong = dml.id_differences(made.select("id"), given.select("id")).count()
            twice = made.groupBy("id").count().where("count > 1").count()
            strange = made.join(owners, "owner", "left_anti").count()
            if wrong or twice or strange:
                raise RuntimeError(f"Vector verification failed: {wrong} ids differ, {twice} occur twice, {strange} are of other owners")
            if not owners.isEmpty():
                self.store.commit(self.collection, lambda _: Change(made, by=OWNER, keys=owners))
        finally:
            self.store.done(made, owners)

    def compact(self) -> None:
        self.store.compact(self.collection)

    def vacuum(self) -> None:
        self.store.vacuum(self.collection)
