"""Keyed merges, child replacement and state changes, each over whole sets of rows.

Tables are immutable DataFrames: an operation returns the table's next version, which
tesserae.sources.store writes beside the last one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What columns may hold.
DOMAINS = {
    "status": ("pending", "indexing", "ready", "failed"),
    "source_type": ("company_blog", "newsroom", "investor_relations", "industry_blog", "news_feed", "sec", "webpage"),
    "ownership": ("official", "third_party", "unknown"),
    "trust_level": ("high", "medium", "low"),
    "discovery_status": ("candidate", "approved", "rejected", "manual"),
    "document_type": ("article", "blog_post", "press_release", "investor_update", "filing", "webpage"),
    "ingestion_status": ("running", "completed", "failed", "partial"),
    "query_status": ("running", "completed", "failed"),
}


def same_keys(left: str, right: str, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys))


def merge_upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], keep_if_null: Sequence[str] = ()) -> DataFrame:
    """current with incoming's rows by key: new keys are added, known ones overwritten, nulls included.

    Columns in keep_if_null, and those that incoming lacks, keep the current value where the new one is
    null. incoming has one row a key. One full join on the key; both sides are already one row a key.
    """
    joined = current.alias("c").join(incoming.withColumn("_new", F.lit(True)).alias("n"), same_keys("c", "n", keys), "full")

    def value(name: str) -> Column:
        if name not in incoming.columns:
            return F.col(f"c.{name}").alias(name)
        if name in keys or name in keep_if_null:
            return F.coalesce(f"n.{name}", f"c.{name}").alias(name)
        return F.when(F.col("_new"), F.col(f"n.{name}")).otherwise(F.col(f"c.{name}")).alias(name)

    return joined.select(*map(value, current.columns))


def one_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Of each key the row with the greatest values of `order`, then of its other columns; nulls are least.

    A maximum, taken in the map tasks first: a key may have very many rows.
    """
    rest = [c for c in rows.columns if c not in keys and c not in order]
    if not rest and not order:
        return rows.distinct()
    best = F.max(F.struct(*order, *rest)).alias("_best")
    return rows.groupBy(*keys).agg(best).select(*(F.col(c) if c in keys else F.col(f"_best.{c}") for c in rows.columns))


def replace_children(current: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """Children of every parent in incoming are exchanged for its rows; those of other parents stay."""
    rest = current.join(incoming.select(parent).distinct(), parent, "left_anti")
    return rest.unionByName(incoming, allowMissingColumns=True)


def reset_runs(runs: DataFrame, chunks: DataFrame, affected: DataFrame) -> DataFrame:
    """Embedding runs of the filings in affected(filing_id) set back to pending, expecting the chunks there are now."""
    counts = chunks.join(affected.select("filing_id").distinct(), "filing_id", "left_semi").groupBy("filing_id").agg(F.count(F.lit(1)).alias("_expected"))
    marked = affected.select("filing_id").distinct().join(counts, "filing_id", "left").withColumn("_hit", F.lit(True))
    joined = runs.join(marked, "filing_id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    changes = {
        "status": F.when(hit, "pending").otherwise(F.col("status")),
        "expected_point_count": F.when(hit, F.coalesce("_expected", F.lit(0))).otherwise(F.col("expected_point_count")),
        "indexed_point_count": F.when(hit, 0).otherwise(F.col("indexed_point_count")),
        **{c: F.when(~hit, F.col(c)) for c in ("error_message", "started_at", "completed_at") if c in runs.columns},
    }
    return joined.withColumns(changes).select(*runs.columns)


def set_run_status(runs: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Runs with the status, counts and error of changes(filing_id, embedding_model, vector_collection, ...).

    Only `indexing` sets the start; `ready` and `failed` set the end, all else clears it.
    """
    keys = ["filing_id", "embedding_model", "vector_collection"]
    merged = merge_upsert(runs, checked(changes, "status", DOMAINS["status"]), keys, ["expected_point_count", "indexed_point_count"])
    hit = changes.select(*keys).withColumn("_hit", F.lit(True))
    merged = merged.join(hit, keys, "left")
    start = F.when(F.col("_hit") & (F.col("status") == "indexing"), now).otherwise(F.col("started_at"))
    end = F.when(F.col("_hit").isNull(), F.col("completed_at")).when(F.col("status").isin("ready", "failed"), now)
    return merged.withColumns({"started_at": start, "completed_at": end}).select(*runs.columns)


def set_run_progress(runs: DataFrame, progress: DataFrame) -> DataFrame:
    """Indexed counts of progress(filing_id, embedding_model, vector_collection, indexed_point_count), for runs that are indexing."""
    keys = ["filing_id", "embedding_model", "vector_collection"]
    joined = runs.join(progress.withColumnRenamed("indexed_point_count", "_n"), keys, "left")
    n = F.when((F.col("status") == "indexing") & F.col("_n").isNotNull(), F.col("_n")).otherwise(F.col("indexed_point_count"))
    return joined.withColumn("indexed_point_count", n).select(*runs.columns)


def delete_cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children without those in gone(key)."""
    gone = gone.select(key).distinct()
    return parents.join(gone, key, "left_anti"), children.join(gone.withColumnRenamed(key, foreign), foreign, "left_anti")


def set_null_reference(rows: DataFrame, gone: DataFrame, key: str, foreign: str) -> DataFrame:
    marked = gone.select(F.col(key).alias(foreign)).distinct().withColumn("_gone", F.lit(True))
    return rows.join(marked, foreign, "left").withColumn(foreign, F.when(F.col("_gone").isNull(), F.col(foreign))).select(*rows.columns)


def decide_sources(sources: DataFrame, ids: Sequence[int], approve: bool) -> DataFrame:
    """Sources approved and enabled, or rejected and disabled; unknown ids change nothing."""
    hit = F.col("id").isin(*ids)
    status, enabled = ("approved", True) if approve else ("rejected", False)
    return sources.withColumns({"discovery_status": F.when(hit, status).otherwise(F.col("discovery_status")), "enabled": F.when(hit, enabled).otherwise(F.col("enabled"))})


def obsolete_ids(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Ids of stored(id) that current(id) lacks."""
    return stored.select("id").distinct().join(current.select("id"), "id", "left_anti")


def id_differences(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """Ids on one side only, with the side: empty if and only if the sets are equal."""
    only = lambda a, b, side: obsolete_ids(a, b).withColumn("side", F.lit(side))
    return only(stored, expected, "stored").unionByName(only(expected, stored, "expected"))


def count_mismatches(source: DataFrame, target: DataFrame) -> DataFrame:
    """Tables whose counts differ, from two frames (table, n)."""
    joined = source.alias("s").join(target.alias("t"), "table", "full").select("table", F.col("s.n").alias("source_n"), F.col("t.n").alias("target_n"))
    return joined.where(~F.col("source_n").eqNullSafe(F.col("target_n")))


def count_message(wrong: Sequence[tuple[str, int | None, int | None]]) -> str:
    # Fixed value: how tables whose counts differ are told.
    return "Migration row-count validation failed: " + "; ".join(f"{t}: source={a or 0} target={b or 0}" for t, a, b in wrong)


def reset_filing_index(runs: DataFrame, chunks: DataFrame, records: DataFrame, model: str, collection: str) -> tuple[DataFrame, DataFrame]:
    """Runs and records of a filing index that is built anew: its runs pending, expecting the chunks there are; its records gone."""
    here = (F.col("embedding_model") == model) & (F.col("vector_collection") == collection)
    own = runs.where(here)
    return reset_runs(own, chunks, own).unionByName(runs.where(~here)), without_records(records, model, collection)


def without_records(records: DataFrame, model: str, collection: str) -> DataFrame:
    """Embedding records without those of one model and collection."""
    return records.where(~((F.col("embedding_model") == model) & (F.col("vector_collection") == collection)))


def replace_vectors(stored: DataFrame, incoming: DataFrame, owners: DataFrame) -> DataFrame:
    """Vectors of owners(owner) exchanged for incoming's; an owner without incoming rows loses all of its own."""
    return stored.join(owners.select("owner").distinct(), "owner", "left_anti").unionByName(incoming, allowMissingColumns=True)


def checked(rows: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """rows, of which one with another value raises when it is read."""
    # Fixed value: the message.
    message = F.concat(F.lit(f"Invalid {column}: "), F.coalesce(F.col(column), F.lit("null")), F.lit(f". Allowed values: {', '.join(sorted(allowed))}"))
    return rows.withColumn(column, F.when(F.col(column).isin(*allowed), F.col(column)).otherwise(F.raise_error(message)))


def quarantine(rows: DataFrame) -> DataFrame:
    """rows with `faults`: the columns whose values are outside their domain, and scores outside 0 to 1."""
    tests = [F.when(~F.coalesce(F.col(c).isin(*v), F.lit(False)), c) for c, v in DOMAINS.items() if c in rows.columns]
    if "confidence_score" in rows.columns:
        tests.append(F.when(~F.coalesce(F.col("confidence_score").between(0, 1), F.lit(True)), "confidence_score"))
    return rows.withColumn("faults", F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>"))


def numbered(rows: DataFrame, order: Sequence[str], start: int = 1) -> DataFrame:
    """rows with an `id` from start in a total order: one window, so for the few rows that one person or cycle adds. Store.numbered takes any number."""
    return rows.withColumn("id", (F.row_number().over(Window.orderBy(*order)) + (start - 1)).cast("long"))


def open_runs(current: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """current with rows added as running, under the next ids in the rows' order of columns."""
    first = (current.agg(F.max("id")).first()[0] or 0) + 1
    new = numbered(rows, rows.columns, first).withColumn("status", F.lit("running")).withColumn("started_at", now)
    return current.unionByName(new, allowMissingColumns=True).select(*current.columns)


def finish_runs(current: DataFrame, changes: DataFrame, allowed: Sequence[str], now: Column) -> DataFrame:
    """Runs of changes(id, status, ...) ended; given values that are not null go over stored ones. An unknown id or status raises."""
    missing = obsolete_ids(changes, current).limit(5).collect()
    if missing:
        raise RuntimeError(f"no run has the id {', '.join(str(r['id']) for r in missing)}")
    given = [c for c in changes.columns if c != "id"]
    ended = checked(changes, "status", allowed).withColumn("completed_at", now)
    return merge_upsert(current, ended, ["id"], given)


def upsert_sessions(current: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Sessions by session_key: new ones added; title and metadata changed only where they are given and differ."""
    joined = current.alias("c").join(incoming.alias("n"), "session_key", "full")
    first = (current.agg(F.max("id")).first()[0] or 0) + 1
    value = {c: F.coalesce(F.col(f"n.{c}"), F.col(f"c.{c}")) for c in ("title", "metadata_json")}
    changed = F.col("c.id").isNull()
    for c, v in value.items():
        changed = changed | ~v.eqNullSafe(F.col(f"c.{c}"))
    out = joined.select(F.col("c.id").alias("id"), "session_key", *(v.alias(c) for c, v in value.items()), F.coalesce("c.created_at", now).alias("created_at"), F.when(changed, now).otherwise(F.col("c.updated_at")).alias("updated_at"))
    new = numbered(out.where("id is null").drop("id"), ["session_key"], first)
    return out.where("id is not null").unionByName(new).select(*current.columns)
