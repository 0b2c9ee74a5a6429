"""A catalog of Parquet tables, each with a log of commits.

A commit writes its rows to a folder of its own and then claims the table's next version by making
that version's entry in the log, which succeeds only if there is none. A writer that comes second
reads the table again and repeats its change, so nothing is lost and no folder is written twice.

A table is its last base and what was committed since. Rows with new keys are only added. Rows that
take the place of known ones are added too, with the keys whose earlier rows they hide: by the table's key
or by an owner, as all chunks of a filing are exchanged at once. So a commit costs what its batch
costs, however large the table; a reader scans the base and leaves out what was hidden, by a join with
those keys alone. compact() makes one base of it all, in an order by which readers skip files, and
vacuum() deletes what no version needs. Versions are never changed: a reader sees whole ones only.

All files are read and written through Spark's file systems. A log entry is claimed by a link on local
disks and by a rename elsewhere, which HDFS refuses where the target exists; a store without such a
rename suits one writer at a time.
"""

from __future__ import annotations

import json
import os
import random
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import dml
from .schemas import CLUSTERED, KEYS, SCHEMAS, WITH_ID, WORKING

ATTEMPTS = 40  #: of a commit whose version another writer took
BROADCAST_BYTES = 16 << 20  #: of hidden keys, as their files measure, that are sent to all tasks
FILE_SCHEMES = ("file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss", "viewfs")


class Conflict(RuntimeError):
    """Other writers took every version that a commit tried for."""


@dataclass
class Change:
    """What a commit does: rows as the whole table (base), or rows to add; with `by`, earlier rows whose values of these columns are in keys are hidden."""

    rows: DataFrame | None
    base: bool = False
    by: tuple[str, ...] = ()
    keys: DataFrame | None = None


class Store:
    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str] | None = None, clustered: dict[str, Sequence[str]] | None = None):
        if "://" in root and root.split("://")[0] not in FILE_SCHEMES:
            raise ValueError(f"unknown store: {root}")
        self.spark, self.root, self.schemas, self.clustered = spark, root.rstrip("/"), schemas or SCHEMAS, clustered or CLUSTERED
        self._all_schemas = self.schemas | WORKING
        self._entries: dict[tuple[str, int], dict] = {}  # entries never change

    # --- files ----------------------------------------------------------------------------

    def _path(self, text: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(text)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _delete(self, text: str) -> None:
        fs, path = self._path(text)
        fs.delete(path, True)

    def _names(self, text: str) -> list[str]:
        fs, path = self._path(text)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _claim(self, name: str, version: int, entry: dict) -> bool:
        """Make the entry of a version, whole, if there is none."""
        fs, mark = self._path(f"{self.root}/{name}/log/{version:012d}")
        _, draft = self._path(f"{self.root}/{name}/drafts/{uuid.uuid4().hex}")
        text = json.dumps(entry).encode()
        if fs.getUri().getScheme() == "file":
            draft, mark = draft.toUri().getPath(), mark.toUri().getPath()
            os.makedirs(os.path.dirname(draft), exist_ok=True)
            os.makedirs(os.path.dirname(mark), exist_ok=True)
            with open(draft, "wb") as f:
                f.write(text)
            try:
                os.link(draft, mark)
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
            return True
        out = fs.create(draft, False)
        out.write(bytearray(text))
        out.close()
        fs.mkdirs(mark.getParent())
        made = not fs.exists(mark) and fs.rename(draft, mark)
        fs.delete(draft, False)
        return made

    def _entry(self, name: str, version: int) -> dict:
        if (name, version) not in self._entries:
            fs, path = self._path(f"{self.root}/{name}/log/{version:012d}")
            stream = fs.open(path)
            self._entries[name, version] = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
        return self._entries[name, version]

    def kept(self, rows: DataFrame) -> DataFrame:
        """rows, written beside the tables and read back; for what is used more than once. done() deletes it."""
        path = f"{self.root}/_work/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        made = self.spark.read.schema(rows.schema).parquet(path)
        made._kept_at = path
        return made

    def done(self, *made: DataFrame) -> None:
        for rows in made:
            self._delete(rows._kept_at)

    # --- versions -------------------------------------------------------------------------

    def versions(self, name: str) -> tuple[int, list[int]]:
        """The number of the last version, and the versions that make up the table: its last base and what was added since."""
        found = sorted((int(n) for n in self._names(f"{self.root}/{name}/log") if n.isdigit()), reverse=True)
        parts: list[int] = []
        for v in found:
            parts.append(v)
            if self._entry(name, v)["base"]:
                break
        return max(found, default=0), parts[::-1]

    def version(self, name: str) -> int:
        """The number of the last version; 0 if there is none."""
        return self.versions(name)[0]

    def read(self, name: str) -> DataFrame:
        """The table as of the last version; an empty one of the right schema before the first."""
        return self._read(name, self.versions(name)[1])

    def _read(self, name: str, parts: Sequence[int]) -> DataFrame:
        schema = self._all_schemas[name]
        parts = [v for v in parts if self._entry(name, v)["folder"]]
        if not parts:
            return self.spark.createDataFrame([], schema)
        folder = lambda v: f"{self.root}/{name}/data/{self._entry(name, v)['folder']}"
        read = lambda vs: self.spark.read.schema(schema).parquet(*(f"{folder(v)}/rows" for v in vs))
        hiding = [v for v in parts if self._entry(name, v)["by"]]
        if not hiding:
            return read(parts)
        # rows are tagged by the last hiding version before or with them; later ones may hide them
        ends = [0, *hiding, parts[-1] + 1]
        runs = [(low, [v for v in parts if low <= v < high]) for low, high in zip(ends, ends[1:], strict=False)]
        whole = None
        for tag, vs in runs:
            if vs:
                part = read(vs).withColumn("_tag", F.lit(tag))
                whole = part if whole is None else whole.unionByName(part)
        typed = self.spark.createDataFrame([], schema).schema
        for by in sorted({tuple(self._entry(name, v)["by"]) for v in hiding}):
            own = [v for v in hiding if tuple(self._entry(name, v)["by"]) == by]
            shape = ", ".join(f"{c} {typed[c].dataType.simpleString()}" for c in by)
            keys = None
            for v in own:
                more = self.spark.read.schema(shape).parquet(f"{folder(v)}/keys").withColumn("_hidden", F.lit(v))
                keys = more if keys is None else keys.unionByName(more)
            keys = keys.select("_hidden", *(F.col(c).alias(f"_by_{c}") for c in by))
            if sum(self._entry(name, v)["key_bytes"] for v in own) <= BROADCAST_BYTES:
                keys = F.broadcast(keys)
            same = F.lit(True)
            for c in by:
                same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
            whole = whole.join(keys, same & (F.col("_tag") < F.col("_hidden")), "left_anti")
        return whole.drop("_tag")

    # --- commits --------------------------------------------------------------------------

    def _staged(self, name: str, change: Change) -> dict:
        """Write what a commit is to add; returns its entry."""
        folder = uuid.uuid4().hex
        at = f"{self.root}/{name}/data/{folder}"
        typed = self.spark.createDataFrame([], self._all_schemas[name]).schema
        rows = self.spark.createDataFrame([], typed) if change.rows is None else change.rows
        missing = [c for c in typed.names if c not in rows.columns]
        rows = rows.withColumns({c: F.lit(None) for c in missing}) if missing else rows
        rows = rows.select(*(F.col(f.name).cast(f.dataType) for f in typed))
        order = self.clustered.get(name)
        if order:  # the least and greatest values of a file's parts tell readers which to skip
            rows = (rows.repartitionByRange(*order) if change.base else rows).sortWithinPartitions(*order)
        rows.write.parquet(f"{at}/rows")
        entry = {"base": change.base, "folder": folder, "by": list(change.by), "key_bytes": 0, "top": None}
        if "id" in typed.names and typed["id"].dataType.simpleString() == "bigint":
            entry["top"] = self.spark.read.schema("id long").parquet(f"{at}/rows").agg(F.max("id")).first()[0]
        if change.by:
            change.keys.select(*(F.col(c).cast(typed[c].dataType) for c in change.by)).distinct().write.parquet(f"{at}/keys")
            fs, path = self._path(f"{at}/keys")
            entry["key_bytes"] = fs.getContentSummary(path).getLength()
        return entry

    def commit(self, name: str, make: Callable[[DataFrame], Change | None], again: bool = True) -> None:
        """Commit what make(table) gives. If another writer takes the version, it is made again from the new table, or, without `again`, as it is."""
        entry = None
        for attempt in range(ATTEMPTS):
            last, parts = self.versions(name)
            if entry is None:
                change = make(self._read(name, parts))
                if change is None:
                    return
                entry = self._staged(name, change)
            if self._claim(name, last + 1, entry):
                return
            if again:
                self._delete(f"{self.root}/{name}/data/{entry['folder']}")
                entry = None
            time.sleep(random.random() * min(2.0, 0.02 * 2**attempt))
        raise Conflict(f"{name}: {ATTEMPTS} versions were taken by others")

    def write(self, name: str, rows: DataFrame) -> None:
        """rows as the whole table, whatever it held; update() is for what follows from the table."""
        self.commit(name, lambda _: Change(rows, base=True), again=False)

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows whose keys the table doesn't have."""
        self.commit(name, lambda _: Change(rows), again=False)

    def update(self, name: str, change: Callable[[DataFrame], DataFrame]) -> None:
        """Write the table anew as change makes it of the last version."""
        self.commit(name, lambda current: Change(change(current), base=True))

    def exchange(self, name: str, rows: DataFrame | Callable[[int], DataFrame] | None, by: Sequence[str], owners: DataFrame) -> None:
        """rows in place of all rows of owners, which are given by the columns `by`; an owner without rows loses all. Rows of tables with an id get the next ones.

        Rows that can be numbered without being moved are given as a function of the next id; they are written once, where they are made.
        """
        rows = rows if rows is None or callable(rows) else self.kept(rows)
        owners = self.kept(owners.select(*by).distinct())
        made = [owners, *([rows] if isinstance(rows, DataFrame) else [])]

        def make(current: DataFrame) -> Change:
            numbered = rows(self.next_id(name)) if callable(rows) else rows
            if isinstance(rows, DataFrame) and "id" in current.columns and "id" not in rows.columns:
                numbered = self.numbered(rows, [*by, *(k for k in KEYS[name] if k not in by)], self.next_id(name))
                made.append(numbered)
            return Change(numbered, by=tuple(by), keys=owners)

        self.commit(name, make)
        self.done(*made)

    def insert(self, name: str, rows: DataFrame, order: Sequence[str]) -> int:
        """Add rows under the next ids, in this order; for the few rows that one person or cycle adds. Returns the first id."""
        first = 0

        def make(_: DataFrame) -> Change:
            nonlocal first
            first = self.next_id(name)
            return Change(dml.numbered(rows, order, first))

        self.commit(name, make)
        return first

    def next_id(self, name: str) -> int:
        """The id after the greatest that the table's versions hold, as their entries tell."""
        return max((self._entry(name, v)["top"] or 0 for v in self.versions(name)[1]), default=0) + 1

    def compact(self, name: str) -> None:
        """Make one base of a table's versions."""
        self.update(name, lambda current: current)

    def vacuum(self, name: str) -> None:
        """Delete what the table no longer consists of; for when no reader or writer holds it."""
        parts = self.versions(name)[1]
        needed = {self._entry(name, v)["folder"] for v in parts}
        for folder in self._names(f"{self.root}/{name}/data"):
            if folder not in needed:
                self._delete(f"{self.root}/{name}/data/{folder}")
        for n in self._names(f"{self.root}/{name}/log"):
            if n.isdigit() and int(n) < min(parts, default=0):
                self._delete(f"{self.root}/{name}/log/{n}")

    # --- merges ---------------------------------------------------------------------------

    def numbered(self, rows: DataFrame, order: Sequence[str], first: int) -> DataFrame:
        """rows with an `id` from `first` on, in their order by these columns.

        Rows are written sorted by range; an id is the rows in the files before, plus the row's place in
        its file. Only one row a file meets in one task. done() deletes these files.
        """
        path = f"{self.root}/_work/{uuid.uuid4().hex}"
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
        read = self.spark.read.schema(rows.schema).parquet(path)
        placed = read.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
        offsets = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_n")).select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        made = placed.join(offsets, "_file").withColumn("id", (F.col("_before") + F.col("_row") + first).cast("long")).drop("_file", "_row", "_before")
        made._kept_at = path
        return made

    def counted(self, rows: DataFrame, order: str, n: str) -> DataFrame:
        """rows with `_before`, the sum of n over the rows before in the order of one column of distinct values; for short rows, as they are moved.

        Rows are written by range; sums of whole files and sums within a file add up. done() deletes these files.
        """
        written = self.kept(rows.repartitionByRange(order))
        placed = written.withColumn("_file", F.col("_metadata.file_name"))
        until = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
        files = placed.groupBy("_file").agg(F.sum(n).alias("_n")).select("_file", F.coalesce(F.sum("_n").over(until(Window.orderBy("_file"))), F.lit(0)).alias("_files"))
        within = F.coalesce(F.sum(n).over(until(Window.partitionBy("_file").orderBy(order))), F.lit(0))
        made = placed.withColumn("_within", within).join(files, "_file").withColumn("_before", F.col("_files") + F.col("_within")).drop("_file", "_files", "_within")
        made._kept_at = written._kept_at
        return made

    def upsert(self, name: str, incoming: DataFrame, keep_if_null: Sequence[str] = (), order: Sequence[str] = ()) -> None:
        """Merge by natural key: new keys are added, known ones overwritten, nulls included (but for keep_if_null). Tickers of companies are upper case.

        Of several incoming rows of a key the one with the greatest values of `order`, then of its other columns,
        counts. New rows of tables with an id get the next ones, in order of their key. Only incoming's rows are written.
        """
        keys = list(KEYS[name])
        if name == "companies":
            incoming = incoming.withColumn("ticker", F.upper("ticker"))
        own = self.spark.createDataFrame([], self._all_schemas[name]).columns
        incoming = self.kept(dml.one_per_key(incoming.select(*(c for c in incoming.columns if c in own)), keys, order))
        made: list[DataFrame] = []

        def make(current: DataFrame) -> Change | None:
            with_id = "id" in current.columns and "id" not in incoming.columns
            value = lambda c: F.col(f"c.{c}") if c not in incoming.columns else F.coalesce(f"n.{c}", f"c.{c}") if c in keep_if_null or c in keys else F.col(f"n.{c}")
            old = self.kept(incoming.alias("n").join(current.alias("c"), dml.same_keys("n", "c", keys)).select(*(value(c).alias(c) for c in current.columns)))
            new = incoming.alias("n").join(old.select(*keys).alias("o"), dml.same_keys("n", "o", keys), "left_anti")
            made.append(old)
            if with_id:
                new = self.numbered(new, keys, self.next_id(name))
                made.append(new)
            if old.isEmpty():
                return None if new.isEmpty() else Change(new)
            return Change(old.unionByName(new, allowMissingColumns=True), by=tuple(keys), keys=old)

        self.commit(name, make)
        self.done(incoming, *made)

    def remembered(self, name: str, tables: Sequence[str], make: Callable[[], DataFrame], also: Sequence[object] = ()) -> DataFrame:
        """What make() tells of these tables, kept in table `name` with their versions: made again only after one of them (or of `also`) has changed."""
        versions = json.dumps([*also, *map(self.version, tables)])
        read = lambda: self.read(name).where(F.col("versions") == versions).drop("versions")
        if read().isEmpty():
            self.write(name, make().withColumn("versions", F.lit(versions)).coalesce(1))
        return read()

    def keep_texts(self, rows: DataFrame) -> None:
        """Keep clean texts, rows(path, text), beside the tables, one a path; a table's clean_text_path names one. rows is made of written tables.

        What is new is found by the paths alone; only if a path comes twice are the texts themselves brought together.
        """
        paths = self.kept(rows.select("path"))
        n = paths.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("path").alias("distinct"), F.count_if(F.col("path").isNull()).alias("null")).first()
        made = [paths]

        def make(current: DataFrame) -> Change:
            old = self.kept(current.select("path").join(paths, "path", "left_semi"))
            made.append(old)
            return Change(rows) if old.isEmpty() else Change(rows, by=("path",), keys=old)

        if n["distinct"] < n["rows"] or n["null"]:
            self.upsert("clean_texts", rows.select("path", "text"))
        elif n["rows"]:
            self.commit("clean_texts", make)
        self.done(*made)

    def texts(self) -> DataFrame:
        """path and text of the clean texts, each path once."""
        return self.read("clean_texts")

    def sql(self, text: str, args=None) -> DataFrame:
        """A query over the tables by name, with ? or :name parameters; a wrong number of ? values raises."""
        if isinstance(args, (list, tuple)) and text.count("?") != len(args):
            raise ValueError(f"{text.count('?')} parameters, {len(args)} values")
        for name in self.schemas:
            if name in text:
                self.read(name).createOrReplaceTempView(name)
        return self.spark.sql(text, args=list(args) if isinstance(args, tuple) else args)

    def initialize(self) -> None:
        """Empty tables for those that are not there."""
        for name in self.schemas:
            if not self.version(name):
                self._claim(name, 1, {"base": True, "folder": None, "by": [], "key_bytes": 0, "top": None})

    def counts(self) -> DataFrame:
        parts = [self.read(n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table"), "n") for n in self.schemas]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.union(p)
        return whole

    def check_columns(self, target: Store) -> None:
        """Tables or columns that only one side has raise."""
        if self.schemas.keys() != target.schemas.keys():
            raise RuntimeError(f"tables on one side only: {', '.join(sorted(self.schemas.keys() ^ target.schemas.keys()))}")
        for name in self.schemas:
            ours, theirs = (set(self.spark.createDataFrame([], s.schemas[name]).columns) for s in (self, target))
            if ours != theirs:
                # Fixed value: how columns on one side only are told.
                raise RuntimeError(f"Table {name!r}: columns on one side only: {', '.join(sorted(ours ^ theirs))}")

    def copy_to(self, target: Store, dry_run: bool = False, replace: bool = False) -> DataFrame:
        """Copy all tables, those that others refer to first, as they are at one moment: table, source_n, target_n and next_id of each, in that order of tables.

        A target that lacks a column or table raises, and so do one with rows unless it is replaced, and counts that
        differ afterwards. A dry run only counts: target_n is null.
        """
        self.check_columns(target)
        moment = {name: self.versions(name)[1] for name in self.schemas}  # versions never change: all tables are read as of here
        counted = lambda store, parts: {name: store._read(name, parts[name]).count() for name in self.schemas}
        if not dry_run:
            full = [r["table"] for r in target.counts().where("n > 0").collect()]  # one row a table
            if full and not replace:
                raise RuntimeError(f"Target tables are not empty: {', '.join(sorted(full))}")
            for name in reversed(self.schemas) if replace else ():
                target.write(name, target.spark.createDataFrame([], target.schemas[name]))
            for name in self.schemas:
                target.write(name, self._read(name, moment[name]))
        ours = counted(self, moment)
        theirs = None if dry_run else counted(target, {name: target.versions(name)[1] for name in self.schemas})
        top = lambda name: max((self._entry(name, v)["top"] or 0 for v in moment[name]), default=0) + 1 if name in WITH_ID else None
        if theirs and theirs != ours:
            raise RuntimeError(dml.count_message([(n, ours[n], theirs[n]) for n in sorted(ours) if ours[n] != theirs[n]]))
        rows = [(i, n, ours[n], theirs and theirs[n], top(n)) for i, n in enumerate(self.schemas)]
        return self.spark.createDataFrame(rows, "place int, table string, source_n long, target_n long, next_id long").orderBy("place").drop("place")
