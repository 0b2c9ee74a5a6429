"""A data source of filing submissions: one row a document, in batches and as a stream.

A file is cut into splits of `split_bytes`. A split gives the documents whose <DOCUMENT> begins in it and reads
on to their ends, so a file of any size is read by many tasks, each with one document in memory. Whether a
tag lies inside another document (then it is text) shows in the last tag before the split; it is looked
for only if the split's first tag opens one.

Options: `path`, a folder; `ticker` and `form`, which name the part of it that downloads of theirs lie in; `name` of the
files, a pattern (full-submission.txt); `split_bytes`; `files`, true for one more row a file, with the SHA-256 of its bytes.
Streams: `settle_seconds` (files younger than that wait).

Rows: path; modified; position of the document in bytes; header, the part before the first document if it holds
a <SEC-HEADER>, else the file's first 20,000 characters; document, what is between its tags; raw_sha256. Rows of files have no position,
and a document only if the file has none marked as such: then all of its text. A file without documents always has that row.
Bytes that aren't UTF-8 raise. An unclosed document is none.

A stream's offset is a time of modification, so its state doesn't grow with the files; its first batch is all there is. Every file modified up to the end
of a batch is in that batch or an earlier one, if files get their time when they appear (written elsewhere and
renamed, or written within `settle_seconds`). Files are opened through pyarrow, which knows local disks, HDFS and object stores.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from fnmatch import fnmatch

from pyarrow import fs as files
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, modified timestamp, position long, header string, document string, raw_sha256 string"
# The tags, and the number of characters that are a header where none is marked.
TAG, OPEN, CLOSE, HEADER = re.compile(rb"</?DOCUMENT>", re.I), len(b"<DOCUMENT>"), len(b"</DOCUMENT>"), re.compile(rb"<SEC-HEADER>", re.I)
HEADER_CHARS = 20_000
BLOCK = 1 << 20  #: bytes that are searched at a time


@dataclass
class Split(InputPartition):
    path: str
    modified: int
    start: int
    end: int


def _tags(file, start: int, end: int) -> Iterator[tuple[int, bool]]:
    """Where tags begin from start to before end, in order, and whether they open a document."""
    for at in range(start, end, BLOCK):
        most = min(BLOCK, end - at)
        for m in TAG.finditer(file.read_at(most + CLOSE - 1, at)):
            if m.start() < most:
                yield at + m.start(), m[0][1:2] != b"/"


def _inside(file, start: int) -> bool:
    """Whether the last tag that begins before start opens a document."""
    while start > 0:
        low = max(0, start - BLOCK)
        found = [opens for _, opens in _tags(file, low, start)]
        if found:
            return found[-1]
        start = low
    return False


def positions(file, start: int, end: int, size: int) -> Iterator[tuple[int, int]]:
    """Where the documents that begin from start to before end have their two tags."""
    own, inside = None, None
    for at, opens in _tags(file, start, end):
        if inside is None:
            inside = opens and _inside(file, start)
        if not opens:
            if own is not None:
                yield own, at
            own, inside = None, False
        elif not inside:
            own, inside = at, True
    if own is not None:  # read on to its end
        last = next((at for at, opens in _tags(file, end, size) if not opens), None)
        if last is not None:
            yield own, last


def header(file, size: int) -> str:
    first = next((at for at, opens in _tags(file, 0, size) if opens), size)
    before = file.read_at(first, 0) if first < size else b""
    if HEADER.search(before):
        return before.decode()
    data = file.read_at(4 * HEADER_CHARS, 0)
    whole = data.decode() if len(data) == size else data.decode(errors="ignore")  # the last character may be cut
    return whole[:HEADER_CHARS]


def _sha256(file, size: int) -> str:
    made = hashlib.sha256()
    for at in range(0, size, BLOCK):
        made.update(file.read_at(BLOCK, at))
    return made.hexdigest()


class _Read:
    """What both readers do: list files, cut them into splits, read one."""

    def __init__(self, options: dict[str, str]):
        told = {k.lower(): v for k, v in options.items()}
        if not told.get("path"):
            raise ValueError("submissions: a path is needed")
        if told.get("form") and not told.get("ticker"):
            raise ValueError("submissions: a form needs a ticker")
        parts = [told["path"].rstrip("/"), *(["sec-edgar-filings", told["ticker"].upper()] if told.get("ticker") else []), *([told["form"]] if told.get("form") else [])]
        self.folder, self.name = "/".join(parts), told.get("name", "full-submission.txt")
        self.split_bytes = int(told.get("split_bytes", 64 << 20))
        self.rows_of_files = told.get("files", "false").lower() == "true"
        self.settle_seconds = float(told.get("settle_seconds", 5))
        if self.split_bytes < 1 or self.settle_seconds < 0:
            raise ValueError("submissions: split_bytes must be positive, settle_seconds not negative")

    def found(self) -> list[tuple[int, str, int]]:
        """time of modification, path and size of each file, oldest first."""
        system, root = files.FileSystem.from_uri(self.folder)
        listed = system.get_file_info(files.FileSelector(root, allow_not_found=True, recursive=True))
        return sorted((f.mtime_ns, f.path, f.size) for f in listed if f.is_file and fnmatch(f.base_name, self.name))

    def splits(self, found: list[tuple[int, str, int]]) -> list[Split]:
        return [Split(path, at, low, min(low + self.split_bytes, size)) for at, path, size in found for low in range(0, max(size, 1), self.split_bytes)]

    def read(self, split: Split | None) -> Iterator[tuple]:
        if split is None:  # there are no files
            return
        system, _ = files.FileSystem.from_uri(self.folder)
        modified = datetime.fromtimestamp(split.modified / 1e9, UTC)
        with system.open_input_file(split.path) as file:
            size, head = file.size(), None
            if split.start == 0:
                none = next(positions(file, 0, size, size), None) is None
                if none or self.rows_of_files:
                    head = header(file, size)
                    yield split.path, modified, None, head, file.read_at(size, 0).decode() if none else None, _sha256(file, size) if self.rows_of_files else None
            for first, last in positions(file, split.start, split.end, size):
                head = header(file, size) if head is None else head
                yield split.path, modified, first, head, file.read_at(last - first - OPEN, first + OPEN).decode(), None


class Reader(_Read, DataSourceReader):
    def partitions(self) -> list[Split]:
        return self.splits(self.found())


class StreamReader(_Read, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        """The time of the newest settled file. It falls only if all later files are deleted, so none is read twice."""
        settled = time.time_ns() - int(self.settle_seconds * 1e9)
        return {"until": max((at for at, _, _ in self.found() if at <= settled), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        return self.splits([f for f in self.found() if start["until"] < f[0] <= end["until"]])


class Submissions(DataSource):
    @classmethod
    def name(cls) -> str:
        return "submissions"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(dict(self.options))
