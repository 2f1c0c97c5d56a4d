"""A data source of dumped pages: one file for each page of a portal's answers, read by ranges of pages."""

from __future__ import annotations

import datetime
import gzip
import json
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_NAME = re.compile(r"page-(\d+)\.(?:json|html)(\.gz)?$")


@dataclass
class Pages(InputPartition):
    """A range of pages of one folder: (number, file) each; or what kept the folder from being listed."""

    files: Sequence[tuple[int, str]]
    error: str | None = None


def local(path: str) -> str:
    """A path of the shared folder as every machine mounts it."""
    return path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")


class PageDumps(DataSource):
    """Options: path, a folder that all machines mount, with page-<n>.json or page-<n>.html, plain or .gz; source; per_task, the pages of a partition (16).

    Rows: source, page, written_at, body, error.  A page that can't be opened or decoded,
    and a .json page that isn't JSON, has an error and no body.  A folder that can't be
    listed gives one row with an error and no page.  Other files are left alone.
    """

    @classmethod
    def name(cls) -> str:
        return "page_dumps"

    def schema(self) -> str:
        return "source string, page long, written_at timestamp, body string, error string"

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)


class PageReader(DataSourceReader):
    def __init__(self, options):
        self.source, self.folder, self.per_task = options["source"], local(options["path"]), max(1, int(options.get("per_task", 16)))

    def partitions(self) -> list[Pages]:
        try:
            found = sorted((int(m[1]), name) for name in os.listdir(self.folder) if (m := _NAME.match(name)))
        except OSError as error:
            return [Pages((), said(error))]
        return [Pages(found[k : k + self.per_task]) for k in range(0, len(found), self.per_task)] or [Pages(())]

    def read(self, partition: Pages) -> Iterator[tuple]:
        if partition.error:
            yield self.source, None, None, None, partition.error
        for page, name in partition.files:
            try:
                yield self.source, page, *opened(os.path.join(self.folder, name)), None
            except Exception as error:  # whatever is wrong with this page, the others count
                yield self.source, page, None, None, said(error)


def opened(path: str) -> tuple[datetime.datetime, str]:
    with open(path, "rb") as file:
        data = file.read()
        written = datetime.datetime.fromtimestamp(os.fstat(file.fileno()).st_mtime, datetime.UTC)
    body = (gzip.decompress(data) if path.endswith(".gz") else data).decode()
    if ".json" in os.path.basename(path):
        json.loads(body)
    return written, body


def said(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"[:500]
