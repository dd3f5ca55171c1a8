"""Ids in pages, as a list call of a mail service gives them: a Python data source for batch and stream.

A page file holds JSON lines, each a page ``{"messages": [{"id", "threadId"}, ...]}``. Files are read in the order of their arrival:
an offset is the modification time and name of the last file that is read, so that a stream goes on behind it and reads none twice.
"""

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "id string, thread_id string, file string"


class Files(InputPartition):
    """Some page files, read by one task."""

    def __init__(self, paths: list[str]):
        self.paths = paths


class _Pages:
    """What both readers share: listing files and reading pages."""

    def __init__(self, options: dict):
        self.folder, self.files_per_task = options["path"], int(options.get("filesPerTask", "8"))

    def _files(self) -> list[tuple[int, str]]:
        """(modification time in ns, path) of all page files, oldest first. Hidden and half-written files do not count."""
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.folder)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return sorted((f.mtime_ns, f.path) for f in found if f.is_file and f.size and not any(part[:1] in "._" for part in f.path[len(root) :].strip("/").split("/")))

    def _cut(self, files: list[tuple[int, str]]) -> list[Files]:
        paths = [p for _, p in files]
        return [Files(paths[i : i + self.files_per_task]) for i in range(0, len(paths), self.files_per_task)]

    def read(self, partition: Files) -> Iterator[tuple]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.folder)
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                for line in f.read().decode().splitlines():
                    for m in json.loads(line).get("messages") or [] if line.strip() else []:
                        yield m.get("id"), m.get("threadId"), path.rpartition("/")[2]


class PageReader(_Pages, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self._cut(self._files()) or [Files([])]


class PageStreamReader(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:
        files = self._files()
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        after, upto = (start["time"], start["path"]), (end["time"], end["path"])
        return self._cut([f for f in self._files() if after < f <= upto])

    def commit(self, end: dict) -> None:
        pass


class PageSource(DataSource):
    """``spark.read.format("mail_pages").load(folder)`` and ``spark.readStream``; options: ``filesPerTask``."""

    @classmethod
    def name(cls) -> str:
        return "mail_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> PageStreamReader:
        return PageStreamReader(self.options)


def read_pages(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(id, thread_id, file) of all pages below a folder, at most ``limit`` ids."""
    spark.dataSource.register(PageSource)
    rows = spark.read.format("mail_pages").load(path)
    return rows.limit(limit) if limit is not None else rows


def stream_pages(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream, which goes on where its checkpoint ended."""
    spark.dataSource.register(PageSource)
    return spark.readStream.format("mail_pages").load(path)
