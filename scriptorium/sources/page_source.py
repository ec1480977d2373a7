"""A data source of pages: a folder of documents, each of which is opened where its pages are read.

    spark.dataSource.register(page_source(read))
    spark.read.format("pages").load(folder)
    spark.readStream.format("pages").load(folder)

Files are packed into tasks by size; a file larger than a task is opened by several tasks, each of which yields its share of
the pages. A file that can't be read gives a row with the error. A stream takes the files that are newer than those it had.
Folders are reached by pyarrow's file systems (local, HDFS, S3, GCS), so every executor opens what it reads.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Pages of a document, each with the label printed on it (None: none) and its text.
Reader = Callable[[bytes], list[tuple[str | None, str]]]

LABEL = re.compile(r"^\s*[-–—\[(]?\s*(?:(?i:page|halaman|p\.)\s*)?(\d{1,4}|[ivxlcIVXLC]{1,7})\s*[-–—\])]?\s*$")


def text_pages(content: bytes) -> list[tuple[str | None, str]]:
    """Pages of UTF-8 text, parted by form feeds; a first or last line of a number alone is the printed label. An empty file has none."""
    out = []
    if not content:  # as Spark writes for a first partition without rows
        return out
    for page in content.decode("utf-8").removesuffix("\f").split("\f"):
        lines = page.strip("\n").split("\n")
        ends = [m.group(1) for m in (LABEL.match(lines[0]), LABEL.match(lines[-1])) if m]
        out.append((ends[0] if ends else None, page))
    return out


@dataclass
class Share(InputPartition):
    """Some files, of each the pages of one part of `parts`."""

    files: list[tuple[str, int, int]]


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(options) -> list[tuple[int, str, int]]:
    """(time, path, size) of the files below the folder with the wanted suffix, oldest first; hidden ones and Spark's own aside."""
    from pyarrow import fs

    system, root = _filesystem(options["path"])
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    suffix = options.get("suffix", "")
    names = [f for f in found if f.type == fs.FileType.File and f.path.endswith(suffix) and not re.search(r"/[._]", f.path.removeprefix(root))]
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in names)


def _packed(files: list[tuple[int, str, int]], task_bytes: int) -> list[Share]:
    out, held, size = [], [], 0
    for _, path, n in files:
        if n > task_bytes:
            parts = -(-n // task_bytes)
            out += [Share([(path, k, parts)]) for k in range(parts)]
            continue
        if held and size + n > task_bytes:
            out.append(Share(held))
            held, size = [], 0
        held.append((path, 0, 1))
        size += n
    return [*out, Share(held)] if held else out


def page_source(read: Reader = text_pages, name: str = "pages") -> type[DataSource]:
    """A data source class for documents that `read` understands. Options: path, suffix, taskBytes (of a task's files, 64 MB)."""

    def rows(options, share: Share) -> Iterator[tuple]:
        system, _ = _filesystem(options["path"])
        for path, part, parts in share.files:
            file = path.rsplit("/", 1)[-1]
            try:
                with system.open_input_stream(path) as f:
                    pages = read(f.read())
            except Exception as e:  # whatever a broken file makes a reader raise
                if part == 0:
                    yield file, None, None, None, f"{type(e).__name__}: {e}"
                continue
            for i in range(part * len(pages) // parts, (part + 1) * len(pages) // parts):
                yield file, i + 1, pages[i][0], pages[i][1], None

    class Batch(DataSourceReader):
        def __init__(self, options):
            self.options = options

        def partitions(self):
            return _packed(_files(self.options), int(self.options.get("taskbytes", 64 << 20))) or [Share([])]

        def read(self, partition):
            return rows(self.options, partition)

    class Stream(DataSourceStreamReader):
        """The offset is the time and path of the last file taken; files must appear whole, as by a rename."""

        def __init__(self, options):
            self.options = options

        def initialOffset(self):
            return {"time": -1, "path": ""}

        def latestOffset(self):
            files = _files(self.options)
            return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

        def partitions(self, start, end):
            after, upto = (start["time"], start["path"]), (end["time"], end["path"])
            new = [f for f in _files(self.options) if after < (f[0], f[1]) <= upto]
            return _packed(new, int(self.options.get("taskbytes", 64 << 20))) or [Share([])]

        def read(self, partition):
            return rows(self.options, partition)

        def commit(self, end): ...

    class Pages(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "doc_id string, page_idx int, page_label string, text string, error string"

        def reader(self, schema):
            return Batch({k.lower(): v for k, v in self.options.items()})

        def streamReader(self, schema):
            return Stream({k.lower(): v for k, v in self.options.items()})

    return Pages
