"""Files to scan: from a table, or from a source tree through a Python data source."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from scanframe import tables
from scanframe.functions import columns as C
from scanframe.schema import FILE

#: Files read by one task.
FILES_PER_TASK = 256
#: The driver lists folders until there are as many, each of which is then a task's to list.
TREES = 64
#: Characters of file content in one batch of rows, about.
BATCH_CHARS = 8 << 20


def files_from_table(rows: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Rows of a table as files; name, extension and language follow from the path."""
    named = rows.select(F.col(path).alias("path"), C.unix_lines(F.col(content)).alias("content")).withColumn("name", C.base_name(F.col("path")))
    typed = named.withColumn("ext", C.extension(F.col("name")))
    return typed.withColumn("language", C.language_of(F.col("ext"))).select(*FILE.names)


def wanted(files: DataFrame) -> DataFrame:
    """The files that a scan reads: none below pruned directories, and only known names."""
    return files.filter(~C.is_pruned(F.col("path")) & C.is_wanted(F.col("name")))


def python_files(files: DataFrame) -> DataFrame:
    """The Python files that are not below pruned directories."""
    return files.filter(~C.is_pruned(F.col("path")) & (F.col("ext") == ".py"))


def suffix(name: str) -> str:
    """As ``pathlib`` has it, in lower case: a leading or a last dot makes none."""
    at = name.rfind(".")
    return name[at:].lower() if 0 < at < len(name) - 1 else ""


def keeps(name: str) -> bool:
    return suffix(name) in tables.TEXT_EXTS or name in tables.SUSPICIOUS_FILES or name in tables.MANIFESTS


class _Chunk(InputPartition):
    def __init__(self, entries: list[tuple[str, int]], folder: str = ""):
        super().__init__(entries)
        self.entries, self.folder = entries, folder


class SourceTree(DataSource):
    """``spark.read.format("source_tree").load(uri)``: the text files of a source tree.

    Lists with Arrow's file systems (local paths and the stores they know), the upper folders on
    the driver and the trees below them in the tasks that read them, and prunes directories
    while listing, so what lies below them is never touched; names that start with
    a dot or an underscore, which Spark's own file sources leave out, are read as any other.
    Options: ``files_per_task``; ``max_bytes`` (none by default): larger files are listed with
    null content. So are files that cannot be read; both count as skipped.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self):
        return FILE

    def reader(self, schema) -> DataSourceReader:
        return SourceTreeReader(self.options)


class SourceTreeReader(DataSourceReader):
    def __init__(self, options):
        self.uri = options["path"]
        self.max_bytes = int(options["max_bytes"]) if "max_bytes" in options else None
        self.per_task = int(options.get("files_per_task", FILES_PER_TASK))

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri) if "://" in self.uri else (fs.LocalFileSystem(), self.uri)

    def _listed(self, store, folder: str) -> tuple[list[str], list[tuple[str, int]]]:
        """The folders and the files, with their sizes, of a folder that a scan looks into."""
        from pyarrow import fs

        infos = sorted(store.get_file_info(fs.FileSelector(folder)), key=lambda i: i.path)
        folders = [i.path for i in infos if i.type == fs.FileType.Directory and i.base_name not in tables.EXCLUDED_DIRS]
        return folders, [(i.path, i.size) for i in infos if i.type != fs.FileType.Directory and keeps(i.base_name)]

    def partitions(self):
        store, base = self._store()
        found, folders = [], [base.rstrip("/")]
        while folders and len(folders) < TREES:
            below = []
            for folder in folders:
                own, entries = self._listed(store, folder)
                below += own
                found += entries
            folders = below
        chunks = [_Chunk(found[k : k + self.per_task]) for k in range(0, len(found), self.per_task)]
        return chunks + [_Chunk([], folder) for folder in folders]

    def _entries(self, store, partition) -> Iterator[tuple[str, int]]:
        yield from partition.entries
        queue = [partition.folder] if partition.folder else []
        while queue:
            folders, entries = self._listed(store, queue.pop())
            queue += folders
            yield from entries

    def _content(self, store, path: str, size: int) -> str | None:
        if self.max_bytes is not None and size > self.max_bytes:
            return None
        try:
            with store.open_input_stream(path) as f:
                return f.read().decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")
        except OSError:
            return None

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        store, base = self._store()
        rows, held = [], 0
        for path, size in self._entries(store, partition) if partition else ():
            shown = path.removeprefix(base.rstrip("/") + "/")
            name = shown.rpartition("/")[2]
            ext = suffix(name)
            content = self._content(store, path, size)
            rows.append((shown, name, ext, tables.LANGUAGE_OF_EXT.get(ext, "unknown"), content))
            held += len(content or "")
            if held > BATCH_CHARS or len(rows) == self.per_task:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], FILE.names)


def files_from_tree(spark: SparkSession, uri: str, **options) -> DataFrame:
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("source_tree")
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(uri)
