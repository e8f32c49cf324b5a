"""Files that tasks open themselves, by pyarrow's file systems: local or shared folders, and object stores by their addresses; and a sink of one file a row."""

from __future__ import annotations

import fnmatch
import os
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, islice

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tidemark.session import folder

#: Files of a task that lie on the disk at once in through_files(); a small file takes a whole block of it.
AT_ONCE = 2_000
#: Files of a folder where a task writes very many: what one task lists and reads of them later.
IN_FOLDER = 10_000
#: Bytes of a batch that read_files() gives; a larger file is a batch of its own.
BATCH_BYTES = 8 << 20


def located(path: str):
    """The file system of a path or address, and the path within it."""
    from pyarrow import fs

    if local := re.fullmatch(r"(?:file:)?(?://)?(/.*)", path):
        return fs.LocalFileSystem(), os.path.normpath(local[1])
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def listed(path: str, pattern: str = "*") -> list[str]:
    """Files at a path, or below it whose names match the pattern, in order; names that begin with _ or . are left out, at any depth."""
    from pyarrow import fs

    store, at = located(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [at]
    hidden = lambda p: any(s[:1] in "_." for s in p[len(at) :].strip("/").split("/"))
    found = store.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    return sorted(i.path for i in found if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, pattern) and not hidden(i.path))


def _delete(store, at: str) -> None:
    """Delete a folder that tasks of a failed job may still write into: moved first, so that they find it gone."""
    from pyarrow import fs

    if store.get_file_info(at).type != fs.FileType.NotFound:
        store.move(at, f"{at}-gone")
        store.delete_dir(f"{at}-gone")


def _put(store, at: str, rows: Iterable[tuple[str, bytes | None]], *, recursive: bool = True) -> list[str]:
    """Write each (name, content) as a file of a new folder; their names, which must be unlike each other. The folder that it lies in must be there, unless recursive."""
    store.create_dir(at, recursive=recursive)
    names = []
    for name, content in rows:
        if not name or "/" in name or name[0] in "_.":
            raise ValueError(f"not a file name: {name!r}")
        with store.open_output_stream(f"{at}/{name}", compression=None) as f:
            f.write(bytes(content or b""))
        names.append(name)
    if len(set(names)) < len(names):
        raise ValueError("two rows have one file name")
    return names


@dataclass
class Pending(WriterCommitMessage):
    """A task's folders of files that are not there yet for readers, and the files' names, or none if the folders are moved as they are."""

    folders: list[str]
    names: list[str]


class _FileWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.job = options["job"]
        self.spread, self.in_folder = options.get("spread") == "true", int(options.get("infolder", IN_FOLDER))

    def _pending(self) -> str:
        return f"{located(self.path)[1]}/_pending-{self.job}"

    def write(self, iterator: Iterator[Row]) -> Pending:
        store, _ = located(self.path)
        task = TaskContext.get()
        at = f"{self._pending()}/{task.partitionId()}-{task.taskAttemptId()}"
        if not self.spread:
            return Pending([at], _put(store, at, iterator, recursive=False))
        folders: list[str] = []
        while first := next(iterator, None):
            folders.append(f"{at}-{len(folders)}")
            _put(store, folders[-1], chain([first], islice(iterator, self.in_folder - 1)), recursive=False)
        return Pending(folders, [])

    def commit(self, messages: list[Pending | None]) -> None:
        store, root = located(self.path)
        names = [n for m in messages if m for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows have one file name")
        for m in filter(None, messages):
            if self.spread:
                for at in m.folders:
                    store.move(at, f"{root}/{self.job}-{at.rsplit('/', 1)[-1]}")  # one move a folder
            else:
                for name in m.names:
                    store.move(f"{m.folders[0]}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Pending | None]) -> None:
        _delete(located(self.path)[0], self._pending())


class FileSink(DataSource):
    """Sink of rows (name, content): one file a row."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> _FileWriter:
        return _FileWriter(self.options)


def write_files(rows: DataFrame, path: str, *, spread: bool = False, in_folder: int = IN_FOLDER) -> None:
    """Write each row (name, content) as a file of the folder; spread puts a task's files, in_folder at most in each, into folders of their own below it, for very many files: the driver moves folders and sees no names.

    Tasks write into a pending folder of their attempt; files appear under their names only when all tasks are through, and a failed job leaves none. A task that
    runs again has a folder of its own, so its first attempt leaves nothing either. Names are single ones, unlike each other; files of the same names are replaced, but not if spread. Null contents are empty files.
    """
    spark = rows.sparkSession
    spark.dataSource.register(FileSink)
    store, at = located(path)

    def write(below: str) -> None:
        job = uuid.uuid4().hex
        store.create_dir(f"{at}{below}/_pending-{job}")
        rows.select("name", "content").write.format("tidemark_files").options(spread=str(spread).lower(), infolder=in_folder, job=job).mode("append").save(path.rstrip("/") + below)

    if not spread:
        return write("")
    from pyarrow import fs

    held = f"/_held-{uuid.uuid4().hex}"  # readers do not see it; tasks compare the names in there
    try:
        write(held)
        if read_files(spark, path.rstrip("/") + held, content=False).groupBy("name").count().where("count > 1").limit(1).count():
            raise ValueError("two rows have one file name")
        for i in store.get_file_info(fs.FileSelector(at + held)):
            store.move(i.path, f"{at}/{i.base_name}")
    finally:
        _delete(store, at + held)


def through_files(rows: DataFrame, *, at_once: int = AT_ONCE) -> DataFrame:
    """path, content: each row (name, content) written as a file of the shared folder and read back from there, for more small files than the disk has room for.

    A task writes at_once files into a folder of its own, reads what it finds in it and deletes it before the next. Names are as in write_files(); they must be unlike each other, which is seen only of files that lie there at once.
    """
    path = folder(rows.sparkSession, "files")

    def through(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, root = located(path)
        for batch in batches:
            for k in range(0, batch.num_rows, at_once):
                part, own = batch.slice(k, at_once).to_pydict(), f"{root}/{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}"
                try:
                    _put(store, own, zip(part["name"], part["content"]))
                    found = [i.path for i in store.get_file_info(fs.FileSelector(own))]
                    contents = []
                    for p in found:
                        with store.open_input_file(p) as f:
                            contents.append(f.read())
                finally:
                    store.delete_dir(own)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

    return rows.select("name", "content").mapInArrow(through, "path string, content binary")


@dataclass
class Below(InputPartition):
    """What lies directly in a folder, or, if deep, at any depth below it; rel is its place below the path."""

    rel: str
    deep: bool


class _FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.content = options["path"].rstrip("/"), options.get("content") == "true"

    def partitions(self) -> list[Below]:
        """The path's own files, and one for each folder in it: what these hold is listed by tasks."""
        from pyarrow import fs

        store, at = located(self.path)
        found = store.get_file_info(fs.FileSelector(at))
        return [Below("", False), *[Below(f"/{i.base_name}", True) for i in found if i.type == fs.FileType.Directory and i.base_name[0] not in "_."]]

    def read(self, partition: Below):
        import pyarrow as pa
        from pyarrow import fs

        store, at = located(self.path)
        hidden = lambda p: any(s[:1] in "_." for s in p[len(at) :].strip("/").split("/"))
        found = store.get_file_info(fs.FileSelector(at + partition.rel, recursive=partition.deep))
        rows, held = [], 0
        names = ["path", "name", "length", "modified", *(["content"] if self.content else [])]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.binary()]
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        for i in found:
            if i.type != fs.FileType.File or hidden(i.path):
                continue
            row = (self.path + i.path[len(at) :], i.base_name, i.size, i.mtime_ns // 1000)
            if self.content:
                with store.open_input_file(i.path) as f:
                    row += (f.read(),)
                held += i.size
            rows.append(row)
            if held >= BATCH_BYTES or len(rows) >= 10_000:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


class FolderSource(DataSource):
    """Files of a folder. Options: path, content (whether they are read)."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_folder"

    def schema(self) -> str:
        return "path string, name string, length long, modified timestamp" + (", content binary" if self.options.get("content") == "true" else "")

    def reader(self, schema: StructType) -> _FolderReader:
        return _FolderReader(self.options)


def read_files(spark: SparkSession, path: str, *, content: bool = True) -> DataFrame:
    """path, name, length, modified and content of the files in a folder and at any depth below it, empty ones too, which Spark's own file readers leave out; names that begin with _ or . are left out.

    The driver sees what lies directly in the folder; a task lists, and reads, each folder below. So very many files should lie in folders, as write_files(spread=True) puts them. Paths begin with the path given.
    """
    return registered(spark, FolderSource, path=path, content=str(content).lower()).load()


def registered(spark: SparkSession, source: type[DataSource], **options: object):
    """A reader of a data source with the options that are not None."""
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**{k: v for k, v in options.items() if v is not None})
