"""A sink that writes one text file per page.

`frame.write.format("page_files").mode("append").save(folder)` takes rows of a key and a text and leaves <folder>/<task>/<key>.txt.
Pages are neither sorted nor shuffled: each task writes the pages it has. A task writes below <folder>/_temporary, in a folder
of its attempt; the driver moves the folders of the tasks that succeeded - one move a task, however many pages - and then
removes the rest, so a failed or repeated attempt, and a job that is given up, leave nothing.

Defined results: a null text is an empty file; a null key is named `_`; keys are quoted, and long ones cut and hashed; a key that
comes again in a task is numbered (<key>-2.txt). Mode overwrite removes what the folder holds, after the tasks are done. No
rows: the folder holds the marker `_SUCCESS` alone."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.workers import ship
from .stores import file_name, located

FORMAT = "page_files"
#: Where files are until their job is done.
UNDONE = "_temporary"


@dataclass
class Written(WriterCommitMessage):
    folder: str
    task: int
    pages: int


class PageFileWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        task = TaskContext.get()
        store, root = located(self.path)
        folder = f"{UNDONE}/{self.job}/{task.taskAttemptId()}"
        seen: Counter = Counter()
        for key, text in rows:
            if not seen:
                store.create_dir(f"{root}/{folder}")
            name = file_name(key)
            seen[name] += 1
            place = f"{root}/{folder}/{name}.txt" if seen[name] == 1 else f"{root}/{folder}/{name}-{seen[name]}.txt"
            with store.open_output_stream(place) as out:
                out.write((text or "").encode())
        return Written(folder if seen else "", task.partitionId(), sum(seen.values()))

    def commit(self, messages: list[Written | None]) -> None:
        store, root = located(self.path)
        store.create_dir(root)
        if self.overwrite:
            from pyarrow import fs

            for old in store.get_file_info(fs.FileSelector(root)):
                if old.base_name != UNDONE:
                    (store.delete_dir if old.type == fs.FileType.Directory else store.delete_file)(old.path)
        for done in messages:
            if done is not None and done.folder:
                store.move(f"{root}/{done.folder}", f"{root}/{self.job[:8]}-{done.task:05}")
        self._forget(store, root)
        with store.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self._forget(*located(self.path))

    def _forget(self, store, root: str) -> None:
        from pyarrow import fs

        own = f"{root}/{UNDONE}/{self.job}"
        if store.get_file_info(own).type == fs.FileType.Directory:
            store.delete_dir(own)
        top = store.get_file_info(f"{root}/{UNDONE}")
        if top.type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(f"{root}/{UNDONE}")):
            store.delete_dir(f"{root}/{UNDONE}")


class PageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "key string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> PageFileWriter:
        if len(schema) != 2:
            raise ValueError("a page is a key and a text")
        return PageFileWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session and the package to its workers."""
    ship(spark.range(0))
    spark.dataSource.register(PageFiles)


def write_pages(pages: DataFrame, key: str, text: str, path: str, mode: str = "append") -> None:
    """A file for each row of pages, named by its key."""
    register(pages.sparkSession)
    pages.select(pages[key].cast("string").alias("key"), pages[text].alias("text")).write.format(FORMAT).mode(mode).save(path)


def listed_pages(spark: SparkSession, path: str) -> DataFrame:
    """(name, uri, size) of the files that `write_pages` has left in a folder; name is the quoted key. The driver lists the folders of
    the sink's tasks alone, and tasks list the files in them; nothing is opened."""
    from pyarrow import fs

    store, root = located(path)
    folders = [(f.base_name,) for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory and f.base_name != UNDONE]
    top, width = path.rstrip("/"), 10_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = located(top)
        for folder in (f for b in batches for f in b.column(0).to_pylist()):
            found = [f for f in store.get_file_info(fs.FileSelector(f"{root}/{folder}")) if f.type == fs.FileType.File and f.base_name.endswith(".txt")]
            for at in range(0, len(found), width):
                part = found[at : at + width]
                names = [f.base_name for f in part]
                yield pa.RecordBatch.from_pydict({"name": [n.removesuffix(".txt") for n in names], "uri": [f"{top}/{folder}/{n}" for n in names], "size": pa.array([f.size for f in part], pa.int64())})

    dealt = spark.createDataFrame(folders, "folder string").repartition(max(1, min(len(folders), 4 * spark.sparkContext.defaultParallelism)))
    return ship(dealt).mapInArrow(run, "name string, uri string, size long")
