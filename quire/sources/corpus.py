"""A corpus of files that are fetched once.

`spark.read.format("cached_corpus").option("list", folder).option("cache", folder).load()` gives a row for each line `name<TAB>uri` of
the list's text files: (name, uri, content, cached, problem). A file that the cache holds is read from there and its source is
not touched; another is fetched, looked at - it must begin with the option `magic`, %PDF unless said otherwise - written beside
its place in the cache and moved there. So a reader never sees half a file, and of two tasks that fetch the same file at once
one whole copy is left. The list is dealt out by ranges of its bytes (option `range`), a task for each; neither the driver nor
a task holds it whole.

Defined results: a source that is missing or has another beginning gives a row with null content and its `problem`, and nothing
in the cache, so it is tried again next time; a line without a tab names itself by its URI; blank lines are no rows; the same
URI on several lines is several rows and one file. `cached` tells whether this read found the file in the cache."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.workers import ship
from .stores import is_file, located, put_whole

FORMAT = "cached_corpus"
#: Bytes of the list that a task goes through.
RANGE = 1 << 16
#: Rows, and bytes of content, that a task hands over at once.
ROWS, HELD = 1000, 1 << 22
COLUMNS = {"name": pa.string(), "uri": pa.string(), "content": pa.binary(), "cached": pa.bool_(), "problem": pa.string()}


class Lines(InputPartition):
    """The lines of a file that begin within a range of its bytes."""

    def __init__(self, path: str, begin: int, end: int):
        super().__init__((path, begin, end))
        self.path, self.begin, self.end = path, begin, end

    def entries(self, store: fs.FileSystem) -> Iterator[tuple[str, str]]:
        with store.open_input_file(self.path) as file:
            at = max(0, self.begin - 1)
            file.seek(at)
            held, first = b"", self.begin > 0  # what stands before the first line end belongs to the range before
            while at + len(held) <= self.end or held:
                cut = held.find(b"\n")
                if cut < 0:
                    more = file.read(1 << 16)
                    if more:
                        held += more
                        continue
                    cut = len(held)
                line, here = held[:cut], at
                at, held = at + cut + 1, held[cut + 1 :]
                if not first and here >= self.end:
                    return
                if not first and line.strip():
                    name, tab, uri = line.decode().strip("\r\n").partition("\t")
                    yield (name, uri) if tab else (name, name)
                first = False
                if not held and file.tell() >= file.size():
                    return


class CorpusReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.list, self.cache = options["list"], options["cache"]
        self.magic, self.range = options.get("magic", "%PDF").encode("latin-1"), int(options.get("range", RANGE))

    def partitions(self) -> list[Lines]:
        store, root = located(self.list)
        found = [store.get_file_info(root)] if is_file(store, root) else store.get_file_info(fs.FileSelector(root))
        shown = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.size and f.base_name[0] not in "._")
        return [Lines(path, a, min(a + self.range, size)) for path, size in shown for a in range(0, size, self.range)] or [Lines("", 0, 0)]

    def read(self, partition: Lines) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in self._rows(partition):
            rows.append(row)
            held += len(row[2] or b"")
            if len(rows) == ROWS or held >= HELD:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _rows(self, partition: Lines) -> Iterator[tuple]:
        if not partition.path:
            return
        cache, root = located(self.cache)
        cache.create_dir(root)
        for name, uri in partition.entries(located(self.list)[0]):
            place = f"{root}/{hashlib.sha256(uri.encode()).hexdigest()}"
            if is_file(cache, place):
                with cache.open_input_stream(place) as file:
                    yield name, uri, file.read(), True, None
                continue
            try:
                source, path = located(uri)
                with source.open_input_stream(path) as file:
                    content = file.read()
            except (OSError, ValueError) as error:
                yield name, uri, None, False, f"{type(error).__name__}: {str(error)[:200]}"
                continue
            if not content.startswith(self.magic):
                yield name, uri, None, False, "another beginning"
                continue
            put_whole(cache, place, content)
            yield name, uri, content, False, None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), COLUMNS.values(), strict=True)], names=list(COLUMNS))


class CachedCorpus(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, uri string, content binary, cached boolean, problem string"

    def reader(self, schema: StructType) -> CorpusReader:
        return CorpusReader(dict(self.options))


def read_corpus(spark: SparkSession, listed: str, cache: str, magic: str = "%PDF", size: int = RANGE) -> DataFrame:
    """(name, uri, content, cached, problem) of all files that the list names."""
    ship(spark.range(0))
    spark.dataSource.register(CachedCorpus)
    return spark.read.format(FORMAT).option("list", listed).option("cache", cache).option("magic", magic).option("range", size).load()
