"""Streams: bounded, resumable batches; write-behind throttling; remembered state kept up to date."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..functions.workers import shared_folder

#: Input files a batch; a fixed value.
SLICE = 8


class Progress(StreamingQueryListener):
    """Keeps (batch, rows) of every batch done."""

    def __init__(self):
        self.seen: list[tuple[int, int]] = []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.seen.append((event.progress.batchId, event.progress.numInputRows))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def fresh_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared one."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


#: The file a row came from, while a slice is walked.
FILE = "__walked_file"


def walk(spark: SparkSession, folder: str, name: str, schema, step, files: int = SLICE, checkpoint: str | None = None) -> str:
    """Run `step` (frame -> frame) over a table in slices of `files` files until nothing is left, writing Parquet by slice and
    part; returns the output's path. With the same checkpoint a later call takes up where this one ended.

    A slice that fails is gone through file by file; a file that fails then is a warning (see warnings), and the walk goes
    on. A slice that runs again after a loss replaces what it wrote before."""
    root = checkpoint or fresh_folder(spark)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/[{name[0]}]{name[1:]}.parquet")

    def one(batch: DataFrame, number: int) -> None:
        put = lambda rows, part: step(rows.drop(FILE)).write.mode("overwrite").parquet(f"{root}/out/slice={number}/part={part}")
        try:
            put(batch, 0)
            return
        except Exception as error:  # whatever a step may raise; each file says below whether it was the one
            reason = error
        failed = []
        for part, file in enumerate(sorted(r[0] for r in batch.select(FILE).distinct().collect())):  # at most `files`
            try:
                put(batch.where(F.col(FILE) == file), part)
            except Exception as error:
                reason = error
                failed.append((number, file, str(reason).strip().splitlines()[0][:500]))
        if failed:
            spark.createDataFrame(failed, WARNING).write.mode("overwrite").json(f"{root}/warnings/{number}")

    query = source.withColumn(FILE, F.col("_metadata.file_path")).writeStream.foreachBatch(one).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return f"{root}/out"


WARNING = "slice int, file string, reason string"


def warnings(spark: SparkSession, out: str) -> DataFrame:
    """(slice, file, reason) of the files that a walk went past; out: what walk returned."""
    root = out.removesuffix("/out")
    return found_or_empty(spark, lambda: spark.read.schema(WARNING).json(f"{root}/warnings/*"), WARNING)


def found_or_empty(spark: SparkSession, read: Callable[[], DataFrame], schema) -> DataFrame:
    """What read gives, or an empty frame where nothing has been written."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def remember(spark: SparkSession, changes: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The latest value of each key of a stream, as a table that a batch reads when the stream is drained. Each micro-batch
    writes the keys that it changed alone. A stream without rows gives an empty table."""
    out = f"{fresh_folder(spark)}/latest"
    state = changes.groupBy(key).agg(F.max(F.struct(order, value)).alias("last"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")

    query = state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    changed = found_or_empty(spark, lambda: spark.read.schema(state.schema).parquet(f"{out}/*"), state.schema)
    return changed.groupBy(key).agg(F.max("last").alias("last")).select(key, f"last.{order}", f"last.{value}")


def throttle(changes: DataFrame, key: str, at: str, wait_ms: int) -> DataFrame:
    """(key, opened, written, n): a key's first change starts a timer that later changes don't move; when it ends, what is
    there then is written and the next change starts another. A sorted stream per key, folded without holding it."""
    rows = changes.select(key, F.unix_micros(at).alias("t")).repartition(key).sortWithinPartitions(key, "t")
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, opened, last, n, kind_ = None, None, None, 0, None

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * 4
            batch = pa.RecordBatch.from_arrays([pa.array(list(cols[0]), kind_ or pa.int64()), *(pa.array(list(c), pa.int64()) for c in cols[1:])], names=[key, "opened", "last", "n"])
            out.clear()
            return batch

        for batch in batches:
            kind_ = batch.schema.field(key).type
            for k, t in zip(batch.column(key).to_pylist(), batch.column("t").to_pylist(), strict=True):
                if opened is None or k != now or t > opened + wait_ms * 1000:
                    if opened is not None:
                        out.append((now, opened, last, n))
                    now, opened, n = k, t, 0
                last, n = t, n + 1
            if len(out) > 50_000:
                yield flush()
        if opened is not None:
            out.append((now, opened, last, n))
        yield flush()

    folded = rows.mapInArrow(run, f"{key} {kind}, opened long, last long, n long")
    return folded.select(key, F.timestamp_micros("opened").cast("timestamp_ntz").alias("opened"), F.timestamp_micros("last").cast("timestamp_ntz").alias("last"), "n")
