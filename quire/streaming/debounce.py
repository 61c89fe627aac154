"""Queries that are typed: each waits until nothing has been typed for a while, and a key may send or drop it.

A stream that remembers one pending text a key and when it is due. What is typed replaces it and moves the time; `enter` sends it at
once and stops the wait, `escape` drops it; when the time comes without either, it is sent. Waits run on event time, so a query is
sent when the stream's watermark - the latest time seen - has reached its time, whatever the wall clock says, and with the same
folder a later run knows what is pending.

A batch's rows come behind what was pending before it, and whether a query is sent follows from its key's next row, so all of it is
a window of Spark's: no worker is asked for a key, and the rows of a key are never held. Only what is not yet due is remembered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .streams import found_or_empty, fresh_folder

SENT = "key string, text string, sent long, cause string"
#: What a batch has made: a folder each, in it what was sent and what still waits.
MADE = f"{SENT}, waiting boolean"
#: The latest time at the end of a batch, in microseconds.
MARK = "batch long, latest long"


def _settled(rows: DataFrame, latest: int | None) -> DataFrame:
    """MADE of rows (key, text, kind, at, n, due, held): of each key what was held comes first, then its rows by time and number."""
    following = F.lead("at").over(Window.partitionBy("key").orderBy(F.desc("held"), "at", "n"))
    each = rows.withColumn("following", following).where("kind = 'enter' or kind = 'type' and (following is null or due <= following)")
    entered = F.col("kind") == "enter"
    return each.select(
        "key", "text", F.when(entered, F.col("at")).otherwise(F.col("due")).alias("sent"), F.when(entered, "enter").otherwise("wait").alias("cause"),
        (~entered & F.col("following").isNull() & (F.col("due") > F.lit(latest))).alias("waiting"),
    )


def sent_queries(spark: SparkSession, events: DataFrame, wait_ms: int, folder: str | None = None) -> tuple[DataFrame, str]:
    """(key, text, sent in microseconds, cause) of all queries that the stream sends, and the folder: a call with the same one
    goes on where this one has ended. What is pending when the stream is drained stays so; see `pending`.

    events: a stream of (key string, at timestamp, n long, kind, text); kinds are type, enter and escape, others and null do
    nothing. n orders events of equal time. Rows without key or time are left out; a row that is older than the watermark, the
    latest time of an earlier batch, comes too late and is dropped. A batch that runs again after a loss replaces what it made."""
    root = folder or fresh_folder(spark)
    rows = events.where("key is not null and at is not null").select("key", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "n", "kind", "text")

    def one(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        before = _mark(own, root, number - 1)
        known = None if before is None else before[1]
        latest = max((t for t in (known, batch.agg(F.max("at")).first()[0]) if t is not None), default=None)
        fresh = batch.where(F.col("kind").isin("type", "enter", "escape"))
        if known is not None:
            fresh = fresh.where(F.col("at") >= known)
        fresh = fresh.select("key", "text", "kind", "at", "n", (F.col("at") + wait_ms * 1000).alias("due"), F.lit(False).alias("held"))
        if before is not None:
            nothing = F.lit(None).cast("long")
            fresh = fresh.unionByName(_waiting(own, root, number - 1).select("key", "text", F.lit("type").alias("kind"), nothing.alias("at"), nothing.alias("n"), F.col("sent").alias("due"), F.lit(True).alias("held")))
        _settled(fresh, latest).write.mode("overwrite").partitionBy("waiting").parquet(f"{root}/made/batch={number}")
        own.createDataFrame([(number, latest)], MARK).coalesce(1).write.mode("overwrite").parquet(f"{root}/marks/{number}")
        if number > 1:  # nobody goes back behind the batch before
            own.createDataFrame([], SENT).write.mode("overwrite").parquet(f"{root}/made/batch={number - 2}/waiting=true")

    query = rows.writeStream.foreachBatch(one).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return found_or_empty(spark, lambda: _made(spark, root, False), SENT), root


def _made(spark: SparkSession, root: str, waiting: bool, part: str = "") -> DataFrame:
    every = spark.read.schema(f"{MADE}, batch long").option("basePath", f"{root}/made").parquet(f"{root}/made{part}")
    return every.where(F.col("waiting") == waiting).drop("waiting", "batch")


def _mark(spark: SparkSession, root: str, number: int | str) -> tuple[int, int | None] | None:
    """The number of a batch and the latest time at its end; `*` for the last one."""
    marks = found_or_empty(spark, lambda: spark.read.schema(MARK).parquet(f"{root}/marks/{number}"), MARK)
    last = marks.agg(F.max(F.struct("batch", "latest")).alias("m")).first()["m"]
    return None if last is None else (last["batch"], last["latest"])


def _waiting(spark: SparkSession, root: str, number: int) -> DataFrame:
    return _made(spark, root, True, f"/batch={number}")


def pending(spark: SparkSession, folder: str) -> DataFrame:
    """(key, text, sent, cause) of what a drained stream has pending, as the wait would send it."""
    last = _mark(spark, folder, "*")
    return spark.createDataFrame([], SENT) if last is None else _waiting(spark, folder, last[0])
