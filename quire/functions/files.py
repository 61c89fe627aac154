"""Files of whatever store Spark can reach, through its own file systems: for markers and pointers, not for data."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    """The file or folder, if it is there."""
    fs, p = _at(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder, in order; nothing if there is no such folder."""
    fs, p = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def put_new(spark: SparkSession, path: str, content: str) -> bool:
    """Write a small file unless it is there; whether this call has written it. The content is written beside it first, and a
    rename that replaces nothing makes it visible, so a reader sees the whole of it or none."""
    fs, p = _at(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{spark._jvm.java.util.UUID.randomUUID()}.part")
    stream = fs.create(part, True)
    stream.write(content.encode())
    stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    p, part = fs.makeQualified(p), fs.makeQualified(part)
    context = hadoop.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    try:
        context.rename(part, p, none)
        return True
    except Py4JJavaError as error:
        fs.delete(part, False)
        if "FileAlreadyExistsException" not in str(error.java_exception):
            raise
        return False


def text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
