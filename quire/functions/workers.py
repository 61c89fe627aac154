"""What a cluster needs: the package at the Python workers, a shared folder, and lineage cut there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(df: DataFrame) -> DataFrame:
    """Make sure that workers can import this package, wherever the driver found it; returns df."""
    sc = df.sparkSession.sparkContext
    if sc.applicationId not in _shipped:
        top = Path(__file__).resolve().parents[1]
        name = Path(tempfile.mkdtemp(prefix="quire-")) / "quire_package.zip"
        with zipfile.ZipFile(name, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        sc.addPyFile(str(name))
        _shipped.add(sc.applicationId)
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a run inside one process (local master: tests, trials) may leave it
    unset, and gets a temporary one; a cluster without the setting is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = sc._jsc.sc().getCheckpointDir()
    if not held.isEmpty():
        return held.get()
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="quire-checkpoint-")


def cut(df: DataFrame) -> DataFrame:
    """df from a reliable checkpoint in the shared folder, so that what follows does not run it again."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
