"""Tables that outlive a session: versions of a table in a folder of the shared store, and a pointer that moves at once.

A version's rows are written first, in a folder of their own; then a small file `commits/<number>` that names it is put there
by a rename that replaces nothing. The highest number is the current version, so readers see the old rows or the new ones,
never both, and an update that is interrupted leaves the old version as it was. Of two writers that began from the same version
the second fails (Conflict), or, in `update`, begins again from what the first has left. The newest `keep` versions stay
readable; older ones, and rows of interrupted updates that can't be committed any more, are deleted after a commit: the pointer
first, so that no pointer ever names rows that are gone. A reader of a version that has just been outlived by `keep` others
fails and reads again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import files
from ..operators.memory import KEEP


class Conflict(RuntimeError):
    """Another writer has published in the meantime."""


class VersionedStore:
    def __init__(self, spark: SparkSession, folder: str, keep: int = KEEP["engines"]):
        if keep < 1:
            raise ValueError("a store keeps one version at least")
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep

    def versions(self) -> list[int]:
        """Numbers of the versions that can be read, oldest first."""
        return sorted(int(n) for n in files.names(self.spark, f"{self.folder}/commits") if n.isdigit())

    def at(self, version: int) -> DataFrame:
        """The rows of a version."""
        path = files.text(self.spark, f"{self.folder}/commits/{version:012}")
        return self.spark.read.parquet(f"{self.folder}/rows/{path}")

    def current(self) -> DataFrame | None:
        """The rows of the newest version; None before the first."""
        known = self.versions()
        return self.at(known[-1]) if known else None

    def publish(self, rows: DataFrame, after: int | None = None) -> int:
        """Make rows the version that follows `after`, by default the newest there is; the new version's number."""
        last = (self.versions() or [0])[-1] if after is None else after
        number = last + 1
        name = f"{number:012}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/rows/{name}")
        if not files.put_new(self.spark, f"{self.folder}/commits/{number:012}", name):
            files.delete(self.spark, f"{self.folder}/rows/{name}")
            raise Conflict(f"version {number} is there already")
        self._forget()
        return number

    def update(self, change: Callable[[DataFrame | None], DataFrame], tries: int = 5) -> int:
        """Publish what `change` makes of the current version; it is called again when another writer was faster."""
        for left in range(tries - 1, -1, -1):
            known = self.versions()
            try:
                return self.publish(change(self.at(known[-1]) if known else None), known[-1] if known else 0)
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def _forget(self) -> None:
        known = self.versions()
        for old in known[: -self.keep]:
            files.delete(self.spark, f"{self.folder}/commits/{old:012}")
        named = {files.text(self.spark, f"{self.folder}/commits/{v:012}") for v in known[-self.keep :]}
        for name in files.names(self.spark, f"{self.folder}/rows"):
            if name not in named and int(name.partition("-")[0]) <= known[-1]:  # a later number may still be committed
                files.delete(self.spark, f"{self.folder}/rows/{name}")
