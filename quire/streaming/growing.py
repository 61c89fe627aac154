"""A search index that grows while it is searched.

The pages' searchable texts are kept as a table in slices of the key's range, lowest pages first. A search reads what is
there, then has further slices built until its hit list is full, and stops; the next search, for whatever phrase, goes on from
there. Slices double in size: the first is 1/2^(slices - 1) of the pages, so a search of a common phrase reads little, a rare
one makes `slices` rounds at most, and no search builds more than about twice the pages that fill its list.

The range is cut once, by approximate quantiles of the key alone, and the cuts are kept with the index, so a session that takes
it up builds the same slices. A slice counts when its write is complete; one that was interrupted is written anew, the others
are never read from the source again. Rows without a key are in the first slice, as they come first in the hit list; equal keys
share a slice. An index belongs to the table it was begun with."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import files
from ..operators import search

#: Slices of an index.
SLICES = 8


class GrowingIndex:
    """The index of `runs` (key, runs) in a folder of the shared store, as far as it has been built."""

    def __init__(self, runs: DataFrame, folder: str, key: str = "page_id", slices: int = SLICES):
        self.runs, self.folder, self.key, self.spark = runs, folder, key, runs.sparkSession
        if not files.exists(self.spark, f"{folder}/cuts.json"):
            shares = [1 / 2**k for k in range(slices - 1, 0, -1)]
            found = runs.agg(F.percentile_approx(key, shares, 10_000).alias("cuts")).first()["cuts"] if shares else []
            files.put_new(self.spark, f"{folder}/cuts.json", json.dumps(sorted(set(found or []))))  # another session's, if it was first
        self.cuts = json.loads(files.text(self.spark, f"{folder}/cuts.json"))

    @property
    def slices(self) -> int:
        return len(self.cuts) + 1

    def _path(self, number: int) -> str:
        return f"{self.folder}/pages/slice={number}"

    def _range(self, number: int) -> Column:
        at, low, high = F.col(self.key), self.cuts[number - 1] if number else None, self.cuts[number] if number < len(self.cuts) else None
        inside = F.lit(True)
        if low is not None:
            inside &= at > low
        if high is not None:
            inside &= at <= high
        return at.isNull() | inside if number == 0 else inside

    def built(self, number: int) -> bool:
        return files.exists(self.spark, f"{self._path(number)}/_SUCCESS")

    def build(self, number: int) -> None:
        """Read a slice's pages and keep their texts, unless that has been done."""
        if not self.built(number):
            own = self.runs.where(self._range(number))
            own.select(self.key, search.joined(F.col("runs")).alias("norm")).write.mode("overwrite").parquet(self._path(number))

    def pages(self, first: int, end: int) -> DataFrame:
        """(key, norm) of built slices."""
        return self.spark.read.parquet(*(self._path(k) for k in range(first, end)))

    def search(self, query: str, most: int = search.MAX_HITS) -> tuple[DataFrame, bool]:
        """The first `most` hits (key, start, end) in order, and whether there are more. The index grows as far as the list needs."""
        n, found, end = len(search.normal(query)), 0, 0
        starts = search.starts(F.col("norm"), query, most + 1)  # of one page, so that a list that is cut shows
        while end < (self.slices if n else 1) and found <= most:
            self.build(end)
            found += self.pages(end, end + 1).agg(F.coalesce(F.sum(F.size(starts)), F.lit(0))).first()[0]
            end += 1
        each = self.pages(0, end).select(self.key, F.explode(starts).alias("start"))
        hits = each.select(self.key, "start", (F.col("start") + n).alias("end")).orderBy(self.key, "start").limit(most)
        return hits, found > most
