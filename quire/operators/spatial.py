"""Matches of points within a tolerance on both axes.

A grid as wide as the tolerance turns the band join into an equi-join: each probe looks into 3 x 3 cells, and an exact test
follows. Without the grid Catalyst would compare all pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The tolerance of positions; a fixed value.
EPSILON = 0.05


def _cell(c: str, eps: float):
    return F.floor(F.col(c) / eps + 0.5).cast("long")


def neighbours(probes: DataFrame, points: DataFrame, probe_key: str, point_key: str, eps: float = EPSILON) -> DataFrame:
    """(probe_key, point_key, dx, dy) of all pairs within eps on both axes; probes and points hold x and y."""
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    p = probes.select(probe_key, F.col("x").alias("px"), F.col("y").alias("py"), _cell("x", eps).alias("cx"), _cell("y", eps).alias("cy"), F.explode(around).alias("o"))
    p = p.select(probe_key, "px", "py", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
    q = points.select(point_key, F.col("x").alias("qx"), F.col("y").alias("qy"), _cell("x", eps).alias("cx"), _cell("y", eps).alias("cy"))
    near = p.join(q, ["cx", "cy"]).where((F.abs(F.col("px") - F.col("qx")) <= eps) & (F.abs(F.col("py") - F.col("qy")) <= eps))
    return near.select(probe_key, point_key, (F.col("px") - F.col("qx")).alias("dx"), (F.col("py") - F.col("qy")).alias("dy"))


def unique_neighbour(probes: DataFrame, points: DataFrame, probe_key: str, point_key: str, eps: float = EPSILON) -> DataFrame:
    """The one point near each probe; a probe near two different points has none."""
    near = neighbours(probes, points, probe_key, point_key, eps)
    one = near.groupBy(probe_key).agg(F.min(point_key).alias(point_key), F.max(point_key).alias("last"))
    return one.where(F.col(point_key) == F.col("last")).drop("last")


def conflicts(probes: DataFrame, points: DataFrame, probe_key: str, point_key: str, code: str, eps: float = EPSILON) -> DataFrame:
    """Probes with a point of another code nearby; both sides hold `code`."""
    near = neighbours(probes, points, probe_key, point_key, eps)
    a = probes.select(probe_key, F.col(code).alias("code_a"))
    b = points.select(point_key, F.col(code).alias("code_b"))
    return near.join(a, probe_key).join(b, point_key).where("code_a <> code_b").select(probe_key).distinct()
