"""Formations: their slots, and who takes which."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.assignment import nearest_slots, points_of

#: Sizes of formations, and when a drone counts as in its slot and a swarm as settled.
RADIUS, SPACING = 5.0, 2.0
IN_SLOT, CONVERGED = 0.5, 0.85


def slots_column(shape: Column, n: Column, radius: Column, spacing: Column, heading: Column) -> Column:
    """array<struct<x, y>> of a circle's or line's slots, as an expression."""
    k = F.sequence(F.lit(0), n - 1)

    def slot(i: Column) -> Column:
        turn = i * (2 * np.pi) / n
        x = F.when(shape == "circle", radius * F.cos(turn)).otherwise(F.lit(0.0))
        y = F.when(shape == "circle", radius * F.sin(turn)).otherwise((i - (n - 1) / 2.0) * spacing)
        return F.struct((x * F.cos(heading) - y * F.sin(heading)).alias("x"), (x * F.sin(heading) + y * F.cos(heading)).alias("y"))

    return F.transform(k, slot)


def assigned(rows: DataFrame, keys: list[str], place: str, own: list[str], slots: Column) -> DataFrame:
    """keys, slot of each member in order of `place` (array, from 0), and the sum of squared distances, of each group's members against its slots (an array of arrays of numbers). A group is a formation: few members."""
    axes = [F.col(a).cast("double").alias(f"_{k}") for k, a in enumerate(own)]
    each = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("_place"), *axes))).alias("m"))
    points = points_of(*[F.col("m")[f"_{k}"] for k in range(len(own))])
    return each.withColumn("a", nearest_slots(points, slots)).select(*keys, F.size("m").alias("n"), "a.slots", "a.cost")
