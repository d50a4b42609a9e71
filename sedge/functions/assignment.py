"""Least-cost assignment of rows to slots, many groups at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def least_cost(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each group of cost (groups, rows, slots; no more rows than slots): the slot of each row, and the potentials of rows and slots that prove it.

    Shortest augmenting paths with potentials: rows enter one by one, and each looks for the cheapest
    way to a free slot past those taken, by reduced costs. All groups take their steps together;
    those that have found their slot wait. Every row's potential plus a slot's is at most their cost, and
    equal where they are matched, so the sum of potentials is a lower bound that the assignment meets.
    """
    groups, n, m = cost.shape
    if n > m:
        raise ValueError("more rows than slots")
    u, v = np.zeros((groups, n + 1)), np.zeros((groups, m + 1))
    taken = np.zeros((groups, m + 1), np.int64)  # the row (from 1) at each slot; place 0 holds the row that enters
    every = np.arange(groups)
    for row in range(1, n + 1):
        taken[:, 0] = row
        at = np.zeros(groups, np.int64)
        nearest, before = np.full((groups, m + 1), np.inf), np.zeros((groups, m + 1), np.int64)
        passed = np.zeros((groups, m + 1), bool)
        going = every
        while len(going):
            passed[going, at[going]] = True
            here = taken[going, at[going]]
            reduced = cost[going, here - 1] - u[going, here][:, None] - v[going, 1:]
            open_slots = ~passed[going, 1:]
            better = open_slots & (reduced < nearest[going, 1:])
            near = np.where(better, reduced, nearest[going, 1:])
            before[going, 1:] = np.where(better, at[going][:, None], before[going, 1:])
            away = np.where(open_slots, near, np.inf)
            to = away.argmin(axis=1)
            step = away[np.arange(len(going)), to][:, None]
            on_way = passed[going]
            raised = np.where(on_way, step, 0.0)
            np.add.at(u, (going[:, None], taken[going]), raised)
            v[going] -= raised
            nearest[going, 1:] = np.where(open_slots, near - step, near)
            at[going] = to + 1
            going = going[taken[going, to + 1] != 0]
        back = every
        while len(back):
            prior = before[back, at[back]]
            taken[back, at[back]] = taken[back, prior]
            at[back] = prior
            back = back[prior != 0]
    slots = np.zeros((groups, n), np.int64)
    g, j = np.nonzero(taken[:, 1:])
    slots[g, taken[g, j + 1] - 1] = j
    return slots, u[:, 1:], v[:, 1:]


def squared_costs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of each point of a (groups, rows, axes) to each of b (groups, slots, axes)."""
    return ((a[:, :, None] - b[:, None]) ** 2).sum(axis=-1)


@F.pandas_udf(T.StructType().add("slots", T.ArrayType(T.IntegerType())).add("cost", "double"))
def nearest_slots(points: pd.Series, slots: pd.Series) -> pd.DataFrame:
    """For arrays of points and of slots (arrays of as many numbers each): the slot (from 0) of each point with the least sum of squared distances, and that sum. Null where either is null, or there are more points than slots."""
    out: list[tuple | None] = [None] * len(points)
    sizes: dict[tuple[int, int], list[int]] = {}
    for i, (p, s) in enumerate(zip(points, slots, strict=True)):
        if p is not None and s is not None and len(p) <= len(s):
            sizes.setdefault((len(p), len(s)), []).append(i)
    for (n, m), members in sizes.items():
        if not n:
            for i in members:
                out[i] = ([], 0.0)
            continue
        stack = lambda x, k: np.array([[list(q) for q in x.iloc[i]] for i in members], float).reshape(len(members), k, -1)
        cost = squared_costs(stack(points, n), stack(slots, m))
        best, _, _ = least_cost(cost)
        total = np.take_along_axis(cost, best[:, :, None], 2).sum(axis=(1, 2))
        for i, b, t in zip(members, best.tolist(), total.tolist(), strict=True):
            out[i] = (b, t)
    return pd.DataFrame([x or (None, None) for x in out], columns=["slots", "cost"])


def points_of(*axes: Column) -> Column:
    """An array of points from arrays of their coordinates."""
    return F.transform(F.arrays_zip(*[a.alias(f"c{k}") for k, a in enumerate(axes)]), lambda p: F.array(*[p[f"c{k}"].cast("double") for k in range(len(axes))]))
