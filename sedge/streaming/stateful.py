"""The ordered operators as keyed state over micro-batches; results equal their batch forms.

Each operator folds a key's rows of a micro-batch, in their order, into a small tuple of state:
whole columns at once where that can be, row by row where the state decides. Across
micro-batches rows count as they arrive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..functions.command import LEGAL


def folded(stream: DataFrame, key: str, order: str, fold: Callable[[tuple, pd.DataFrame], tuple[tuple, pd.DataFrame]], start: tuple, state_schema: str, out_schema: str, columns: list[str]) -> DataFrame:
    """Apply fold(state, rows in order) -> (state, output rows) to each key's rows of a micro-batch; only `columns` are sent to it. The key must be a bigint and out_schema must start with it."""
    names = [f.split()[0] for f in out_schema.split(", ")]

    def run(k: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts), ignore_index=True).sort_values(order, kind="stable", ignore_index=True)
        state, out = fold(held.get if held.exists else start, rows)
        held.update(state)
        out.insert(0, key, k[0])
        yield out[names]

    return stream.select(key, *dict.fromkeys([order, *columns])).groupBy(key).applyInPandasWithState(run, out_schema, state_schema, "append", "NoTimeout")


def keyed(stream: DataFrame, key: str, order: str, step: Callable[..., tuple[tuple, tuple | None]], start: tuple, state_schema: str, out_schema: str, columns: list[str]) -> DataFrame:
    """folded() for what needs the state row by row: step(state, order, *columns) -> (state, output values after the key, or None)."""
    names = [f.split()[0] for f in out_schema.split(", ")][1:]

    def fold(state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        made = []
        for values in zip(*[rows[c].tolist() for c in (order, *columns)], strict=True):
            state, out = step(state, *values)
            if out is not None:
                made.append(out)
        return state, pd.DataFrame(made, columns=names)

    return folded(stream, key, order, fold, start, state_schema, out_schema, columns)


def high_water(stream: DataFrame, key: str, order: str = "event_id") -> DataFrame:
    """Messages (seq, branch) with `stale`: a B below the highest A so far."""

    def fold(state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        mark = rows["seq"].where(rows["branch"] == "A", -1).cummax().clip(lower=state[0])
        return (int(mark.iloc[-1]),), pd.DataFrame({"event_id": rows[order], "stale": (rows["branch"] == "B") & (rows["seq"] < mark)})

    return folded(stream, key, order, fold, (-1,), "mark bigint", f"{key} bigint, event_id bigint, stale boolean", ["seq", "branch"])


def debounced(stream: DataFrame, key: str, order: str, score: str, threshold: float, gap: int) -> DataFrame:
    """Rows that fire: at threshold, more than gap after the last that was."""

    def fold(state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        at = rows.loc[rows[score] >= threshold, order]
        before = at.shift()
        if len(at) and state[1]:
            before.iloc[0] = state[0]
        fires = at[before.isna() | (at - before > gap)]
        return (int(at.iloc[-1]), True) if len(at) else state, pd.DataFrame({"event_id": fires})

    return folded(stream, key, order, fold, (0, False), "last bigint, seen boolean", f"{key} bigint, event_id bigint", [score])


def best_frame(df: DataFrame, keys: list[str], label: str, score: str, priority: list[str]) -> DataFrame:
    """Of each frame's detector scores the best one with its label; equal ones go by the labels' priority."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col(label))
    return df.groupBy(*keys).agg(F.max_by(F.struct(label, score), F.struct(F.col(score), -rank)).alias("b")).select(*keys, "b.*")


def flight_states(stream: DataFrame, key: str, order: str = "event_id") -> DataFrame:
    """Intents with the state after each and what is dispatched."""
    moves = {"takeoff": "TAKING_OFF", "land": "LANDING", "abort": "ABORTED"}
    signals = {"altitude_reached": ("TAKING_OFF", "FLYING"), "ground_contact": ("LANDING", "LANDED"), "reset": ("ABORTED", "LANDED")}

    def step(state: tuple, at: int, intent: str) -> tuple[tuple, tuple]:
        now, sent = state[0], None
        if intent in signals:
            now = signals[intent][1] if now == signals[intent][0] else now
        elif now in LEGAL.get(intent, ()):
            sent, now = intent, moves.get(intent, now)
        elif intent not in ("abort", "unknown") and now in LEGAL["hover"]:
            sent = "hover"
        return (now,), (at, now, sent)

    return keyed(stream, key, order, step, ("LANDED",), "state string", f"{key} bigint, event_id bigint, state string, dispatched string", ["intent"])


def endpoints(stream: DataFrame, key: str, order: str, prob: str, onset: float = 0.5, hysteresis: float = 0.15, silence: int = 14, pad: int = 6, longest: int = 468) -> DataFrame:
    """Utterances (start, end, t0, forced) as they end; see operators.ordered.endpoints."""

    def step(state: tuple, _: int, p: float) -> tuple[tuple, tuple | None]:
        free, is_open, start, quiet, i = state
        done = i + 1
        if p >= onset:
            quiet = -1
            if not is_open:
                is_open, start = True, max(free, i - pad)
        low = is_open and p < onset - hysteresis
        if low and quiet < 0:
            quiet = i
        ends = low and done - quiet >= silence
        forced = not ends and is_open and done - start >= longest
        if not (ends or forced):
            return (free, is_open, start, quiet, done), None
        return (done, False, 0, -1, done), (start, min(quiet + pad, done) if ends else done, done, forced)

    state = "free bigint, open boolean, start bigint, quiet bigint, i bigint"
    return keyed(stream, key, order, step, (0, False, 0, -1, 0), state, f"{key} bigint, start bigint, end bigint, t0 bigint, forced boolean", [prob])


def reflex_gate(stream: DataFrame, key: str, order: str, keep_s: float) -> DataFrame:
    """Utterances (kind 'utterance', at: their start) at their arrival, suppressed by a reflex (kind 'reflex', at: when it fired) at or after their start and seen before; the earliest owns it, older ones than an utterance's start expire.

    A reflex more than keep_s older than the newest one expires too, so a key's state holds the reflexes of
    keep_s seconds at most; keep_s must be as long as an utterance may be from its start to its arrival.
    """

    def step(state: tuple, at: int, kind: str, when: float) -> tuple[tuple, tuple | None]:
        fired = state[0]
        if kind == "reflex":
            return ([*(t for t in fired if t >= when - keep_s), float(when)],), None
        fired = [t for t in fired if t >= when]
        return (fired,), (at, min(fired, default=None))

    return keyed(stream, key, order, step, ([],), "fired array<double>", f"{key} bigint, event_id bigint, reflex double", ["kind", "at"])
