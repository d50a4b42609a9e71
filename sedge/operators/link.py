"""From commands to flight: what a consumer says of each message, where the swarm is sent, and what recorded flights say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.command import LIMITS, legal
from . import swarm

#: The height of a take-off that names none, unit steps of the directions.
TAKEOFF_Z = 2.0
UNIT = {"north": (0, 1, 0), "south": (0, -1, 0), "east": (1, 0, 0), "west": (-1, 0, 0), "up": (0, 0, 1), "down": (0, 0, -1), "forward": (0, 1, 0), "back": (0, -1, 0), "left": (-1, 0, 0), "right": (1, 0, 0)}


# ---------------------------------------------------------------- messages


def outcome_text(stale: Column, mark: Column, state: Column, asked: Column, dispatched: Column) -> Column:
    """What a consumer records of a message. The formats of its texts."""
    return (
        F.when(stale, F.concat(F.lit("discarded: older than reflex #"), mark.cast("string"))).when(dispatched.isNull() & (asked == "unknown"), F.lit("logged, never dispatched"))
        .when(dispatched.isNull() & (asked == "abort"), F.concat(F.lit("logged no-op: abort in "), state))
        .when(dispatched.isNull(), F.concat(F.lit("not dispatched: illegal in "), state, F.lit(", and so is a hold")))
        .when((dispatched == "hover") & (asked != "hover"), F.concat(F.lit("rejected in "), state, F.lit(" -> hold position"))).otherwise(dispatched)
    )


def command_text(intent: Column, slots: Column) -> Column:
    """intent (slot value, ...) of a map of slots, in its order; the bare intent without any."""
    rest = F.array_join(F.transform(F.map_entries(slots), lambda e: F.concat_ws(" ", e["key"], e["value"])), ", ")
    return F.when(F.size(slots) > 0, F.concat(intent, F.lit(" ("), rest, F.lit(")"))).otherwise(intent)


def reserved(messages: DataFrame, key: str, started: list[str], published: list[str]) -> DataFrame:
    """messages with seq, given when their processing starts, and arrival, their place when published: a slow one arrives with an old number."""
    by = lambda cols: F.row_number().over(Window.partitionBy(key).orderBy(*cols)).cast("bigint")
    return messages.withColumn("seq", by(started)).withColumn("arrival", by(published))


def scripted(steps: DataFrame, script: str) -> DataFrame:
    """script, step, seq, arrival, branch, intent of scripts' actions (script, step, place, path, intent): a path `B-stale` takes its number before the others of its step and is sent after them, as B."""
    late = F.col("path") == "B-stale"
    rows = steps.withColumn("_late", late.cast("int")).withColumn("_early", 1 - late.cast("int"))
    return reserved(rows, script, ["step", "_early", "place"], ["step", "_late", "place"]).select(script, "step", "seq", "arrival", F.when(late, "B").otherwise(F.col("path")).alias("branch"), "intent")


def sampled(trajectory: DataFrame, keys: list[str], at: str, every: float) -> DataFrame:
    """The last row of each key in every stretch of `every` seconds that has one; a late tick is in the stretch it fell in, none is made up."""
    stretch = F.floor(F.round(F.col(at) / every, 6)).alias("stretch")
    row = F.struct(*trajectory.columns)
    return trajectory.groupBy(*keys, stretch).agg(F.max_by(row, at).alias("r")).select("stretch", "r.*")


# ---------------------------------------------------------------- targets


def retarget(positions: Column, targets: Column, command: Column, state: Column, flying: Column) -> Column:
    """The targets after a command (array of x, y, z): a second guard refuses what is illegal in the state (null), what the controller can't do holds position, or nothing if it isn't flying.

    command: a struct intent, z, pos, dir, dist, shape, radius, spacing, ids.
    """
    intent = command["intent"]
    at = lambda p, x=None, y=None, z=None: F.struct((p["x"] if x is None else x).alias("x"), (p["y"] if y is None else y).alias("y"), (p["z"] if z is None else z).alias("z"))
    now = F.when(F.size(targets) > 0, targets).otherwise(positions)
    mean = lambda a, c: F.aggregate(a, F.lit(0.0), lambda s, p: s + p[c]) / F.size(a)
    step = F.try_element_at(F.create_map(*[x for k, v in UNIT.items() for x in (F.lit(k), F.array(*[F.lit(float(u)) for u in v]))]), command["dir"])
    delta = [F.when(command["pos"].isNotNull(), F.get(command["pos"], F.lit(k)) - mean(now, c)).otherwise(F.get(step, F.lit(k)) * command["dist"]) for k, c in enumerate("xyz")]
    moved = F.transform(now, lambda p: at(p, p["x"] + delta[0], p["y"] + delta[1], F.greatest(p["z"] + delta[2], F.lit(LIMITS["z"][0]))))
    slots = swarm.slots_column(command["shape"], F.size(positions), F.coalesce(command["radius"], F.lit(swarm.RADIUS)), F.coalesce(command["spacing"], F.lit(swarm.SPACING)), F.lit(0.0))
    formed = F.transform(slots, lambda s: F.struct((s["x"] + mean(positions, "x")).alias("x"), (s["y"] + mean(positions, "y")).alias("y"), mean(positions, "z").alias("z")))
    able = (command["ids"].isNull() | intent.isin("takeoff", "land")) & ((intent != "formation") | command["shape"].isin("circle", "line"))
    made = (
        F.when(intent == "takeoff", F.transform(positions, lambda p: at(p, z=F.coalesce(command["z"], F.lit(TAKEOFF_Z))))).when(intent == "formation", formed).when(intent == "hover", positions)
        .when(intent == "move", moved).when(intent == "altitude", F.transform(now, lambda p: at(p, z=command["z"]))).when(intent.isin("land", "abort"), F.transform(positions, lambda p: at(p, z=F.lit(0.0))))
    )
    held = F.when(flying & legal(F.lit("hover"), state), positions).otherwise(targets)
    return F.when(legal(intent, state), F.when(able & made.isNotNull(), made).otherwise(held))


# ---------------------------------------------------------------- recorded trajectories


def closest_pairs(trajectory: DataFrame, keys: list[str], drone: str, below: float) -> DataFrame:
    """Per key (a trial's tick): the closest two drones, their distance, and how many pairs are closer than `below`. trajectory: keys, drone, x, y, z; few drones a tick, so pairs are made inside it."""
    one = trajectory.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(drone).alias("d"), "x", "y", "z"))).alias("all"))
    pair = lambda a, b: F.struct(F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]) + (a["z"] - b["z"]) * (a["z"] - b["z"])).alias("distance"), a["d"].alias("a"), b["d"].alias("b"))
    pairs = F.flatten(F.transform("all", lambda a: F.transform(F.filter("all", lambda b: b["d"] > a["d"]), lambda b: pair(a, b))))
    return one.withColumn("p", pairs).where(F.size("p") > 0).select(*keys, F.array_min("p").alias("m"), F.size(F.filter("p", lambda x: x["distance"] < below)).alias("n_below")).select(*keys, "m.a", "m.b", "m.distance", "n_below")


def in_slot_shares(trajectory: DataFrame, keys: list[str], at: str, error: str, within: float = swarm.IN_SLOT) -> DataFrame:
    """Per key and tick the share of drones within reach of their slots."""
    return trajectory.groupBy(*keys, at).agg(F.avg((F.col(error) <= within).cast("double")).alias("share"))


def first_settled(shares: DataFrame, keys: list[str], at: str, least: float = swarm.CONVERGED) -> DataFrame:
    """Per key the first tick at which the share is reached; null if it never is."""
    return shares.groupBy(*keys).agg(F.min(F.when(F.col("share") >= least, F.col(at))).alias("first"))
