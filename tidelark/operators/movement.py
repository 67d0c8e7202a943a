"""Concurrent events, movement between rooms and zones, and what is impossible in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelark.operators.temporal import SECOND, Counted, interval_join, micros, nearby, neighbour, seconds_between

#: Least seconds between two rooms, whichever comes first; 2 for other pairs.
ROOM_SECONDS = [("bedroom", "kitchen", 4.0), ("bedroom", "office", 3.0), ("office", "kitchen", 3.0), ("living_kitchen", "bedroom", 4.0), ("living_kitchen", "office", 3.0)]


def _pair_map(pairs) -> Column:
    return F.create_map(*[x for a, b, s in pairs for x in (F.lit("|".join(sorted((a, b)))), F.lit(float(s)))])


def least_seconds(a: str | Column, b: str | Column, pairs, default: float | None) -> Column:
    """Looks the pair up in either order."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    found = F.try_element_at(_pair_map(pairs), F.concat_ws("|", F.least(a, b), F.greatest(a, b)))
    return F.coalesce(found, F.lit(default)) if default is not None else found


def concurrent_counts(events: DataFrame, within_s: float = 5) -> DataFrame:
    """Adds concurrent, events of other entities within ``within_s`` on either side, and cross_room, those of other rooms."""
    near = nearby(events, within_s, within_s, {"_all": Counted(), "_entity": Counted(keys=("entity_id",)), "_room": Counted(keys=("room",))})
    return near.select(*events.columns, (F.col("_all") - F.col("_entity")).alias("concurrent"), (F.col("_all") - F.col("_room")).alias("cross_room"))


def concurrent_entities(events: DataFrame, within_s: float = 5) -> DataFrame:
    """Adds the sorted other entities with an event within ``within_s`` on either side."""
    found = nearby(events, within_s, within_s, {"_set": lambda w: F.collect_set("entity_id").over(w)})
    return found.select(*events.columns, F.sort_array(F.array_remove("_set", F.col("entity_id"))).alias("concurrent_entities"))


def room_state(events: DataFrame, within_s: float = 30) -> DataFrame:
    """Adds the sorted active subzones and full zones of the same room within ``within_s`` on either side."""
    active = F.col("state").isin("on", "open", "detected")
    zones = lambda kind: lambda w: F.sort_array(F.collect_set(F.when(active & (F.col("zone_type") == kind), F.col("zone"))).over(w))
    return nearby(events, within_s, within_s, {"active_subzones": zones("subzone"), "active_full_zones": zones("full")}, keys=("room",))


def rapid_movements(events: DataFrame, within_s: float = 3) -> DataFrame:
    """Pairs of active presence events in different rooms less than ``within_s`` apart, the earlier first."""
    seen = events.where("sensor_type = 'presence' AND state = 'on'").select("event_id", "ts", "room", "entity_id")
    other = seen.select(F.col("event_id").alias("to_id"), F.col("ts").alias("to_ts"), F.col("room").alias("to_room"), F.col("entity_id").alias("to_entity"))
    pairs = interval_join(seen, other, [], "ts", "to_ts", 0, within_s).where("room <> to_room AND to_ts > ts")
    dt = seconds_between("to_ts", "ts")
    return pairs.where(dt < within_s).select("event_id", "to_id", "ts", F.col("room").alias("from_room"), "to_room", dt.alias("dt_s"), F.lit("rapid_movement_anomaly").alias("anomaly_type"), F.lit(0.8).alias("anomaly_score"))


def door_between(moves: DataFrame, doors: DataFrame, start: str, end: str, room: str, longest_s: float) -> DataFrame:
    """Moves whose room had a door event in (start, end]; moves last at most ``longest_s``."""
    opened = doors.select(F.col("room").alias(room), F.col("ts").alias("_door"))
    return interval_join(moves, opened, [room], end, "_door", -longest_s, 0, how="left_semi", extra=F.col("_door") > F.col(start))


def general_presence(events: DataFrame, within_s: float = 30) -> DataFrame:
    """Active full-zone events without an active subzone of their room within ``within_s``."""
    active = events.where(F.col("state").isin("on", "open", "detected"))
    sub = active.where("zone_type = 'subzone'").select("room", F.col("ts").alias("_sub"))
    return interval_join(active.where("zone_type = 'full'"), sub, ["room"], "ts", "_sub", -within_s, within_s, how="left_anti")


def subzone_transitions(events: DataFrame, key: str = "room") -> DataFrame:
    """Active subzone events whose key's next subzone event is active in another zone: from, to, seconds."""
    sub = events.where("zone_type = 'subzone'")
    w = W.partitionBy(key).orderBy("ts", "event_id")
    on = F.col("state").isin("on", "open", "detected")
    moved = sub.select(key, "ts", "event_id", "zone", on.alias("_on"), F.lead("zone").over(w).alias("to_zone"), F.lead(on).over(w).alias("_to_on"), F.lead("ts").over(w).alias("_to"))
    return moved.where("_on AND _to_on AND zone <> to_zone").select(key, "ts", "event_id", F.col("zone").alias("from_zone"), "to_zone", seconds_between("_to", "ts").alias("dt_s"))


def granularity(events: DataFrame) -> DataFrame:
    """Adds the class of each event and the next: precise, general, hybrid, or null without a pair of known zones."""
    paired = neighbour(events, ["zone_type"], ahead=True)
    a, b = F.col("zone_type"), F.col("next_zone_type")
    kind = F.when((a == "subzone") & (b == "subzone"), "precise").when((a == "full") & (b == "full"), "general").when(a.isin("full", "subzone") & b.isin("full", "subzone"), "hybrid")
    return paired.withColumn("granularity", kind)


def sequential_activations(events: DataFrame, window_s: int = 60, within_s: float = 30) -> DataFrame:
    """Consecutive events inside one tumbling window, more than 0 and at most ``within_s`` apart."""
    w = W.partitionBy("_w").orderBy("ts", "event_id")
    step = events.withColumn("_w", F.floor(micros("ts") / (window_s * SECOND)))
    step = step.select("event_id", "ts", "entity_id", F.lead("entity_id").over(w).alias("next_entity"), F.lead("ts").over(w).alias("_next"))
    dt = seconds_between("_next", "ts")
    return step.where((dt > 0) & (dt <= within_s)).select("event_id", "entity_id", "next_entity", dt.alias("dt_s"))


def quiet_periods(events: DataFrame, least_s: float = 3600, keys: tuple[str, ...] = ()) -> DataFrame:
    """Gaps above ``least_s`` between consecutive events, of all or of each key."""
    if keys:
        w = W.partitionBy(*keys).orderBy("ts", "event_id")
        paired = events.withColumn("next_ts", F.lead("ts").over(w))
    else:
        paired = neighbour(events, ["ts"], ahead=True)
    gap = seconds_between("next_ts", "ts")
    return paired.where(gap > least_s).select(*keys, F.col("ts").alias("start_ts"), F.col("next_ts").alias("end_ts"), gap.alias("gap_s"))


def velocities(events: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy("ts", "event_id")
    dt = seconds_between("ts", F.lag("ts").over(w))
    return events.withColumn("dt_s", dt).withColumn("velocity", F.when(F.col("dt_s") > 0, 1 / F.col("dt_s")))


def impossible_moves(events: DataFrame, zone_pairs=(), room_pairs=ROOM_SECONDS, fastest_s: float = 0.5) -> DataFrame:
    """Consecutive events with dt_s and a reason: inter_room_speed, subzone_speed or normal_precision_change, or null."""
    cols = ["room", "zone", "zone_type", "ts", "event_id"]
    paired = neighbour(events, cols)
    dt = F.abs(seconds_between("ts", "prev_ts"))
    rooms = F.col("room") != F.col("prev_room")
    zones = (F.col("zone") != F.col("prev_zone")) & (F.col("zone_type") == "subzone") & (F.col("prev_zone_type") == "subzone")
    by_zone = least_seconds("zone", "prev_zone", zone_pairs, None) if zone_pairs else F.lit(None).cast("double")
    reason = (
        F.when(rooms, F.when((F.col("room") != "") & (F.col("prev_room") != "") & (dt < least_seconds("room", "prev_room", room_pairs, 2.0)), "inter_room_speed"))
        .when(zones, F.when((dt < fastest_s) | F.coalesce(dt < by_zone, F.lit(False)), "subzone_speed"))
        .when(F.col("zone_type") != F.col("prev_zone_type"), "normal_precision_change")
    )
    return paired.select("event_id", "prev_event_id", "room", "prev_room", "prev_ts", "ts", dt.alias("dt_s"), reason.alias("reason"))


def sequence_features(events: DataFrame, gap_s: float = 30, keys: tuple[str, ...] = ("person",)) -> DataFrame:
    """One row for each session of a key (cut at gaps above ``gap_s``) with the features of a movement sequence and the pet rule."""
    w = W.partitionBy(*keys).orderBy("ts", "event_id")
    dt = seconds_between("ts", F.lag("ts").over(w))
    stepped = events.withColumn("_dt", dt).withColumn("_s", F.sum(F.when(F.col("_dt") > gap_s, 1).otherwise(0)).over(w))
    inside = F.when(F.col("_dt") <= gap_s, F.col("_dt"))
    out = stepped.groupBy(*keys, F.col("_s").alias("session")).agg(
        F.count("*").alias("length"),
        ((F.max(micros("ts")) - F.min(micros("ts"))) / SECOND).alias("duration_s"),
        F.count_distinct("room").alias("rooms"),
        F.count_distinct("zone_type").alias("zone_types"),
        F.count(F.when(inside < 0.5, 1)).alias("simultaneous"),
        F.count(F.when(inside < 2, 1)).alias("fast"),
    )
    return out.withColumn("is_pet", (F.col("length") > 1) & ((F.col("fast") > 2) | (F.col("simultaneous") > 1) | (F.col("duration_s") < 1)))


def zone_coverage(events: DataFrame) -> DataFrame:
    full, sub = F.count(F.when(F.col("zone_type") == "full", 1)), F.count(F.when(F.col("zone_type") == "subzone", 1))
    return events.groupBy("room").agg(F.when(full > 0, F.least(F.lit(1.0), sub / full)).otherwise(0.0).alias("coverage"))


def periodic_entities(events: DataFrame, least_events: int = 3, most_cv: float = 0.3) -> DataFrame:
    """Entities with enough gaps of little variation: mean and population variance of the gaps."""
    w = W.partitionBy("entity_id").orderBy("ts", "event_id")
    gaps = events.withColumn("_g", seconds_between("ts", F.lag("ts").over(w)))
    out = gaps.groupBy("entity_id").agg(F.count("*").alias("n"), F.count("_g").alias("gaps"), F.avg("_g").alias("mean_gap_s"), F.var_pop("_g").alias("var_gap"))
    return out.where((F.col("n") >= least_events) & (F.col("gaps") >= 3) & (F.col("mean_gap_s") > 0) & (F.sqrt("var_gap") < most_cv * F.col("mean_gap_s")))


def bursts(events: DataFrame, window_s: int = 300, spread: float = 2.0) -> DataFrame:
    """Non-empty windows with more events than mean + spread * std of all of them."""
    counts = events.groupBy(F.floor(micros("ts") / (window_s * SECOND)).alias("bucket")).agg(F.count("*").alias("n"))
    mean, std = counts.agg(F.avg("n"), F.stddev_pop("n")).first()  # two numbers
    return counts.where(F.col("n") > (mean or 0) + spread * (std or 0))


def simultaneous(events: DataFrame, ts: str = "ts") -> DataFrame:
    return events.groupBy(ts).agg(F.sort_array(F.collect_list("entity_id")).alias("entities"), F.count("*").alias("n")).where("n >= 2")
