"""Columns that enrich sensor events: place, kind, calendar, flags and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelark.operators.temporal import micros

#: Ordered (substring, room) rules; the first that the id holds counts.
ROOM_RULES = [("livingroom", "livingroom"), ("kitchen", "kitchen"), ("guest", "guest_bedroom"), ("bedroom", "bedroom"), ("office", "office"), ("small_bathroom", "small_bathroom"), ("bathroom", "bathroom")]
#: The order in which a plain bedroom is tested first.
STRICT_ROOM_RULES = [("livingroom", "livingroom"), ("kitchen", "kitchen"), ("bedroom", "bedroom"), ("office", "office"), ("small_bathroom", "small_bathroom"), ("bathroom", "bathroom"), ("guest", "guest_bedroom")]
#: Ordered (substring, sensor type) rules; a door also needs its contact.
TYPE_RULES = [("presence", "presence"), ("pressence", "presence"), ("door_contact", "door"), ("contact_door", "door"), ("entrance", "entrance"), ("temperature", "temperature"), ("humidity", "humidity"), ("light", "light")]
#: Fixed values: (substring, room, zone, zone type, coverage, area, specific location); ids as they occur and their plain forms.
ZONE_RULES = [
    ("livingroom_full", "living_kitchen", "livingroom_full", "full", "general_living_area", None, None),
    ("kitchen_full", "living_kitchen", "kitchen_full", "full", "general_kitchen_area", None, None),
    ("kitchen_pressence_full", "living_kitchen", "kitchen_full", "full", "general_kitchen_area", None, None),
    ("livingroom_couch", "living_kitchen", "livingroom_couch", "subzone", None, "livingroom", "couch"),
    ("kitchen_stove", "living_kitchen", "kitchen_stove", "subzone", None, "kitchen", "stove"),
    ("kitchen_pressence_stove", "living_kitchen", "kitchen_stove", "subzone", None, "kitchen", "stove"),
    ("kitchen_sink", "living_kitchen", "kitchen_sink", "subzone", None, "kitchen", "sink"),
    ("kitchen_pressence_sink", "living_kitchen", "kitchen_sink", "subzone", None, "kitchen", "sink"),
    ("kitchen_dining", "living_kitchen", "kitchen_dining", "subzone", None, "kitchen", "dining"),
    ("kitchen_pressence_dining", "living_kitchen", "kitchen_dining", "subzone", None, "kitchen", "dining"),
    ("bedroom_full", "bedroom", "bedroom_full", "full", "general_room_area", None, None),
    ("office_full", "office", "office_full", "full", "general_room_area", None, None),
    ("office_desk", "office", "office_desk", "subzone", None, None, "desk"),
]
#: Subzones of the two full zones that have some.
SUBZONES = {"livingroom_full": ["livingroom_couch"], "kitchen_full": ["kitchen_stove", "kitchen_sink", "kitchen_dining"]}
ACTIVE = ("on", "open", "detected")
INACTIVE = ("off", "closed", "clear")


def first_rule(id_col: str | Column, rules, default: str = "unknown") -> Column:
    c = F.lower(F.col(id_col) if isinstance(id_col, str) else id_col)
    return F.coalesce(*[F.when(c.contains(part), value) for part, value, *_ in rules], F.lit(default))


def room_of(id_col="entity_id", strict_reference: bool = False) -> Column:
    """``strict_reference``: a guest bedroom is found as a plain one, because that is tested first."""
    return first_rule(id_col, STRICT_ROOM_RULES if strict_reference else ROOM_RULES)


def sensor_type_of(id_col="entity_id") -> Column:
    c = F.lower(F.col(id_col))
    door = c.contains("door") & c.contains("contact")
    return F.when(c.contains("presence") | c.contains("pressence"), "presence").when(door, "door").otherwise(first_rule(id_col, TYPE_RULES[4:]))


def zone_info(id_col="entity_id") -> Column:
    """Struct of room, zone, zone_type, coverage, area, specific_location, related_subzones."""
    c = F.lower(F.col(id_col))
    names = ("room", "zone", "zone_type", "coverage", "area", "specific_location")

    def made(rule):
        related = SUBZONES.get(rule[2])
        return F.struct(*[F.lit(x).cast("string").alias(n) for n, x in zip(names, rule[1:], strict=True)], (F.array(*map(F.lit, related)) if related else F.lit(None).cast("array<string>")).alias("related_subzones"))

    plain = F.struct(room_of(id_col).alias("room"), F.lit("main").alias("zone"), F.lit("unknown").alias("zone_type"), *[F.lit(None).cast("string").alias(n) for n in names[3:]], F.lit(None).cast("array<string>").alias("related_subzones"))
    return F.coalesce(*[F.when(c.contains(r[0]), made(r)) for r in ZONE_RULES], plain)


def merged_room(room="room", parts=("livingroom", "kitchen"), name="living_kitchen") -> Column:
    return F.when(F.col(room).isin(*parts), name).otherwise(F.col(room))


def transition_class(state="state") -> Column:
    return F.when(F.col(state).isin(*ACTIVE), "activation").when(F.col(state).isin(*INACTIVE), "deactivation").otherwise("unknown")


def is_active(state="state") -> Column:
    return F.col(state).isin(*ACTIVE).cast("int")


def numeric_state(state="state") -> Column:
    return F.col(state).try_cast("double")


def calendar(ts="ts") -> dict[str, Column]:
    h, d = F.hour(ts), F.weekday(ts)
    flag = lambda c: c.cast("int")
    return {"hour": h, "day_of_week": d, "minute_of_day": h * 60 + F.minute(ts), "is_weekend": flag(d >= 5), "is_morning": flag(h.between(6, 11)), "is_afternoon": flag(h.between(12, 17)), "is_evening": flag(h.between(18, 23)), "is_night": flag(h < 6)}


def context_flags(ts="ts") -> dict[str, Column]:
    return {"is_morning_routine": F.hour(ts).between(6, 9).cast("int"), "is_evening_routine": F.hour(ts).between(21, 23).cast("int")}


def cyclical(ts="ts") -> dict[str, Column]:
    h, d = F.hour(ts) * (2 * F.pi() / 24), F.weekday(ts) * (2 * F.pi() / 7)
    return {"hour_sin": F.sin(h), "hour_cos": F.cos(h), "day_sin": F.sin(d), "day_cos": F.cos(d)}


def interactions(ts="ts", state="state") -> dict[str, Column]:
    return {"hour_x_day": F.hour(ts) * F.weekday(ts), "state_x_hour": is_active(state) * F.hour(ts)}




def features(ts="ts", state="state", more: dict[str, Column] | None = None) -> dict[str, Column]:
    """All named features, and the caller's own; missing values are 0."""
    return {k: F.coalesce(c, F.lit(0)) for k, c in {**calendar(ts), **context_flags(ts), **cyclical(ts), **interactions(ts, state), **(more or {})}.items()}


def zone_features(zone_type="zone_type", coverage="coverage", specific="specific_location") -> dict[str, Column]:
    z, c = F.col(zone_type), F.col(coverage)
    score = F.when(c == "general_room_area", 0.5).when(c.isin("general_living_area", "general_kitchen_area"), 0.7).when(F.col(specific).isNotNull(), 1.0).otherwise(0.0)
    return {"is_full_zone": (z == "full").cast("int"), "is_subzone": (z == "subzone").cast("int"), "coverage_score": score}


def person_of(tokens: list[str], id_col="entity_id", zone="zone") -> Column:
    has = lambda t: F.lower(F.coalesce(F.col(id_col), F.lit(""))).contains(t) | F.lower(F.coalesce(F.col(zone), F.lit(""))).contains(t)
    return F.coalesce(*[F.when(has(t), t) for t in tokens])


def cache_key() -> Column:
    return F.concat_ws("|", "entity_id", "room", "state", F.floor(micros("ts") / 60_000_000).cast("string"))


def significant(df: DataFrame, names: list[str], keys: list[str], least: float = 0.01) -> DataFrame:
    """Features in long form whose absolute value is above ``least``."""
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])).alias("f")).select(*keys, "f.*")
    return long.where(F.abs("value") > least)


def validated(df: DataFrame, as_of: Column) -> DataFrame:
    """Adds reason (null if valid) and warning."""
    reason = F.when(F.col("entity_id").isNull() | (F.col("entity_id") == ""), "missing entity_id").when(F.col("state").isNull(), "missing state").when(F.col("ts").isNull(), "missing timestamp")
    warning = F.when(F.col("ts") > as_of + F.make_dt_interval(hours=F.lit(1)), "future timestamp").when(F.col("ts") < as_of - F.make_dt_interval(days=F.lit(365)), "old timestamp")
    return df.withColumn("reason", reason).withColumn("warning", warning)


def preheat(preds: DataFrame) -> DataFrame:
    return preds.where("horizon_minutes = 120 AND probability > 0.7 AND confidence > 0.6")


def precool(preds: DataFrame, temperature="temperature") -> DataFrame:
    return preds.where(f"horizon_minutes = 15 AND probability > 0.8 AND confidence > 0.7 AND {temperature} > 25")


def notable_anomalies(anomalies: DataFrame) -> DataFrame:
    return anomalies.where("is_anomaly AND NOT is_pet")


def signature(items: Column, sep: str = "->") -> Column:
    return F.array_join(items, sep)


#: Prior probability of occupancy by hour of day, from 0.
HOUR_PRIOR = (0.1, 0.05, 0.05, 0.05, 0.05, 0.1, 0.3, 0.5, 0.6, 0.4, 0.2, 0.2, 0.4, 0.3, 0.2, 0.2, 0.2, 0.3, 0.4, 0.6, 0.7, 0.6, 0.5, 0.3)


def prior_prediction(ts: str, horizon: str, room: str = "room") -> Column:
    target = ((F.hour(ts) + F.floor(F.col(horizon) / 60)) % 24).cast("int")
    p = F.element_at(F.array(*map(F.lit, HOUR_PRIOR)), target + 1)
    return F.least(F.lit(0.8), p * F.when(F.col(room) == "living_kitchen", 1.2).when(F.col(room).isin("bathroom", "small_bathroom"), 0.5).otherwise(1.0))


def with_fallback(asked: DataFrame, primary: DataFrame, secondary: DataFrame, keys: list[str]) -> DataFrame:
    """probability, uncertainty, confidence of the first source that has the key, else 0.5, 1.0, 0.0, and fallback_used."""
    cols = ("probability", "uncertainty", "confidence")
    a = primary.select(*keys, *[F.col(c).alias(f"a_{c}") for c in cols])
    b = secondary.select(*keys, *[F.col(c).alias(f"b_{c}") for c in cols])
    joined = asked.join(a, keys, "left").join(b, keys, "left")
    neutral = dict(zip(cols, (0.5, 1.0, 0.0), strict=True))
    return joined.select(*asked.columns, *[F.coalesce(f"a_{c}", f"b_{c}", F.lit(neutral[c])).alias(c) for c in cols], F.col("a_probability").isNull().alias("fallback_used"))


def lookback_of(horizon="horizon_minutes") -> dict[str, Column]:
    h = F.col(horizon)
    return {"lookback_minutes": F.when(h <= 30, 60).when(h <= 120, 180).otherwise(360), "model_family": F.when(h <= 30, "fast_adaptive").when(h <= 120, "balanced").otherwise("stable_pattern")}


def typical_duration(hour: Column) -> Column:
    """Seconds of a typical stay where nothing has been learned."""
    return F.when(hour.between(6, 9), 180.0).when(hour.between(21, 23), 300.0).otherwise(120.0)


def hourly_prior(hour: Column) -> Column:
    return F.when(hour.between(6, 9), 0.4).when(hour.between(21, 23), 0.3).when(hour.between(12, 14), 0.2).otherwise(0.1)


def entry_confidence(hour: Column, samples: Column) -> Column:
    base = F.when(hour.between(6, 9) | hour.between(21, 23), 0.8).when(hour.between(12, 14), 0.6).otherwise(0.5)
    return F.least(F.lit(0.95), base + F.when(F.coalesce(samples, F.lit(0)) > 5, 0.1).otherwise(0.0))


def horizon_score(family: Column, recent_activity: Column, hourly_strength: Column) -> Column:
    raw = F.when(family == "fast_adaptive", 0.5 + 0.1 * recent_activity).when(family == "stable_pattern", 0.5 + 0.2 * hourly_strength).otherwise(0.5)
    return F.greatest(F.lit(0.1), F.least(F.lit(0.9), raw))


def evolution_strategy(mean="mean_accuracy", std="std_accuracy", response="mean_response_ms") -> Column:
    m, d = F.coalesce(mean, F.lit(0.0)), F.coalesce(std, F.lit(0.0))
    return (
        F.when(m < 0.6, "change_algorithm")
        .when((m < 0.75) & (d < 0.05), "feature_engineering")
        .when(F.coalesce(response, F.lit(0.0)) > 100, "prune_ensemble")
        .when(d > 0.1, "hyperparameter_tuning")
        .when(m > 0.75, "expand_ensemble")
        .otherwise("hyperparameter_tuning")
    )


def complexity_penalty(samples: Column, complexity: Column) -> Column:
    medium = F.when(samples < 500, 0.1).when(samples < 2000, 0.05).otherwise(0.0)
    high = F.when(samples < 500, 0.2).when(samples < 2000, 0.15).otherwise(0.05)
    return F.when(complexity == "medium", medium).when(complexity == "high", high).otherwise(0.0)
