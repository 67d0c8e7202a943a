"""The bathroom state machine: an ordered fold for each room, the same in batch and in streaming."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelark.operators.folds import in_order

RESULT = "event_id long, room string, ts timestamp, occupied boolean, confidence double, reason string, duration_s double, door_probability double"


# Hours of the day, durations, shares and confidences of the machine's rules, here and in Machine, and the reasons' names.
def default_duration(hour: int) -> float:
    return 180.0 if 6 <= hour <= 9 else 300.0 if 21 <= hour <= 23 else 120.0


@dataclass
class Machine:
    """State of one room; ``step`` takes an event and returns (occupied, confidence, reason, duration) or None."""

    door_closed_state: str = "off"
    occupied: bool = False
    entered: float | None = None
    door_closed: bool = False
    triggered: bool = False
    door_probability: float = 0.5
    #: Microseconds and number of the stays that ended in each hour; whole numbers, so that their sums don't depend on the order.
    sums: list[int] = field(default_factory=lambda: [0] * 24)
    counts: list[int] = field(default_factory=lambda: [0] * 24)

    def typical(self, hour: int) -> float:
        return self.sums[hour] / self.counts[hour] / 1e6 if self.counts[hour] > 3 else default_duration(hour)

    def _leave(self, at: float, hour: int) -> float:
        spent = at - self.entered
        self.occupied = self.triggered = False
        self.sums[hour] += round(spent * 1e6)
        self.counts[hour] += 1
        return spent

    def carried(self, entry: Machine, exit: Machine) -> Machine:
        """Where rows that led from entry to exit lead from here, if every decision stays: the stays learned are added up."""
        moved = lambda name: [a + (c - b) for a, b, c in zip(getattr(self, name), getattr(entry, name), getattr(exit, name), strict=True)]
        return replace(exit, sums=moved("sums"), counts=moved("counts"), entered=self.entered if exit.entered == entry.entered else exit.entered)

    def step(self, at: float, hour: int, sensor: str, state: str):
        if sensor == "entrance":
            if state in ("on", "detected"):
                if self.occupied:
                    return True, 0.3, "already_occupied", None
                self.occupied = self.triggered = True
                self.entered = at
                base = 0.8 if 6 <= hour <= 9 or 21 <= hour <= 23 else 0.6 if 12 <= hour <= 14 else 0.5
                return True, min(0.95, base + (0.1 if self.counts[hour] > 5 else 0.0)), "entrance_trigger", self.typical(hour)
            if self.occupied and self.entered is not None and at - self.entered > 0.5 * self.typical(hour) and not self.door_closed:
                return False, 0.7, "entrance_clear", self._leave(at, hour)
            return None
        if sensor != "door":
            return None
        self.door_closed = state == self.door_closed_state
        self.door_probability = 0.9 * self.door_probability + 0.1 * self.door_closed
        if self.door_closed and self.triggered:
            self.occupied = True
            return True, 0.95, "door_closed_after_entrance", None
        if not self.door_closed and self.occupied and self.entered is not None and at - self.entered > 0.8 * self.typical(hour):
            return False, 0.8, "door_opened_after_duration", self._leave(at, hour)
        return self.occupied, 0.5, "state_maintained", None


def results(machine: Machine, rows: pd.DataFrame) -> pd.DataFrame:
    """Feeds rows (event_id, room, ts, sensor_type, state) in order and collects what the machine says."""
    rows = rows.sort_values(["ts", "event_id"], kind="stable")
    out = []
    for r in rows.itertuples():
        said = machine.step(r.ts.value / 1e9, r.ts.hour, r.sensor_type, r.state)
        if said:
            out.append((r.event_id, r.room, r.ts, said[0], said[1], said[2], said[3], machine.door_probability))
    return pd.DataFrame(out, columns=["event_id", "room", "ts", "occupied", "confidence", "reason", "duration_s", "door_probability"])


def bathroom_states(events: DataFrame, keys: tuple[str, ...] = ("room",), door_closed_state: str = "off", **how) -> DataFrame:
    """Rows of RESULT for each event that the machine answers.

    A key's chunks of rows are run at once (``folds.in_order``, which takes ``how``): what the machine has learned of
    stays moves few of its decisions, so the states that chunks begin with settle in a few rounds.
    """
    columns = list(dict.fromkeys(["ts", "event_id", *keys, "room", "sensor_type", "state"]))
    some = events.where("sensor_type IN ('entrance', 'door')").withColumn("ts", F.col("ts").cast("timestamp")).select(*columns)
    return in_order(some, list(keys), ["ts", "event_id"], partial(Machine, door_closed_state), results, RESULT, **how)
