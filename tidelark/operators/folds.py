"""Ordered folds whose state depends on all earlier rows, run for many chunks of a key's rows at once.

Every chunk is folded from a guessed state, all at the same time.  A walk over
one row for each chunk then follows, from the start, the states that chunks were seen to
lead to; where it meets a chunk with a state that it wasn't folded from, that
is what the next round folds, and the walk goes on with a guess.  When
the walk meets none, each chunk's entry is what the fold over the whole key
gives, to the last bit, and a last pass makes the answers.

Rounds are few where a fold forgets (alarms that start it anew, a door that settles the
state), or where what it doesn't forget is added up: a state with a method ``carried(entry, exit)`` says what a chunk
that led from entry to exit should lead to from this state, if it decides nothing otherwise.  The first open chunk
of each key is settled by every round, so there are never more rounds than chunks.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelark.operators.segments import DAY, numbered
from tidelark.sources.tables import discard, kept

#: Rows of a chunk, which is one task's work in each round.  A fold should forget within a chunk: two runs of the
#: Page-Hinkley test over noise meet after some hundred alarms.
CHUNK = 65_536


def _dump(state) -> str:
    return json.dumps(asdict(state))


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, pd.DataFrame]]:
    for rows in batches:
        for (k, b), part in rows.groupby(["_k", "_b"], sort=False):
            yield k, int(b), part


def in_order(df: DataFrame, keys: list[str], order: list[str], make: Callable, feed: Callable, schema: str, *, chunk: int = CHUNK, bucket_s: float = DAY, rounds: list[int] | None = None) -> DataFrame:
    """Rows of ``feed(state, rows)`` over each key's rows in order, where feed changes the state that ``make()`` starts as.

    The state is a dataclass of numbers, texts and lists.  feed takes a DataFrame with the columns of ``df``, any number of
    consecutive rows at a time.  order[0] is a time; rows without one come first.  Rows that nothing in ``order`` tells
    apart may come in either order.  The number of chunks folded in each round is appended to ``rounds``.
    """
    start = make()
    kind, first = type(start), _dump(start)
    columns = df.columns
    own = [f.name for f in df.schema]
    rows = numbered(df, keys, order, bucket_s=bucket_s).select(*own, F.to_json(F.struct(*keys)).alias("_k"), F.floor((F.col("_n") - 1) / chunk).alias("_b"), "_n")
    rows = kept(rows)
    guess = (lambda state, entry, exit: _dump(kind(**json.loads(state)).carried(kind(**json.loads(entry)), kind(**json.loads(exit))))) if hasattr(kind, "carried") else (lambda state, entry, exit: exit)
    sort = ["_k", "_b", "_n"]

    def dealt(entries: DataFrame | None) -> DataFrame:
        asked = rows.withColumn("_entry", F.lit(first)) if entries is None else rows.join(entries.hint("merge"), ["_k", "_b"])
        return asked.repartition("_k", "_b").sortWithinPartitions(*sort)

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, entry = None, None, None
        for k, b, part in _groups(batches):
            if (k, b) != now:
                if now:
                    yield pd.DataFrame([(*now, entry, _dump(state))], columns=["_k", "_b", "entry", "exit"])
                now, entry = (k, b), part["_entry"].iloc[0]
                state = kind(**json.loads(entry))
            feed(state, part[columns])
        if now:
            yield pd.DataFrame([(*now, entry, _dump(state))], columns=["_k", "_b", "entry", "exit"])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, key, state, seen, latest = None, None, first, {}, None

        def closed() -> tuple:
            nonlocal state
            row = (*now, state, state in seen)
            state = seen[state] if state in seen else guess(state, *latest)
            return row

        for tries in batches:
            out = []
            for k, b, entry, exit in tries.itertuples(index=False, name=None):
                if (k, b) != now:
                    if now:
                        out.append(closed())
                    now, seen = (k, b), {}
                    if k != key:
                        key, state = k, first
                seen[entry], latest = exit, (entry, exit)
            yield pd.DataFrame(out, columns=["_k", "_b", "_entry", "known"])
        if now:
            yield pd.DataFrame([closed()], columns=["_k", "_b", "_entry", "known"])

    def answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for k, b, part in _groups(batches):
            if (k, b) != now:
                now, state = (k, b), kind(**json.loads(part["_entry"].iloc[0]))
            yield feed(state, part[columns])

    tried, used, entries, number = None, [], None, 0
    while True:
        new = kept(dealt(entries).mapInPandas(ends, "_k string, _b long, entry string, exit string").withColumn("round", F.lit(number)), of=used)
        if rounds is not None:
            rounds.append(new.count())
        tried = new if tried is None else tried.unionByName(new)
        way = tried.repartition("_k").sortWithinPartitions("_k", "_b", "round").select("_k", "_b", "entry", "exit")
        way = kept(way.mapInPandas(walk, "_k string, _b long, _entry string, known boolean"), of=used)
        entries, number = way.where("not known").select("_k", "_b", "_entry"), number + 1
        if entries.isEmpty():
            break
    for path in used[:-1]:
        discard(df.sparkSession, path)
    return dealt(way.select("_k", "_b", "_entry")).mapInPandas(answers, schema)
