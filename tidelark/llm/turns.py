"""Conversations with faulty turns, and the cheapest edits that give them a valid order of roles.

A valid order of role initials is ``(s?(ua)+)?``.  A turn may be kept, given
another role or deleted, and empty turns may be inserted.  The cheapest edits
are found by depth-first branch-and-bound: an explicit stack of partial edits;
a lower bound for the turns still to come; the best complete edits so far; and
for each place and each state of the order the best partial edits that reached
it, which end all worse ones.  It stops when the stack is empty, so what it
returns is proved best.

Spark deals turns by conversation and sorts them, and a task reads them as a
stream.  A conversation is solved in stretches of ``STRETCH`` turns, from every
state that the stretches before can end in to every state after it, so the
search stays small and no more texts than a stretch's are held, however long a conversation is.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values of the contract: costs of the edits, and of a truncated turn that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States of the order: nothing yet, after s, after u, after a.  The only initial of user or assistant that may follow, and the state after an initial.
START, S, U, A = range(4)
EXPECTS = ("u", "u", "a", "u")
AFTER = ({"s": S, "u": U}, {"u": U}, {"a": A}, {"u": U})
ENDS = (START, A)
ROLE = {"u": "user", "a": "assistant"}
#: Turns that one search takes.
STRETCH = 48

#: Damage of ``damaged``: what crc32 of ``conv_id:turn`` modulo 20 stands for.
DROPPED, EMPTIED, UNSTOPPED, REPEATED, MADE_USER, OF = 0, 1, 2, 3, 4, 20
_SPACE = r"\x20\x09-\x0D"


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with made faults, for tests of the repair on sound conversations; nulls of role and text, and in the hashed key, count as one space."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), F.pmod(F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")), F.lit(OF)).alias("_d")).where(F.col("_d") != DROPPED)
    text = F.when(F.col("_d") == EMPTIED, "").when(F.col("_d") == UNSTOPPED, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_d") == MADE_USER, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("_d") == REPEATED, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_c")).drop("_c")


def faults(turns: DataFrame) -> DataFrame:
    """Turns with ``fault``, the first that holds: blank, duplicate (role and text stand earlier in the conversation) or truncated; null if none.

    ``copy`` counts the turns of equal role and text, and is the order of those of one number.

    Turns are dealt by conversation once; both sorts are by columns, not in memory.
    """
    return _faults(turns.withColumn("there", F.lit(True)), {})


def _faults(turns: DataFrame, more: dict[str, Column]) -> DataFrame:
    """``faults`` with ``more`` columns, of rows whose ``there`` is true; the others hold a conversation's id alone and aren't compared with them."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "there").repartition("conv_id")
    copy = F.row_number().over(W.partitionBy("conv_id", "there", "role", "text").orderBy(F.asc_nulls_first("turn")))
    last = F.substring(F.regexp_replace("text", rf"[{_SPACE}]+\z", ""), -1, 1)
    fault = F.when(~F.col("text").rlike(rf"[^{_SPACE}]"), "blank").when(F.col("copy") > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    return rows.withColumn("copy", copy).withColumn("fault", fault).select("conv_id", "turn", "role", "text", "copy", "fault", *[c.alias(name) for name, c in more.items()])


def _moves(state: int, initial: str, fault: str | None):
    """(cost, letter, state after, initial of the role that it gives) of each edit of a turn, the most promising first."""
    if fault not in ("blank", "duplicate"):
        stays = TRUNCATED if fault == "truncated" else 0
        if not initial:  # a turn without a role's name leaves the order as it is
            yield KEEP + stays, "K", state, ""
        elif initial in AFTER[state]:
            yield KEEP + stays, "K", AFTER[state][initial], initial
        yield REROLE + stays, "R", AFTER[state][EXPECTS[state]], EXPECTS[state]
    yield DELETE, "D", state, ""


def _least(initial: str, fault: str | None) -> int:
    """The least that a turn costs in any state."""
    if fault in ("blank", "duplicate"):
        return DELETE
    stays = TRUNCATED if fault == "truncated" else 0
    return stays + (KEEP if initial in ("", "s", "u", "a") else min(REROLE, DELETE - stays))


def search(turns: list[tuple[str, str | None]], entry: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, letters) of the cheapest edits of (initial, fault) turns that lead from ``entry`` to one of ``ends``, ties to the ASCII-least letters.

    Dominance is by (cost, letters): of two prefixes that reach the same place
    and state, what may follow is the same, and prefixes of equal cost aren't the beginning
    of each other, because each further letter there is an insertion, which costs.
    """
    n = len(turns)
    bound = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        bound[i] = bound[i + 1] + _least(*turns[i])
    best: tuple[int, str] | None = None
    reached: list[dict[int, tuple[int, str]]] = [{} for _ in range(n + 1)]
    reached[0][entry] = (0, "")
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, letters = stack.pop()
        if reached[i][state] != (cost, letters):
            continue  # a better prefix came meanwhile
        if best is not None and (cost + bound[i], letters) > (best[0], best[1][: len(letters)]):
            continue
        if i == n and state in ends and (best is None or (cost, letters) < best):
            best = (cost, letters)
        wanted = EXPECTS[state]
        steps = [(cost + INSERT, i, AFTER[state][wanted], letters + "I")]
        if i < n:
            steps += [(cost + c, i + 1, after, letters + letter) for c, letter, after, _ in _moves(state, *turns[i])]
        ready = []
        for c, k, after, grown in steps:
            if best is not None and (c + bound[k], grown) > (best[0], best[1][: len(grown)]):
                continue
            known = reached[k].get(after)
            if known is None or (c, grown) < known:
                reached[k][after] = (c, grown)
                ready.append((c + bound[k], grown, (k, after, c, grown)))
        stack += [node for _, _, node in sorted(ready, reverse=True)]
    return best


def applied(turns: list[tuple[str, str]], letters: str, state: int) -> Iterator[tuple[str, str]]:
    """(role, text) turns after the edits; letters and the state before them settle every role."""
    at = 0
    for letter in letters:
        if letter == "I":
            yield ROLE[EXPECTS[state]], ""
            state = AFTER[state][EXPECTS[state]]
            continue
        role, text = turns[at]
        at += 1
        if letter == "K":
            state = AFTER[state][role[0]] if role else state
            yield role, text
        elif letter == "R":
            role = EXPECTS[state]
            state = AFTER[state][role]
            yield ROLE[role], text


class _Conversation:
    """What is known of a conversation whose turns come in order."""

    def __init__(self, with_turns: bool):
        self.with_turns = with_turns
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.low = self.high = self.initial = None
        self.distinct = 0
        self.turns: list[tuple[str, str]] = []
        self.faults: list[str | None] = []
        #: Letters that all ways share, and for each state that the turns so far can end in: cost, further letters, number and hash of the repaired turns, and the turns if they are wanted.
        self.settled: list[str] = []
        self.open = {START: (0, "", 0, hashlib.sha256(), ())}

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if fault:
            self.counts[fault] += 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.initial = role[:1]
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += turn != self.high
            self.high = turn
        self.turns.append((role, text))
        self.faults.append(fault)
        if len(self.turns) == STRETCH:
            self._close(tuple(range(4)))

    def _close(self, ends: tuple[int, ...]) -> None:
        coded = [(role[:1], fault) for (role, _), fault in zip(self.turns, self.faults, strict=True)]
        after = {}
        for end in ends:
            ways = [(cost + found[0], letters + found[1], found[1], state) for state, (cost, letters, *_) in self.open.items() if (found := search(coded, state, (end,)))]
            if not ways:
                continue
            cost, letters, new, state = min(ways)
            _, _, lines, digest, kept = self.open[state]
            digest, kept = digest.copy(), list(kept)
            for role, text in applied(self.turns, new, state):
                digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                lines += 1
                if self.with_turns:
                    kept.append({"role": role, "text": text})
            after[end] = (cost, letters, lines, digest, kept)
        shared = os.path.commonprefix([x[1] for x in after.values()])
        self.settled.append(shared)
        self.open = {end: (x[0], x[1][len(shared) :], *x[2:]) for end, x in after.items()}
        self.turns, self.faults = [], []

    def report(self) -> dict:
        self._close(ENDS)
        cost, letters, _, digest, kept = min(self.open.values(), key=lambda x: x[:2])
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return {"gaps": gaps, **self.counts, "cost": cost, "audit": "".join(self.settled) + letters, "repaired_sha256": digest.hexdigest(), "repaired": kept}


_REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _schema(with_turns: bool, conv_id: pa.DataType) -> pa.Schema:
    more = [("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))] if with_turns else []
    return pa.schema([("conv_id", conv_id), *[(c, pa.int64()) for c in _REPORT], ("audit", pa.string()), ("repaired_sha256", pa.string()), *more])


def _reports(with_turns: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, done, schema = None, None, [], None
        for batch in batches:
            schema = schema or _schema(with_turns, batch.schema.field("conv_id").type)
            for row in batch.to_pylist():
                if now is None or row["conv_id"] != key:
                    if now is not None:
                        done.append({"conv_id": key, **now.report()})
                    key, now = row["conv_id"], _Conversation(with_turns)
                if row["there"]:
                    now.add(row["turn"], row["role"], row["text"], row["fault"])
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
                done = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": key, **now.report()}], schema=schema)

    return run


def repair(turns: DataFrame, conversations: DataFrame | None = None, *, with_turns: bool = False) -> DataFrame:
    """A row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 and, ``with_turns``, the repaired turns.

    ``turns`` has conv_id, turn, role and text; other columns aren't read.  Turns are taken in
    the order of ``turn``, nulls first, ties by role and text.  gaps counts the numbers missing between the least
    and the largest turn, illegal the neighbours whose roles' initials aren't su, ua or au.  The audit has a
    letter for each edit in order: Keep, Rerole, Delete, Insert.  repaired_sha256 is of ``role:text`` lines.

    ``conversations`` (conv_id) names further ones: those without turns get zeros, an empty audit and
    the hash of the empty string.  A null role or text is one space, which makes such a turn blank or
    its role none of the order's; an empty role has no initial and, kept, leaves the order as it is.  A null conv_id is a
    conversation like any other.  Repeated rows are duplicates; empty tables give no rows.

    A task holds ``STRETCH`` turns of a conversation and, of what it has read, four ways at most;
    only ``with_turns`` holds a conversation's repaired texts, as the row that it returns does.  One conversation is
    read by one task, since its hash is one over all its texts in order.
    """
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", F.lit(True).alias("there"))
    if conversations is not None:
        none = {"turn": "long", "role": "string", "text": "string"}
        rows = rows.unionByName(conversations.select("conv_id").distinct().select("conv_id", *[F.lit(None).cast(t).alias(c) for c, t in none.items()], F.lit(False).alias("there")))
    found = _faults(rows, {"there": F.col("there")})
    kind = dict(turns.dtypes)["conv_id"]
    schema = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in _REPORT) + ", audit string, repaired_sha256 string" + (", repaired array<struct<role string, text string>>" if with_turns else "")
    order = ["conv_id", "there", F.asc_nulls_first("turn"), "role", "text", "copy"]
    return found.sortWithinPartitions(*order).mapInArrow(_reports(with_turns), schema)
