"""Conversation repair, sharding and hard negatives against brute force, with nulls, ties, repeated rows, long and empty input and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelark.llm import examples, lines, negatives, queries, secrets, sharding, turns
from tidelark.llm.frames import table

# Conversation repair


def every_repair(rows, most=2):
    """(cost, audit) over all edits with at most ``most`` insertions in a row."""
    best, options = None, []
    for initial, fault in rows:
        late = fault == "truncated"
        free = [] if fault in ("blank", "duplicate") else [("K", late, initial), ("R", 2 + late, "u"), ("R", 2 + late, "a")]
        options.append([("D", 3, ""), *free])
    more = ["".join(x) for k in range(most + 1) for x in itertools.product("ua", repeat=k)]
    for chosen in itertools.product(*options):
        for put in itertools.product(more, repeat=len(rows) + 1):
            roles, audit, cost = put[0], "I" * len(put[0]), 2 * len(put[0])
            for (letter, price, initial), extra in zip(chosen, put[1:], strict=True):
                roles, audit, cost = roles + initial + extra, audit + letter + "I" * len(extra), cost + price + 2 * len(extra)
            if (best is None or (cost, audit) < best) and re.fullmatch("(s?(ua)+)?", roles):
                best = (cost, audit)
    return best


def least_repair(rows):
    """(cost, audit) by the suffixes' best, for longer conversations."""
    worst = (10**9, "")

    def inserted(best):
        for _ in range(4):
            for s in range(4):
                after = best.get(turns.AFTER[s][turns.EXPECTS[s]])
                if after:
                    best[s] = min(best.get(s, worst), (after[0] + 2, "I" + after[1]))
        return best

    best = inserted({turns.START: (0, ""), turns.A: (0, "")})
    for initial, fault in reversed(rows):
        here = {}
        for s in range(4):
            late = fault == "truncated"
            ways = [(3, "D", s)]
            if fault not in ("blank", "duplicate"):
                ways.append((2 + late, "R", turns.AFTER[s][turns.EXPECTS[s]]))
                if initial == "" or initial in turns.AFTER[s]:
                    ways.append((int(late), "K", turns.AFTER[s].get(initial, s)))
            here[s] = min((c + best[t][0], x + best[t][1]) for c, x, t in ways if t in best)
        best = inserted(here)
    return best[turns.START]


def test_search_is_brute_force():
    rnd = random.Random(3)
    for n, times in ((0, 1), (1, 60), (2, 60), (3, 25)):
        for _ in range(times):
            rows = [(rnd.choice(["s", "u", "a", "x", ""]), rnd.choice([None, None, "blank", "duplicate", "truncated"])) for _ in range(n)]
            assert turns.search(rows, turns.START, turns.ENDS) == every_repair(rows), rows


@pytest.mark.parametrize("n", [turns.STRETCH - 1, turns.STRETCH, 3 * turns.STRETCH + 5])
def test_stretches_compose(n):
    rnd = random.Random(n)
    for _ in range(15):
        rows = [(rnd.choice("suax") if rnd.random() < 0.4 else "ua"[i % 2], rnd.choice([None, None, None, "blank", "duplicate", "truncated"])) for i in range(n)]
        one = turns._Conversation(with_turns=True)
        for i, (initial, fault) in enumerate(rows):
            one.add(i, initial, f"t{i}", fault)
        got = one.report()
        assert (got["cost"], got["audit"]) == least_repair(rows)
        assert hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in got["repaired"]).encode()).hexdigest() == got["repaired_sha256"]
        assert re.fullmatch("(s?(ua)+)?", "".join(t["role"][0] for t in got["repaired"]))


def repaired_by_hand(rows):
    """The contract's row for one conversation's (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, coded = set(), []
    for _, role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else None if last in ".!?" else "truncated"
        seen.add((role, text))
        coded.append((role[:1], fault))
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(coded, coded[1:]))
    cost, audit = least_repair(coded)
    text = "\n".join(f"{r}:{t}" for r, t in turns.applied([r[1:] for r in rows], audit, turns.START))
    faults = Counter(f for _, f in coded)
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def test_odd_conversations(spark):
    rows = [
        (1, 0, "user", "Hi there."), (1, 0, "user", "Hi there."), (1, None, "system", "Be kind."), (1, 3, "assistant", "Well"), (1, 9, None, "x."),
        (2, None, None, None), (3, 1, "", "No role."), (3, 2, "user", "Q?"), (3, 2, "assistant", " \n"), (3, 3, "assistant", "A. \t"),
        (None, 5, "user", "é" * 50_000 + "!"), (4, 1, "user", "same."), (4, 2, "assistant", "b."), (4, 3, "user", "same."), (4, 4, "assistant", "日本。"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"fault": F.lit(7), "there": F.lit("x"), "copy": F.lit(1.5), "audit": F.lit("y")})
    ids = spark.createDataFrame([(1,), (7,), (7,), (None,)], "conv_id long")
    got = {r.conv_id: tuple(r)[1:9] for r in turns.repair(df, ids, with_turns=True).collect()}
    want = {}
    for c, t, role, text in rows:
        want.setdefault(c, []).append((t, " " if role is None else role, " " if text is None else text))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: repaired_by_hand(r) for c, r in want.items()} | {7: empty}
    assert turns.repair(df.limit(0)).collect() == [] and turns.damaged(df.limit(0)).collect() == []


def test_a_long_conversation_is_a_stream(spark):
    """One conversation holds most rows; its turns come in several batches."""
    rnd = random.Random(1)
    rows = [(1, i, rnd.choice(["user", "assistant", "system"]), rnd.choice(["a.", f"t{i}", f"t{i}.", ""])) for i in range(3_000)] + [(2, 0, "user", "Q?")]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, "100")
    got = {r.conv_id: tuple(r)[1:] for r in turns.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    spark.conf.set(key, was)
    assert got[1] == repaired_by_hand([r[1:] for r in rows if r[0] == 1]) and got[2] == repaired_by_hand([(0, "user", "Q?")])


def test_a_conversation_is_one_row_however_its_turns_are_dealt(spark):
    """Turns and ids of many partitions, which are merged by size at run time, differently if they were dealt apart."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t} " + "long " * 40 + ".") for c in range(2_000) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    asked = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.unionOutputPartitioning": "true"}
    was = {key: spark.conf.get(key) for key in asked}
    for key, value in asked.items():
        spark.conf.set(key, value)
    try:
        got = [tuple(r)[:2] + tuple(r)[6:8] for r in turns.repair(df, df.select("conv_id")).collect()]
    finally:
        for key, value in was.items():
            spark.conf.set(key, value)
    assert sorted(got) == [(c, 0, 0, "KKKK") for c in range(2_000)]


def test_damage_is_the_contracts(spark, sf):
    df = table(spark, sf, "conversations")
    want = []
    for r in df.collect():
        d = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if d == 1 else re.sub("[.!?]", "", r.text) if d == 2 else r.text
        want += [(r.conv_id, r.turn, "user" if d == 4 else r.role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    assert sorted(tuple(r) for r in turns.damaged(df).collect()) == sorted(want)


# Sharding


def test_shards_hold_the_mixture(spark):
    """A source with most rows, small ones, a null one; equal texts, null texts and ids, and repeated rows."""
    rnd = random.Random(2)
    rows = [(i if i % 50 else None, rnd.choice(["same", None, "", "é" * 9, f"t{i}"]), rnd.choice(["hot"] * 6 + ["b", "c", None]), 5) for i in range(3_000)]
    rows += rows[:40]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, slot int")
    for count in (1, 7, 24):
        got = sharding.assign(df, count, bucket=16).collect()
        assert Counter((r.doc_id, r.source, r.size, r.text_crc32) for r in got) == Counter((i, s, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, s, _ in rows)
        held = Counter(r.shard for r in got)
        assert set(held) == set(range(count)) and max(held.values()) - min(held.values()) <= 1
        assert sorted((r.shard, r.slot) for r in got) == sorted((s, i) for s, n in held.items() for i in range(n))
        for source, n in Counter(r[2] for r in rows).items():
            parts = Counter(r.shard for r in got if r.source == source)
            assert all(abs(parts[s] - n * held[s] / len(rows)) < 2 for s in range(count)), source


def test_shards_are_the_same_in_any_layout(spark, sf):
    df = table(spark, sf, "documents")
    pick = lambda d, **how: sorted((r.doc_id, r.shard, r.slot) for r in sharding.assign(d, **how).collect())
    one = pick(df)
    assert one == pick(df.repartition(7), bucket=3) and one != pick(df, seed=1)
    # by hand: seeded order in each source, fractional ranks, one sort
    keyed = sorted(((r.source, hashlib.md5(f"0:{r.doc_id}:{zlib.crc32((r.text or '').encode())}".encode()).hexdigest(), r.doc_id) for r in df.collect()))
    sizes, at, ranked = Counter(k[0] for k in keyed), Counter(), []
    for source, h, doc in keyed:
        at[source] += 1
        ranked.append(((at[source] - 0.5) / sizes[source], h, source, doc))
    ranked.sort()
    want = [(doc, p * 24 // len(ranked)) for p, (*_, doc) in enumerate(ranked)]
    assert sorted(want) == sorted((d, s) for d, s, _ in one)


def test_written_shards(spark, tmp_path):
    rows = [(1, "a", "s"), (1, "a", "s"), (None, None, None), (2, "", "s"), (3, "b", None)] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("law", F.lit("x"))
    placed = sharding.write_shards(df, f"{tmp_path}/out", 3, rows_per_file=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert Counter((r.doc_id, r.text, r.source) for r in back.collect()) == Counter(rows)
    assert sorted((r.shard, r.slot) for r in back.collect()) == sorted((r.shard, r.slot) for r in placed.collect())
    assert sharding.assign(df.limit(0)).collect() == []


# Hard negatives


def mined_by_hand(rows, is_anchor, positives=5, negatives_=3):
    """rows: (id, label, components); every product, sorted."""
    good = [(i, y, [int(np.floor(256 * x)) for x in v]) for i, y, v in rows if y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    last = lambda i: (i is None, i or 0)
    out = []
    for k, (i, y, v) in enumerate(good):
        if i is None or not is_anchor(i):
            continue
        scored = sorted(((sum(a * b for a, b in zip(v, w)), j, z) for m, (j, z, w) in enumerate(good) if m != k), key=lambda s: (-s[0], last(s[1])))
        for p, j, _ in [s for s in scored if s[2] == y][:positives]:
            found = [(n, m) for n, m, z in scored if z != y and 50 * p <= 100 * n <= 95 * p][:negatives_]
            out += [(i, j, rank + 1, m, p, n) for rank, (n, m) in enumerate(found)]
    return out


@pytest.mark.parametrize("low, high, d", [(-300, 300, 64), (-1, 2, 5), (0, 2, 8), (-(2**40), 2**40, 9), (-128, 128, 16), (5, 6, 3)])
def test_tables_give_whole_products(low, high, d):
    rng = np.random.default_rng(d)
    a, b = rng.integers(low, high, (70, d)), rng.integers(low, high, (530, d))
    wide = (b.astype(object) @ a.T.astype(object)) % 2**64
    assert (negatives.scores(a, negatives.packed(b)) == wide.astype(np.uint64).astype(np.int64)).all()


@pytest.mark.parametrize("block, anchor_block", [(1024, 512), (16, 4)])
def test_hard_negatives_are_brute_force(spark, block, anchor_block):
    """One label holds most rows; ties, repeated rows, nulls anywhere, other lengths, negative scores."""
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.choice([0, 0, 0, 1, 2])), [float(x) for x in rng.normal(0.1, 0.2, 10)]) for i in range(140)]
    rows += rows[:6] + [(200, 1, [0.5] * 10), (201, 1, [0.5] * 10), (202, 2, [0.45] * 10), (203, 2, [0.45] * 10)]
    rows += [(210, None, [1.0] * 10), (220, 1, None), (230, 1, [None] * 10), (240, 1, [float("nan")] + [1.0] * 9), (250, 1, [float("inf")] + [1.0] * 9), (260, 1, []), (270, 1, [0.9, -0.3]), (None, 2, [0.44] * 10), (None, 1, [0.4] * 10), (280, 9, [0.3] * 10)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"row": F.lit("x"), "score": F.lit(1), "block": F.lit(None).cast("int")})
    got = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, block=block, anchor_block=anchor_block).collect()
    assert Counter(tuple(r) for r in got) == Counter(mined_by_hand(rows, lambda i: i % 10 == 0)) and len(got) > 50
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).collect() == []


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_sharding", "op13_hard_negatives"])
def test_queries_give_their_sqls_rows(spark, sf, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        duck.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df, found = queries.QUERIES[name](spark, sf), duck.execute(queries.ORACLE_SQL[name])
    places = [[d[0] for d in found.description].index(c) for c in df.columns]
    assert Counter(map(tuple, df.collect())) == Counter(tuple(r[i] for i in places) for r in found.fetchall())


def test_mined_from_the_table(spark, sf):
    e = table(spark, sf, "embeddings").collect()
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in e]
    assert sorted(tuple(r) for r in queries.op13_hard_negatives(spark, sf).collect()) == sorted(mined_by_hand(rows, lambda i: i % 50 == 0))


# Line dedup and secrets


def said(i, j):
    """A line that no other one is like."""
    r = random.Random(i * 1_000 + j)
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(3, 8))) for _ in range(r.randint(6, 9)))


def test_lines_of_rows_that_share_an_id(spark):
    """Each row loses lines of its own text only; blocks of any length go whole."""
    foot = "This footer stands in every page of the site."
    rows = [(i, "\n".join([said(i, 0), said(i, 1), foot, said(i, 2)])) for i in range(20)]
    other = "\n".join([said(99, 0), said(99, 1), said(99, 2), said(99, 3)])
    rows += [(1, other), (1, other), (None, "\n".join([said(77, 0), foot, said(77, 1)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_lines": F.lit("x"), "row": F.lit(1), "n_dropped": F.lit(None).cast("int")})
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in lines.without_recurring_lines(df).collect())
    assert got == Counter((i, t.replace(foot + "\n", ""), t.count("\n") + 1, int(foot in t)) for i, t in rows)


@pytest.mark.parametrize("length", [4, 40])
def test_a_block_is_judged_at_once(spark, length, monkeypatch):
    block = [f"License line {chr(97 + j % 26)}{chr(97 + j // 26)} of the terms that hold {'so ' * (j % 5)}here" for j in range(length)]
    rows = [(i, "\n".join([said(i, 0), *block, said(i, 1), said(i, 2)])) for i in range(20)]
    made = []
    plain = lines.keep
    monkeypatch.setattr(lines, "keep", lambda df, **how: made.append(1) or plain(df, **how))
    got = {r.doc_id: r.text for r in lines.without_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: "\n".join([said(i, 0), said(i, 1), said(i, 2)]) for i, _ in rows} and len(made) <= 22


def test_look_alikes_of_secrets():
    """Forms of the table drawn in lines that aren't in it: few part numbers, commits, encoded images and ids are taken, most credentials are."""
    net, r = secrets.fitted(list(examples.secret_forms(3_600))), random.Random(9)
    hexes = lambda n: "".join(r.choices("0123456789abcdef", k=n))
    parts = lambda r: "".join(r.choices("ABCDEFGH", k=3)) + f"-{r.randint(1000, 9999)}-XY"
    forms = {
        "part": ("replace the part {v} now", parts, False), "commit": ("reverted by {v}", lambda r: hexes(8), False), "image": ("background: url(data:image/gif;base64,{v}) x", lambda r: "".join(r.choices(examples.BASE64, k=200)), False),
        "uuid": ("the id {v} was", lambda r: f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}", False), "hex": ("the value {v} was seen", lambda r: hexes(22), True), "yaml": ("db_pass: {v}", examples.PASSWORDS[0], True), "key": ("use {v} for it", examples.SECRET_VALUES[1], True),
    }
    for name, (line, make, good) in forms.items():
        hit = 0
        for _ in range(60):
            text = line.replace("{v}", make(r))
            spots = secrets.candidates(text, secrets.base_spans(text))
            hit += bool(spots) and bool((net.scores([secrets.window_of(text, *s) for s in spots]) >= net.threshold).any())
        assert hit >= 48 if good else hit <= 3, (name, hit)
