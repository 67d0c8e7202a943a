"""Documents as token sequences of a fixed length: byte-level BPE, cutting, and packing by bin completion.

Tokens: texts of Latin script are split into the tokenizer's pieces by numpy
over code points and each distinct piece is encoded once per worker; other
texts go to the tokenizer whole.  Both give the tokenizer's ids.

Packing: a piece is shorter than a sequence or fills one, so a histogram of at
most ``capacity`` lengths holds all that packing needs, whatever the corpus.
The driver completes bins over that histogram: it takes the longest length
left, searches its undominated fillings by branch and bound on waste, and uses
the best one as often as the counts allow.  A best-fit decreasing plan is the
incumbent, and a plan that reaches the lower bound ends the search.  Tasks then
give each piece the number of its slot.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .frames import keep

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
#: Code points below this are split by numpy.
_LATIN = 0x370
_CLASS = np.zeros(_LATIN, np.uint8)
for _c in range(_LATIN):
    _CLASS[_c] = {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(_c))[0], _OTHER)
_CLASS[[9, 10, 11, 12, 13, 0x20, 0x85, 0xA0]] = _SPACE
_LETTERS = bw.mix(np.arange(_LATIN, dtype=bw.U), 11)
#: Encoded pieces that a worker keeps at most; beyond that it starts anew.
CACHE_PIECES = 400_000


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the tokenizer's pieces in joined Latin texts; first: starts of the texts and the end.

    The pieces are: 's 't 're 've 'm 'll 'd, runs of letters, of numbers or of
    other signs with one blank before them, and runs of white space.
    """
    n = len(cp)
    kind = _CLASS[cp]
    head = np.zeros(n + 1, bool)
    head[first] = True
    start = head.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    # the last character of white space before a word stands alone, or joins the word if it is a blank
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~head[1:n])
    start[last] = True
    start[last[cp[last] == 0x20] + 1] = False
    # contractions: a lone apostrophe that begins a piece
    tick = np.flatnonzero((cp == 0x27) & start[:n])
    if len(tick):
        pad = np.append(cp, [0, 0, 0])
        edge = np.append(head, [True, True, True])
        a, b = pad[tick + 1], pad[tick + 2]
        near, far = ~edge[tick + 1], ~edge[tick + 1] & ~edge[tick + 2]
        one = near & np.isin(a, [ord(x) for x in "stmd"])
        two = far & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        hit = tick[one | two]
        start[hit + 1] = False
        start[np.minimum(np.where(one, tick + 2, tick + 3)[one | two], n)] = True
    return np.flatnonzero(start[:n])


class Encoder:
    """Ids of texts, with a cache of pieces."""

    def __init__(self, vocabulary: str = "byte_bpe_50k"):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_file(f"{vocabulary}.json"))
        self.whole.encode_special_tokens = True
        self.one = self._pieces(vocabulary)
        self._empty()

    def _pieces(self, vocabulary: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(tokenizer_file(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        ranks_of = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return getattr(ranks_of, "_encode_single_piece", ranks_of.encode_ordinary)  # without splitting it again, where the library offers that

    def _empty(self) -> None:
        self.known: dict[int, int] = {}
        self.at, self.ids = array("q", [0]), array("I")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's begin (and the end)."""
        joined = "".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        if len(cp) and int(cp.max()) >= _LATIN:
            return self._mixed(texts)
        return self._latin(joined, cp, np.cumsum([0, *map(len, texts)]))

    def _mixed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        other = [not t.isascii() and max(map(ord, t)) >= _LATIN for t in texts]
        ids, at = self.encode([t for t, o in zip(texts, other, strict=True) if not o])
        latin = iter(np.split(ids, at[1:-1]) if len(at) > 1 else [])
        rest = iter(self.whole.encode_batch([t for t, o in zip(texts, other, strict=True) if o], add_special_tokens=False))
        out = [np.array(next(rest).ids, np.uint32) if o else next(latin) for o in other]
        return np.concatenate([np.zeros(0, np.uint32), *out]), np.cumsum([0, *map(len, out)])

    def _latin(self, joined: str, cp: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(cp):
            return np.zeros(0, np.uint32), np.zeros(len(first), np.int64)
        start = piece_starts(cp, first[:-1][np.diff(first) > 0])
        end = np.append(start[1:], len(cp))
        place = np.arange(len(cp)) - np.repeat(start, end - start)
        h = bw.mix(np.add.reduceat(_LETTERS[cp] * (bw._PLACE[place & 0xFFFF] + (place >> 16).astype(bw.U)), start) + (end - start).astype(bw.U))
        row, distinct = pd.factorize(h)
        example = np.empty(len(distinct), np.int64)
        example[row[::-1]] = np.arange(len(row) - 1, -1, -1)
        if len(self.known) > CACHE_PIECES:
            self._empty()
        slot = np.fromiter(map(self.known.get, distinct.tolist(), iter(lambda: -1, 0)), np.int64, len(distinct))
        for i in np.flatnonzero(slot < 0).tolist():
            x = example[i]
            self.ids.extend(self.one(joined[start[x] : end[x]]))
            self.at.append(len(self.ids))
            slot[i] = self.known[int(distinct[i])] = len(self.at) - 2
        at, ids = np.array(self.at), np.array(self.ids, dtype=np.uint32)
        begin, count = at[slot], at[slot + 1] - at[slot]
        n = count[row]
        before = np.concatenate([[0], np.cumsum(n)])
        flat = ids[np.repeat(begin[row] - before[:-1], n) + np.arange(before[-1])]
        return flat, before[np.searchsorted(start, first)]


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def pieces(docs: DataFrame, capacity: int = 2048, vocabulary: str = "byte_bpe_50k", end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its text's ids and then ``end_id``; a null or empty text is
    that one id.  Longer ones are cut into pieces of ``capacity`` ids, and only
    the first may be shorter.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def run(batches):
        code = encoder(vocabulary)
        for whole in batches:
            for part in bw.slices(whole):
                doc_ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                flat, at = code.encode(part.column("text").fill_null("").to_pylist())
                size = np.diff(at) + 1
                count = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                cut = size - (count - 1) * capacity
                start = np.where(piece == 0, 0, cut[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, cut[doc], capacity)
                ended = np.insert(flat, at[1:], end_id).astype("<u4")
                base = (at[:-1] + np.arange(len(size)))[doc] + start
                view = memoryview(ended).cast("B")
                crc = np.fromiter((zlib.crc32(view[4 * a : 4 * (a + b)]) for a, b in zip(base.tolist(), length.tolist(), strict=True)), np.int64, len(doc))
                columns = [doc_ids[doc], piece.astype(np.int32), start, length, crc]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(base, len(ended)), pa.int32()), pa.array(ended.astype(np.int32))))
                yield bw.batch(schema, *columns)

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)


@dataclass
class Plan:
    """(lengths in one sequence, how many such sequences), the least number that any plan needs, and how often a search was cut."""

    fillings: list[tuple[list[int], int]]
    lower_bound: int
    cut_searches: int = 0

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.fillings)


def completion(counts: dict[int, int], largest: int, room: int, nodes: int | None = 4000, enough: int = 0) -> tuple[dict[int, int], bool]:
    """Lengths that fill ``room`` beside ``largest`` with the least waste, how often each, and whether the search was cut.

    Depth-first, larger lengths first, so the first filling found is best-fit
    decreasing and the incumbent; one with a shorter length in a longer one's
    place is dominated and is met only if the longer one wastes more.  A
    branch is cut when even the best sum of lengths within its room wastes as
    much as the incumbent, and the search ends at a waste of ``enough`` or
    after ``nodes`` steps (None: never).
    """
    sizes = sorted((x for x, n in counts.items() if n and x <= room), reverse=True)
    reach = []  # reach[i]: bit s is set if lengths from i on can add up to s
    bits = 1
    mask = (1 << (room + 1)) - 1
    for x in reversed(sizes):
        n, step = min(counts[x] - (x == largest), room // x), 1
        while n > 0:
            take = min(step, n)
            bits |= (bits << (take * x)) & mask
            n, step = n - take, step * 2
        reach.append(bits)
    reach.reverse()
    best: tuple[int, dict[int, int]] = (room, {})
    left = -1 if nodes is None else nodes
    done = False

    def search(i: int, room: int, filling: dict[int, int]) -> None:
        nonlocal best, left, done
        left -= 1
        if room < best[0]:
            best = (room, dict(filling))
        done = done or best[0] <= enough or left == 0
        if i >= len(sizes) or done:
            return
        fits = reach[i] & ((1 << (room + 1)) - 1)
        if room - (fits.bit_length() - 1) >= best[0]:
            return
        x = sizes[i]
        have = min(counts[x] - (x == largest), room // x)
        for n in range(have, -1, -1):
            if n:
                filling[x] = n
            else:
                filling.pop(x, None)
            j = i + 1
            while j < len(sizes) and sizes[j] > room - n * x:
                j += 1
            search(j, room - n * x, filling)
            if done:
                break
        filling.pop(x, None)

    search(0, room, {})
    return best[1], left == 0 and best[0] > enough


def _completed(histogram: dict[int, int], capacity: int, nodes: int | None, enough: int) -> tuple[list[tuple[list[int], int]], int]:
    """Bins one after another, each around the largest length left, and how many searches were cut."""
    counts, out, cut = dict(histogram), [], 0
    for largest in sorted(counts, reverse=True):
        while counts[largest]:
            rest, stopped = completion(counts, largest, capacity - largest, nodes, enough)
            cut += stopped
            fill = [largest] + [x for x, n in sorted(rest.items(), reverse=True) for _ in range(n)]
            need = Counter(fill)
            times = min(counts[x] // n for x, n in need.items())
            for x, n in need.items():
                counts[x] -= n * times
            out.append((fill, times))
    return out, cut


def _best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing over the histogram: the pieces of one length go to the fullest open bins that have room."""
    open_bins: dict[int, dict[tuple[int, ...], int]] = {capacity: {(): sum(histogram.values())}}  # by room; empty bins as needed
    for x in sorted(histogram, reverse=True):
        left = histogram[x]
        for room in sorted(r for r in open_bins if r >= x):
            if not left:
                break
            for fill, n in list(open_bins[room].items()):
                each = room // x if n * (room // x) <= left else max(1, left // n)
                bins = min(n, left // each)
                if bins:
                    open_bins[room][fill] -= bins
                    after = open_bins.setdefault(room - each * x, {})
                    after[(*fill, *[x] * each)] = after.get((*fill, *[x] * each), 0) + bins
                    left -= bins * each
                if not left:
                    break
    return [(list(fill), n) for fills in open_bins.values() for fill, n in fills.items() if n and fill]


def plan_bins(histogram: dict[int, int], capacity: int = 2048, nodes: int | None = 4000) -> Plan:
    """Sequences that hold every piece of the histogram, as few as found.

    A whole best-fit decreasing plan is the first incumbent.  Bin completion
    is then tried with growing contentment: with ``enough`` 0 every bin has
    the least waste, with more it keeps to larger pieces and leaves the small
    ones for later bins.  The first plan that reaches the lower bound ends the
    search, and otherwise the one with the fewest sequences is kept.
    """
    import sys

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * capacity + 1000))
    histogram = {x: n for x, n in histogram.items() if n}
    halves = sum(n for x, n in histogram.items() if 2 * x > capacity)  # no two of these share a sequence
    bound = max(-(-sum(x * n for x, n in histogram.items()) // capacity), halves)
    best = Plan(_best_fit(histogram, capacity), bound)
    cut = 0
    for enough in (0, capacity // 512, capacity // 128, capacity // 32):
        if best.sequences == bound:
            break
        fillings, stopped = _completed(histogram, capacity, nodes, enough)
        cut += stopped
        if sum(n for _, n in fillings) < best.sequences:
            best = Plan(fillings, bound)
    best.cut_searches = cut
    return best


def packed(cut: DataFrame, capacity: int = 2048, nodes: int | None = 4000, part_pieces: int = 50_000) -> DataFrame:
    """Adds sequence_id and offset to the result of pieces().

    What comes to the driver is one count for each length, at most
    ``capacity`` rows.  Pieces of one length are numbered in hashed parts, as
    many as make about ``part_pieces`` of all pieces each, so a length that
    most documents have is never one task's work.  ``nodes`` bounds the search
    for one filling (plan_bins); no piece is lost by it.
    """
    cut = keep(cut)
    parts = cut.count() // part_pieces + 1
    cut = cut.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(parts)).cast("int"))
    counts = keep(cut.groupBy("length", "_part").count())
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    slots, base = [], 0
    taken: dict[int, int] = {}
    for fill, times in plan_bins(histogram, capacity, nodes).fillings:
        offset = 0
        for x in fill:
            slots.append((x, taken.get(x, 0), base, offset))
            taken[x] = taken.get(x, 0) + times
            offset += x
        base += times
    slots.sort()
    length, low, first, offset = (np.array([s[i] for s in slots], np.int64) for i in range(4))
    block = np.searchsorted(length, np.arange(capacity + 2))
    shared = cut.sparkSession.sparkContext.broadcast((low, first, offset, block))

    def place(batches):
        low, first, offset, block = shared.value
        for b in batches:
            size = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("_rank").to_numpy(zero_copy_only=False)
            row = np.zeros(len(size), np.int64)
            for x in np.unique(size):
                of = size == x
                row[of] = block[x] + np.searchsorted(low[block[x] : block[x + 1]], rank[of], "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "_rank"), pa.array(first[row] + rank - low[row]), pa.array(offset[row])], names=[*(c for c in b.schema.names if c != "_rank"), "sequence_id", "offset"])

    before = F.coalesce(F.expr("sum(count) over (partition by length order by _part rows between unbounded preceding and 1 preceding)"), F.lit(0))
    starts = counts.select("length", "_part", before.alias("_before"))  # at most capacity * parts rows
    names = [c for c in cut.columns if c != "_part"]
    ranked = cut.withColumn("_n", F.expr("row_number() over (partition by length, _part order by doc_id, piece, start)")).join(starts.hint("merge"), ["length", "_part"])
    out = ranked.select(*names, (F.col("_before") + F.col("_n") - 1).alias("_rank"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.select(*names).schema)
    return out.mapInArrow(place, f"{kind}, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str = "byte_bpe_50k", with_ids: bool = True) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most ``capacity`` ids."""
    return packed(pieces(docs, capacity, vocabulary, with_ids=with_ids), capacity)
