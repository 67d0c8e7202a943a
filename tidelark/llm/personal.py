"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The field is trained on a small labelled table of cases that the patterns miss
(``examples``) and on a bounded number of the patterns' own findings.  It reads
zones, the stretches around digits, at-signs and spelled-out dots, cut into
runs of letters or digits and single signs; outside zones nothing can be
labelled.  Zones are decoded by Viterbi, many at once in numpy, and a span is
added only where its pieces' marginal probabilities reach a threshold that
held-out rows set for a wanted precision.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from . import examples
from .frames import keep, sampled

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a match can only begin where digits do
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ODD = str.maketrans("", "", " -+().")
_DOUBLE = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(_DOUBLE[x] for x in d[1::2])) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """From each at-sign outwards, which is linear; the pattern alone would retry every start."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            end = m.end()
            out.append((a, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind."""
    out = [(a, b, 0) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in m[0].split("."))):
            out.append((*m.span(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := m[0].translate(_ODD)) <= 19 and luhn(d):
            out.append((*m.span(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(m[0].translate(_ODD)) <= 15:
                out.append((*m.span(), 3))
    out.sort(key=lambda x: (x[0], x[2]))
    return [(a, b, KINDS[k]) for a, b, k in out]


def swallowed(text: str) -> bool:
    """Whether a pattern's match has too many digits, so that what stands inside it has no label."""
    digits = lambda m: len(m[0].translate(_ODD))
    return any(digits(m) > 19 for m in _CARD.finditer(text)) or any(digits(m) > 15 for m in _PHONE.finditer(text))


_HOT = re.compile(r"[0-9@]+|[dD](?:ot|OT)(?=[\x20\])}>])|[\[({<] ?(?:at|AT) ?[\])}>]")
_OPENS = frozenset(" [({<")
_BEFORE = re.compile(r"(?:[^\x20\x09-\x0D]{0,40}[\x20\x09-\x0D]){0,2}[^\x20\x09-\x0D]{0,80}\Z")
#: Around a spelled-out dot there may be words for the at-sign and further dots.
_FAR_BEFORE = re.compile(r"(?:[^\x20\x09-\x0D]{0,40}[\x20\x09-\x0D]){0,5}[^\x20\x09-\x0D]{0,80}\Z")
_AFTER = re.compile(r"[^\x20\x09-\x0D]{0,80}(?:[\x20\x09-\x0D][^\x20\x09-\x0D]{0,40}){0,2}")
_PIECE = re.compile(r"[A-Za-z]+|[0-9]+|[^\W\d_]+|[^\x20\x09-\x0D]")


def zones(text: str) -> list[tuple[int, int]]:
    """Stretches around digits and at-signs: about two words on either side, joined where they meet."""
    out: list[list[int]] = []
    for m in _HOT.finditer(text):
        spelled = m[0][0] in "dD[({<"
        if m[0][0] in "dD" and text[m.start() - 1 : m.start()] not in _OPENS:
            continue
        if out and m.end() <= out[-1][1] - 40:
            continue
        b = _AFTER.match(text, m.end()).end()
        if out and m.start() <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
            continue
        low = max(0, m.start() - 290 if spelled else m.start() - 170)
        a = low + (_FAR_BEFORE if spelled else _BEFORE).search(text[low : m.start()]).start()
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def shape(piece: str) -> str:
    if piece[0] in "0123456789":
        n = len(piece)
        if n == 3 and piece > "255":
            return "d3+"
        return f"d{n if n <= 4 else '5-8' if n <= 8 else '9-11' if n <= 11 else '12-16' if n <= 16 else '17+'}"
    if piece.isalpha():
        n = len(piece)
        if n <= 3 and (word := piece.lower()) in ("at", "dot"):
            return word
        return f"{'A' if piece.isupper() else 'Aa' if piece[0].isupper() else 'a'}{n if n <= 3 else '4-8' if n <= 8 else '9+'}"
    return piece


def cut(text: str, a: int, b: int) -> list[tuple[int, int]]:
    return [m.span() for m in _PIECE.finditer(text, a, b)]


def _checked(text: str, at: list[tuple[int, int]]) -> list[str]:
    """For each piece how many dotted numbers stand together, and whether it begins, or is inside, digit groups that pass Luhn's check."""
    out, dotted = [""] * len(at), [""] * len(at)
    for i, (x, y) in enumerate(at):
        if not text[x].isdecimal() or y - x > 19:
            continue
        if not dotted[i]:
            run = [i]
            while run[-1] + 2 < len(at) and text[at[run[-1]][1] : at[run[-1] + 2][0]] == "." and text[at[run[-1] + 2][0]].isdecimal():
                run.append(run[-1] + 2)
            for g in run:
                dotted[g] = f"{min(len(run), 6)}{'' if all(at[k][1] - at[k][0] <= 3 and text[slice(*at[k])] <= '255' or at[k][1] - at[k][0] < 3 for k in run) else '+'}"
        j, groups = i, [i]
        digits = text[x:y]
        while True:
            if 12 <= len(digits) <= 19 and digits.isascii() and luhn(digits):
                for k, g in enumerate(groups):
                    out[g] = out[g] or ("B" if not k else "I")
            step = 2 if j + 2 < len(at) and text[at[j][1] : at[j + 2][0]] == "-" else 1 if j + 1 < len(at) and text[at[j][1] : at[j + 1][0]] == " " else 0
            if not step or len(groups) == 5 or y - x > 6:
                break
            j += step
            p, q = at[j]
            if not text[p].isdecimal() or q - p > 6:
                break
            groups.append(j)
            digits += text[p:q]
    return [f"{a}.{b}" if a or b else "" for a, b in zip(out, dotted, strict=True)]


def featured(text: str, at: list[tuple[int, int]]) -> list[list[str]]:
    """Features of each of the pieces."""
    shapes = ["^", "^", *(shape(text[i:j]) for i, j in at), "$", "$"]
    gaps = [0, *(int(x[1] < y[0]) for x, y in zip(at, at[1:])), 0]
    checks = ["", *_checked(text, at), ""]
    out = []
    for i, (x, y) in enumerate(at):
        s0, s1, s2, s3, s4 = shapes[i : i + 5]
        g = f"{gaps[i]}{gaps[i + 1]}"
        out.append([f"0{s2}", f"1{s1}", f"2{s3}", f"3{s1}|{s2}|{g[0]}", f"4{s2}|{s3}|{g[1]}", f"5{s0}|{s1}", f"6{s3}|{s4}", f"7{s1}|{s2}|{s3}|{g}", f"8{g}", f"9{text[x:y].lower()}" if text[x:y].isalpha() and y - x <= 5 else "9", f"L{checks[i]}|{checks[i + 1]}|{checks[i + 2]}"])
    return out


LABELS = 1 + 2 * len(KINDS)  # O, then B and I of each kind


def labels_of(at: list[tuple[int, int]], base: list[tuple[int, int, str]]) -> list[int]:
    out = [0] * len(at)
    for a, b, kind in base:
        k, first = KINDS.index(kind), True
        for i, (x, y) in enumerate(at):
            if x >= a and y <= b and not out[i]:
                out[i] = 1 + 2 * k + (not first)
                first = False
    return out


class Field:
    """Weights of features by label and of neighbouring labels."""

    def __init__(self, names: dict[str, int]):
        self.names = names
        self.emit = np.zeros((len(names) + 1, LABELS))  # the last row is for unknown features
        self.move = np.zeros((LABELS, LABELS))
        self.ban = np.zeros((LABELS, LABELS))
        for inside in range(2, LABELS, 2):
            for x in range(LABELS):
                if x not in (inside, inside - 1):
                    self.ban[x, inside] = -1e4
        self.least, self.held_out = 0.9, {}
        self.start = np.where((np.arange(LABELS) > 0) & (np.arange(LABELS) % 2 == 0), -1e4, 0.0)

    def ids(self, features: list[list[str]]) -> np.ndarray:
        return np.array([[self.names.get(f, len(self.names)) for f in each] for each in features], np.int64)

    def _padded(self, zones: list[np.ndarray]):
        n = np.array([len(z) for z in zones])
        e = np.zeros((len(zones), n.max(), LABELS))
        for i, z in enumerate(zones):
            e[i, : len(z)] = self.emit[z].sum(1)
        return n, e

    @staticmethod
    def _lse(x, axis):
        m = x.max(axis, keepdims=True)
        return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)

    def marginals(self, zones: list[np.ndarray]):
        """Posterior of each label at each place, expected moves, and log partition sums."""
        n, e = self._padded(zones)
        move = self.move + self.ban
        steps = e.shape[1]
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0] + self.start
        for t in range(1, steps):
            new = self._lse(alpha[:, t - 1, :, None] + move, 1) + e[:, t]
            alpha[:, t] = np.where((t < n)[:, None], new, alpha[:, t - 1])
        for t in range(steps - 2, -1, -1):
            new = self._lse(move + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where((t + 1 < n)[:, None], new, 0)
        z = self._lse(alpha[:, -1], 1)
        live = np.arange(steps) < n[:, None]
        post = np.exp(np.minimum(alpha + beta - z[:, None, None], 0)) * live[:, :, None]
        moves = np.zeros_like(self.move)
        for t in range(1, steps):
            p = alpha[:, t - 1, :, None] + move + (e[:, t] + beta[:, t])[:, None, :] - z[:, None, None]
            moves += (np.exp(np.minimum(p, 0)) * (t < n)[:, None, None]).sum(0)
        return post, moves, z

    def viterbi(self, zones: list[np.ndarray]) -> list[np.ndarray]:
        n, e = self._padded(zones)
        move = self.move + self.ban
        best, back = e[:, 0] + self.start, np.zeros(e.shape, np.int64)
        for t in range(1, e.shape[1]):
            s = best[:, :, None] + move
            back[:, t] = s.argmax(1)
            best = np.where((t < n)[:, None], s.max(1) + e[:, t], best)
        label = best.argmax(1)
        out = np.zeros(e.shape[:2], np.int64)
        for t in range(e.shape[1] - 1, -1, -1):
            out[:, t] = label
            if t:
                label = np.where(t < n, np.take_along_axis(back[:, t], label[:, None], 1)[:, 0], label)
        return [o[:k] for o, k in zip(out, n, strict=True)]

    def fit(self, zones: list[np.ndarray], labels: list[list[int]], epochs: int = 30, seed: int = 5) -> Field:
        rng = np.random.default_rng(seed)
        params = [self.emit, self.move]
        total = [np.zeros_like(p) for p in params]
        order = np.argsort([len(z) for z in zones], kind="stable")
        batches = [order[k : k + 64] for k in range(0, len(order), 64)]
        for _ in range(epochs):
            for k in rng.permutation(len(batches)):
                take = batches[k]
                some = [zones[i] for i in take]
                post, moves, _ = self.marginals(some)
                emit, move = np.zeros_like(self.emit), -moves
                for i, (z, y) in enumerate(zip(some, (labels[i] for i in take), strict=True)):
                    d = -post[i, : len(z)]
                    d[np.arange(len(y)), y] += 1
                    for c in range(z.shape[1]):
                        np.add.at(emit, z[:, c], d)
                    np.add.at(move, (y[:-1], y[1:]), 1)
                for p, g, t in zip(params, (emit - 1e-3 * self.emit, move - 1e-3 * self.move), total, strict=True):
                    t += g * g
                    p += 0.3 * g / (np.sqrt(t) + 1e-6)
        return self


    def spans(self, zones: list[np.ndarray]) -> list[list[tuple[int, int, str, float]]]:
        """For each zone the labelled runs of its best path: first piece, end, kind, least marginal."""
        paths = self.viterbi(zones)
        out: list[list[tuple[int, int, str, float]]] = [[] for _ in zones]
        sure = [i for i, p in enumerate(paths) if p.any()]
        if not sure:
            return out
        post = self.marginals([zones[i] for i in sure])[0]
        for row, i in enumerate(sure):
            path, j = paths[i], 0
            while j < len(path):
                e = j + 1
                if path[j] and path[j] % 2:
                    while e < len(path) and path[e] == path[j] + 1:
                        e += 1
                    out[i].append((j, e, KINDS[(path[j] - 1) // 2], float(min(post[row, t, path[t]] for t in range(j, e)))))
                j = e
        return out


def fitted(rows: list[tuple[str, list[tuple[int, int, str]]]], *, precision: float = 0.98, held: int = 4) -> Field:
    """A field for labelled texts; one row of ``held`` is kept out and sets ``least`` and ``held_out``.

    least is the lowest marginal at which the spans that the patterns miss in
    the rows kept out still have this precision; held_out tells their
    precision, recall and number.
    """
    names: dict[str, int] = {}
    given, labels, kept_out = [], [], []
    for text, spans in rows:
        at = cut(text, 0, len(text))
        if not at:
            continue
        if zlib.crc32(text.encode()) % held == 0:
            kept_out.append((text, at, spans))
            continue
        features = featured(text, at)
        given.append(features)
        labels.append(labels_of(at, spans))
        for each in features:
            for f in each:
                names.setdefault(f, len(names))
    field = Field(names)
    field.fit([field.ids(f) for f in given], labels)
    said, wanted = [], 0
    for k in range(0, len(kept_out), 64):
        some = kept_out[k : k + 64]
        for (text, at, spans), got in zip(some, field.spans([field.ids(featured(t, at)) for t, at, _ in some]), strict=True):
            far = lambda a, b, base=base_spans(text): not any(x < b and a < y for x, y, _ in base)
            wanted += sum(far(a, b) for a, b, _ in spans)
            said += [(p, (at[i][0], at[j - 1][1], kind) in spans) for i, j, kind, p in got if far(at[i][0], at[j - 1][1])]
    said.sort(reverse=True)
    right = np.cumsum([ok for _, ok in said])
    share = right / np.arange(1, len(said) + 1)
    enough = np.flatnonzero(share >= precision)
    last = int(enough[-1]) if len(enough) else -1
    field.least = said[last][0] if last >= 0 else 1.1
    field.held_out = {"precision": float(share[last]) if last >= 0 else 1.0, "recall": float(right[last] / max(1, wanted)) if last >= 0 else 0.0, "spans": wanted}
    return field


def train(docs: DataFrame, *, sample_docs: int = 20_000, zones_used: int = 1_500, examples_used: int = 1_500, precision: float = 0.98) -> Field:
    """A field fitted on the labelled table and at most ``zones_used`` zones of the corpus.

    Two thirds of the zones hold findings of the patterns, from all documents;
    the others hold none, from about ``sample_docs`` documents.  Both are those
    with the least hashes.  Zones in which a pattern's match ran too long have
    no certain label and are left out.
    """
    schema = pa.schema([("zone", pa.string()), ("spans", pa.string()), ("found", pa.bool_())])

    def run(batches):
        for whole in batches:
            out = []
            for text, sample in zip(whole.column("text").to_pylist(), whole.column("sample").to_pylist(), strict=True):
                base = base_spans(text or "")
                if not base and not sample:
                    continue
                for a, b in zones(text or ""):
                    mine = [(x - a, y - a, k) for x, y, k in base if x >= a and y <= b]
                    if b - a <= 600 and (mine or sample) and not swallowed(text[a:b]):
                        out.append((text[a:b], ",".join(f"{k}:{x}:{y}" for x, y, k in mine), bool(mine)))
            if out:
                yield bw.batch(schema, *zip(*out, strict=True))

    rows = keep(sampled(docs, sample_docs).select("text", "sample").mapInArrow(run, "zone string, spans string, found boolean").dropDuplicates(["zone"]))
    got = [r for share, found in ((2, "found"), (1, "not found")) for r in rows.where(found).orderBy(F.xxhash64("zone"), "zone").limit(share * zones_used // 3).collect()]
    of_corpus = [(r.zone, [(int(x), int(y), k) for k, x, y in (s.split(":") for s in r.spans.split(",") if s)]) for r in got]
    return fitted([*examples.personal_rows(examples_used), *of_corpus], precision=precision)


#: A zone is decoded in stretches of so many pieces, each with a margin of its neighbours on either side.
STRETCH, MARGIN = 192, 32


def decode(field: Field, texts: list[str], spots: list[tuple[int, int, int]], least: float) -> list[tuple[int, int, int, str]]:
    """(text number, start, end, kind) of labelled runs in the zones whose every marginal is at least ``least``.

    A run belongs to the stretch in which it begins.
    """

    def stretches():
        for d, a, b in spots:
            at = cut(texts[d], a, b)
            for k in range(0, len(at), STRETCH):
                low = max(0, k - MARGIN)
                near = at[low : k + STRETCH + MARGIN]
                yield d, near, k - low, min(k + STRETCH, len(at)) - low

    out = []

    def finish(some):
        some.sort(key=lambda x: len(x[1]))
        for k in range(0, len(some), 128):
            part = some[k : k + 128]
            for (d, at, low, high), got in zip(part, field.spans([field.ids(featured(texts[d], at)) for d, at, _, _ in part]), strict=True):
                out.extend((d, at[i][0], at[j - 1][1], kind) for i, j, kind, p in got if low <= i < high and p >= least)

    waiting: list = []
    for x in stretches():
        waiting.append(x)
        if len(waiting) == 1024:
            finish(waiting)
            waiting = []
    if waiting:
        finish(waiting)
    return out


def personal_data(docs: DataFrame, *, field: Field | None = None, **how) -> DataFrame:
    """For each document: base spans and all spans, as arrays of (start, end, kind).

    The field (one given, or one trained here) adds spans that touch no base
    span.  Null and empty texts have none, equal texts get equal spans, other
    columns are dropped.  Places count code points and ends are exclusive.
    """
    model = docs.sparkSession.sparkContext.broadcast(field or train(docs, **how))
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
    schema = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(span)), ("spans", pa.list_(span))])

    def run(batches):
        field = model.value
        for whole in batches:
            for part in bw.slices(whole):
                texts = [t or "" for t in part.column("text").to_pylist()]
                bases = [base_spans(t) for t in texts]
                full = [list(x) for x in bases]
                spots = [(d, a, b) for d, t in enumerate(texts) for a, b in zones(t)]
                edges = [np.array([(x, y) for x, y, _ in base], np.int64).reshape(-1, 2) for base in bases]
                for d, a, b, kind in decode(field, texts, spots, field.least):
                    if not len(edges[d]) or not ((edges[d][:, 0] < b) & (a < edges[d][:, 1])).any():
                        full[d].append((a, b, kind))
                full = [sorted(x, key=lambda s: (s[0], KINDS.index(s[2]))) for x in full]
                as_rows = lambda spans: [[dict(zip(("start", "end", "kind"), s, strict=True)) for s in x] for x in spans]
                yield bw.batch(schema, part.column("doc_id").to_numpy(zero_copy_only=False), pa.array(as_rows(bases), schema.types[1]), pa.array(as_rows(full), schema.types[2]))

    kind = "array<struct<start:int,end:int,kind:string>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")
