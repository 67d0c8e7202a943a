"""Leaked credentials: fixed patterns, and a character network for what they miss.

A small convolutional network in numpy is trained on a labelled table of cases
that the patterns miss (``examples``) and on a bounded number of the patterns'
own findings and of other tokens of the corpus.  It scores every candidate with
the characters around it: tokens of eight or more characters that are not plain
words, and words after a keyword.  Values are split into fitted and held-out
ones before any augmentation; the held-out ones calibrate the scores and set
a threshold that keeps the wanted recall there.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from . import examples
from .frames import keep, sampled

KINDS = ("assign", "access", "hex", "model")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # whole runs, so the length can stand in the pattern
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"""[^\x00-\x20"'`,;()<>\[\]{}|\\\x7F-\U0010FFFF]{6,}""")
_PART = re.compile(r"[^:=&?]{6,}=*")
_GROUPS = re.compile(r"(?:[0-9A-Fa-f]{2,8}:){3,}[0-9A-Fa-f]{2,8}")
_TRIMMED = re.compile(r"[-.#*&$%!?]*(.*?)[-.#*&$%!?]*", re.S)
_UNUSUAL = re.compile(r"[0-9]|[a-z][A-Z]|[A-Za-z][+/_=!@$%^&*~#-]+[A-Za-z]")
_KEYWORD = re.compile(r"(?i:pass|pwd|secret|token|key|credential|login|bearer)[a-z_-]*")
LEFT, RIGHT, WIDTH, FILTERS = 24, 12, 7, 32


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(*m.span(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), 1) for m in _ACCESS.finditer(text)]
    out += [(*m.span(), 2) for m in _HEX.finditer(text)]
    out.sort(key=lambda x: (x[0], x[2]))
    return [(a, b, KINDS[k]) for a, b, k in out]


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Tokens that no base span touches: of eight or more characters unless they are plain words, and of six or more near a keyword.

    A token with inner = & ? or : is cut there if a part is long enough, and an
    address with a name before its host at the at-sign too; signs around a
    token don't belong to it.
    """
    out, i = [], 0
    far = np.maximum.accumulate([b for _, b, _ in base]).tolist() if base else []
    keywords: list[int] | None = None
    for run in _RUN.finditer(text):
        start, whole = run.start(), run[0]
        parts = [run.span()]
        if ("=" in whole or "?" in whole or ":" in whole) and not _GROUPS.fullmatch(whole):
            parts = [(start + m.start(), start + m.end()) for m in _PART.finditer(whole)] or parts
            if "://" in whole and "@" in whole:
                parts = [(a, a + text[a:b].find("@")) if "@" in text[a:b] else (a, b) for a, b in parts]
        for a, b in parts:
            a, b = _TRIMMED.fullmatch(text, a, b).span(1)
            if b - a < 6:
                continue
            while i < len(base) and base[i][0] < b:
                i += 1
            if i and far[i - 1] > a:
                continue
            if b - a < 8 or not _UNUSUAL.search(text, a, b):
                if keywords is None:
                    keywords = [k.end() for k in _KEYWORD.finditer(text)]
                k = bisect_right(keywords, a)
                if not k or a - keywords[k - 1] > LEFT:
                    continue
            out.append((a, b))
    return out


_CLASS = np.full(128, 11, np.int64)
for _i, _set in enumerate(("abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/", "_.-", "=", "\"'", ":", " \t\r\n\v\f")):
    _CLASS[[ord(c) for c in _set]] = _i
CHANNELS = 15  # twelve classes, inside the candidate, its share of distinct characters, its length
#: Length from which candidates count as equally long.
LONGEST = 32


def window_of(text: str, a: int, b: int) -> tuple[str, int, int]:
    left = max(0, a - LEFT)
    return text[left : b + RIGHT], a - left, b - left


#: A longer window is read in parts of so many places; the maximum over places is the same.
PART = 4096


def _rows(windows: list[tuple[str, int, int]]):
    """(text, start and end of the candidate, its share of distinct characters, its length, places to read) for each part of each window."""
    out, first = [], []
    half = WIDTH // 2
    for t, a, b in windows:
        first.append(len(out))
        share, length = len(set(t[a:b])) / max(8, b - a), min(b - a, LONGEST) / LONGEST
        for lo in range(0, max(len(t), 1), PART):
            hi = min(lo + PART, len(t))
            left = max(0, lo - half)
            piece = t[left : hi + half]
            out.append((piece, max(0, min(a - left, len(piece))), max(0, min(b - left, len(piece))), share, length, lo - left, hi - left))
    return out, np.array(first, np.int64)


def _inputs(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Patches (n, places, WIDTH * CHANNELS) and a mask of places to read."""
    most = max(max(len(r[0]) for r in rows), WIDTH)
    x = np.zeros((len(rows), most + WIDTH - 1, CHANNELS), np.float32)
    mask = np.zeros((len(rows), most), bool)
    for i, (t, a, b, share, length, lo, hi) in enumerate(rows):
        code = np.minimum(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), 127)
        at = np.arange(len(t)) + WIDTH // 2
        x[i, at, np.where(code == 127, 11, _CLASS[code])] = 1
        x[i, at[a:b], 12] = 1
        x[i, at[a:b], 13] = share
        x[i, at[a:b], 14] = length
        mask[i, lo:hi] = True
    patches = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1)
    return patches.transpose(0, 1, 3, 2).reshape(len(rows), most, WIDTH * CHANNELS), mask


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Network:
    """Convolution, maximum over places, one logistic unit; then Platt scaling and a threshold."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, 0.3, (WIDTH * CHANNELS, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS).astype(np.float32), np.zeros(1, np.float32)]
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5
        self.held_out: dict[str, float] = {}

    def _pooled(self, x, mask):
        z = np.where(mask[:, :, None], x @ self.w[0] + self.w[1], -1e9)
        at = z.argmax(1)
        return at, np.maximum(np.take_along_axis(z, at[:, None], 1)[:, 0], 0)

    def raw(self, windows: list[tuple[str, int, int]], batch: int = 256) -> np.ndarray:
        """Uncalibrated scores; rows of like length share a batch."""
        if not windows:
            return np.zeros(0)
        rows, first = _rows(windows)
        order = np.argsort([len(r[0]) for r in rows], kind="stable")
        top = np.zeros((len(rows), FILTERS), np.float32)
        k = 0
        while k < len(order):
            size = max(1, min(batch, 40_000 // max(1, len(rows[order[min(k + batch, len(order)) - 1]][0]))))
            take = order[k : k + size]
            top[take] = self._pooled(*_inputs([rows[i] for i in take]))[1]
            k += size
        return (np.maximum.reduceat(top, first) @ self.w[2] + self.w[3]).astype(float)

    def scores(self, windows: list[tuple[str, int, int]]) -> np.ndarray:
        """Calibrated probabilities."""
        return _sigmoid(self.scale * self.raw(windows) + self.shift)

    def fit(self, windows: list[tuple[str, int, int]], y: np.ndarray, epochs: int = 16, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        rows = [_rows([w])[0][0] for w in windows]
        order = np.argsort([len(r[0]) for r in rows], kind="stable")
        batches = [order[k : k + 64] for k in range(0, len(order), 64)]
        m = [np.zeros_like(p) for p in self.w]
        v = [np.zeros_like(p) for p in self.w]
        step = 0
        weight = np.where(y, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3)).astype(np.float32)
        for _ in range(epochs):
            for k in rng.permutation(len(batches)):
                take = batches[k]
                x, mask = _inputs([rows[i] for i in take])
                at, top = self._pooled(x, mask)
                d = (_sigmoid(top @ self.w[2] + self.w[3]) - y[take]) * weight[take] / len(take)
                dt = d[:, None] * self.w[2] * (top > 0)
                best = x[np.arange(len(take))[:, None], at]  # (n, filters, width * channels)
                grads = [np.einsum("nfc,nf->cf", best, dt), dt.sum(0), top.T @ d, np.array([d.sum()])]
                step += 1
                for p, g, mi, vi in zip(self.w, grads, m, v, strict=True):
                    mi += 0.1 * (g - mi)
                    vi += 0.001 * (g * g - vi)
                    p -= (0.01 * (mi / (1 - 0.9**step)) / (np.sqrt(vi / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def calibrate(self, windows: list[tuple[str, int, int]], y: np.ndarray, doubtful: np.ndarray, recall: float, forms: np.ndarray | None = None, form_recall: float = 0.9) -> Network:
        """Platt scaling with his smoothed targets, and a threshold that finds this share of the credentials given.

        With ``forms``, a name for each row, it also finds ``form_recall`` of each form of twenty or more credentials, so that a
        rare form isn't what is given up.  Of the thresholds that do, and that take no more of the others than the
        highest such one, it is the middle.  Doubtful ones only count in ``held_out``, as others.
        """
        every, truth = self.raw(windows), y
        raw, y = every[~doubtful], y[~doubtful]
        names = np.array([""] * len(y)) if forms is None else forms[~doubtful]
        centre, spread = raw.mean(), max(raw.std(), 1e-6)
        target = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
        scale, shift, at = 1.0, 0.0, (raw - centre) / spread
        for _ in range(500):
            err = _sigmoid(scale * at + shift) - target
            scale -= 1.0 * float((err * at).mean())
            shift -= 1.0 * float(err.mean())
        self.scale, self.shift = scale / spread, shift - scale * centre / spread
        p = _sigmoid(self.scale * raw + self.shift)
        found = np.sort(p[y])
        keeps = found[int(np.floor((1 - recall) * len(found)))]  # any threshold up to here has the recall
        for name in np.unique(names[y]):
            own = np.sort(p[y & (names == name)])
            if len(own) >= 20:
                keeps = min(keeps, own[int(np.floor((1 - form_recall) * len(own)))])
        below = p[~y][p[~y] < keeps].max(initial=0.0)
        self.threshold = float((keeps + below) / 2)  # no higher than that, as far from credentials as from the rest
        said = _sigmoid(self.scale * every + self.shift) >= self.threshold
        right = int((said & truth).sum())
        self.held_out = {"recall": right / max(1, int(truth.sum())), "precision": right / max(1, int(said.sum())), "credentials": int(truth.sum()), "others": int((~truth).sum())}
        return self


def _blanked(t: str, a: int, b: int) -> tuple[str, int, int]:
    """The same value with nothing around it, so that the keyword alone doesn't decide."""
    return " " * a + t[a:b] + " " * (len(t) - b), a, b


def fitted(labelled: list[tuple], others: list[tuple[str, int, int]] = (), *, recall: float = 0.97, held: int = 4) -> Network:
    """A network for labelled windows (text, start, end, whether it is a credential and perhaps its form) and unlabelled tokens of the corpus.

    Other candidates in the labelled windows are none.  One value of ``held``
    is kept out.  Among the unlabelled tokens are the credentials that the
    patterns miss, so those that a first network, fitted on labelled rows
    alone, holds for credentials as surely as all but two in a hundred labelled ones are not used
    for fitting; among the values kept out they count as false findings.
    """
    labelled = [(*row[:4], row[4] if len(row) > 4 else "") for row in labelled]
    labelled += [(t, x, y, False, "") for t, a, b, *_ in labelled for x, y in candidates(t, [(a, b, "")])]
    out = lambda t, a, b: zlib.crc32(t[a:b].encode("utf-8", "surrogatepass")) % held == 0
    kept = [(*window_of(t, a, b), y) for t, a, b, y, _ in labelled if not out(t, a, b)]
    windows, y = [r[:3] for r in kept], np.array([r[3] for r in kept], bool)
    windows, y = windows + [_blanked(*w) for w in windows], np.concatenate([y, y])
    more, sure = [window_of(*o) for o in others], np.zeros(len(others), bool)
    if more:
        first = Network().fit(windows, y, epochs=8)
        sure = first.raw(more) >= np.quantile(first.raw([w for w, good in zip(windows, y, strict=True) if good]), 0.02)
    away = np.array([out(*o) for o in others], bool)
    fit = [w for w, use in zip(more, ~away & ~sure, strict=True) if use]
    net = Network().fit(windows + fit, np.concatenate([y, np.zeros(len(fit), bool)]))
    held_rows = [(window_of(t, a, b), good, False, form) for t, a, b, good, form in labelled if out(t, a, b)]
    held_rows += [(w, False, bool(d), "") for w, d, use in zip(more, sure, away, strict=True) if use]
    columns = [np.array([r[i] for r in held_rows], kind) for i, kind in ((1, bool), (2, bool), (3, str))]
    return net.calibrate([r[0] for r in held_rows], columns[0], columns[1], recall, columns[2])


def train(docs: DataFrame, *, sample_docs: int = 20_000, findings: int = 2_000, examples_used: int = 3_600, recall: float = 0.97) -> Network:
    """A network fitted on the labelled table, at most ``findings`` of the patterns' findings and as many other tokens.

    Findings come from all documents, other tokens from about ``sample_docs``
    of them; both are those with the least hashes.
    """
    schema = pa.schema([("window", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("found", pa.bool_())])

    def run(batches):
        for whole in batches:
            out = []
            for text, sample in zip(whole.column("text").to_pylist(), whole.column("sample").to_pylist(), strict=True):
                text = text or ""
                base = base_spans(text)
                for a, b, kind in base:
                    if kind == "assign":
                        a = _ASSIGN.match(text, a, b).start(2)  # the value itself
                    if b - a <= 400:
                        out.append((*window_of(text, a, b), True))
                if sample:
                    out += [(*window_of(text, a, b), False) for a, b in candidates(text, base) if b - a <= 400]
            if out:
                yield bw.batch(schema, *zip(*out, strict=True))

    rows = keep(sampled(docs, sample_docs).select("text", "sample").mapInArrow(run, "window string, a int, b int, found boolean").dropDuplicates(["window", "a", "b"]))
    got = [rows.where("found" if found else "not found").orderBy(F.xxhash64("window"), "window", "a").limit(findings).collect() for found in (True, False)]
    labelled = [*examples.secret_forms(examples_used), *((r.window, r.a, r.b, True) for r in got[0])]
    return fitted(labelled, [(r.window, r.a, r.b) for r in got[1]], recall=recall)


def secrets(docs: DataFrame, *, network: Network | None = None, **how) -> DataFrame:
    """For each document: base spans and all spans, as arrays of (start, end, kind).

    The network (one given, or one trained here) adds candidates that reach its
    threshold.  Null and empty texts have none.  Equal texts get equal spans;
    other columns are dropped.  Places count code points and ends are exclusive.
    """
    model = docs.sparkSession.sparkContext.broadcast(network or train(docs, **how))
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
    schema = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(span)), ("spans", pa.list_(span))])

    def run(batches):
        net = model.value
        for whole in batches:
            for part in bw.slices(whole):
                texts = [t or "" for t in part.column("text").to_pylist()]
                bases = [base_spans(t) for t in texts]
                extra: list[list] = [[] for _ in texts]
                spots = [(d, a, b) for d, t in enumerate(texts) for a, b in candidates(t, bases[d])]
                for k in range(0, len(spots), 4096):
                    some = spots[k : k + 4096]
                    for (d, a, b), p in zip(some, net.scores([window_of(texts[d], a, b) for d, a, b in some]), strict=True):
                        if p >= net.threshold:
                            extra[d].append((a, b, "model"))
                full = [sorted(x + y, key=lambda s: (s[0], KINDS.index(s[2]))) for x, y in zip(bases, extra, strict=True)]
                as_rows = lambda spans: [[dict(zip(("start", "end", "kind"), s, strict=True)) for s in x] for x in spans]
                yield bw.batch(schema, part.column("doc_id").to_numpy(zero_copy_only=False), pa.array(as_rows(bases), schema.types[1]), pa.array(as_rows(full), schema.types[2]))

    kind = "array<struct<start:int,end:int,kind:string>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")
