"""Language of texts and pages from several kinds of evidence.

Three kinds are multiplied: the likelihood of the text's byte trigrams, the
likelihood of the language that markup or metadata declares, and the prior of
the host, smoothed towards its address suffix, and that towards all hosts.
The priors and the declaration's reliability are grouped sums over all rows of
what the text alone says; a row's own share is taken out of its host's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .extract import main_text
from .frames import keep

BUCKETS = 1 << 15
_FOLD = bw.ALNUM[1]


def visible(page: str) -> str:
    return main_text(page, None)[0]


def _trigrams(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte trigram without a digit or sign, and the text it is in."""
    data, offsets = bw.buffer(col)
    low = np.where(bw.ALNUM[0][_FOLD[data]], _FOLD[data], 0x20).astype(np.uint32)
    low[(data >= 0x30) & (data <= 0x39)] = 0x20
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = (doc[:-2] == doc[2:]) & (low[1:-1] != 0x20)
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)
    return bucket[inside], doc[:-2][inside]


class TextModel:
    """Smoothed log-probabilities of trigram buckets by language."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        table = np.array([counts[x] for x in self.languages], np.float64).reshape(len(self.languages), BUCKETS) + 0.1
        self.log = np.log(table / table.sum(1, keepdims=True)).T.astype(np.float32)

    def scores(self, col: pa.Array, most: int) -> np.ndarray:
        """Log-likelihoods; a text's trigrams weigh no more than ``most`` independent ones."""
        bucket, doc = _trigrams(col)
        out = np.stack([np.bincount(doc, self.log[bucket, i], minlength=len(col)) for i in range(len(self.languages))], 1) if len(col) else np.zeros((0, len(self.languages)))
        n = np.bincount(doc, minlength=len(col))
        return out * (np.minimum(n, most) / np.maximum(n, 1))[:, None]


def train(labelled: DataFrame, of_each: int = 5_000, labels: int = 500) -> TextModel:
    """Counts trigrams by label over (doc_id, text, lang); null labels and texts are left out.

    Of each label it takes about ``of_each`` documents, all where there are
    fewer, chosen by hashed doc_id; so a rare label is in the model like a
    common one.  Tasks count, a shuffle adds up, and one row of
    ``BUCKETS`` counts for each label comes to the driver.

    The labelled rows that it learns from are those of the ``labels`` labels
    with most rows, ties by name.  That bounds the model, which has a column of
    ``BUCKETS`` numbers for each, where a free-text field puts a new label into
    every other row.  Rows of other labels are identified like all others, and
    what they declare stays evidence.  Repeated rows count as often as they stand.
    """
    some = labelled.where("lang is not null").select("doc_id", "text", "lang")
    sizes = keep(some.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(labels))  # reads no text
    share = F.lit(float(of_each)) / F.col("count")
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1) / F.lit(float(1 << 63))
    some = some.join(sizes.select("lang", share.alias("_share")).hint("broadcast"), "lang").where(place < F.col("_share")).drop("_share")
    counts = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for whole in batches:
            for part in bw.slices(whole):
                langs = np.array(part.column("lang").to_pylist(), dtype=object)
                bucket, doc = _trigrams(part.column("text"))
                for lang in set(langs):
                    of = bucket[(langs == lang)[doc]] if len(doc) else bucket
                    total[lang] = total.get(lang, 0) + np.bincount(of, minlength=BUCKETS)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield bw.batch(counts, [lang] * len(at), at.astype(np.int32), n[at].astype(np.int64))

    summed = some.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = {r.lang: np.zeros(BUCKETS, np.int64) for r in sizes.collect()}
    for r in summed.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts")).toLocalIterator():
        at = np.array(r.counts, np.int64).reshape(-1, 2)
        table[r.lang][at[:, 0]] = at[:, 1]
    return TextModel(table)


def declared_of(page: Column) -> Column:
    return F.lower(F.regexp_extract(page, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]+)", 1))


def identify(rows: DataFrame, model: TextModel, *, keys: list[str], is_page: str | None = None, most: int = 60, host_weight: float = 5.0, suffix_weight: float = 20.0, least_sure: float = 0.0, broadcast_rows: int = 50_000) -> DataFrame:
    """keys, host, declared, text_lang, lang, probability.

    rows has ``text``, ``declared`` and ``host`` besides the keys; nulls are
    missing evidence.  Every declared value has its own reliability, however
    rare it is; the tables of hosts and of declared values are broadcast up to
    ``broadcast_rows`` rows and joined in a shuffle beyond.  If ``is_page`` names a boolean column, those texts are
    HTML.  Without any trained language, lang is null.  A text without letters
    is decided by its declaration and host.  Equal scores go to the first
    language by name.  Repeated rows are rows like any other.  Between the
    steps a row carries two numbers for each language.
    """
    languages = model.languages
    if not languages:
        nothing = F.lit(None).cast("string")
        return rows.select(*keys, "host", "declared", nothing.alias("text_lang"), nothing.alias("lang"), F.lit(None).cast("double").alias("probability"))
    shared = rows.sparkSession.sparkContext.broadcast(model)
    page = F.col(is_page) if is_page else F.lit(False)
    given = rows.select(*keys, F.coalesce("host", F.lit("")).alias("host"), F.coalesce(F.lower("declared"), F.lit("")).alias("declared"), page.alias("_page"), "text")
    given = given.withColumn("suffix", F.regexp_extract("host", r"\.([^.]+)$", 1))
    carried = [c for c in given.columns if c not in ("_page", "text")]

    def run(batches):
        for whole in batches:
            for part in bw.slices(whole):
                pages = part.column("_page").to_pylist()
                col = part.column("text")
                if any(pages):
                    col = pa.array([visible(t) if p and t else t for p, t in zip(pages, col.to_pylist(), strict=True)], pa.large_string())
                log = shared.value.scores(col, most).astype(np.float64)
                soft = np.exp(log - log.max(1, keepdims=True))
                soft /= soft.sum(1, keepdims=True)
                first = pa.array(np.array(languages, dtype=object)[log.argmax(1)], pa.string())
                ends = pa.array(np.arange(len(log) + 1) * len(languages), pa.int32())
                both = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (log, soft)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), *both, first], names=[*carried, "log", "soft", "text_lang"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.select(*carried).schema)
    scored = keep(given.mapInArrow(run, f"{kind}, log array<double>, soft array<double>, text_lang string"))
    n = range(len(languages))
    sums = [F.sum(F.col("soft")[i]) for i in n]

    hosts = keep(scored.groupBy("suffix", "host").agg(F.array(*sums).alias("of_host")))
    in_all = F.aggregate("of_host", F.lit(0.0), lambda a, x: a + x)
    suffixes = hosts.groupBy("suffix").agg(F.array(*[F.sum(F.col("of_host")[i]) for i in n]).alias("of_suffix"), F.sum(in_all).alias("in_suffix"))
    sum_row = hosts.agg(*[F.sum(F.col("of_host")[i]).alias(f"x{i}") for i in n]).first()
    everywhere = [sum_row[f"x{i}"] or 0.0 for i in n]
    base = [(x + 1) / ((sum(everywhere) or 1.0) + len(languages)) for x in everywhere]
    known = scored.where("declared <> ''").groupBy("declared").agg(F.array(*sums).alias("of_declared"))
    kinds = known.count()

    # Arrays meet element by element, so that an expression is as long for five hundred languages as for two.
    prior = F.zip_with("of_suffix", F.lit(base), lambda x, b: (x + suffix_weight * b) / (F.col("in_suffix") + suffix_weight))
    priors = keep(hosts.join(suffixes.hint("merge"), "suffix").select("host", "of_host", prior.alias("of_suffix")))
    small = lambda df, rows: df.hint("broadcast" if rows <= broadcast_rows else "merge")
    joined = scored.join(small(priors, priors.count()), "host").join(small(keep(known), kinds), "declared", "left")
    others = F.zip_with("of_host", "soft", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    rest = F.zip_with(others, "of_suffix", lambda a, b: a + host_weight * b)
    says = F.zip_with("of_declared", F.lit(everywhere), lambda a, b: (a + 0.5) / (b + 0.5 * (kinds + 1)))
    score = F.when(F.col("of_declared").isNull(), F.col("log")).otherwise(F.zip_with("log", says, lambda a, b: a + F.log(b)))
    score = F.zip_with(score, rest, lambda a, b: a + F.log(b))
    joined = joined.withColumn("score", score).withColumn("_best", F.array_max("score"))
    sure = 1 / F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_best")))
    lang = F.get(F.array(*map(F.lit, languages)), F.array_position("score", F.col("_best")).cast("int") - 1)
    return joined.select(*keys, "host", "declared", "text_lang", F.when(sure >= least_sure, lang).alias("lang"), sure.alias("probability"))
