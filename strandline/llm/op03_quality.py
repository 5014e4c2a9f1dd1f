"""Quality classifier: regularised quadratic discriminant over document statistics.

Counts over the whole text (letters, capitals, digits, marks, words, their
lengths, repeats and variety) are made roughly normal by logarithms of smoothed
shares. Each class has a Gaussian whose covariance is drawn towards the pooled
one and towards a sphere; the score is the posterior of class 1, from the
difference of two Mahalanobis forms whose inverse Cholesky factors are computed
once. Moments are summed over all labelled training rows, none are sampled.

Defined cases: null and empty texts have the statistics of a text with no
characters and get a score like any; labels that are null or neither 0 nor 1
are not learnt from; of repeated labels of a document the largest counts; with
a class unseen the score is the share of the other; extra columns pass through,
and names that clash get underscores in front.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

FOLDS, THRESHOLD = 5, 0.3
#: Weight of the pooled covariance, and of the sphere.
POOLED, SPHERE = 0.1, 0.02

_KINDS = ("lower", "upper", "digit", "space", "line", "stop", "bang", "bar", "mark", "lead", "rest")
_KIND = np.full(256, _KINDS.index("mark"), np.uint8)
_KIND[0x61:0x7B] = _KINDS.index("lower")
_KIND[0x41:0x5B] = _KINDS.index("upper")
_KIND[0x30:0x3A] = _KINDS.index("digit")
_KIND[:0x21] = _KINDS.index("space")
_KIND[0x0A] = _KINDS.index("line")
for _c in b".,;:?'\"()-":
    _KIND[_c] = _KINDS.index("stop")
_KIND[ord("!")] = _KINDS.index("bang")
_KIND[ord("|")] = _KINDS.index("bar")
_KIND[0xC0:] = _KINDS.index("lead")
_KIND[0x80:0xC0] = _KINDS.index("rest")
FEATURES = ("length", "word_length", "upper", "digit", "space", "line", "stop", "bang", "bar", "mark", "beyond", "repeat", "variety")


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of each row's values."""
    out = np.zeros(len(offsets) - 1, np.int64)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full], dtype=np.int64)
    return out


def statistics(offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """The transformed statistics of some rows, a row each."""
    w = C.Words(offsets, raw)
    kind = _KIND[raw[int(offsets[0]) : int(offsets[-1])]]
    n = {k: _sums((kind == i).view(np.uint8), w.offsets).astype(np.float64) for i, k in enumerate(_KINDS)}
    letters = n["lower"] + n["upper"] + n["lead"]
    chars = sum(v for k, v in n.items() if k != "rest")
    words = np.diff(w.first).astype(np.float64)
    hashes = w.hashes()
    same = np.zeros(len(hashes), np.uint8)
    if len(hashes) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (w.row[1:] == w.row[:-1])
    repeats = _sums(same, w.first).astype(np.float64)
    order = np.lexsort((hashes, w.row))
    new = np.ones(len(hashes), np.uint8)
    if len(hashes) > 1:
        x, r = hashes[order], w.row[order]
        new[1:] = (x[1:] != x[:-1]) | (r[1:] != r[:-1])
    distinct = _sums(new, w.first).astype(np.float64)
    share = lambda a, b: np.log((a + 0.5) / (b + 2))
    return np.column_stack(
        [
            np.log1p(chars), np.log((letters + 1) / (words + 1)), share(n["upper"], letters), share(n["digit"], chars),
            share(n["space"], chars), share(n["line"], chars), share(n["stop"], words), share(n["bang"], words),
            share(n["bar"], words), share(n["mark"], words), share(n["lead"], letters), share(repeats, words),
            np.log((distinct + 1) / (words + 1)),
        ]
    )


@dataclass
class Discriminant:
    prior: np.ndarray
    mean: np.ndarray
    root: np.ndarray  # inverse Cholesky factors
    logdet: np.ndarray

    @classmethod
    def fit(cls, n: np.ndarray, total: np.ndarray, square: np.ndarray, pooled: float = POOLED, sphere: float = SPHERE) -> Discriminant:
        """From the count, sum and sum of outer products of each class."""
        k, d = total.shape
        seen = np.maximum(n, 1)[:, None]
        mean = total / seen
        cov = square / seen[:, :, None] - mean[:, :, None] * mean[:, None, :]
        both = (cov * n[:, None, None]).sum(0) / max(n.sum(), 1)
        roots, logdets = [], []
        for c in cov:
            c = (1 - pooled) * c + pooled * both
            c = (1 - sphere) * c + (sphere * np.trace(c) / d + 1e-6) * np.eye(d)
            low = np.linalg.cholesky(c)
            roots.append(np.linalg.inv(low))
            logdets.append(2 * np.log(np.diag(low)).sum())
        return cls(n / max(n.sum(), 1), mean, np.array(roots), np.array(logdets))

    def score(self, x: np.ndarray) -> np.ndarray:
        if (self.prior == 0).any():
            return np.full(len(x), self.prior[1] if self.prior.sum() else 0.5)
        form = [((x - m) @ r.T) ** 2 for m, r in zip(self.mean, self.root, strict=True)]
        logs = [np.log(p) - 0.5 * (f.sum(1) + g) for p, f, g in zip(self.prior, form, self.logdet, strict=True)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def in_fold(doc_id, folds: int):
    """Whether a row is held out: crc32 of the id as text, modulo the folds, is 0."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0, F.lit(False))


def labelled(labels: DataFrame, name: str) -> DataFrame:
    return labels.where(F.col(name).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(name).cast("int").alias("label"))


def _statistics(batches):
    for batch in batches:
        for part, offsets, raw in C.slices(batch, "text"):
            x = statistics(offsets, raw)
            flat = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), flat], ["doc_id", "x"])


def _moments(batches):
    d = len(FEATURES)
    out = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        x = np.array(batch.column("x").flatten()).reshape(-1, d)
        y = np.array(batch.column("label"))
        for k in (0, 1):
            z = x[y == k]
            out[k] += np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
    n = out.size
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(out.ravel())], ["at", "v"])


def with_statistics(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(C.tidied(_statistics), T.StructType([docs.schema["doc_id"], T.StructField("x", T.ArrayType(T.DoubleType()))]))


def fit(frame: DataFrame, labels: DataFrame, name: str = "quality", folds: int = FOLDS) -> Discriminant:
    """Learn from the labelled rows that aren't held out, of documents or of their statistics; the driver gets the moments alone."""
    d = len(FEATURES)
    known = C.written(labelled(labels, name), "labels")
    rows = frame.where(~in_fold(F.col("doc_id"), folds))
    if "x" not in frame.columns:  # of texts, those with labels only are gone through
        rows = with_statistics(C.within(rows.select("doc_id", "text"), known, "doc_id", "left_semi"))
        rows = C.written(rows, "statistics")  # else two Python functions in a stage, and two workers for each task
    rows = C.checked_join(rows.select("doc_id", "x"), known, "doc_id", "inner").select("x", "label")
    sums = rows.mapInArrow(C.tidied(_moments), "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(2 * (1 + d + d * d))
    for at, v in sums:
        out[at] = v
    out = out.reshape(2, -1)
    return Discriminant.fit(out[:, 0], out[:, 1 : 1 + d], out[:, 1 + d :].reshape(2, d, d))


def with_score(frame: DataFrame, model: Discriminant, *, text_col: str | None = "text", name: str = "score") -> DataFrame:
    """``frame`` with the score of its texts, or of its statistics ``x`` where ``text_col`` is None."""
    name = C.free_name(frame.columns, name)

    def run(batches):
        for batch in batches:
            if text_col is None:
                x = np.array(batch.column("x").flatten()).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], [*batch.schema.names, name])
                continue
            for part, offsets, raw in C.slices(batch, text_col):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(statistics(offsets, raw)))], [*part.schema.names, name])

    return frame.mapInArrow(C.tidied(run), C.with_fields(frame.schema, (name, T.DoubleType())))


def without_rejected(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score of at least ``threshold``, their columns as they were."""
    model = fit(docs.select("doc_id", "text"), labels)
    name = C.free_name(docs.columns, "score")
    return with_score(docs, model, name=name).where(F.col(name) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document, learnt from the labels of those that aren't held out."""
    stats = C.written(with_statistics(C.table(spark, sf_dir, "documents")), "statistics")
    scored = with_score(stats, fit(stats, C.table(spark, sf_dir, "labels")), text_col=None)
    return scored.select("doc_id", in_fold(F.col("doc_id"), FOLDS).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
