"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples are positives; a sample of documents whose labels are hidden is
the unlabelled set. A linear classifier on the presence of word cues minimises

    prior * R(positive as 1) + max(0, R(unlabelled as 0) - prior * R(positive as 0)),

the class-prior-corrected risk kept from going negative. Cues (words and word beginnings)
are chosen by how much more often positives hold them than the unlabelled set. The
classifier is fitted in NumPy on a bounded sample; all documents are scored in tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleframe.llm.base import text_batches
from rippleframe.session import durable

#: At most this many labelled documents, chosen by a hash of their id, are fitted on.
SAMPLE = 40_000
#: At most this many cues, the strongest ones, are kept.
CUES = 4096
#: A cue occurs in this many positives at least, and this much more often there than in the unlabelled set.
MIN_POSITIVES, MIN_LIFT = 3, 1.5
PREFIXES = (4, 5)
EDGE = ".,;:!?\"'()[]{}<>|*#$%&-_"
CACHE = 500_000


def cues(word: str) -> tuple[str, ...]:
    """The cues of a lower-case word: itself and its beginnings."""
    bare = word.strip(EDGE)
    return (bare, *(bare[:n] + "~" for n in PREFIXES if len(bare) > n)) if bare else ()


def document_cues(text: str | None, known: dict[str, tuple[str, ...]]) -> set[str]:
    found: set[str] = set()
    for w in set((text or "").lower().split()):
        own = known.get(w)
        if own is None:
            own = known.setdefault(w, cues(w)) if len(known) < CACHE else cues(w)
        found.update(own)
    return found


@dataclass
class Model:
    """A linear classifier; ``index`` maps cues to weights. Documents without any cue get the bias alone."""

    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        known: dict[str, list[int]] = {}
        margin = []
        for text in texts:
            found: set[int] = set()
            for w in set((text or "").lower().split()):
                own = known.get(w)
                if own is None:
                    own = [self.index[c] for c in cues(w) if c in self.index]
                    if len(known) < CACHE:
                        known[w] = own
                found.update(own)
            margin.append(self.bias + float(self.weights[sorted(found)].sum()) if found else self.bias)
        return 1 / (1 + np.exp(-np.clip(np.array(margin, dtype=np.float64), -500, 500)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(rows: list[np.ndarray], positive: np.ndarray, n_cues: int, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of the non-negative risk's minimiser by Adam steps.

    ``rows`` holds each document's cue numbers. All documents serve as the unlabelled set,
    the positives among them as the positive set. Where the unlabelled part of the risk
    turns negative, the step climbs out of it instead.
    """
    size = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    doc, cue = np.repeat(np.arange(len(rows)), size), np.concatenate(rows) if len(rows) else np.empty(0, dtype=np.int64)
    w = np.zeros(n_cues + 1)
    w[-1] = math.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    pos = positive.astype(np.float64)
    n_pos = max(pos.sum(), 1.0)
    for t in range(1, steps + 1):
        margin = np.bincount(doc, weights=w[cue], minlength=len(rows)) + w[-1]
        p = _sigmoid(margin)
        # Logistic loss: as 1 it is log(1 + e^-m) with slope p - 1, as 0 log(1 + e^m) with slope p.
        as_zero = np.logaddexp(0, margin)
        corrected = as_zero.mean() - prior * (pos * as_zero).sum() / n_pos
        slope = p / len(rows) - prior * pos * p / n_pos
        grad_doc = prior * pos * (p - 1) / n_pos + slope if corrected >= 0 else -slope
        g = np.append(np.bincount(cue, weights=grad_doc[doc], minlength=n_cues), grad_doc.sum())
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _cue_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple[str, ...]] = {}
    for batch in batches:
        n, pos = {}, {}
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for c in document_cues(text, known):
                n[c] = n.get(c, 0) + 1
                if toxic:
                    pos[c] = pos.get(c, 0) + 1
        # A cue that no positive of the task holds still counts for the unlabelled set.
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([pos.get(c, 0) for c in n], pa.int64()), pa.array(list(n.values()), pa.int64())], names=["cue", "pos", "n"])


def _row_cues(index: dict[str, int]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            rows = [sorted(index[c] for c in document_cues(t, known) if c in index) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), batch.column(1)], names=["cues", "toxic"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, max_cues: int = CUES) -> Model:
    """Fit on ``labels`` (doc_id, toxic 0/1) of ``docs``; rows without a label or an id are left out.

    The prior is the share of positives in the sample. Without both kinds the model gives
    every document the prior (0 if nothing is labelled).
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # the sample is the feature; its rows bound the broadcast
    chosen = chosen.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    texts = durable(text_batches(texts).select("text", "toxic"), "sample")
    totals = texts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos")).first()
    n, n_pos = totals["n"], totals["pos"]
    if not 0 < n_pos < n:
        share = n_pos / n if n else 0.0
        return Model(bias=500.0 if share == 1 else -500.0)
    counts = texts.mapInArrow(_cue_counts, "cue string, pos bigint, n bigint").groupBy("cue").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    lift = (F.col("pos") / n_pos) / (F.col("n") / n)
    # Weight of evidence: positives times the log of how much more often they hold the cue.
    best = counts.where((F.col("pos") >= MIN_POSITIVES) & (lift >= MIN_LIFT)).orderBy((F.col("pos") * F.log(lift)).desc(), "cue").limit(max_cues)
    index = {r["cue"]: k for k, r in enumerate(best.select("cue").collect())}  # at most ``max_cues``
    rows = texts.mapInArrow(_row_cues(index), "cues array<int>, toxic int").toArrow()  # at most ``sample`` short rows
    lists = [np.array(x, dtype=np.int64) for x in rows.column("cues").to_pylist()]
    positive = rows.column("toxic").to_numpy() > 0
    order = sorted(range(len(lists)), key=lambda k: (lists[k].tolist(), positive[k]))  # fitted alike however the rows arrive
    weights, bias = fit([lists[k] for k in order], positive[order], len(index), n_pos / n)
    return Model(index, weights, bias)


def score(docs: DataFrame, model: Model) -> Column:
    """Column with the toxicity of the whole text, 0 to 1; null and empty texts are scored by the bias."""
    # Plain values: workers need no copy of this package to read them.
    shared = docs.sparkSession.sparkContext.broadcast((model.index, model.weights, model.bias))  # at most ``CUES`` weights

    @F.arrow_udf("double")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model(*shared.value)
        for batch in texts:
            yield pa.array(own.score(t.as_py() for t in batch))

    return run(F.col("text").cast("string"))
