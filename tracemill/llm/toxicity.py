"""Toxicity from the nearest labelled examples.

Terms are lower-case words of letters and of numerals other than decimal digits. Those whose presence depends on the label (log-likelihood ratio of at least
MIN_G2 over the training sample) make the vocabulary. Texts are TF-IDF vectors (1 + log tf, idf over the sample,
unit length); the K examples of highest cosine vote with the square of the cosine as weight; a logistic curve fitted to
leave-one-out votes of the examples calibrates the score.

The search is exact. The inverted index keeps for every term and block of 64 examples the weights and their
maximum; a text's bound for a block is the sum over its terms of weight times maximum; blocks are opened in order of
their bounds until the next bound is below the K-th best cosine.

Defined results: null and empty texts and texts without a vocabulary term have no neighbours and get the calibrated
base rate; without labelled rows the score is 0; rows of `labels` with a null label, and documents
with contradicting labels, teach nothing; ties go to the example first in the index; a null id counts as held out; repeated
rows are scored alike, each on its own; an empty table gives no rows; texts of any length are scored whole; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, shipped

#: Bounds of the training sample: labelled rows for the choice of terms, examples in the index, terms.
SAMPLE_ROWS = 20_000
EXAMPLES = 4096
MAX_TERMS = 1024
MIN_G2 = 10.83
MIN_DF = 3
K = 25
BLOCK = 64

WORD = re.compile(r"[^\W\d_]+")
WORD_JVM = r"[^\p{L}\p{Nl}\p{No}]+"  # what WORD leaves out


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS, label: str = "toxic") -> DataFrame:
    """doc_id, text, y (0 or 1) and mark of labelled documents that are not held out: about `limit` by the hash of their id."""
    own = labels.filter(~held_out() & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    scale = 1 << 30
    mark = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(scale))
    n = own.count()
    picked = own.select("doc_id", label, mark.alias("mark")).filter(F.col("mark") < min(scale, scale * limit // max(n, 1) + 1))
    single = picked.groupBy("doc_id", "mark").agg(F.min(label).alias("lo"), F.max(label).alias("hi")).filter("lo = hi").select("doc_id", "mark", F.col("lo").cast("int").alias("y"))
    return docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(single), "doc_id")


def g2(a, b, pos, neg):
    """Log-likelihood ratio of a term in a of pos and b of neg texts."""
    total = 0
    n = pos + neg
    for seen, of in ((a, pos), (b, neg)):
        for k, share in ((seen, (a + b) / n), (of - seen, 1 - (a + b) / n)):
            if k > 0:
                total += k * np.log(k / (of * share))
    return 2 * total


@dataclass(frozen=True)
class Model:
    terms: dict[str, tuple[int, float]]  # number and idf
    index: np.ndarray  # blocks x terms x BLOCK
    tops: np.ndarray  # terms x blocks
    y: np.ndarray
    slope: float
    offset: float
    prior: float

    def vector(self, got: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and weights of counted terms."""
        at = np.array([self.terms[w][0] for w in sorted(got)], np.int64)
        v = np.array([(1 + np.log(got[w])) * self.terms[w][1] for w in sorted(got)])
        size = np.sqrt((v * v).sum())
        return at, v / size if size else v

    def neighbours(self, at: np.ndarray, v: np.ndarray, k: int = K, skip: int = -1) -> list[tuple[float, int]]:
        """(cosine, example) of the k nearest examples with a cosine over 0."""
        if not len(at):
            return []
        bound = v @ self.tops[at]
        order = np.argsort(-bound, kind="stable")
        bound = bound[order]
        cos, ids, floor = np.empty(0), np.empty(0, np.int64), 1e-9
        lo, step = 0, 8
        while lo < len(order):
            hi = min(lo + step, int(np.searchsorted(-bound, 1e-6 - floor, side="right")))
            if hi <= lo or bound[lo] <= 0:
                break
            some = order[lo:hi]
            new = np.round(v @ self.index[some, at[:, None]].reshape(len(at), -1), 9)
            hit = np.flatnonzero(new >= floor)
            cos = np.concatenate([cos, new[hit]])
            ids = np.concatenate([ids, some[hit // BLOCK] * BLOCK + hit % BLOCK])
            if skip >= 0:
                cos, ids = cos[ids != skip], ids[ids != skip]
            best = np.lexsort((ids, -cos))[:k]
            cos, ids = cos[best], ids[best]
            floor = cos[-1] if len(cos) == k else floor
            lo, step = hi, 2 * step
        return list(zip(cos.tolist(), ids.tolist()))

    def vote(self, near: list[tuple[float, int]]) -> float:
        w = sum(c * c for c, _ in near)
        return (sum(c * c * float(self.y[i]) for c, i in near) + 0.2 * self.prior) / (w + 0.2)

    def score(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-(self.slope * vote + self.offset))))


class Terms:
    """Counts the vocabulary's terms in texts: a text is parted into words once, of which the terms are kept."""

    def __init__(self, terms):
        self.terms = frozenset(terms)

    def count(self, text: str) -> Counter:
        return Counter([w for w in WORD.findall(text.lower()) if w in self.terms])


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    rows = training_rows(docs, labels)
    flat = F.filter(F.split(F.lower("text"), WORD_JVM), lambda w: w != "")
    bags = rows.select("mark", "doc_id", "y", flat.alias("words"))
    found = bags.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.max("mark").alias("top")).collect()
    totals, top = {r.y: r.n for r in found}, max((r.top for r in found), default=0)
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos + neg:
        return None
    seen = bags.select("y", F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_DF)
    base = pos / (pos + neg)
    # Only terms that depart from the base rate by two standard errors can reach MIN_G2.
    odd = seen.filter(F.abs(F.col("a") - F.col("n") * base) > 2 * F.sqrt(F.col("n") * base * (1 - base)))
    ranked = sorted(((float(g2(r.a, r.n - r.a, pos, neg)), r.w, r.n) for r in odd.collect()), reverse=True)
    chosen = sorted((w, n) for g, w, n in ranked[:MAX_TERMS] if g >= MIN_G2)
    terms = {w: (i, float(np.log((pos + neg + 1) / (n + 0.5)))) for i, (w, n) in enumerate(chosen)}
    picked = bags.filter(F.col("mark") <= (top + 1) * EXAMPLES // (pos + neg)) if pos + neg > EXAMPLES else bags
    # The empty word, which is no term, keeps examples without a term.
    own = docs.sparkSession.range(1).select(F.explode(F.array(*[F.lit(w) for w in ["", *terms]])).alias("w"))
    rows = picked.select(F.monotonically_increasing_id().alias("at"), "mark", "doc_id", "y", "words")  # apart from explode, which would number words
    each = rows.select("at", "mark", "doc_id", "y", F.explode(F.concat(F.array(F.lit("")), "words")).alias("w"))
    held = each.join(F.broadcast(own), "w").groupBy("at", "mark", "doc_id", "y").agg(F.sort_array(F.collect_list("w")).alias("words"))
    got = held.select("mark", "doc_id", "y", F.expr("slice(words, 2, size(words))").alias("words")).collect()
    got = sorted(got, key=lambda r: (-r.y, r.words[0] if r.words else "", r.mark, str(r.doc_id)))[: 2 * EXAMPLES]
    blocks = -(-max(len(got), 1) // BLOCK)
    m = Model(terms, np.zeros((blocks, max(len(terms), 1), BLOCK), np.float32), np.zeros((max(len(terms), 1), blocks), np.float32), np.array([r.y for r in got], np.int8), 1.0, 0.0, base)
    vectors = [m.vector(Counter(r.words)) for r in got]
    for i, (at, v) in enumerate(vectors):
        m.index[i // BLOCK, at, i % BLOCK] = v
    m.tops[:] = m.index.max(axis=2).T
    votes = np.array([m.vote(m.neighbours(at, v, skip=i)) for i, (at, v) in enumerate(vectors)])
    slope, offset = logistic(votes, m.y.astype(float))
    return Model(m.terms, m.index, m.tops, m.y, slope, offset, base)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (at least 0) and offset of the logistic curve through (x, y), with a little ridge."""
    a, b = 4.0, -2.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        grad = np.array([((p - y) * x).sum() + 0.01 * a, (p - y).sum() + 0.01 * b])
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        d = np.linalg.solve(h, grad)
        a, b = a - d[0], b - d[1]
        if abs(d).max() < 1e-8:
            break
    return max(float(a), 0.0), float(b)


def score(docs: DataFrame, model: Model | None, evidence: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text); with evidence the neighbours' cosines and labels too."""
    spark = docs.sparkSession
    shipped(spark)
    sent = spark.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]
    extra = ", evidence array<struct<cosine:double,label:int>>" if evidence else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        terms = Terms(m.terms) if m else None
        for batch in batches:
            out, why = [], []
            for text in batch.column(2).to_pylist():
                if m is None:
                    out.append(0.0)
                    why.append([])
                    continue
                near = m.neighbours(*m.vector(terms.count(text))) if text else []
                out.append(m.score(m.vote(near)))
                why.append([{"cosine": c, "label": int(m.y[i])} for c, i in near])
            cols = [batch.column(0), batch.column(1), pa.array(out, pa.float64()), pa.array([int(s >= 0.5) for s in out], pa.int32())]
            names = ["doc_id", "held_out", "score", "predicted"]
            if evidence:
                cols.append(pa.array(why, pa.list_(pa.struct([("cosine", pa.float64()), ("label", pa.int32())]))))
                names.append("evidence")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int{extra}")
