"""Toxicity by maximum-scoring segments over token log-odds.

Tokens are the words of lower-cased text. Token scores are log-odds of toxic
against other labelled documents with an informative Dirichlet prior (Monroe,
Colaresi and Quinn 2008): pseudo-counts follow each word's share of the whole
corpus. A word scores the lower confidence bound of its log-odds where that is
over ``floor`` (toxic text uses it e times as often, for certain), and the upper
bound where that is under ``-gap`` (clean text does, for certain); all other
words, whose side is not certain, cost ``gap`` each. Every maximal scoring segment of a
document is found in linear time (Ruzzo and Tompa 1999). A segment's score S
becomes ``lambda * S - ln(K * n)`` for n words (Karlin and Altschul 1990),
where lambda solves ``sum p e^(lambda s) = 1`` for the background's word
frequencies and K is fitted to the best scores of the clean learning rows; segments
above 0 are the significant passages. A document's
largest and summed values are calibrated to a probability by a logistic fit.

Labels are learned from at most about ``max_toxic`` and ``max_clean`` rows of
the learning folds, thinned by a hash of the id (documented bounds, so ids and
words of them can be broadcast). Word shares are counted over all documents.
Four narrow passes over the texts; texts are never moved. What is shuffled or
sent to the driver is one row a candidate word and task: words seen in at
least ``min_docs`` of the bounded toxic sample.

Cases. Null and empty texts have no passages and get the lowest score. With no
toxic learning rows, or an empty table, every score is the share of toxic
labels (0 if there are none). The largest label of a document counts; repeated
rows are scored each time; very long texts are read whole. Extra columns are
dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import _text as tx
from gridloom.llm._run import map_arrow, written
from gridloom.llm.quality import learn_flag


def maximal_segments(at: list[int], score: list[float], before: list[float]) -> list[tuple[int, int, float]]:
    """(first, end, score) of all maximal scoring segments, where position ``at[i]`` scores ``score[i]`` > 0,
    ``before[i]`` is the sum of all positions before it, and no other position scores above 0."""
    found: list[list[float]] = []  # start, end, sum before it, sum through it, nearest earlier one with a smaller sum before
    for start, s, left in zip(at, score, before):
        end, right = start + 1, left + s
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = int(found[j][4])
            if j < 0 or found[j][3] >= right:
                found.append([start, end, left, right, j])
                break
            start, left = int(found[j][0]), found[j][2]
            del found[j:]
    return [(int(f[0]), int(f[1]), f[3] - f[2]) for f in found]


def karlin_lambda(p: np.ndarray, s: np.ndarray, gap: float) -> float:
    """The positive root of ``sum p e^(lambda s) = 1``; the rest of the mass scores -gap."""
    rest = max(1.0 - p.sum(), 0.0)
    f = lambda x: rest * math.exp(-gap * x) + float((p * np.exp(np.minimum(x * s, 700))).sum()) - 1.0
    lo, hi = 0.0, 1e-3
    while f(hi) < 0 and hi < 1e3:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return max(hi, 1e-3)


class Lexicon:
    """Word hashes (sorted) with scores, what all other words cost, and the extreme-value constants."""

    def __init__(self, words: np.ndarray, score: np.ndarray, lam: float, gap: float, k: float = 0.1):
        order = np.argsort(words)
        self.words, self.score, self.lam, self.gap, self.k = words[order], score[order], lam, gap, k

    def segments(self, texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
        """(words, [(first byte, end byte, score), ...]) of each text, for all maximal scoring segments."""
        for a, b, raw, off in tx.chunks(texts):
            _, start, end, first, h = tx.words(raw, off)
            value = np.full(len(h), -self.gap)
            if len(self.words) and len(h):
                at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
                value = np.where(self.words[at] == h, self.score[at], value)
            total = np.concatenate([[0.0], np.cumsum(value)])
            up = np.flatnonzero(value > 0)
            cut = np.searchsorted(up, first)
            for i in range(b - a):
                mine = up[cut[i] : cut[i + 1]]
                out = maximal_segments(mine.tolist(), value[mine].tolist(), total[mine].tolist()) if len(mine) else []
                yield int(first[i + 1] - first[i]), [(int(start[x] - off[i]), int(end[y - 1] - off[i]), s) for x, y, s in out]

    def passages(self, texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
        """(words, [(first byte, end byte, significance), ...]) of each text, for the significant segments."""
        for n, found in self.segments(texts):
            base = math.log(max(self.k * n, 1.0))
            yield n, [(x, y, self.lam * s - base) for x, y, s in found if self.lam * s > base]


def extreme_constant(clean: DataFrame, lexicon: Lexicon) -> float:
    """K of the extreme-value law of best scores, by maximum likelihood over clean texts (t): the number of those
    with a segment over the sum of n * e^(-lambda * S), for texts of n words whose best segment scores S. Where there
    is none, S is only known to be under the least score of a word."""
    least = float(lexicon.score[lexicon.score > 0].min(initial=np.inf))
    if not math.isfinite(least):
        return 0.1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, total = 0.0, 0.0
        for b in batches:
            for n, found in lexicon.segments(b.column(0)):
                docs += bool(found)
                total += n * math.exp(-lexicon.lam * max((s for *_, s in found), default=least))
        yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([total])], names=["docs", "total"])

    got = map_arrow(clean.select("t"), run, "docs double, total double").agg(F.sum("docs").alias("docs"), F.sum("total").alias("total")).first()  # one row
    return got["docs"] / got["total"] if got["docs"] else 0.1


def _word_counts(rows: DataFrame, candidates: np.ndarray | None) -> DataFrame:
    """(w, docs, c, t, n) summed over rows (t, y): documents, uses, uses where y is 1, and 0; w = 0 has totals.

    Without ``candidates`` every word of the rows is counted, else only those.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(0, np.uint64) if candidates is None else candidates
        sums = np.zeros((4, len(words)))
        totals = np.zeros(4)
        for batch in batches:
            label = batch.column(1).fill_null(-1).to_numpy()
            for a, b, raw, off in tx.chunks(batch.column(0)):
                _, _, _, first, h = tx.words(raw, off)
                sizes = np.diff(first)
                y = np.repeat(label[a:b], sizes)
                totals += [b - a, len(h), (y == 1).sum(), (y == 0).sum()]
                if candidates is None:
                    doc = np.repeat(np.arange(b - a), sizes)
                    u, inv = np.unique(h, return_inverse=True)
                    c = np.bincount(inv, minlength=len(u))
                    pair = np.unique(inv.astype(np.int64) * (b - a) + doc)
                    docs = np.bincount(pair // max(b - a, 1), minlength=len(u))
                    yield _rows(u, docs, c, c, c * 0)
                elif len(words) and len(h):
                    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
                    ok = words[at] == h
                    at, y = at[ok], y[ok]
                    for k, mine in ((1, at), (2, at[y == 1]), (3, at[y == 0])):
                        sums[k] += np.bincount(mine, minlength=len(words))
        used = np.flatnonzero(sums[1])
        yield _rows(words[used], *sums[:, used])
        yield _rows(np.zeros(1, np.uint64), *totals[:, None])

    schema = "w long, docs double, c double, t double, n double"
    out = map_arrow(rows.select("t", "y"), run, schema)
    return out.groupBy("w").agg(*[F.sum(c).alias(c) for c in ("docs", "c", "t", "n")])


def _rows(w: np.ndarray, *cols: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(w.view(np.int64)), *[pa.array(np.asarray(c, float)) for c in cols]]
    return pa.RecordBatch.from_arrays(arrays, names=["w", "docs", "c", "t", "n"])


def learn_lexicon(
    docs: DataFrame, known: DataFrame, min_docs: int = 2, prior_share: float = 1.0, z: float = 1.65, gap: float = 0.2, floor: float = 1.0
) -> Lexicon:
    """``docs`` is (id, t), ``known`` the bounded (id, y) rows to learn from."""
    toxic = docs.join(F.broadcast(known.filter("y = 1")), "id")
    first = _word_counts(toxic, None).filter((F.col("docs") >= min_docs) & (F.col("w") != 0)).select("w")
    cand = np.sort(first.toPandas()["w"].to_numpy(np.int64).view(np.uint64))  # words of the bounded sample
    got = _word_counts(docs.join(F.broadcast(known), "id", "left"), cand).toPandas()
    total = got[got.w == 0].iloc[0]
    got = got[got.w != 0]
    n_t, n_n = total.t, total.n
    a0 = prior_share * n_t
    alpha = a0 * got.c.to_numpy() / max(total.c, 1)
    t, n = got.t.to_numpy() + alpha, got.n.to_numpy() + alpha
    with np.errstate(divide="ignore", invalid="ignore"):
        delta = np.log(t / np.maximum(n_t + a0 - t, 1)) - np.log(n / np.maximum(n_n + a0 - n, 1))
        error = z * np.sqrt(1 / t + 1 / n)
    low, high = delta - error, delta + error
    ok = np.isfinite(delta)
    up, down = ok & (low > floor), ok & (high < -gap)
    share = (got.n.to_numpy() + alpha) / max(n_n + a0, 1)
    s = np.where(up, low, np.where(down, high, 0.0))
    # the expected score must be negative, or there would be no lambda
    free = 1 - float(share[up | down].sum())
    gap = max(gap, 2 * float((share * s).sum()) / max(free, 1e-9))
    keep = up | down
    words, s, share = got.w.to_numpy(np.int64).view(np.uint64)[keep], s[keep], share[keep]
    lexicon = Lexicon(words, s, karlin_lambda(share, s, gap), gap)
    lexicon.k = extreme_constant(docs.join(F.broadcast(known.filter("y = 0")), "id"), lexicon)
    return lexicon


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights of a ridge logistic fit by Newton steps; the last is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 1e-2 * w
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + 1e-2 * np.eye(len(w)), g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def known_rows(labels: DataFrame, id_col: str, label_col: str, folds: int, held: int, limits: tuple[int, int]) -> tuple[DataFrame, float]:
    """(id, y) of learning rows, thinned by class to about ``limits`` (of 1, of 0), and the share of 1."""
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
        .filter(F.col("y").isin(0, 1) & F.col("id").isNotNull() & learn_flag("id", folds, held))
        .groupBy("id").agg(F.max("y").alias("y"))
    )
    count = known.agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("p")).first()
    pos, neg = count["p"] or 0, count["n"] - (count["p"] or 0)
    part = [min(1.0, lim / max(x, 1)) for lim, x in zip(limits, (pos, neg))]
    cut = F.when(F.col("y") == 1, int(part[0] * 1e6)).otherwise(int(part[1] * 1e6))
    return known.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < cut), pos / max(count["n"], 1)


def scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    folds: int = 5,
    held: int = 0,
    max_toxic: int = 40_000,
    max_clean: int = 80_000,
    threshold: float = 0.5,
) -> DataFrame:
    """``id_col``, held_out, score, predicted and passages (byte ranges with significance) of every document."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    known, share = known_rows(labels, id_col, label_col, folds, held, (max_toxic, max_clean))
    known = written(known)
    lexicon = learn_lexicon(texts, known) if share > 0 else Lexicon(np.zeros(0, np.uint64), np.zeros(0), 1.0, 0.2)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("value", pa.float64())]))
        for b in batches:
            got = [p for _, p in lexicon.passages(b.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([max((s for *_, s in p), default=0.0) for p in got], pa.float64()),
                    pa.array([math.log1p(sum(s for *_, s in p)) for p in got], pa.float64()),
                    pa.array([[{"first": x, "end": y, "value": s} for x, y, s in p] for p in got], spans),
                ],
                names=["id", "most", "all", "passages"],
            )

    found = written(map_arrow(texts, find, f"id {kind}, most double, all double, passages array<struct<first:long,end:long,value:double>>"))
    sample = found.join(F.broadcast(known), "id").select("id", "most", "all", "y").orderBy("id", "most", "all").toPandas()
    if share > 0 and len(sample):
        w = logistic(sample[["most", "all"]].to_numpy(), sample["y"].to_numpy(float)).tolist()
        odds = F.col("most") * w[0] + F.col("all") * w[1] + w[2]
        score = 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(30.0)), F.lit(-30.0))))
    else:
        score = F.lit(float(share))
    out = found.withColumn("score", score.cast("double")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    held_out = (~learn_flag("id", folds, held)).alias("held_out")
    return out.select(F.col("id").alias(id_col), held_out, "score", "predicted", "passages")
