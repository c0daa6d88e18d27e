"""Quality classifier by positive-unlabelled learning with non-negative risk.

Features are measures of the whole text (case, symbols, repetition, word and
line lengths, entropy), computed in array passes; labels, language, source and
id never enter them. A linear model with logistic loss minimises the
non-negative PU risk of Kiryo, Niu, du Plessis and Sugiyama (2017)::

    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))

where R_p averages over trusted positives (rows labelled 1 in the learning
folds), and R_u over unlabelled text: every row of the learning folds, whatever
its label. When the second term is negative the step ascends it, as in the
paper. The class prior is the share of 1 among labelled learning rows, or 0.5
if there are none; rows labelled 0 serve nothing else.

Trusted positives are at most about ``max_positives`` rows, thinned by a hash
of the id (documented bound). Unlabelled statistics cover all rows: features
are written once (4 bytes a feature) and each of ``steps`` full gradients is
one narrow pass over them, summed per task; only vectors of the number of
features reach the driver. Texts are read once and not moved.

Cases. Null and empty texts have all-zero features and get the score that the
model gives to those. No positives, or an empty table: every score is 0.5. A document labelled several times: the largest label counts. A repeated
row is scored each time. Extra columns are dropped by the scores and kept by
:func:`keep_good`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import _text as tx
from gridloom.llm._run import map_arrow, packed, sized, written

THRESHOLD = 0.7
_UPPER = tx.class_table(bytes(range(65, 91)))
_DIGIT = tx.class_table(b"0123456789")
_SENTENCE = tx.class_table(b".,;:?'-\"()")
_SYMBOL = tx.class_table(bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:?'-\"()"))
_LINE = tx.class_table(bytes(x for x in range(256) if x != 10))
N_FEATURES = 20


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``N_FEATURES`` numbers for each text, all about 0 to 1."""
    out = np.zeros((len(texts), N_FEATURES), np.float32)
    for a, b, raw, off in tx.chunks(texts):
        size = np.diff(off)
        n = np.maximum(size, 1).astype(float)

        def share(table: np.ndarray, rows: np.ndarray = raw, off: np.ndarray = off) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(table[rows])])[off])

        start, end, first = tx.spans(raw, off, tx.NONSPACE)
        words = np.diff(first)
        w = np.maximum(words, 1).astype(float)
        h = tx.span_hashes(raw, start, end)
        same = np.zeros(len(h) + 1, bool)
        same[1:-1] = h[1:] == h[:-1]
        same[first[:-1]] = False
        total = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x, dtype=float)])[first])  # noqa: E731, B023
        length = (end - start).astype(float)
        upper_word = _UPPER[raw[start]] & _UPPER[raw[np.minimum(start + 1, end - 1)]] if len(start) else np.zeros(0, bool)
        odd_end = _SYMBOL[raw[end - 1]] if len(end) else np.zeros(0, bool)
        odd_run = odd_end & (_SYMBOL[raw[np.maximum(end - 2, start)]] if len(end) else odd_end) & (length > 1)
        lines_s, lines_e, lines_first = tx.spans(raw, off, _LINE)
        lines = np.maximum(np.diff(lines_first), 1).astype(float)
        upper, letters = share(_UPPER), share(tx.WORD) + share(_UPPER)
        mean = total(length) / w
        distinct = np.array([len(np.unique(h[x:y])) for x, y in zip(first[:-1], first[1:])], float)
        f = out[a:b]
        f[:, 0] = upper / np.maximum(letters, 1)
        f[:, 1] = share(_DIGIT) / n
        f[:, 2] = share(_SYMBOL) / n
        f[:, 3] = np.minimum(share(_SENTENCE) / n * 10, 2)
        f[:, 4] = (n - letters) / n
        f[:, 5] = total(same[:-1]) / w
        f[:, 6] = distinct / w
        f[:, 7] = np.minimum(distinct / np.sqrt(w), 30) / 30
        f[:, 8] = np.minimum(mean, 20) / 20
        f[:, 9] = np.minimum(np.sqrt(np.maximum(total(length**2) / w - mean**2, 0)), 10) / 10
        f[:, 10] = total(upper_word) / w
        f[:, 11] = total(odd_end) / w
        f[:, 12] = total(odd_run) / w
        f[:, 13] = total(length <= 3) / w
        f[:, 14] = total(length == 1) / w
        f[:, 15] = np.log1p(words) / 12
        f[:, 16] = np.minimum(n / lines, 2000) / 2000
        f[:, 17] = np.log1p(lines) / 8
        f[:, 18] = np.minimum(total(length > 14) / w * 5, 2)
        f[:, 19] = size > 0
        f[size == 0] = 0
    return out


def learn_flag(id_col, folds: int, held: int):
    """Whether a row's fold, crc32 of the id as text, is a learning fold; a null id is one too."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) != held, F.lit(True))


def _featured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = features(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in f], pa.binary())], names=["id", "f"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), run, f"id {kind}, f binary")


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(np.float64)


def expand(x: np.ndarray) -> np.ndarray:
    """Features with their squares and a constant, as the linear model sees them."""
    return np.hstack([x, x * x, np.ones((len(x), 1))])


def _pass(rows: DataFrame, fn, width: int) -> np.ndarray:
    """Sums ``fn``'s vector over all batches; one vector a task comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            if b.num_rows:
                total += fn(_matrix(b.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

    sums = map_arrow(rows.select("f"), run, "v array<double>")
    sums = sums.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    out = np.zeros(width)
    for r in sums.collect():  # ``width`` rows
        out[r["i"]] = r["x"]
    return out


def fit(rows: DataFrame, positives: np.ndarray, prior: float, steps: int = 40, rate: float = 0.5, l2: float = 1e-4):
    """(mean, scale, weights) that minimise the non-negative PU risk over ``rows`` (f)."""
    width = 2 * N_FEATURES + 1
    moments = _pass(rows, lambda x: np.concatenate([expand(x).sum(0), (expand(x) ** 2).sum(0)]), 2 * width)
    n = max(moments[width - 1], 1.0)
    mean = moments[:width] / n
    scale = np.sqrt(np.maximum(moments[width:] / n - mean**2, 1e-6))
    mean[-1], scale[-1] = 0.0, 1.0
    p = np.clip((expand(positives) - mean) / scale, -8, 8)
    w = np.zeros(width)
    speed, square = np.zeros(width), np.zeros(width)
    for step in range(1, steps + 1):

        def unlabelled(x: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            z = np.clip((expand(x) - mean) / scale, -8, 8)
            s = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            return np.concatenate([z.T @ s, [-np.log1p(-np.minimum(s, 1 - 1e-12)).sum()]])

        u = _pass(rows, unlabelled, width + 1)
        s = 1 / (1 + np.exp(-np.clip(p @ w, -30, 30)))
        g_pos = prior * (p.T @ (s - 1)) / len(p)
        g_neg = u[:width] / n - prior * (p.T @ s) / len(p)
        risk_neg = u[width] / n + prior * np.log1p(-np.minimum(s, 1 - 1e-12)).mean()
        g = g_pos + g_neg if risk_neg >= 0 else -g_neg
        g = g + l2 * w
        speed = 0.9 * speed + 0.1 * g
        square = 0.99 * square + 0.01 * g * g
        w = w - rate * (1 - step / (steps + 1)) * (speed / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6) * 0.5
    return mean, scale, w


#: Bins of scores, slack and failure chance of the prior's bounds.
BINS, SLACK, CHANCE = 1000, 0.01, 0.1


def chances(x: np.ndarray, model) -> np.ndarray:
    mean, scale, w = model
    return 1 / (1 + np.exp(-np.clip(np.clip((expand(x) - mean) / scale, -8, 8) @ w, -30, 30)))


def best_bin(unlabelled: np.ndarray, positive: np.ndarray) -> float:
    """The class prior from counts of scores in equal bins, the lowest scores first."""
    n_u, n_p = max(unlabelled.sum(), 1), max(positive.sum(), 1)
    q_u, q_p = np.cumsum(unlabelled[::-1]) / n_u, np.cumsum(positive[::-1]) / n_p
    some = q_p > 0
    if not some.any():
        return 0.5
    wide = math.sqrt(math.log(4 / CHANCE) / (2 * n_u)) + math.sqrt(math.log(4 / CHANCE) / (2 * n_p))
    ratio = q_u[some] / q_p[some]
    at = int((ratio + (1 + SLACK) * wide / q_p[some]).argmin())
    return float(np.clip(ratio[at], 0.01, 0.99))


def estimated_prior(rows: DataFrame, positives: np.ndarray, steps: int = 20) -> float:
    """The share of positives among ``rows`` (f), from positives in any order."""
    if len(positives) < 20:
        return 0.5
    model = fit(rows, positives[::2], 0.5, steps)
    counts = lambda x: np.bincount((chances(x, model) * (BINS - 1)).astype(int), minlength=BINS).astype(float)
    return best_bin(_pass(rows, counts, BINS), counts(positives[1::2]))


def scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = 4,
    held: int = 2,
    max_positives: int = 20_000,
    steps: int = 40,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``id_col``, held_out, score and predicted of every document."""
    feats = written(_featured(docs, id_col, text_col))
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
        .filter(F.col("y").isNotNull() & F.col("id").isNotNull() & learn_flag("id", folds, held))
        .groupBy("id").agg(F.max("y").alias("y"))
    )
    n_pos = known.filter("y = 1").count()
    thin = min(1.0, max_positives / n_pos) if n_pos else 1.0
    chosen = known.filter((F.col("y") == 1) & (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(thin * 1_000_000)))
    got = feats.join(chosen, "id").orderBy("id").select("f").toPandas()["f"].tolist() if n_pos else []
    learn = feats.filter(learn_flag("id", folds, held))
    model, prior = None, 0.5
    if got:
        positives = np.frombuffer(b"".join(map(bytes, got)), np.float32).reshape(-1, N_FEATURES).astype(float)
        prior = estimated_prior(learn, positives)
        model = fit(learn, positives, prior, steps)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if model is None:
                s = np.full(b.num_rows, prior)
            else:
                s = chances(_matrix(b.column(1)) if b.num_rows else np.zeros((0, N_FEATURES)), model)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_arrow(feats, score, f"`{id_col}` {kind}, score double, predicted int")
    return out.select(id_col, (~learn_flag(id_col, folds, held)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents that the classifier accepts, with all their columns; rows with a null id stay.

    Ids of rejected documents are joined back, so texts move only where that
    table is too large to broadcast.
    """
    bad = scores(docs, labels, threshold=threshold, **options).filter("predicted = 0 AND doc_id IS NOT NULL")
    bad = written(bad.select(F.col("doc_id").alias("bad_id")).distinct())
    out = packed(docs).join(sized(bad, 16), F.expr("doc_id = bad_id"), "left_anti")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
