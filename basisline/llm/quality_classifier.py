"""Quality classifier by non-negative positive-unlabelled learning.

A linear model over features of the whole text (style, repetition, and hashed words and word pairs) is fitted to trusted
positives and unlabelled text: the non-negative unbiased risk with squared loss,
`pi R_p(+1) + max(0, R_u(-1) - pi R_p(-1))`, needs the data only through first and second feature moments of the two samples.
One distributed pass sums them by fold over all rows that are not held out, so the fit on the driver has the same small size
for any corpus, and the ridge is chosen by cross-validation on the folds' moments: for each candidate the model of the other
folds is judged by its risk on the fold left out. The class prior is estimated from score tails (negatives run out among the
highest scores) and scores are turned into probabilities by Bayes' rule on bounded score histograms, made monotone; both
use each row's score under the model fitted without its fold. Candidate ridges rise by a fixed factor until larger ones have
stopped helping on the folds. Held-out rows have no part in the fit, the ridge, its candidates or the calibration.

Edge cases: null and empty texts get the features of an empty text and a score like any other; documents with several
labels count once for each; without positives every score is the prior guess 0.5; repeated rows score alike; an empty table
gives an empty result; language, source and ids are never inputs; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basisline.llm.common import crc_text, stored, table
from basisline.llm.shingles import hash_runs, mix, text_chunks

CUTS = (0.002, 0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9)
#: Byte classes: their shares of the text are features.
_CLASS = np.full(256, 9, "uint8")
for _k, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b"\n", b"!?", b".,;:'\"-()", b"#*$%&|<>@~^_+={}[]\\/`")):
    _CLASS[list(_set)] = _k
_CLASS[128:] = 8
N_CLASSES = 10
SHARES = N_CLASSES + 7
N_STYLE = SHARES + 3
HASHED = 64  # signed sums of hashed words and word pairs
N_BASE = N_STYLE + HASHED
#: Ridges rise from the first by the factor; cross-validation over the training rows stops after so many without a lower risk.
FIRST_RIDGE, RIDGE_FACTOR, PATIENCE = 1e-3, 10**0.5, 4
FOLDS = 4
BINS = 400
FAN_IN = 64  # vectors of a group and fold that one task adds up


def _distinct(values: np.ndarray) -> int:
    return len(np.unique(values))


def base_features(column: pa.Array) -> np.ndarray:
    """One row of N_BASE numbers a text: byte class shares, word and line repetition, logarithms of sizes, hashed words and pairs."""
    out = np.zeros((len(column), N_BASE), "float32")
    for row, data, bounds in text_chunks(column):
        n = len(bounds) - 1
        size = np.diff(bounds)
        owner = np.repeat(np.arange(n), size)
        classes = np.bincount(owner * N_CLASSES + _CLASS[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
        words, first = hash_runs(data, (_CLASS[data] != 3) & (_CLASS[data] != 4), bounds)
        lines, line_first = hash_runs(data, _CLASS[data] != 4, bounds)
        again = np.zeros(len(words), bool)
        again[1:] = words[1:] == words[:-1]
        block = out[row : row + n]
        block[:, :N_CLASSES] = classes / np.maximum(size, 1)[:, None]
        for i in range(n):
            w, ln = words[first[i] : first[i + 1]], lines[line_first[i] : line_first[i + 1]]
            m, k = len(w), N_CLASSES
            x = block[i]
            if m:
                counts = np.unique(w, return_counts=True)[1]
                pairs = w[1:] * np.uint64(31) + w[:-1]
                x[k] = 1 - len(counts) / m
                x[k + 1] = counts.max() / m
                x[k + 2] = again[first[i] + 1 : first[i + 1]].mean() if m > 1 else 0
                x[k + 3] = 1 - _distinct(pairs) / (m - 1) if m > 1 else 0
                x[k + 4] = 1 - _distinct(ln) / len(ln) if len(ln) else 0
                letters = classes[i, 0] + classes[i, 1] + classes[i, 8]
                x[k + 5] = min(1.0, letters / m / 16)
                x[k + 6] = min(1.0, len(ln) / m)
                grams = np.concatenate([w, mix(pairs)])
                sign = 1.0 - 2.0 * (grams >> np.uint64(63)).astype("float64")
                x[N_STYLE:] = np.bincount((grams & np.uint64(HASHED - 1)).astype("int64"), sign, HASHED) / np.sqrt(len(grams))
            x[SHARES:N_STYLE] = np.log1p(size[i]), np.log1p(m), np.log1p(len(ln))
    return out


def expanded(base: np.ndarray) -> np.ndarray:
    """Model inputs: a constant, the base features, and steps of the shares and sizes."""
    share, logs, words = base[:, :SHARES], base[:, SHARES:N_STYLE], base[:, N_STYLE:]
    steps = [share > c for c in CUTS] + [logs > c for c in (1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0)]
    return np.hstack([np.ones((len(base), 1)), share, logs / 10, words / 10, *steps]).astype("float64")


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and its base features as packed float32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = base_features(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"doc_id {kind}, x binary")


def unpack(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "float32").reshape(-1, N_BASE)


def summed(rows: DataFrame, stat: Callable[[np.ndarray, int], np.ndarray]) -> dict[tuple[str, int], np.ndarray]:
    """Sum of `stat(x, fold)` over the rows of each group and fold in columns (grp, fold, x), with the row count first.
    Bounded vectors only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], np.ndarray] = {}
        for b in batches:
            grp, fold, x = b.column(0).to_pylist(), b.column(1).to_pylist(), unpack(b.column(2))
            keys = list(zip(grp, fold, strict=True))
            for g in dict.fromkeys(keys):
                mine = np.asarray([k == g for k in keys])
                part = np.append(float(mine.sum()), stat(x[mine], g[1]))
                total[g] = total[g] + part if g in total else part
        yield _vectors(total)

    parts = rows.select("grp", "fold", "x").mapInArrow(run, _VECTORS)
    n = rows.rdd.getNumPartitions()
    while n > FAN_IN:  # a tree: no task and not the driver meets a vector of every input task
        n = -(-n // FAN_IN)
        parts = parts.repartition(n, F.spark_partition_id() % n).mapInArrow(_added, _VECTORS)
    parts = parts.repartition("grp", "fold").mapInArrow(_added, _VECTORS)
    t = parts.toArrow()  # a vector for each group and fold
    return {(g, f): np.frombuffer(v, "float64") for g, f, v in zip(*(t.column(c).to_pylist() for c in ("grp", "fold", "v")), strict=True)}


_VECTORS = "grp string, fold int, v binary"


def _vectors(total: dict[tuple[str, int], np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([g for g, _ in total], pa.string()), pa.array([f for _, f in total], pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["grp", "fold", "v"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors of each group and fold added up, one at a time."""
    total: dict[tuple[str, int], np.ndarray] = {}
    for b in batches:
        for g, f, v in zip(*(b.column(c) for c in range(3)), strict=True):
            part, k = np.frombuffer(v.as_py(), "float64"), (g.as_py(), f.as_py())
            total[k] = total[k] + part if k in total else part
    yield _vectors(total)


def over_folds(sums: dict[tuple[str, int], np.ndarray], grp: str, but: int | None = None) -> np.ndarray | None:
    """The sums of a group over all folds, or over all but one."""
    found = [v for (g, f), v in sums.items() if g == grp and f != but]
    return sum(found[1:], found[0]) if found else None


def moments(base: np.ndarray, fold: int = 0) -> np.ndarray:
    x = expanded(base)
    return np.concatenate([x.sum(axis=0), (x.T @ x)[np.triu_indices(x.shape[1])]])


def unpacked_moments(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and second moment matrix."""
    n, d = v[0], int((np.sqrt(9 + 8 * (len(v) - 1)) - 3) / 2)
    m, s = v[1 : d + 1] / n, np.zeros((d, d))
    s[np.triu_indices(d)] = v[d + 1 :] / n
    return m, s + np.triu(s, 1).T


def non_negative_fit(m_p: np.ndarray, s_p: np.ndarray, m_u: np.ndarray, s_u: np.ndarray, prior: float, ridge: float, steps: int = 500) -> np.ndarray:
    """Weights that minimise the non-negative unbiased risk under squared loss (1 - z)**2 / 4, with a ridge.

    The unbiased risk has a closed minimum, which is the answer where its negative part is not below zero. Otherwise that
    part counts as zero: descent steps from there, each halved until it lowers the risk, until none does.
    """
    scale = ridge * np.diag(np.maximum(np.diag(s_u), 1e-6))
    total = lambda w: risk(w, m_p, s_p, m_u, s_u, prior) + w @ scale @ w
    w = np.linalg.solve(s_u + 4 * scale, 2 * prior * m_p - m_u)
    rate, best = 4 / (np.linalg.eigvalsh(s_u + s_p).max() + 1e-9), total(w)
    for _ in range(steps):
        g = prior * (s_p @ w - m_p) / 2 + 2 * scale @ w
        if (1 + 2 * w @ m_u + w @ s_u @ w) - prior * (1 + 2 * w @ m_p + w @ s_p @ w) >= 0:
            g = g + (m_u + s_u @ w) / 2 - prior * (m_p + s_p @ w) / 2
        if np.abs(g).max() < 1e-7:
            break
        step = rate
        while (new := total(w - step * g)) >= best and step > 1e-9:
            step /= 2
        if new >= best:
            break
        w, best = w - step * g, new
    return w


def risk(w: np.ndarray, m_p: np.ndarray, s_p: np.ndarray, m_u: np.ndarray, s_u: np.ndarray, prior: float) -> float:
    """The non-negative risk of weights on a sample given by its moments."""
    positive = prior * (1 - 2 * w @ m_p + w @ s_p @ w) / 4
    negative = (1 + 2 * w @ m_u + w @ s_u @ w) / 4 - prior * (1 + 2 * w @ m_p + w @ s_p @ w) / 4
    return float(positive + max(0.0, negative))


def chosen_ridge(sums: dict[tuple[str, int], np.ndarray], prior: float) -> tuple[float, dict[int, np.ndarray]]:
    """The ridge of least mean risk on the folds left out, and for each fold the weights fitted without it.

    Candidates rise until PATIENCE of them in a row have not lowered the risk, so the range follows from the folds alone; as
    a model shrinks to nothing its risk settles, so this ends. Folds that lack a group are skipped; without any two of both
    groups nothing can be compared and a ridge of one is taken.
    """
    folds = [f for f in range(FOLDS) if all((g, f) in sums and over_folds(sums, g, f) is not None for g in "pu")]
    if not folds:
        return 1.0, {}
    best: tuple[float, float, dict[int, np.ndarray]] | None = None
    ridge, worse = FIRST_RIDGE, 0
    while worse < PATIENCE:
        fits = {f: non_negative_fit(*unpacked_moments(over_folds(sums, "p", f)), *unpacked_moments(over_folds(sums, "u", f)), prior, ridge, 200) for f in folds}
        mean = sum(risk(w, *unpacked_moments(sums["p", f]), *unpacked_moments(sums["u", f]), prior) for f, w in fits.items()) / len(folds)
        if best is None or mean < best[0] * (1 - 1e-9):
            best, worse = (mean, ridge, fits), 0
        else:
            worse += 1
        ridge *= RIDGE_FACTOR
    return best[1], best[2]


def bins_of(weights: dict[int, np.ndarray], otherwise: np.ndarray) -> Callable[[np.ndarray, int], np.ndarray]:
    """Score histogram of rows under the weights of their fold."""

    def count(base: np.ndarray, fold: int) -> np.ndarray:
        z = np.clip((expanded(base) @ weights.get(fold, otherwise) + 2) / 4 * BINS, 0, BINS - 1).astype("int64")
        return np.bincount(z, minlength=BINS).astype("float64")

    return count


def estimated_prior(p: np.ndarray, u: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled: the smallest ratio of score tails, with a confidence margin on each."""
    n_p, n_u = p.sum(), u.sum()
    tail_p, tail_u = np.cumsum(p[::-1]) / n_p, np.cumsum(u[::-1]) / n_u
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(n_p) + 1 / np.sqrt(n_u))
    ok = tail_p > max(0.05, 3 * slack)
    if not ok.any():
        return 0.5
    k = np.argmin(np.where(ok, (tail_u + slack) / np.maximum(tail_p, 1e-12), np.inf))
    return float(np.clip(tail_u[k] / tail_p[k], 0.02, 0.98))


def calibration(p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Probability of a positive in each score bin: prior * p / u, pooled until it rises with the score."""
    n_p, n_u = max(p.sum(), 1), max(u.sum(), 1)
    blocks: list[list[float]] = []  # positive mass, unlabelled mass, bins
    for a, b in zip(p / n_p * prior, u / n_u, strict=True):
        blocks.append([a + prior * 0.01 / n_u, b + 0.01 / n_u, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            x = blocks.pop()
            blocks[-1] = [blocks[-1][0] + x[0], blocks[-1][1] + x[1], blocks[-1][2] + x[2]]
    return np.clip(np.concatenate([np.full(int(k), a / b) for a, b, k in blocks]), 0.0, 1.0)


def score_with(rows: DataFrame, w: np.ndarray, curve: np.ndarray) -> DataFrame:
    """Replace x by `score`: the calibrated probability, with a small share of the raw order kept among equals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = expanded(unpack(b.column("x"))) @ w
            at = np.clip((z + 2) / 4 * BINS - 0.5, 0, BINS - 1)
            s = 0.999 * np.interp(at, np.arange(BINS), curve) + 0.001 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64())], names=["doc_id", "held_out", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "held_out", "x").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, prior: float | None = None) -> DataFrame:
    """doc_id, held_out and score of every document; labels are learnt only where `held_out` (of doc_id) is false."""
    rows = stored(features(docs).withColumn("held_out", held_out), "quality-features")
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("k")).distinct()
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")
    learn = rows.where(~F.coalesce(F.col("held_out"), F.lit(False)))
    trusted = learn.join(good, F.col("doc_id") == F.col("k"), "left_semi").select(F.lit("p").alias("grp"), fold, "x")
    both = stored(trusted.unionByName(learn.select(F.lit("u").alias("grp"), fold, "x")), "pu-rows")
    sums = summed(both, moments)
    p_sums, u_sums = over_folds(sums, "p"), over_folds(sums, "u")
    if p_sums is None or u_sums is None:
        return rows.select("doc_id", "held_out", F.lit(0.5).alias("score"))
    guess = 0.5 if prior is None else prior
    for _ in range(1 if prior is not None else 2):
        ridge, fits = chosen_ridge(sums, guess)
        w = non_negative_fit(*unpacked_moments(p_sums), *unpacked_moments(u_sums), guess, ridge)
        hist = summed(both, bins_of(fits, w))
        p, u = over_folds(hist, "p")[1:], over_folds(hist, "u")[1:]
        guess = estimated_prior(p, u) if prior is None else prior
    return score_with(rows, w, calibration(p, u, guess))


def op2_nonnegative_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_text(F.col("doc_id")) % 5 == 0
    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held)
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
