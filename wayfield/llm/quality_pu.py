"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train an additive logistic model over
binned text statistics. The share of positives among the unlabelled texts (the class
prior) is estimated first, by best-bin estimation on a classifier of positives
against unlabelled. Then the non-negative unbiased risk is minimised:

    prior * L+(P) + max(0, L-(U) - prior * L-(P))

where L+ and L- are mean logistic losses for the labels positive and negative.
Negative labels are never used.

Of the trusted positives at most ``POSITIVES`` are taken, those with the smallest hashes
of their ids. Unlabelled texts are all taken: each becomes one byte a statistic, kept in
the shared folder, and every evaluation of the risk is a pass over those bytes that
returns sums. Every text is scored as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import batch_limits, checkpointed
from .secrets import SPAN

POSITIVES = 4000
#: Unlabelled rows of a task, and most tasks, of a pass: bound what the driver sums.
PASS_ROWS, PASS_TASKS = 20_000, 4096
BINS = 16
#: Over about so much the risk's corner at zero is rounded, so that its slope is continuous.
CORNER = 0.01
THRESHOLD = 0.7
NAMES = (
    "words", "word_length", "upper", "digits", "bangs", "bars", "symbols", "stops", "quotes", "beyond_ascii",
    "distinct_words", "distinct_triples", "same_as_last", "top_word", "lines", "dup_lines", "mean_line", "capital_words", "one_letter",
)

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "bangs": b"!?", "bars": b"|", "symbols": b"#*$%&<>=+~^@\\/_{}[]",
    "stops": b".,;:", "quotes": b"\"'()-",
}


def statistics_of(text: str) -> list[float]:
    """The NAMES statistics of one text; an empty text has zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    w = text.split()
    if not w:
        return [0.0] * len(NAMES)
    histogram = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(w)
    size = max(1, len(text) - int(histogram[[9, 10, 11, 12, 13, 32]].sum()))
    share = {k: float(histogram[list(v)].sum()) / size for k, v in _CLASSES.items()}
    counts: dict[str, int] = {}
    for x in w:
        counts[x] = counts.get(x, 0) + 1
    triples = len(set(zip(w, w[1:], w[2:]))) / (n - 2) if n > 2 else 1.0
    again = sum(map(str.__eq__, w, w[1:])) / n
    lines = [s for s in text.split("\n") if s.strip()]
    return [
        float(np.log1p(n)), size / n, *share.values(), float(histogram[0xC0:].sum()) / size,
        len(counts) / n, triples, again, max(counts.values()) / n, len(lines) / n, 1 - len(set(lines)) / len(lines), float(np.log1p(n / len(lines))),
        sum(x[:1].isupper() for x in w) / n, sum(len(x) == 1 for x in w) / n,
    ]


@dataclass
class Model:
    cuts: list[np.ndarray]
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.weights[places(x, self.cuts)].sum(axis=1) + self.bias)


def places(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """For each row and statistic the number of its bin, bins of all statistics counted through."""
    first = np.cumsum([0, *(len(c) + 1 for c in cuts)])
    return np.stack([np.searchsorted(c, x[:, f], side="left") + first[f] for f, c in enumerate(cuts)], axis=1) if len(x) else np.zeros((0, len(cuts)), np.int64)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _z(at: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The model's log-odds; the last weight is the bias."""
    return w[:-1][at].sum(axis=1) + w[-1]


def _gradient(at: np.ndarray, each: np.ndarray, size: int) -> np.ndarray:
    """Sum of the rows' one-hot vectors times ``each``."""
    return np.r_[np.bincount(at.ravel(), np.repeat(each, at.shape[1]), size - 1), each.sum()]


def sums_of(at: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Rows, sum of the losses for the label negative, and its gradient."""
    z = _z(at, w)
    return np.r_[len(at), np.logaddexp(0, z).sum(), _gradient(at, _sigmoid(z), len(w))]


def counts_of(at: np.ndarray, w: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many rows score between neighbouring cuts."""
    return np.bincount(np.searchsorted(cuts, _z(at, w), side="right"), minlength=len(cuts) + 1).astype(float)


class Rows:
    """Unlabelled rows in memory."""

    def __init__(self, at: np.ndarray):
        self.at = at

    def total(self, f, half: int | None = None) -> np.ndarray:
        return f(self.at if half is None else self.at[half::2])


class Table:
    """Unlabelled rows as a DataFrame (half, bins): one byte a statistic."""

    def __init__(self, bins: DataFrame, first: np.ndarray):
        self.bins, self.first = bins, first

    def total(self, f, half: int | None = None) -> np.ndarray:
        """The sum of ``f`` over the rows, each task summing its own."""
        first = self.first
        rows = self.bins if half is None else self.bins.filter(F.col("half") == half)

        def run(batches):
            total = None
            for batch in batches:
                packed = b"".join(batch.column("bins").to_pylist())
                got = f(np.frombuffer(packed, np.uint8).reshape(-1, len(first)).astype(np.int64) + first)
                total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

        found = rows.select("bins").mapInArrow(run, "total binary").collect()
        empty = f(np.zeros((0, len(first)), np.int64))
        return sum((np.frombuffer(r.total) for r in found), empty)


def quantile_cuts(x: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]


def minimise(f, size: int, steps: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS from zero with steps halved until the value falls; ``f`` gives value and gradient."""
    w = np.zeros(size)
    value, g = f(w)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, kept = g.copy(), []
        for s, y in reversed(pairs):
            share = (s @ d) / (s @ y)
            kept.append(share)
            d -= share * y
        if pairs:
            d *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1])
        for (s, y), share in zip(pairs, reversed(kept), strict=True):
            d += s * (share - (y @ d) / (s @ y))
        slope = -(d @ g)
        if slope >= 0:
            d, slope = g.copy(), -(g @ g)
        rate = 1.0 if pairs else min(1.0, 1 / max(1e-12, float(np.abs(g).sum())))
        while True:
            new = w - rate * d
            new_value, new_g = f(new)
            if new_value <= value + 1e-4 * rate * slope or rate < 1e-3:
                break
            rate /= 2
        if new_value >= value:
            break
        s, y = new - w, new_g - g
        if s @ y > 1e-12:
            pairs = [*pairs[1 - memory :], (s, y)]
        settled = value - new_value <= 1e-5 * max(1.0, abs(value))
        w, value, g = new, new_value, new_g
        if settled:
            break
    return w


def class_prior(p: np.ndarray, u: Rows | Table, size: int, decay: float = 1e-4, least: float = 0.2) -> float:
    """Share of positives among the unlabelled rows: best-bin estimation.

    A classifier of positives against unlabelled is fitted on one half. On the other,
    the top of its scores holds hardly anything but positives, so the ratio of the two
    upper tails there is the prior, and lower cuts only add to it. Of the cuts that
    keep a share ``least`` of the positives the one with the smallest ratio plus standard
    error is taken, and its ratio less two errors is returned: too small a prior costs
    little, too large a one hides the negatives.
    """
    one, other = p[0::2], p[1::2]

    def risk(w: np.ndarray) -> tuple[float, np.ndarray]:
        n, loss, *down = u.total(lambda at: sums_of(at, w), 0)
        z = _z(one, w)
        up = _gradient(one, _sigmoid(z) - 1, size) / len(one)
        value = 0.5 * np.logaddexp(0, -z).mean() + 0.5 * loss / max(1, n) + decay / 2 * (w[:-1] @ w[:-1])
        return float(value), 0.5 * up + 0.5 * np.array(down) / max(1, n) + decay * np.r_[w[:-1], 0]

    w = minimise(risk, size, steps=15)
    zp = np.sort(_z(other, w))
    cuts = np.unique(zp)
    counts = u.total(lambda at: counts_of(at, w, cuts), 1)
    n_u = max(1.0, counts.sum())
    qp = 1 - np.searchsorted(zp, cuts) / len(zp)
    qu = np.maximum(counts[1:][::-1].cumsum()[::-1] / n_u, 1 / n_u)
    kept = qp >= least
    qp, qu = qp[kept], qu[kept]
    ratio = qu / qp
    error = ratio * np.sqrt((1 - qu) / (qu * n_u) + (1 - qp) / (qp * len(zp)))
    at = int(np.argmin(ratio + error))
    return float(np.clip(ratio[at] - 2 * error[at], 0.01, 0.99))


def fit_bins(p: np.ndarray, u: Rows | Table, cuts: list[np.ndarray], decay: float = 1e-2) -> Model | None:
    """The model of positives' bins and unlabelled rows; None if either has fewer than two rows."""
    size = sum(len(c) + 1 for c in cuts) + 1
    if len(p) < 2 or u.total(lambda at: np.array([float(len(at))]))[0] < 2:
        return None
    prior = class_prior(p, u, size)

    def risk(w: np.ndarray) -> tuple[float, np.ndarray]:
        n, loss, *down = u.total(lambda at: sums_of(at, w))
        z = _z(p, w)
        negative = loss / n - prior * np.logaddexp(0, z).mean()
        value = prior * np.logaddexp(0, -z).mean() + decay / 2 * (w[:-1] @ w[:-1])
        slope = prior * _gradient(p, _sigmoid(z) - 1, size) / len(p) + decay * np.r_[w[:-1], 0]
        # Below zero the negative part has been overfitted and counts as zero, with the corner rounded.
        counts = 1 / (1 + np.exp(-np.clip(negative / CORNER, -30, 30)))
        part = np.array(down) / n - prior * _gradient(p, _sigmoid(z), size) / len(p)
        return float(value + CORNER * np.logaddexp(0, negative / CORNER)), slope + counts * part

    w = minimise(risk, size, steps=60)
    return Model(cuts, w[:-1].astype(np.float32), float(w[-1]), prior)


def fit_rows(positive: np.ndarray, unlabelled: np.ndarray) -> Model | None:
    """The model of two arrays of statistics."""
    cuts = quantile_cuts(np.concatenate([positive, unlabelled]))
    return fit_bins(places(positive, cuts), Rows(places(unlabelled, cuts)), cuts)


def _measured(text: Column) -> Column:
    @arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([statistics_of(t or "") for t in texts.to_pylist()], pa.list_(pa.float64()))

    return run(text)


def fit(docs: DataFrame, positives: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """A model from ``docs`` (all of it unlabelled) and the ids in ``positives``.

    Null texts don't count. A positive counts once, however often its id occurs;
    unlabelled rows count each time. None with fewer than two of either. Other columns
    are not read.
    """
    batch_limits(docs.sparkSession)
    order = F.pmod(F.xxhash64(F.col("id")), F.lit(SPAN))
    # At most POSITIVES ids of eight bytes: a bounded table.
    trusted = positives.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    trusted = F.broadcast(trusted.orderBy(order, "id").limit(POSITIVES))
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = checkpointed(texts.select("id", _measured(F.col("text")).alias("x")))
    n = rows.count()
    shares = [float(q) for q in np.linspace(0, 1, BINS + 1)[1:-1]]
    found = rows.agg(*[F.percentile_approx(F.col("x")[i], shares, 10_000).alias(f"q{i}") for i in range(len(NAMES))]).first()
    if not n:
        return None
    cuts = [np.unique(np.array(found[f"q{i}"], float)) for i in range(len(NAMES))]
    first = np.cumsum([0, *(len(c) + 1 for c in cuts)])[:-1]

    @arrow_udf("binary")
    def packed(xs: pa.Array) -> pa.Array:
        x = np.array(xs.to_pylist(), float).reshape(-1, len(NAMES))
        return pa.array([r.tobytes() for r in (places(x, cuts) - first).astype(np.uint8)], pa.binary())

    # Halves by the statistics, so that copies lie in one of them.
    halves = rows.select((F.pmod(F.xxhash64("x"), F.lit(2))).cast("int").alias("half"), packed(F.col("x")).alias("bins"))
    bins = checkpointed(halves.coalesce(int(min(PASS_TASKS, n // PASS_ROWS + 1))))
    some = rows.join(trusted, "id", "left_semi").groupBy("id").agg(F.min("x").alias("x")).orderBy("id").collect()
    p = places(np.array([r.x for r in some], float).reshape(-1, len(NAMES)), cuts)
    return fit_bins(p, Table(bins, first), cuts)


def scored(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= threshold, else 0).

    Null and empty texts are scored by their (zero) statistics; without a model every
    score is 0.5. Columns of these names are replaced, all others and all rows stay.
    """
    batch_limits(docs.sparkSession)
    if model is None:
        return docs.withColumn("score", F.lit(0.5)).withColumn("predicted", F.lit(int(0.5 >= threshold)))

    @arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        x = np.array([statistics_of(t or "") for t in texts.to_pylist()], float).reshape(-1, len(NAMES))
        return pa.array(model.score(x).astype(float), pa.float64())

    return docs.withColumn("score", run(F.col(text_col))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def training_part(id_col: str = "doc_id") -> Column:
    """Rows whose labels may be learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 != 2, F.lit(False))
