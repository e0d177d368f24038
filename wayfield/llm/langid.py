"""Language identification by nearest clustered centroids of TF-IDF n-gram vectors.

A text becomes the counts of its character 1- to 3-grams, hashed into ``DIM`` places,
damped, weighted by IDF and scaled to length one. Each language has several
centroids (spherical k-means over its own training texts), so that prose, headings
and lists of one language need not share one mean. A text gets the language of the
centroid with the largest cosine, and that cosine as its score.

A text is rejected if it is farther from its centroid than texts of about its length
that belong there: if its cosine is under ``SLACK`` times the cosine that a share ``USUAL``
of the centroid's training texts, cut to that length, reach. Short texts are far from
any mean, so the reach is learnt for each of the lengths ``PIECES``. The prediction of a
rejected text stays its nearest language; ``rejected`` is a column of its own.

Fitting uses at most ``SAMPLE`` texts of each language, those with the smallest
hashes of their ids; the bound covers vectors and everything derived from them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import batch_limits, checkpointed, free_name

DIM = 4096
SAMPLE = 500
SPAN = 1 << 40
CLUSTERS = 4
#: Code points to which training texts are cut for the reach of short texts; the last band is of whole texts.
PIECES = (12, 40, 160, 640)
USUAL = 0.99
SLACK = 0.6
#: Training texts below which a centroid takes the reach of all texts of its language.
LEAST = 20
REJECTED = "und"


@dataclass
class Centroids:
    langs: list[str]  # one for each centroid
    idf: np.ndarray
    vectors: np.ndarray  # centroids x DIM, rows of length one
    reach: np.ndarray  # centroids x (PIECES and whole texts): largest distance (1 - cosine) accepted


def codes_of(text: str) -> np.ndarray:
    """Code points of a text in lower case, runs of plain characters that aren't letters as one blank."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where((c < 33) | ((c > 32) & (c < 65)) | ((c > 90) & (c < 97)) | ((c > 122) & (c < 128)), 32, c)  # what isn't a letter separates
    return c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]


def grams_of(c: np.ndarray) -> np.ndarray:
    """Damped counts of hashed 1- to 3-grams of code points."""
    counts = np.zeros(DIM, np.int64)
    h = np.zeros(len(c), np.uint32)
    for n in range(3):
        if len(c) <= n:
            break
        h = (h[: len(c) - n] + c[n:]) * np.uint32(2654435761)
        h ^= h >> np.uint32(15)
        counts += np.bincount(h % np.uint32(DIM), minlength=DIM)
    return np.log1p(counts).astype(np.float32)


def gram_counts(text: str) -> np.ndarray:
    """Damped counts of the whole text's grams."""
    return grams_of(codes_of(text))


def band_of(length: int) -> int:
    """The number of the shortest piece that is as long, or of whole texts."""
    return sum(length > p for p in PIECES)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12)


def clusters(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, begun with texts far from one another."""
    chosen = [unit(rows.mean(axis=0))]
    nearest = rows @ chosen[0]
    centres = []
    for _ in range(min(k, len(rows))):
        at = int(np.argmin(nearest)) if centres else int(np.argmax(nearest))
        centres.append(rows[at])
        nearest = np.maximum(rows @ rows[at], -1 if len(centres) == 1 else nearest)
    centre = np.array(centres)
    for _ in range(rounds):
        own = np.argmax(rows @ centre.T, axis=1)
        centre = np.array([unit(rows[own == j].sum(axis=0)) if (own == j).any() else centre[j] for j in range(len(centre))])
    return centre


def fit_vectors(langs: list[str], counts: np.ndarray, k: int = CLUSTERS) -> Centroids:
    """Centroids of labelled count vectors."""
    order = sorted(range(len(langs)), key=lambda i: langs[i])
    langs, counts = [langs[i] for i in order], counts[order]
    idf = np.log((1 + len(langs)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(1)
    rows = unit(counts * idf)
    names, vectors = [], []
    for lang in sorted(set(langs)):
        own = rows[[i for i, x in enumerate(langs) if x == lang]]
        centre = clusters(own, k)
        names += [lang] * len(centre)
        vectors.append(centre)
    vectors = np.concatenate(vectors).astype(np.float32)
    return Centroids(names, idf, vectors, np.ones((len(names), len(PIECES) + 1), np.float32))


def distances(text: str, lang: str, model: Centroids) -> list[tuple[int, int, float]]:
    """(centroid, band, distance) of a training text and of its middle pieces, to the nearest centroid of its language."""
    own = [j for j, x in enumerate(model.langs) if x == lang]
    codes = codes_of(text)
    out = []
    for size in (*PIECES, len(codes)):
        at = max(0, (len(codes) - size) // 2)
        piece = codes[at : at + size]
        if size != len(codes) and len(piece) < size or not (piece != 32).any():
            continue
        cosine = model.vectors[own] @ unit(grams_of(piece) * model.idf)
        best = int(np.argmax(cosine))
        out.append((own[best], band_of(len(piece)), float(1 - cosine[best])))
    return out


def reach_of(far: list[tuple[int, int, int, float]], langs: list[str]) -> np.ndarray:
    """The reach from rows (centroid, band, texts, usual distance); a centroid of few texts takes its language's largest."""
    reach = np.full((len(langs), len(PIECES) + 1), np.nan)
    for j, band, n, d in far:
        if n >= LEAST:
            reach[j, band] = d
    for j, lang in enumerate(langs):
        for band in range(reach.shape[1]):
            if np.isnan(reach[j, band]):
                others = [d for k, b, _, d in far if b == band and langs[k] == lang]
                reach[j, band] = max(others, default=np.nan)
    # Without training texts of a length, what is usual for shorter ones holds.
    for band in range(1, reach.shape[1]):
        reach[:, band] = np.where(np.isnan(reach[:, band]), reach[:, band - 1], reach[:, band])
    return (1 - SLACK * (1 - np.where(np.isnan(reach), 1, reach))).astype(np.float32)


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> Centroids | None:
    """Centroids from labelled rows; None without any.

    Rows without language, text or any letter don't count. A row repeated under one id
    may count more than once; ties of hashes are settled by the text. Columns other than
    the three named are not read.
    """
    batch_limits(train.sparkSession)

    @arrow_udf("binary")
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array([gram_counts(t).tobytes() for t in texts.to_pylist()], pa.binary())

    rows = train.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(SPAN)).alias("h"))
    counts = {r.lang: r["count"] for r in rows.filter("lang is not null").groupBy("lang").count().collect()}
    if not counts:
        return None
    # About twice the sample by hash, then the smallest hashes of each language among those few.
    near = [F.when((F.col("lang") == lang) & (F.col("h") < int(SPAN * min(1.0, 2 * sample / n))), True) for lang, n in counts.items()]
    few = rows.filter(F.coalesce(*near, F.lit(False))).filter(F.col("text").rlike(r"\p{L}"))
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("r") <= sample).select("lang", "text")
    ranked = checkpointed(ranked)
    found = ranked.select("lang", counted(F.col("text")).alias("v")).collect()
    if not found:
        return None
    model = fit_vectors([r.lang for r in found], np.array([np.frombuffer(r.v, np.float32) for r in found]))

    @arrow_udf("array<struct<centroid: int, band: int, distance: double>>")
    def measured(texts: pa.Array, langs: pa.Array) -> pa.Array:
        every = [[dict(zip(("centroid", "band", "distance"), x, strict=True)) for x in distances(t, lang, model)] for t, lang in zip(texts.to_pylist(), langs.to_pylist(), strict=True)]
        return pa.array(every, pa.list_(pa.struct([("centroid", pa.int32()), ("band", pa.int32()), ("distance", pa.float64())])))

    far = ranked.select(F.explode(measured(F.col("text"), F.col("lang"))).alias("x")).select("x.*")
    usual = far.groupBy("centroid", "band").agg(F.count("*").alias("n"), F.percentile("distance", F.lit(USUAL)).alias("d")).collect()
    model.reach = reach_of([(r.centroid, r.band, r.n, r.d) for r in usual], model.langs)
    return model


def nearest(text: str, model: Centroids) -> tuple[str, float, bool]:
    """(language, cosine with its nearest centroid from 0 to 1, whether that is too far) of a text."""
    codes = codes_of(text)
    cosine = model.vectors @ unit(grams_of(codes) * model.idf)
    at = int(np.argmax(cosine))
    return model.langs[at], float(np.clip(cosine[at], 0, 1)), bool(1 - cosine[at] > model.reach[at, band_of(len(codes))])


def classify(text: str, model: Centroids) -> tuple[str, float]:
    """(language, cosine) of a text, or (``und``, 0) if it is rejected."""
    lang, score, rejected = nearest(text, model)
    return (REJECTED, 0.0) if rejected else (lang, score)


def predicted(text: Column, model: Centroids | None) -> Column:
    """struct<lang_pred: string, score: double, rejected: boolean> of a text column."""
    none = F.struct(F.lit(REJECTED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    if model is None:
        return none

    @arrow_udf("struct<lang_pred: string, score: double, rejected: boolean>")
    def run(texts: pa.Array) -> pa.Array:
        found = [nearest(t or "", model) for t in texts.to_pylist()]
        columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
        return pa.StructArray.from_arrays(columns, names=["lang_pred", "score", "rejected"])

    return F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), run(text)).otherwise(none)


def identify(docs: DataFrame, model: Centroids | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected.

    Every text with a letter gets its nearest language, rejected or not; null texts and
    texts without a letter get ``und`` and 0 and are rejected, as are all if nothing was
    learnt. On a tie the first language by name counts. Columns of these three names are
    replaced, all others kept; every row stays.
    """
    batch_limits(docs.sparkSession)
    held = free_name(docs, "lang_")
    found = docs.withColumn(held, predicted(F.col(text_col), model))
    return found.withColumns({c: F.col(held)[c] for c in ("lang_pred", "score", "rejected")}).drop(held)


def recognised(docs: DataFrame, model: Centroids | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their own columns only."""
    batch_limits(docs.sparkSession)
    held = free_name(docs, "lang_")
    return docs.withColumn(held, predicted(F.col(text_col), model)).filter(~F.col(held)["rejected"]).drop(held)


def training_part(id_col: str = "doc_id") -> Column:
    """Rows that may be learnt from: the CRC of the id leaves a remainder other than 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 != 1, F.lit(False))
