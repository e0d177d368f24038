"""Phrases whose words keep company, counted from their longest windows.

Every word opens one window: itself and the words that follow in its piece, LONGEST at
most, in columns w1 to w5 padded with null. Only these windows are counted. A phrase
of k words occurs as often as windows begin with it, so sums over ROLLUP (w1, .., w4) of
the counted windows give the counts of all shorter phrases; no other n-grams are made.

A window ends early before a pair of words that is found fewer than LEAST times: a phrase
over it is as rare, so is no candidate and no part of one. Pairs are counted first,
by a 64-bit hash; the frequent ones make a Bloom filter of a fixed size. What passes it
by mistake only makes a window longer than it need be.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_limits, stored

#: Words of a phrase at most, its occurrences at least, phrases reported for each language, and the share (of 100) of a
#: phrase's occurrences inside a longer one from which it is dropped.
LONGEST, LEAST, TOP, INSIDE = 5, 100, 2000, 100
#: Bits of the filter and places of a pair in it.
BLOOM_BITS, PROBES = 1 << 25, 4
UNKNOWN = "und"
#: Languages (of about 50 bytes each) up to which their totals are broadcast.
LANGUAGES = 100_000
WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]
#: Texts of a language handled at once, in bytes: bounds a task's memory but for a longer text.
BLOCK = 4 << 20

#: What ends a piece becomes a line feed, a tab a space, and A-Z are lowered.
_PLAIN = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)]


def coded(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The different words of some texts, and the texts as numbers of words from 1, with 0 between pieces."""
    plain = b"\n".join(texts).translate(_PLAIN).replace(b"\n", b" \n ")
    number: dict[bytes, int] = {b"\n": 0}
    parts = plain.split(b" ")
    codes = np.fromiter((number.setdefault(p, len(number)) for p in parts if p), np.int64)
    return list(number)[1:], codes


def _hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array([0, *(xxhash.xxh64_intdigest(w) for w in words)], np.uint64)


def pair_hashes(hashes: np.ndarray, lang: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    import xxhash

    with np.errstate(over="ignore"):
        h = (hashes[first] * _ODD[0]) ^ (hashes[second] + np.uint64(xxhash.xxh64_intdigest(lang, 3)))
        h = (h ^ (h >> np.uint64(31))) * _ODD[1]
        return h ^ (h >> np.uint64(29))


def _places(h: np.ndarray) -> np.ndarray:
    """PROBES bit numbers of each hash."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(h + np.uint64(i) * step) & np.uint64(BLOOM_BITS - 1) for i in range(PROBES)])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts by language, in blocks."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for b in batches:
        for lang, text in zip(b["lang"].to_pylist(), b["text"]):
            if value := text.as_py():
                held.setdefault(lang, []).append(value)
                size += len(value)
                if size >= BLOCK:
                    yield from held.items()
                    held, size = {}, 0
    yield from held.items()


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n) of each block."""
    for lang, texts in _blocks(batches):
        words, codes = coded(texts)
        both = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0))
        pairs, n = np.unique(codes[both] * (len(words) + 1) + codes[both + 1], return_counts=True)
        h = pair_hashes(_hashes(words), lang, pairs // (len(words) + 1), pairs % (len(words) + 1))
        yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["pair", "n"])


def filter_of(pairs: DataFrame) -> np.ndarray:
    """The Bloom filter of ``pair`` hashes as bytes: at most BLOOM_BITS / 64 rows come to the driver."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _places(b["pair"].to_numpy().view(np.uint64)).ravel()
            yield pa.record_batch([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "bits"])

    rows = pairs.select("pair").mapInArrow(words, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bloom = np.zeros(BLOOM_BITS // 64, np.int64)
    bloom[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return bloom.view(np.uint8)


def _windows(bloom: np.ndarray):
    """(lang, w1, .., w5, n) of each block: its different windows and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _blocks(batches):
            words, codes = coded(texts)
            hashes = _hashes(words)
            go = np.zeros(len(codes), bool)  # whether a window goes on to the next word
            both = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0))
            at = _places(pair_hashes(hashes, lang, codes[both], codes[both + 1]))
            go[both] = ((bloom[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)
            lead = [codes]
            for k in range(1, LONGEST):
                open_ = np.concatenate((go[k - 1 :], np.zeros(k - 1, bool))) & (lead[-1] > 0)
                lead.append(np.where(open_, np.concatenate((codes[k:], np.zeros(k, np.int64)))[: len(codes)], 0))
            lead = [c[codes > 0].astype(np.int32) for c in lead]
            order = np.lexsort(lead[::-1])
            lead = [c[order] for c in lead]
            new = np.ones(len(order), bool)
            if len(order):
                new[1:] = np.any([c[1:] != c[:-1] for c in lead], axis=0)
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(order)))
            names = pa.array(words, pa.binary()).cast(pa.string())
            for low in range(0, len(first), 100_000):
                part = first[low : low + 100_000]
                columns = [names.take(pa.array(c[part] - 1, mask=c[part] == 0)) for c in lead]
                yield pa.record_batch([pa.array([lang] * len(part)), *columns, pa.array(n[low : low + 100_000], pa.int64())], ["lang", *WORDS, "n"])

    return run


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, length, f) of all phrases of up to LONGEST words found ``least`` times or more in a language, and (lang, n), its words."""
    batch_limits(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    pairs = texts.mapInArrow(_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    windows = texts.mapInArrow(_windows(filter_of(pairs)), f"lang string, {', '.join(f'{w} string' for w in WORDS)}, n long")
    longest = stored(windows.groupBy("lang", *WORDS).agg(F.sum("n").alias("n")), "windows")
    whole = longest.filter(F.col(WORDS[-1]).isNotNull() & (F.col("n") >= least)).select("lang", F.concat_ws(" ", *WORDS).alias("phrase"), F.lit(LONGEST).alias("length"), F.col("n").alias("f"))
    # ROLLUP (lang, w1, .., w4): a level has the phrases of as many words, and windows padded before, which go. At no words it has all windows of a language: its words.
    level = F.lit(LONGEST - 1) - F.bit_count(F.grouping_id())
    rolled = longest.rollup("lang", *WORDS[:-1]).agg(F.sum("n").alias("f"), level.cast("int").alias("length"))
    last = F.when(F.col("length") > 0, F.element_at(F.array(*WORDS[:-1]), F.greatest(F.lit(1), F.col("length"))))
    shorter = rolled.filter((F.col("length") == 0) | ((F.col("f") >= least) & last.isNotNull())).select("lang", F.concat_ws(" ", *WORDS[:-1]).alias("phrase"), "length", "f")
    found = stored(whole.unionByName(shorter), "phrases")
    return found.filter("length > 0"), found.filter("length = 0").select("lang", F.col("f").alias("n"))


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of two to LONGEST words of each language.

    a, l and r count the phrase and the two parts of its lowest-scoring cut (the first of
    equal ones), n all words of the language; score is floor(1000 a n / (l r)). A phrase inside
    a longer one that is found at least ``inside`` of 100 times as often is left out. Order: score,
    then a, both falling, then the phrase by its bytes. Null texts are empty, a null
    language is ``und``; repeated rows count each time; an empty table gives an empty
    result. Other columns are not read.
    """
    found, total = counts(docs, text_col, lang_col, least)
    words = F.split("phrase", " ")
    candidates = found.filter("length > 1").select("lang", "phrase", "length", F.col("f").alias("a"))
    joined = lambda first, n: F.array_join(F.slice(words, first, n), " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("length") - 1))).withColumns({"left": joined(F.lit(1), F.col("k")), "right": joined(F.col("k") + 1, F.col("length") - F.col("k"))})
    part = lambda name, f: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    # Parts are found as often as their phrase or more, so each is known.
    # A row a language: sent around where these are few, so that none of them is a key of a shuffle.
    total = F.broadcast(total) if total.count() <= LANGUAGES else total
    rated = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(total, "lang")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    rated = rated.withColumn("top", (big("a") * big("n")).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")).withColumn("bottom", big("l") * big("r"))
    rated = rated.withColumn("score", F.expr("top div bottom"))
    lowest = rated.groupBy("lang", "phrase", "length", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("length") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("length") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))
    longer = candidates.filter("length > 2").select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    alone = lowest.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), F.asc("phrase"))
    ranked = alone.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "c.l", "c.r", "n", "c.score")
