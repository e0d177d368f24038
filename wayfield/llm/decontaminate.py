"""Benchmark decontamination by spaced-seed hashing.

Texts become sequences of word hashes. A seed is a mask over ``SPAN`` neighbouring
words that looks at ``WEIGHT`` of them and ignores the others, so a substituted word
at an ignored place does no harm. The masks are chosen so that any window of
``WINDOW`` words with two substitutions holds a place where some mask sees none of
them (checked by the tests). Seed hashes of documents and of benchmark items are
joined; each meeting gives an alignment (document place minus item place), and
around it words are compared one by one. A document leaks an item if, in some window
of ``WINDOW`` words of an alignment, at most two differ.

The documents' seeds pass a Bloom filter of the benchmark's seeds before they leave
the scan, so only the surroundings of likely hits are shuffled. The filter has a
fixed size, whatever the benchmark's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import batch_limits, checkpointed, of_rows, row_key

MASKS = ((0, 1, 2, 3, 5, 8), (0, 3, 4, 6, 7, 8))
SPAN = 9
WINDOW = 13
#: Words of a window that must agree.
AGREE = 11
#: Words from the first hit of a stretch to its last: each alignment compares no more.
PIECE = 256
BLOOM_BITS = 1 << 25
#: Seeds of a benchmark up to which its side of the joins is broadcast (under 32 MB).
BROADCAST_ROWS = 500_000
#: Characters handled at once; bounds a Python worker's memory.
BLOCK = 1 << 20

_random = np.random.default_rng(20240607)
_PLACE = _random.integers(0, 1 << 63, 64, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_COEF = _random.integers(0, 1 << 63, (len(MASKS), 8), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SEPARATOR = "\x00\n\x00"
_WORD: list[np.ndarray] = []


def _is_word(codes: np.ndarray) -> np.ndarray:
    """Letters, digits and underscore; characters beyond the basic plane count as letters."""
    if not _WORD:
        _WORD.append(np.array([chr(c).isalnum() or c == 95 for c in range(65536)]))
    return _WORD[0][np.minimum(codes, 65535)] | (codes > 65535)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, lower-cased, and the number of the text it is in."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer(_SEPARATOR.join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    word = _is_word(codes)
    if not word.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    begins = word & ~np.concatenate(([False], word[:-1]))
    starts = np.flatnonzero(begins)
    inside = np.flatnonzero(word)
    first = np.searchsorted(inside, starts)
    place = inside - np.repeat(starts, np.diff(np.append(first, len(inside))))
    with np.errstate(over="ignore"):
        spread = (codes[inside].astype(np.uint64) + np.uint64(1)) * _PLACE[place % 64] * (place // 64 + 1).astype(np.uint64)
        hashes = _mix(np.add.reduceat(spread, first))
    ends = np.cumsum([len(t) + len(_SEPARATOR) for t in lowered])
    return hashes, np.searchsorted(ends, starts, side="right")


def seed_hashes(tokens: np.ndarray, mask: int) -> np.ndarray:
    """The mask's hash at every place where it fits."""
    n = len(tokens) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(n, np.uint64(mask + 1))
        for k, at in enumerate(MASKS[mask]):
            h += tokens[at : at + n] * _COEF[mask, k]
        return _mix(h)


def _bloom_places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return h & np.uint64(BLOOM_BITS - 1), (h >> np.uint64(32)) & np.uint64(BLOOM_BITS - 1)


def _blocks(texts: list[str]):
    """Runs of texts of about BLOCK characters, with the number of the first."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK or i == len(texts) - 1:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0


_SEEDS = "array<struct<place: int, seed: bigint>>"
_SEGMENTS = "array<struct<start: int, tokens: array<bigint>, hits: array<struct<place: int, seed: bigint>>>>"


def _tokens_and_seeds(text: Column) -> Column:
    """All word hashes and seeds of a (benchmark) text."""

    @arrow_udf(f"struct<tokens: array<bigint>, seeds: {_SEEDS}>")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            tokens, _ = word_hashes([t or ""])
            seeds = [{"place": i, "seed": int(s)} for m in range(len(MASKS)) for i, s in enumerate(seed_hashes(tokens, m).view(np.int64))]
            out.append({"tokens": tokens.view(np.int64).tolist(), "seeds": seeds})
        kind = pa.struct([("tokens", pa.list_(pa.int64())), ("seeds", pa.list_(pa.struct([("place", pa.int32()), ("seed", pa.int64())])))])
        return pa.array(out, kind)

    return run(text)


def _segments(text: Column, bloom: np.ndarray) -> Column:
    """Stretches of a text around seeds that pass the filter, of PIECE words and their surroundings at most.

    A window that leaks holds a hit, and lies within WINDOW words of it: so it is whole in
    the stretch of that hit.
    """

    @arrow_udf(_SEGMENTS)
    def run(texts: pa.Array) -> pa.Array:
        every = [t or "" for t in texts.to_pylist()]
        out: list[list] = [[] for _ in every]
        for base, block in _blocks(every):
            tokens, owner = word_hashes(block)
            found: dict[int, list[tuple[int, int]]] = {}
            for m in range(len(MASKS)):
                h = seed_hashes(tokens, m)
                one, two = _bloom_places(h)
                at = np.flatnonzero((bloom[one >> np.uint64(3)] >> (one & np.uint64(7)).astype(np.uint8)) & 1)
                two = two[at]
                at = at[((bloom[two >> np.uint64(3)] >> (two & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)]
                at = at[owner[at] == owner[at + SPAN - 1]]
                for i, s in zip(at.tolist(), h[at].view(np.int64).tolist()):
                    found.setdefault(int(owner[i]), []).append((i, s))
            for doc, hits in found.items():
                hits.sort()
                low, high = np.searchsorted(owner, [doc, doc + 1])
                begin = 0
                for k in range(1, len(hits) + 1):
                    if k == len(hits) or hits[k][0] - hits[k - 1][0] > SPAN + 2 * WINDOW or hits[k][0] - hits[begin][0] >= PIECE:
                        first = max(int(low), hits[begin][0] - WINDOW)
                        last = min(int(high), hits[k - 1][0] + SPAN + WINDOW)
                        out[base + doc].append({"start": first - int(low), "tokens": tokens[first:last].view(np.int64).tolist(), "hits": [{"place": i - int(low), "seed": s} for i, s in hits[begin:k]]})
                        begin = k
        hit = pa.struct([("place", pa.int32()), ("seed", pa.int64())])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("tokens", pa.list_(pa.int64())), ("hits", pa.list_(hit))])))

    return run(text)


def _filter_of(seeds: DataFrame) -> np.ndarray:
    """The seeds' Bloom filter as bytes: built by aggregation, at most BLOOM_BITS / 64 rows."""
    mask = BLOOM_BITS - 1
    one, two = F.col("seed").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("seed", 32).bitwiseAND(F.lit(mask))
    places = seeds.select(F.explode(F.array(one, two)).alias("p"))
    rows = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).collect()
    bloom = np.zeros(BLOOM_BITS // 64, np.int64)
    for r in rows:
        bloom[r.w] = r.bits
    return bloom.view(np.uint8)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """One row for each document and benchmark item whose passage it holds.

    Columns: id, item_id, place (first word of the best matching window in the
    document), agreed (agreeing words of that window), words (its length), and
    ``keep``. Items of fewer than SPAN words are too short to tell and never match;
    items between SPAN and WINDOW words must agree in all their words. Null and empty
    texts leak nothing; ids may be null; rows repeated under one id come out once for
    each item. Other columns are not read.
    """
    spark = docs.sparkSession
    batch_limits(spark)
    items = benchmark.filter(F.col(item_text_col).isNotNull()).select(F.col(item_col).alias("item_id"), _tokens_and_seeds(F.col(item_text_col)).alias("x"))
    items = checkpointed(items.select("item_id", F.monotonically_increasing_id().alias("item_no"), "x.tokens", "x.seeds"))
    seeds = items.select("item_no", F.explode("seeds").alias("s")).select("item_no", F.col("s.place").alias("item_place"), "s.seed")
    small = seeds.count() <= BROADCAST_ROWS
    held = F.broadcast if small else lambda df: df
    found = docs.select(F.col(id_col).alias("id"), *(keep or []), F.explode(_segments(F.col(text_col), _filter_of(seeds))).alias("x"))
    found = checkpointed(found.withColumn("no", F.monotonically_increasing_id()))
    hits = found.select("no", F.explode("x.hits").alias("h")).select("no", F.col("h.place").alias("place"), "h.seed")
    aligned = hits.join(held(seeds), "seed").select("no", "item_no", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    item_words = items.select("item_no", "item_id", F.col("tokens").alias("item"))
    pairs = aligned.join(found, "no").join(held(item_words), "item_no")
    # Agreement at each word of the item that lies in the stretch kept of the document.
    first = F.greatest(F.lit(0), F.col("x.start") - F.col("shift"))
    last = F.least(F.size("item"), F.col("x.start") + F.size("x.tokens") - F.col("shift")) - 1
    pairs = pairs.withColumns({"first": first, "last": last}).filter("last >= first")
    same = F.transform(F.sequence("first", "last"), lambda q: (F.get("item", q) == F.get("x.tokens", q + F.col("shift") - F.col("x.start"))).cast("int"))
    pairs = pairs.withColumn("same", same).withColumn("words", F.least(F.lit(WINDOW), F.size("item"))).filter(F.size("same") >= F.col("words"))
    sums = F.transform(F.sequence(F.lit(0), F.size("same") - F.col("words")), lambda i: F.struct(F.aggregate(F.slice("same", i + 1, F.col("words")), F.lit(0), lambda a, b: a + b).alias("agreed"), (-i).alias("at")))
    best = pairs.withColumn("best", F.array_max(sums)).filter(F.col("best.agreed") >= F.when(F.col("words") < WINDOW, F.col("words")).otherwise(AGREE))
    place = F.col("first") - F.col("best.at") + F.col("shift")
    names = [c for c in found.columns if c not in ("x", "no")]
    per_pair = best.select(*names, "item_id", place.alias("place"), F.col("best.agreed").alias("agreed"), "words")
    per_pair = per_pair.groupBy(*names, "item_id").agg(F.max(F.struct("agreed", (-F.col("place")).alias("at"), "words")).alias("b"))
    return per_pair.select(F.col("id").alias(id_col), F.col("item_id"), (-F.col("b.at")).cast("long").alias("place"), F.col("b.agreed").alias("agreed"), F.col("b.words").alias("words"), *[c for c in names if c != "id"])


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that leak no item, with all their columns.

    Null and empty texts leak nothing and stay, as do all rows without a benchmark. Rows
    equal in id and text share their fate; an empty table stays empty.
    """
    bad = leaks(docs, benchmark, id_col, text_col, keep=row_key(id_col, text_col)).select("_k1", "_k2").distinct()
    return of_rows(docs, bad, "left_anti", id_col, text_col)
