"""Lines that many documents share, dropped by probing minimal perfect hash arrays.

Every line of at least ``LEAST`` characters has a key, hashed to 128 bits. Keys found in
two documents or more are dealt to shards; a shard is one row of compact arrays: the
levels of a minimal perfect hash, then a fingerprint, a count and the largest id for
each key, at the place the hash gives it. No line and no key is kept.

Documents never meet lines. They send (shard, hash, place of the line) to the shards,
where a task streams through its shards one by one, each with its arrays first and its
probes after them. What comes back to a document is the list of its lines to drop.

Keys with more than 1/HOT of all probes are at most HOT, whatever the input. They make a
shard of their own that goes along with the task that sends probes, so a line in a
third of the documents sends none. All other shards are even, as they are dealt by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import batch_limits, row_key, stored

#: A key's least number of characters and of documents from which its lines are dropped.
LEAST, DOCUMENTS = 20, 3
#: Shards at least, keys of a shard on average at most, and the share of all probes that makes a key hot (parameters).
SHARDS, SHARD_KEYS, HOT = 1024, 1 << 15, 4096
#: Bits of a level for each key that is still to be placed.
GAMMA = 2
BLANKS = b" \t\n\x0b\x0c\r"
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD))
#: A shard's arrays.
ARRAYS = "levels binary, bits binary, fingerprints binary, counts binary, lasts binary"


def key_of(line: bytes, least: int = LEAST) -> bytes | None:
    """A line's key in UTF-8, without blanks at its ends and in lower case (ASCII); None if it is too short to count."""
    key = line.strip(BLANKS).lower()
    return key if len(key) >= least and len(key.decode("utf-8", "replace")) >= least else None


def _level(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h1 + np.uint64(level + 1) * _ODD[0]) ^ ((h2 ^ (h2 >> np.uint64(31))) * _ODD[1])
        h = (h ^ (h >> np.uint64(33))) * _ODD[2]
        return h ^ (h >> np.uint64(29))


class Shard:
    """A minimal perfect hash with the arrays at its places.

    Each level has bits for the keys that are still to be placed; a key that is alone at its
    bit keeps it, the others go on. A key's place is the number of bits set before its own.
    """

    def __init__(self, levels: np.ndarray, bits: np.ndarray, fingerprints: np.ndarray, counts: np.ndarray, lasts: np.ndarray):
        self.levels, self.bits, self.fingerprints, self.counts, self.lasts = levels, bits, fingerprints, counts, lasts
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)))

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, lasts: np.ndarray) -> Shard:
        """Of distinct pairs (h1, h2)."""
        rest, sizes, bits = np.arange(len(h1)), [], []
        while len(rest):
            if len(sizes) > 200:
                raise ValueError("the pairs of hashes are not distinct")
            size = -(-len(rest) * GAMMA // 64) * 64
            at = (_level(h1[rest], h2[rest], len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            rest = rest[~alone[at]]
        made = cls(np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, np.uint64), h2, counts, lasts)
        order = np.empty(len(h1), np.int64)
        order[made.places(h1, h2)] = np.arange(len(h1))
        made.fingerprints, made.counts, made.lasts = h2[order], counts[order], lasts[order]
        return made

    def places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The place of each key; that of a pair that isn't one is -1 or any."""
        out, rest, start = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
        for level, size in enumerate(self.levels.tolist()):
            at = start + (_level(h1[rest], h2[rest], level) % np.uint64(size)).astype(np.int64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            met = ((self.bits[word] >> bit) & np.uint64(1)).astype(bool)
            below = self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[rest[met]] = (self.before[word] + np.bitwise_count(below))[met]
            rest, start = rest[~met], start + size
        return out

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and largest id of each key, 0 and 0 where the fingerprint is another's."""
        at = self.places(h1, h2)
        known = at >= 0
        known[known] = self.fingerprints[at[known]] == h2[known]
        counts, lasts = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        counts[known], lasts[known] = self.counts[at[known]], self.lasts[at[known]]
        return counts, lasts

    def row(self) -> list[bytes]:
        return [a.tobytes() for a in (self.levels, self.bits, self.fingerprints, self.counts, self.lasts)]

    @classmethod
    def of_row(cls, row: list[bytes]) -> Shard:
        return cls(*[np.frombuffer(b, k) for b, k in zip(row, (np.int64, np.uint64, np.uint64, np.int64, np.int64))])


def _line_keys(text) -> "F.Column":
    """array<struct<line, h1, h2>> of a text in bytes: its different keys, each with its first line."""
    kind = pa.list_(pa.struct([("line", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())]))

    @arrow_udf("array<struct<line: int, h1: bigint, h2: bigint>>")
    def run(texts: pa.Array) -> pa.Array:
        import xxhash

        lines, hashes, ends = [], [], [0]
        for value in texts:
            own: dict[bytes, int] = {}
            for i, line in enumerate((value.as_py() or b"").split(b"\n")):
                if len(line) >= LEAST and (key := key_of(line)):
                    own.setdefault(xxhash.xxh3_128_digest(key), i)
            lines += own.values()
            hashes += own
            ends.append(len(lines))
        pairs = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
        of = pa.StructArray.from_arrays([pa.array(lines, pa.int32()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], fields=list(kind.value_type))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), of, type=kind)

    return run(text)


def _build(group: pa.Table) -> pa.Table:
    """A shard's row of its keys."""
    h1, h2, counts, lasts = (group[c].to_numpy() for c in ("h1", "h2", "n", "last"))
    row = Shard.build(h1.view(np.uint64), h2.view(np.uint64), counts, lasts).row()
    return pa.table({"shard": pa.array([group["shard"][0].as_py()], pa.int32())} | {c.split()[0]: pa.array([b], pa.binary()) for c, b in zip(ARRAYS.split(", "), row)})


def index(keys: DataFrame, shards: int) -> DataFrame:
    """(shard, arrays) of distinct keys (h1, h2, n, last); a shard has about as many keys as the others."""
    dealt = keys.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(_build, f"shard int, {ARRAYS}")


def _lost(counts: np.ndarray, lasts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return (counts >= DOCUMENTS) & (lasts != ids)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_lines, n_dropped) of every row: its text without lines that the document with the largest id keeps.

    A key's lines go if DOCUMENTS rows or more have it, except in those of the largest
    id, where all of them stay. Ids are whole numbers; null ids count below all others. Each
    repeated row counts as a document. A null or empty text has one empty line and
    stays empty. An empty table gives an empty result. Other columns aren't read.
    """
    spark = docs.sparkSession
    batch_limits(spark)
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    sent = docs.select(*row_key(id_col, text_col), own.alias("id"), _line_keys(F.col(text_col).cast("binary")).alias("keys")).filter(F.size("keys") > 0)
    sent = stored(sent, "line-keys")
    keys = sent.select("id", F.explode("keys").alias("k")).groupBy("k.h1", "k.h2").agg(F.count("*").alias("n"), F.max("id").alias("last"))
    keys = stored(keys.filter("n > 1"), "repeated-lines")
    probes = sent.agg(F.sum(F.size("keys"))).first()[0] or 0
    # At most HOT rows.
    hot = keys.filter(F.col("n") > probes // HOT).toArrow()
    shards = max(SHARDS, -(-keys.count() // SHARD_KEYS))
    hot_row = Shard.build(*(hot[c].to_numpy().view(np.uint64) for c in ("h1", "h2")), *(hot[c].to_numpy() for c in ("n", "last"))).row()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Probes of other shards than the hot one, and the lines that this one decides, which are ``known``."""
        own = Shard.of_row(hot_row)
        for b in batches:
            flat = b["keys"].flatten()
            of = np.repeat(np.arange(b.num_rows), b["keys"].value_lengths().to_numpy())
            line, h1, h2 = (flat.field(i).to_numpy() for i in range(3))
            counts, lasts = own.probe(h1.view(np.uint64), h2.view(np.uint64))
            lost = _lost(counts, lasts, b["id"].to_numpy()[of])
            goes = lost | (counts == 0)
            rows = pa.array(of[goes])
            k1 = b["_k1"].take(rows)
            # Lines that are decided pass through, spread by their documents.
            shard = np.where(lost[goes], k1.to_numpy(), h1[goes]) % shards
            yield pa.record_batch([pa.array(shard.astype(np.int32)), k1, b["_k2"].take(rows), b["id"].take(rows), pa.array(line[goes]), pa.array(h1[goes]), pa.array(h2[goes]), pa.array(lost[goes])], ["shard", "_k1", "_k2", "id", "line", "h1", "h2", "known"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by shard, each shard's arrays before its probes."""
        arrays, at = None, None
        for b in batches:
            shard = b["shard"].to_numpy()
            is_index = b["bits"].is_valid().to_numpy(zero_copy_only=False)
            lost = b["known"].fill_null(False).to_numpy(zero_copy_only=False).copy()
            h1, h2, ids = (b[c].fill_null(0).to_numpy() for c in ("h1", "h2", "id"))
            cuts = np.flatnonzero(np.concatenate(([True], (shard[1:] != shard[:-1]) | is_index[1:] | is_index[:-1])))
            for low, high in zip(cuts, np.append(cuts[1:], b.num_rows)):
                if is_index[low]:
                    at, arrays = shard[low], Shard.of_row([b[c.split()[0]][int(low)].as_py() for c in ARRAYS.split(", ")])
                elif at == shard[low]:
                    part = slice(low, high)
                    lost[part] |= _lost(*arrays.probe(h1[part].view(np.uint64), h2[part].view(np.uint64)), ids[part])
            yield pa.RecordBatch.from_arrays([b[c].filter(pa.array(lost)) for c in ("_k1", "_k2", "line")], ["_k1", "_k2", "line"])

    asked = sent.mapInArrow(send, "shard int, _k1 long, _k2 int, id long, line int, h1 long, h2 long, known boolean")
    both = index(keys, shards).unionByName(asked, allowMissingColumns=True)
    dealt = both.repartition("shard").sortWithinPartitions("shard", F.col("bits").isNull())
    drops = dealt.mapInArrow(meet, "_k1 long, _k2 int, line int").groupBy("_k1", "_k2").agg(F.collect_set("line").alias("drops"))
    rows = docs.select(F.col(id_col), F.col(text_col), *row_key(id_col, text_col)).join(drops, ["_k1", "_k2"], "left")
    left = _without(F.col(text_col).cast("binary"), F.col("drops"))
    return rows.select(F.col(id_col), left.alias("x")).select(id_col, F.col("x.text").alias(text_col), "x.n_lines", "x.n_dropped")


def _without(text, drops):
    """struct<text, n_lines, n_dropped>: a text without the lines whose keys are those of the lines in ``drops``."""

    @arrow_udf("text string, n_lines bigint, n_dropped bigint")
    def run(texts: pa.Array, drops: pa.Array) -> pa.Array:
        out: list[tuple[bytes, int, int]] = []
        for value, drop in zip(texts, drops):
            whole, drop = value.as_py() or b"", drop.as_py()
            lines = whole.split(b"\n")
            if not drop:
                out.append((whole, len(lines), 0))
                continue
            gone = {key_of(lines[i]) for i in drop}
            kept = [line for line in lines if len(line) < LEAST or key_of(line) not in gone]
            out.append((b"\n".join(kept), len(lines), len(lines) - len(kept)))
        text, n, dropped = zip(*out) if out else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(text, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], ["text", "n_lines", "n_dropped"])

    return run(text, drops)
