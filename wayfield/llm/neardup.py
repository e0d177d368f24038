"""Near duplicates by the overlap of their five-word shingles, SimHash first.

Texts whose sets of shingles have a Jaccard similarity of SIMILAR or more are linked.
Ball hashing of the sets' SimHashes (``simhash.links``) finds candidates within two
bits. At a similarity of 0.8 fingerprints differ in about ten bits, and a ball that wide
can't be enumerated; so min-hashes in BANDS bands of ROWS find candidates too: a pair at
0.8 shares no bucket with a chance of 7e-5, a closer one with less. Texts with equal sets
are folded into one before anything else.

All members of a bucket are candidates of one another, whatever its size, but few pairs
have to be looked at. In each of STARS rounds a bucket's members are compared with one of
them; what links is one group from then on, and a bucket whose members are all in one
group is settled. In the buckets that are left the members of other groups than the
largest are compared with all that are not in their group. So a large group of near
copies costs a few comparisons a text, and no link of a bucket is lost.

Texts are compared in cells of about CELL texts or CELL_SIZE shingles, dealt by hash, so
no bucket meets in one task and no pair carries its texts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import batch_limits, checkpointed, of_rows, row_key, spread_join
from .simhash import components, links, majority

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 24, 5
#: Rounds in which a bucket's members meet one of them.
STARS = 2
#: Texts and shingles that are compared in one piece, on the average.
CELL, CELL_SIZE = 64, 1 << 17
#: Parts into which the members of a group are dealt where they look for their root.
SALTS = 32


def shingles_of(text: str | None, shingle: int = SHINGLE):
    """Sorted distinct hashes of a text's shingles; a text of fewer words is one shingle, one without words none."""
    import numpy as np
    import xxhash

    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(tokens[i:] for i in range(shingle)))) if len(tokens) >= shingle else [b" ".join(tokens)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(g, 42) for g in grams), np.uint64))


def _factors():
    import numpy as np

    draw = np.random.default_rng(5).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def bands_of(hashes) -> list[int]:
    """One signed hash a band; none for a text without words."""
    import numpy as np
    import xxhash

    if not len(hashes):
        return []
    times, plus = _factors()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):  # bounds the products
        least = np.minimum(least, (hashes[at : at + 1024, None] * times + plus).min(axis=0))
    return [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) - (1 << 63) for k in range(BANDS)]


def signature(text: Column) -> Column:
    """struct<key: of the set of shingles, fp: its SimHash, size, bands>."""

    @arrow_udf("key long, fp long, size long, bands array<long>")
    def run(texts: pa.Array) -> pa.Array:
        import xxhash

        keys, prints, sizes, bands = [], [], [], []
        for t in texts.to_pylist():
            found = shingles_of(t)
            keys.append(xxhash.xxh64_intdigest(found.tobytes(), 7) - (1 << 63))
            prints.append(majority(found))
            sizes.append(len(found))
            bands.append(bands_of(found))
        longs = [pa.array(c, pa.int64()) for c in (keys, prints, sizes)]
        return pa.StructArray.from_arrays([*longs, pa.array(bands, pa.list_(pa.int64()))], ["key", "fp", "size", "bands"])

    return run(text)


def similar(sets: list, groups: list[int]) -> set[tuple[int, int]]:
    """Pairs (a, b), a < b, that connect the groups as sets with a Jaccard similarity of SIMILAR or more do: the least of each connected lot with every other."""
    import numpy as np

    if len(sets) < 2:
        return set()
    sizes = np.array([len(s) for s in sets])
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    column = np.cumsum(np.concatenate(([False], values[1:] != values[:-1]))[: len(values)])
    shared = np.bincount(column)[column] > 1 if len(column) else np.zeros(0, bool)
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    both = np.zeros((len(sets), len(sets)))
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):  # bounds the table of holders
        low, high = np.searchsorted(column, [at, at + width])
        holds = np.zeros((len(sets), width), np.float32)
        holds[owner[low:high], column[low:high] - at] = 1
        both += holds @ holds.T
    linked = (both >= SIMILAR * (sizes[:, None] + sizes[None, :] - both)) & (both > 0)
    least = {g: g for g in groups}

    def find(g):
        while least[g] != g:
            least[g] = least[least[g]]
            g = least[g]
        return g

    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(linked, 1)))):
        one, two = find(groups[i]), find(groups[j])
        least[max(one, two)] = min(one, two)
    return {(find(g), g) for g in least if find(g) != g}


def compared(cells: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (a, b) between roots of texts of a cell that are similar; takes ``cell``, ``key`` and ``root``, and texts by ``key``."""

    def run(batches):
        cell, sets, roots = None, [], []
        for batch in batches:
            found = set()
            for c, r, t in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if c != cell:
                    found |= similar(sets, roots)
                    cell, sets, roots = c, [], []
                sets.append(shingles_of(t))
                roots.append(r)
            yield edges(found)
        yield edges(similar(sets, roots))

    def edges(found):
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    rows = cells.join(texts, "key").select("cell", "root", "text")
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long").distinct()


def _parts(n: Column, size: Column) -> Column:
    """Parts to deal ``n`` texts of ``size`` shingles to."""
    return F.ceil(F.greatest(n / CELL, size / CELL_SIZE, F.lit(1))).cast("long")


def _dealt(parts: Column) -> Column:
    return F.pmod(F.xxhash64("key"), parts)


def led(members: DataFrame, salt: int) -> DataFrame:
    """``members`` (bucket, key, root, size) of buckets of more than one, with their number ``n`` and one of them, ``l``: that with the least hash, so buckets of the same texts have the same one."""
    drawn = F.min(F.struct(F.xxhash64("key", F.lit(salt)).alias("h"), "key", "root"))
    return members.join(members.groupBy("bucket").agg(F.count("*").alias("n"), drawn.alias("l")).filter("n > 1"), "bucket")


def star_cells(met: DataFrame) -> DataFrame:
    """(cell, key, root): members with their leader, in pieces; takes ``key``, ``root``, ``size``, and the leader as ``lead`` and ``lead_root``."""
    pairs = checkpointed(met.filter("root <> lead_root").select("lead", "lead_root", "key", "root", "size").distinct())
    leads = pairs.groupBy("lead", "lead_root").agg(_parts(F.count("*"), F.sum("size")).alias("parts"))
    wide = leads.filter("parts > 1").select("lead", "parts")
    one = F.lit(0).cast("long")
    members = pairs.join(wide, "lead", "left").withColumn("part", _dealt(F.coalesce("parts", F.lit(1).cast("long"))))
    heads = leads.withColumn("part", F.explode(F.sequence(one, F.col("parts") - 1)))
    cell = F.xxhash64("lead", "part").alias("cell")
    return members.select(cell, "key", "root").union(heads.select(cell, "lead", "lead_root"))


def block_cells(live: DataFrame) -> DataFrame:
    """(cell, key, root) so that any two members of a bucket with different roots share a cell; takes ``bucket``, ``key``, ``root`` and ``size``.

    Parts of a bucket's largest group meet those of the rest, and these one another;
    the largest group's own members need not meet.
    """
    by_root = live.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("size").alias("w"))
    most = by_root.groupBy("bucket").agg(F.max(F.struct("n", "root", "w")).alias("m"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    sides = most.select("bucket", F.col("m.root").alias("main"), _parts(F.col("m.n"), F.col("m.w")).alias("mains"), _parts(F.col("n") - F.col("m.n"), F.col("w") - F.col("m.w")).alias("rests"))
    is_main = F.col("root") == F.col("main")
    placed = live.join(sides, "bucket").withColumn("part", _dealt(F.when(is_main, F.col("mains")).otherwise(F.col("rests"))))
    to = lambda name: F.sequence(F.lit(0).cast("long"), F.col(name) - 1)
    part = F.col("part")
    of_main = F.transform(to("rests"), lambda j: F.xxhash64("bucket", F.lit("main"), part, j))
    of_rest = F.transform(to("mains"), lambda i: F.xxhash64("bucket", F.lit("main"), i, part))
    others = F.transform(F.filter(to("rests"), lambda j: j != part), lambda j: F.xxhash64("bucket", F.lit("rest"), F.least(part, j), F.greatest(part, j)))
    return placed.select(F.explode(F.when(is_main, of_main).otherwise(F.concat(of_rest, others))).alias("cell"), "key", "root")


def merged(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``roots`` (key, root) after roots that share an edge have become one."""
    up = components(edges).select(F.col("node").alias("root"), F.col("root").alias("up"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = roots.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    return checkpointed(salted.join(up, ["root", "salt"], "left").select("key", F.coalesce("up", "root").alias("root")))


def unsettled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` (bucket, key, size) of buckets with more than one root, with their roots."""
    known = members.join(roots, "key")
    several = known.groupBy("bucket").agg((F.min("root") != F.max("root")).alias("s")).filter("s").select("bucket")
    return checkpointed(known.join(several, "bucket", "left_semi").select("bucket", "key", "root", "size"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_k1, _k2, id, root) of every row: its row key, id, and the group of near duplicates it is in.

    Null and empty texts and those without words are one group. Rows with a null id take
    part; repeated rows each get a row. Other columns aren't read; an empty table gives
    an empty result.
    """
    batch_limits(docs.sparkSession)
    k1, k2 = row_key(id_col, text_col)
    marked = checkpointed(docs.select(F.col(id_col).alias("id"), k1, k2, signature(F.col(text_col)).alias("s")).select("id", "_k1", "_k2", "s.key", "s.fp", "s.size", "s.bands"))
    first = F.min(F.struct("_k1", "_k2")).alias("k")
    distinct = checkpointed(marked.groupBy("key").agg(F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.count("*").alias("n"), first))
    # Equal fingerprints share a bucket as well; linked ones meet through their least keys.
    buckets = F.concat("bands", F.array(F.xxhash64(F.lit("fp"), "fp")))
    members = distinct.select(F.explode(buckets).alias("bucket"), "key", F.col("key").alias("root"), "size")
    met = checkpointed(led(members, 0))
    least = checkpointed(distinct.groupBy("fp").agg(F.min("key").alias("key"), F.min_by("size", "key").alias("size")))
    near = links(least.select("fp")).join(least.withColumnRenamed("fp", "a"), "a").join(least.select(F.col("fp").alias("b"), F.col("key").alias("lead")), "b")
    led_by = lambda df: df.select("key", "root", "size", F.col("l.key").alias("lead"), F.col("l.root").alias("lead_root"))
    pairs = led_by(met).union(near.select("key", "key", "size", "lead", "lead"))
    cells = checkpointed(star_cells(pairs))
    # One text of each key that has a candidate.
    one = distinct.join(cells.select("key").distinct(), "key", "left_semi").select("key", "k._k1", "k._k2")
    texts = checkpointed(docs.select(k1, k2, F.col(text_col).alias("text")).join(one, ["_k1", "_k2"]).dropDuplicates(["key"]).select("key", "text"))
    roots = merged(one.select("key", F.col("key").alias("root")), compared(cells, texts))
    # In buckets of two all has been said.
    live = unsettled(met.filter("n > 2").select("bucket", "key", "size"), roots)
    for salt in range(1, STARS):
        roots = merged(roots, compared(star_cells(led_by(led(live, salt))), texts))
        live = unsettled(live.drop("root"), roots)
    roots = merged(roots, compared(block_cells(live), texts))
    known = checkpointed(distinct.select("key", "n").join(roots, "key", "left").select("key", "n", F.coalesce("root", "key").alias("root")))
    return spread_join(marked, known, "key").select("_k1", "_k2", "id", "root")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every group of near duplicates, with all columns of ``docs``.

    The row with the smallest id stays (null ids last, then by text hash); of equal
    rows one stays.
    """
    first = F.min(F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("i"), "_k1", "_k2"))
    stays = groups(docs, id_col, text_col).groupBy("root").agg(first.alias("s")).select("s._k1", "s._k2")
    return of_rows(docs, stays, "left_semi", id_col, text_col, once=True)
