"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

A fingerprint is the bitwise majority of the hashes of a text's 3-word shingles.
Two fingerprints at most 2 bits apart have a common neighbour at most 1 bit from
each, so every distinct fingerprint sends itself and its 64 one-bit variants
through one shuffle. Those that meet under a variant are within the radius of one
another, at most 65 of them since they are distinct, and each is linked with the
smallest: that keeps the groups connected without listing pairs.

Rows with equal fingerprints are folded into one before anything else, so that a
text repeated in a third of the corpus costs one fingerprint.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import batch_limits, checkpointed, of_rows, row_key, spread_join

RADIUS = 2
#: Parts into which the members of a group are dealt where they look for their root.
SALTS = 32


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit fingerprint of one text; 0 for a text without words."""
    import numpy as np
    import xxhash

    # bytes.lower() and bytes.split() know ASCII only: A-Z and \x20 \x09-\x0D.
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return 0
    if len(tokens) < shingle:
        grams = [b" ".join(tokens)]
    else:
        grams = list(map(b" ".join, zip(*(tokens[i:] for i in range(shingle)))))
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(g, 42) for g in grams), np.uint64, len(grams)))


def majority(hashes) -> int:
    """The signed 64-bit number with each bit that is set in over half the hashes; 0 for none."""
    import numpy as np

    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):  # bounds the unpacked bits
        block = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += block.sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprint(text: Column) -> Column:
    """64-bit SimHash of a text column as a long."""

    @arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(t) for t in texts.to_pylist()], pa.int64())

    return run(text)


def links(fingerprints: DataFrame) -> DataFrame:
    """Edges (a, b) that connect distinct ``fp`` values at most RADIUS bits apart.

    Takes one column ``fp`` of distinct longs. Meeting under one variant implies the
    distance; it is verified all the same before an edge leaves.
    """
    flips = F.array(F.lit(0).cast("long"), *(F.shiftleft(F.lit(1).cast("long"), i) for i in range(64)))
    sent = fingerprints.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    met = sent.withColumn("low", F.min("fp").over(Window.partitionBy("variant")))
    return (
        met.filter("fp <> low")
        .filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("low"))) <= RADIUS)
        .select(F.col("fp").alias("a"), F.col("low").alias("b"))
        .distinct()
    )


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node of its component.

    Each round takes the smallest root among a node's neighbours, then follows
    roots one step further (pointer jumping), so long chains shrink quickly. Every
    round is checkpointed in the shared folder. Counts travel to the driver, never nodes.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
    for _ in range(rounds):
        roots = state.select(F.col("node").alias("b"), F.col("root").alias("near"))
        best = both.join(roots, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        stepped = state.join(best, "node").select("node", "root", F.least("root", "near").alias("next"))
        # Members of a large group share one root: they are spread over SALTS, and each node that is a root is copied as often.
        above = stepped.select(F.col("node").alias("next"), F.col("next").alias("up")).join(stepped.select("next").distinct(), "next", "left_semi")
        above = above.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        spread = stepped.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        up = F.coalesce(F.least("next", "up"), F.col("next"))
        jumped = spread.join(above, ["next", "salt"], "left").select("node", up.alias("root"), (up != F.col("root")).alias("moved"))
        jumped = checkpointed(jumped)
        moved = jumped.filter("moved").limit(1).count()
        state = jumped.select("node", "root")
        if not moved:
            return state
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """Near-duplicate group of every row: id, fingerprint (16 hex digits), component_id, and ``keep``.

    component_id is the smallest id in the group. A null text has fingerprint zero
    and is linked like any other. Rows with a null id take part; a group of such
    rows only has component_id null. Repeated ids and rows each get a row. Other
    columns of ``docs`` are not read. An empty table gives an empty result.
    """
    batch_limits(docs.sparkSession)
    marked = checkpointed(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col)).alias("fp"), *(keep or [])))
    distinct = checkpointed(marked.groupBy("fp").agg(F.min("id").alias("least_id"), F.count("*").alias("n")))
    joined = components(links(distinct.select("fp")))
    # Fingerprints without a partner are their own group.
    rooted = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"), F.col("n").alias("rows"))
    rooted = checkpointed(rooted)
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n"))
    of_fp = checkpointed(spread_join(rooted, checkpointed(named), "root").select("fp", "root", "component_id", F.col("rows").alias("n")))
    return spread_join(marked, of_fp, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "root",
        *[c for c in marked.columns if c not in ("id", "fp")],
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every near-duplicate group, with all columns of ``docs``.

    The row with the smallest id stays (null ids last, then by text hash); of equal
    rows one stays.
    """
    k1, k2 = row_key(id_col, text_col)
    marked = groups(docs, id_col, text_col, keep=[k1, k2])
    first = F.min(F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col("_k1"), F.col("_k2")))
    stays = marked.groupBy("root").agg(first.alias("s")).select("s._k1", "s._k2")
    return of_rows(docs, stays, "left_semi", id_col, text_col, once=True)
