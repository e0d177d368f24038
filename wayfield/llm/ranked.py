"""The best documents for each of many queries, by a hybrid of term- and document-at-a-time search.

Scores are sums of integer contributions of terms (see ``best``), so results are exact
and don't depend on how documents are dealt.

Documents are split among tasks, terms are not: a task reads forward rows (the query
terms of a document and how often each occurs), turns some millions of postings at a
time into lists by term, and answers all queries on them. Every task keeps the best of
each query, which bounds the work on its later lists; only these few leave it.

For a query the short lists are summed first, into accumulators sorted by document. These
are then one more iterator, bounded by their largest sum, beside the long lists, each
bounded by its largest contribution. Iterators whose bounds together stay under the
query's threshold can't bring in a document by themselves: documents come from the
others, in order, and the long lists are skipped to those that can still pass.

Queries are taken in blocks of a bounded number of bytes, so their terms fit in a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_limits, stored

TOP = 10
#: Bytes of queries answered in one pass over the documents (a parameter), and postings turned into lists at once.
QUERY_BYTES, POSTINGS = 4 << 20, 1 << 21
#: Lists of at most this share of a block's documents are short.
SHORT = 1 / 32
#: ASCII letters and digits make terms, as does all beyond ASCII; A-Z are lowered, the rest separates.
TERMS = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
FORWARD = "id long, n long, terms array<int>, tfs array<int>"


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8, in order."""
    return text.translate(TERMS).split() if text else []


def forward(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """FORWARD rows of (id, text): n terms of a document in all, and which of ``vocabulary`` it holds, how often. Documents without terms have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for b in batches:
            ids, ns, terms, tfs, ends = [], [], [], [], [0]
            for i, text in zip(b["id"].to_pylist(), b["text"]):
                found = terms_of(text.as_py())
                if found:
                    own, tf = np.unique(np.fromiter((k for k in map(number, found) if k is not None), np.int32), return_counts=True)
                    ids.append(i)
                    ns.append(len(found))
                    terms.append(own)
                    tfs.append(tf.astype(np.int32))
                    ends.append(ends[-1] + len(own))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x) if x else np.zeros(0, np.int32))) for x in (terms, tfs)]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), *lists], ["id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, FORWARD)


class Lists:
    """Postings of a block by term: document numbers in rising order, contributions without weights, and the largest."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, of: np.ndarray, terms: np.ndarray, tfs: np.ndarray, n_docs: int, total: int, vocabulary: int):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        number = np.empty(len(ids), np.int64)
        number[order] = np.arange(len(ids))
        # Python's whole numbers where 64 bits could be passed.
        m = 25 + (75 * n * n_docs // total if 75 * int(n.max()) * n_docs < 1 << 63 else np.array([75 * int(x) * n_docs // total for x in n], np.int64))
        value = 1_000_000_000 * tfs.astype(np.int64) // (1000 * tfs.astype(np.int64) + 8 * m[of])
        by_term = np.lexsort((number[of], terms))
        self.docs, self.values = number[of][by_term], value[by_term]
        self.starts = np.searchsorted(terms[by_term], np.arange(vocabulary + 1))
        lengths = np.diff(self.starts)
        self.most = np.zeros(vocabulary, np.int64)
        held = np.flatnonzero(lengths)
        if len(held):
            self.most[held] = np.maximum.reduceat(self.values, self.starts[held])
        self.short = max(1, int(len(ids) * SHORT))

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.starts[term], self.starts[term + 1])
        return self.docs[part], self.values[part]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Documents of all parts in order, with the sums of their scores."""
    docs, at = np.unique(np.concatenate([d for d, _ in parts]), return_inverse=True)
    sums = np.zeros(len(docs), np.int64)
    np.add.at(sums, at, np.concatenate([s for _, s in parts]))
    return docs, sums


def search(lists: Lists, query: list[tuple[int, int]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents whose score is ``least`` or more, with their scores; ``query`` has terms with their weights.

    ``least`` is 1 at least: documents with a score of 0 never come out.
    """
    present = [(t, w) for t, w in query if w and lists.starts[t + 1] > lists.starts[t]]
    size = lambda t: lists.starts[t + 1] - lists.starts[t]
    iterators: list[tuple[int, np.ndarray, np.ndarray]] = []  # bound, documents, scores
    short = [(d, v * w) for t, w in present if size(t) <= lists.short for d, v in [lists.of(t)]]
    if short:
        docs, sums = _summed(short)
        iterators.append((int(sums.max()), docs, sums))
    long = {t: w for t, w in present if size(t) > lists.short}
    iterators += [(int(lists.most[t]) * w, *lists.of(t)) for t, w in long.items()]
    weights = [1] * bool(short) + list(long.values())
    order = sorted(range(len(iterators)), key=lambda i: iterators[i][0])
    room = np.cumsum([iterators[i][0] for i in order])
    optional = int(np.searchsorted(room, least))  # iterators that together stay under the threshold
    if optional == len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    docs, sums = _summed([(iterators[i][1], iterators[i][2] * weights[i]) for i in order[optional:]])
    for k in range(optional - 1, -1, -1):
        can = sums + room[k] >= least
        docs, sums = docs[can], sums[can]
        if not len(docs):
            break
        _, there, scores = iterators[order[k]]
        at = np.minimum(np.searchsorted(there, docs), len(there) - 1)  # skips to each document
        met = there[at] == docs
        sums[met] += scores[at[met]] * weights[order[k]]
    passes = sums >= least
    return docs[passes], sums[passes]


def _answered(rows: DataFrame, queries: list[list[tuple[int, int]]], n_docs: int, total: int, vocabulary: int, top: int) -> DataFrame:
    """(query, id, score): the best of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def answer(held: list[pa.RecordBatch]) -> None:
            block = pa.Table.from_batches(held).combine_chunks()
            # Null ids come last among equal scores.
            ids = block["id"].combine_chunks().fill_null(np.iinfo(np.int64).max).to_numpy()
            terms, tfs = block["terms"].combine_chunks(), block["tfs"].combine_chunks()
            of = np.repeat(np.arange(len(ids)), terms.value_lengths().to_numpy())
            lists = Lists(ids, block["n"].to_numpy(), of, terms.flatten().to_numpy(), tfs.flatten().to_numpy(), n_docs, total, vocabulary)
            for q, query in enumerate(queries):
                known_ids, known = best.get(q, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                least = max(1, int(known[-1])) if len(known) == top else 1
                docs, scores = search(lists, query, least)
                if len(docs):
                    every, sums = np.concatenate((known_ids, lists.ids[docs])), np.concatenate((known, scores))
                    first = np.lexsort((every, -sums))[:top]
                    best[q] = every[first], sums[first]

        held, postings = [], 0
        for b in batches:
            held.append(b)
            postings += len(b["terms"].flatten()) + b.num_rows
            if postings >= POSTINGS:
                answer(held)
                held, postings = [], 0
        if any(b.num_rows for b in held):
            answer(held)
        for q, (ids, scores) in best.items():
            given = pa.array(ids, mask=ids == np.iinfo(np.int64).max)
            yield pa.record_batch([pa.array([q] * len(ids), pa.int32()), given, pa.array(scores)], ["query", "id", "score"])

    return rows.mapInArrow(run, "query int, id long, score long")


def best(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item, rank, id, score): the ``top`` documents of each row of ``items``, by score, then by id.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))) over the N documents with terms;
    it gives a document with n terms weight times (10^9 tf) div (1000 tf + 8 m), where
    m = 25 + (75 n N) div L and L is the number of all terms; repeated terms of a query count each time. Documents
    without a score don't come out, so an item has fewer than ``top`` rows if fewer share
    a term. Null and empty texts have no terms. Ids are whole numbers, null ids come last
    among equal scores; repeated rows are documents of their own. Each row of ``items``
    gets its own ranks, also where item ids are repeated or null. Without documents or
    items the result is empty. Other columns are not read.
    """
    spark = docs.sparkSession
    batch_limits(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    asked = stored(items.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("binary").alias("text")), "items")
    blocks = -(-(asked.agg(F.sum(F.length("text"))).first()[0] or 0) // QUERY_BYTES)
    out = None
    for k in range(blocks):
        # A block's texts are QUERY_BYTES on average.
        rows = asked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).toArrow()
        found = [terms_of(t.as_py()) for t in rows["text"]]
        vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for own in found for t in own))}
        if not vocabulary:
            continue
        postings = stored(forward(texts, vocabulary), "forward")
        n_docs, total = postings.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        # A row for each term of the block's queries.
        held = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, df in zip(held["term"].to_pylist(), held["df"].to_pylist())}
        queries = []
        for own in found:
            numbers, times = np.unique([vocabulary[t] for t in own], return_counts=True) if own else ((), ())
            queries.append([(int(t), weight[int(t)] * int(r)) for t, r in zip(numbers, times) if int(t) in weight])
        scored = _answered(postings, queries, n_docs, total, len(vocabulary), top)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        names = spark.createDataFrame(pa.table({"query": pa.array(range(rows.num_rows), pa.int32()), "item": rows["item"]}))
        # One row for each query of the block.
        met = ranked.join(F.broadcast(names), "query").select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
        out = out.unionAll(met) if out else met
    if out is None:
        return asked.filter("false").select(F.col("item").alias(item_col), F.lit(0).alias("rank"), F.lit(0).cast("long").alias(id_col), F.lit(0).cast("long").alias("score"))
    return out
