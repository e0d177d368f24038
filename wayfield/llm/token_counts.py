"""Token counts from one exact histogram of encoded lengths.

Every text is encoded once and only its length kept. The histogram (length, number
of documents) with suffix sums then answers, for every context limit at once: how
many documents reach it, how many tokens there are, how many are left after
truncation, and any quantile. Its size is the number of different lengths. A limit
that is no length joins the histogram as a length of no documents, and gets its sums
like any other; quantiles are those lengths at which the sums pass a share.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import batch_limits, checkpointed

#: Lengths summed together before suffix sums run over the sums: bounds the rows of a
#: window; a text of 2 GB, the longest there can be, makes two million strips at most.
STRIP = 1024
#: Context limits of the registered query (parameters), and the percentiles it marks.
CONTEXTS = (128, 512, 1024, 2048, 4096, 8192, 16384, 32768, 131072, 1048576)
PERCENTILES = (1, 5, 10, 25, 50, 75, 90, 95, 99, 100)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(2)
def encoding(path: str):
    """The tiktoken encoding of a rank file, once for each Python worker."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Characters of a run of blanks from which it is encoded by itself: the library's pattern overflows its stack on runs of about a million.
RUN = 50_000
_RUNS: list = []


def counted(text: str, encoding) -> int:
    """Number of tokens of a text, of any length.

    The pattern takes a run of blanks before other text but for its last character as one
    piece, and one at the end as a whole. So a long run is such a piece, and the text
    goes on with its last character.
    """
    if not _RUNS:
        import re

        # What the pattern's \s matches: the characters that Unicode calls white space (fixed values).
        _RUNS.append(re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % RUN))
    total, at = 0, 0
    for run in _RUNS[0].finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        total += len(encoding.encode_ordinary(text[at : run.start()])) + len(encoding._encode_single_piece(text[run.start() : end]))
        at = end
    return total + len(encoding.encode_ordinary(text[at:]))


def n_tokens(text: Column, path: str | None = None) -> Column:
    """Number of tokens of a whole text; 0 for null. Strings of special tokens are ordinary text."""
    path = path or default_path()

    @arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        own = encoding(path)
        return pa.array([counted(t, own) if t else 0 for t in texts.to_pylist()], pa.int64())

    return run(text)


def lengths(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """(n_tokens, n_docs): how many texts have each encoded length; null and empty texts have length 0."""
    batch_limits(docs.sparkSession)
    return docs.select(n_tokens(F.col(text_col), path).alias("n_tokens")).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def histogram(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row for each encoded length that occurs.

    Columns: n_tokens, n_docs, docs_at_least, tokens_at_least (of documents this long
    or longer) and truncated_total (tokens left when every document is cut to
    n_tokens). Null and empty texts have length 0. Repeated rows count each time. An
    empty table gives no rows. Other columns are not read.
    """
    return suffix_sums(checkpointed(lengths(docs, text_col, path)))


def report(docs: DataFrame, limits: tuple[int, ...] = CONTEXTS, percentiles: tuple[int, ...] = PERCENTILES, text_col: str = "text", path: str | None = None) -> DataFrame:
    """The histogram with a row for each limit too, and marks of the quantiles.

    Beside the histogram's columns: longer (documents longer than n_tokens), is_limit,
    and percentiles, those of which n_tokens is the smallest length that as many
    documents don't exceed. A limit that is no length has n_docs 0. An empty table gives
    the limits alone, with zeros.
    """
    spark = docs.sparkSession
    counted = checkpointed(lengths(docs, text_col, path))
    rows = at_lengths(counted, spark.createDataFrame([(int(x),) for x in sorted(set(limits))], "limit long"))
    marks = quantiles(rows, [p / 100 for p in percentiles])
    marked = marks.groupBy("n_tokens").agg(F.sort_array(F.collect_list(F.round(F.col("q") * 100).cast("int"))).alias("percentiles"))
    # As many rows as there are percentiles.
    out = rows.join(F.broadcast(marked), "n_tokens", "left").withColumn("percentiles", F.coalesce("percentiles", F.array().cast("array<int>")))
    return out.select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", "truncated_total", (F.col("docs_at_least") - F.col("n_docs")).alias("longer"), "is_limit", "percentiles")


def suffix_sums(counted: DataFrame) -> DataFrame:
    """Suffix sums of (n_tokens, n_docs).

    Strips of neighbouring lengths are summed first; only those sums, one for each
    STRIP lengths, meet in one task.
    """
    rows = counted.withColumn("strip", F.floor(F.col("n_tokens") / STRIP)).withColumn("n", F.col("n_tokens") * F.col("n_docs"))
    sums = rows.groupBy("strip").agg(F.sum("n_docs").alias("d"), F.sum("n").alias("t"), F.lit(0).alias("one"))
    later = Window.partitionBy("one").orderBy(F.desc("strip")).rowsBetween(Window.unboundedPreceding, -1)
    after = sums.select("strip", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_after") for c in "dt"])
    earlier = Window.partitionBy("one").orderBy("strip").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = sums.select("strip", F.sum("t").over(earlier).alias("total"))
    here = Window.partitionBy("strip").orderBy(F.desc("n_tokens"))
    out = rows.join(after, "strip").join(total, "strip").select(
        "n_tokens", "n_docs", "total",
        (F.sum("n_docs").over(here) + F.col("d_after")).alias("docs_at_least"),
        (F.sum("n").over(here) + F.col("t_after")).alias("tokens_at_least"),
    )
    return out.select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", (F.col("total") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"))


def at_lengths(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """Suffix sums of (n_tokens, n_docs) at its lengths and at every ``limit``, which is_limit tells."""
    both = counted.select("n_tokens", "n_docs", F.lit(False).alias("is_limit")).union(limits.select(F.col("limit").cast("long"), F.lit(0).cast("long"), F.lit(True)).distinct())
    merged = both.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"), F.bool_or("is_limit").alias("is_limit"))
    return suffix_sums(merged.select("n_tokens", "n_docs")).join(merged.select("n_tokens", "is_limit"), "n_tokens")


def at_limits(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """For each ``limit``: documents, those longer than it, and tokens in all and after truncation.

    ``rows`` is a histogram. Null limits don't count, repeated ones count once; a limit
    above all lengths truncates nothing; an empty histogram has zeros.
    """
    every = at_lengths(rows.select("n_tokens", "n_docs"), limits.filter("limit is not null").union(limits.sparkSession.createDataFrame([(0,)], "limit long")))
    # The sums at length 0 are the totals: one row.
    total = every.filter("n_tokens = 0").select(F.col("docs_at_least").alias("docs"), F.col("tokens_at_least").alias("total"))
    asked = limits.select(F.col("limit").cast("long").alias("n_tokens")).distinct()
    found = every.join(asked, "n_tokens", "left_semi").crossJoin(F.broadcast(total))
    return found.select(F.col("n_tokens").alias("limit"), "docs", (F.col("docs_at_least") - F.col("n_docs")).alias("longer"), "total", "truncated_total")


def quantiles(rows: DataFrame, shares: list[float]) -> DataFrame:
    """(q, n_tokens): for each share the smallest length that at least as many documents don't exceed; no rows for no documents.

    ``rows`` is a histogram or ``at_lengths``.
    """
    docs = rows.agg(F.max("docs_at_least").alias("docs"))  # one row
    reached = rows.filter("n_docs > 0").crossJoin(F.broadcast(docs)).withColumn("upto", F.col("docs") - F.col("docs_at_least") + F.col("n_docs"))
    least = reached.agg(*[F.min(F.when(F.col("upto") >= F.ceil(F.lit(q * (1 - 1e-12)) * F.col("docs")), F.col("n_tokens"))).alias(f"q{i}") for i, q in enumerate(shares)])
    pairs = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), F.col(f"q{i}").alias("n_tokens")) for i, q in enumerate(shares)]))
    return least.select(pairs.alias("x")).select("x.*").filter("n_tokens is not null")


def quantile(rows: DataFrame, q: float) -> int | None:
    """The smallest length that at least a share ``q`` of the documents don't exceed; None without documents."""
    found = quantiles(rows, [q]).first()
    return found.n_tokens if found else None
