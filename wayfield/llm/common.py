"""Small helpers that the text operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import free_name
from ..functions.shared import checkpointed, shared_dir

__all__ = ["BLANKS", "batch_limits", "checkpointed", "free_name", "of_rows", "row_key", "set_aside", "shared_dir", "spread_join", "stored", "words"]

#: Keys that may hold more than one in so many rows are as many at most.
HOT_KEYS = 4096
#: What separates words: space and the control characters tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Maximal runs of non-blank characters; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Two hashes (96 bits) naming a row by its id and text, nulls included.

    Rows equal in both share the key, so a decision about a text of an id can be
    joined back even where ids are null or repeated.
    """
    parts = [F.coalesce(F.col(id_col).cast("string"), F.lit("\x00")), F.coalesce(F.col(text_col), F.lit(""))]
    return [F.xxhash64(*parts).alias("_k1"), F.hash(*parts).alias("_k2")]


def of_rows(docs: DataFrame, decided: DataFrame, how: str, id_col: str, text_col: str, once: bool = False) -> DataFrame:
    """The rows of ``docs`` whose key is in ``decided`` (left_semi) or not (left_anti); with ``once`` one row a key.

    ``decided`` has ``row_key``'s columns; those of ``docs`` keep their own names and values.
    """
    names = [free_name(docs, "row_key_1"), free_name(docs, "row_key_2")]
    keyed = docs.withColumns(dict(zip(names, row_key(id_col, text_col), strict=True)))
    out = keyed.join(decided.select(F.col("_k1").alias(names[0]), F.col("_k2").alias(names[1])), names, how)
    return (out.dropDuplicates(names) if once else out).drop(*names)


def spread_join(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``known``, which has one row for each of their keys and the number ``n`` of rows that hold it.

    Keys of more than one in HOT_KEYS rows, at most HOT_KEYS of them, are sent around, so
    that no task gets all rows of one; the others meet by key. Read twice: ``rows`` should be
    stored.
    """
    hot = F.broadcast(known.filter(F.col("n") * HOT_KEYS > rows.count()).drop("n"))
    rest = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(known.drop("n"), key))


def set_aside(df: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` without columns of these names, which go by others for a while, and how to name them again."""
    taken = {c: free_name(df, f"aside_{c}") for c in df.columns if c.lower() in {n.lower() for n in names}}
    return df.withColumnsRenamed(taken), {v: k for k, v in taken.items()}


def batch_limits(spark: SparkSession) -> None:
    """Arrow batches of a bounded size, so that very long texts don't pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
