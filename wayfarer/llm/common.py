"""Session helpers shared by the training-data operators."""

from __future__ import annotations

from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.sources.shared import shared_dir, stash

__all__ = ["shared_dir", "stash"]

NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posix_path(uri: str) -> str:
    """The mounted path of a shared folder, for code that memory-maps files in it."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped models need a mounted shared folder, not {uri}")
    return unquote(parts.path)


GROUP_BYTES = 64 << 20


def input_bytes(docs: DataFrame) -> int:
    """What Spark's statistics say docs takes; 0 where they have no estimate."""
    found = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return found if found < 1 << 60 else 0


def buckets(docs: DataFrame, per_partition: int = 4) -> int:
    """Number of key buckets: some for each shuffle partition, and so many that a bucket has GROUP_BYTES of the input at most."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(8, per_partition * partitions, -(-input_bytes(docs) // GROUP_BYTES))


def row_key() -> tuple[Column, Column]:
    """Names a row of documents in 128 bits: rows that agree in both are repeated rows, whose results are equal."""
    doc_id, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.xxhash64(text, doc_id), F.xxhash64(doc_id, text)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id, text (null text: empty) and the row's key as k1 and k2 only, so that further columns can't clash."""
    k1, k2 = row_key()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), k1.alias("k1"), k2.alias("k2"))


def whole_rows(docs: DataFrame) -> DataFrame:
    """Each row of docs as the struct row, and its text beside it (null: empty), so that no column can clash."""
    return docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def fresh(docs: DataFrame, n: int) -> list[str]:
    """Column names that docs doesn't have."""
    taken, out = {c.lower() for c in docs.columns}, []
    k = 0
    while len(out) < n:
        if (name := f"_own{k}") not in taken:
            out.append(name)
        k += 1
    return out


def by_key(docs: DataFrame, keys: DataFrame, how: str, once: bool = False) -> DataFrame:
    """docs joined with keys (k1, k2 and others) on the row key; docs' columns keep their names, whatever they are.

    once: of repeated rows one stays, for which the join's exchange will do.
    """
    a, b, c, d = fresh(docs, 4)
    k1, k2 = row_key()
    marked = docs.select("*", k1.alias(a), k2.alias(b))
    other = keys.withColumnsRenamed({"k1": c, "k2": d})
    joined = marked.join(other, (F.col(a) == F.col(c)) & (F.col(b) == F.col(d)), how)
    return (joined.dropDuplicates([a, b]) if once else joined).drop(a, b, c, d)
