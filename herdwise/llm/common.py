"""Small helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import mark, release, shared_dir, stored

__all__ = ["CHUNK_BYTES", "LOWER", "RANK", "chunks", "mark", "prefix", "ranked", "read", "release", "rows_of", "shared_dir", "stored", "text_bytes"]

#: Bytes of text that a Python task works on at a time, whatever the size of Spark's Arrow batches.
CHUNK_BYTES = 8 << 20

#: Maps ASCII capitals to small letters and leaves every other byte alone.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: What orders the rows of a node and tells them apart: has it no id, the id, a hash of all columns.
RANK = ("none", "id", "row")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prefix(df: DataFrame) -> str:
    """A beginning that no column of ``df`` has: names that are made with it can't clash."""
    out = "__"
    while any(c.startswith(out) for c in df.columns):
        out += "_"
    return out


def text_bytes(column: str = "text"):
    """The text as UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def chunks(batch: pa.RecordBatch, column: str, max_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``max_bytes`` of ``column`` each (one row at least)."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(lengths) > start:
        yield batch.slice(start)


def ranked(docs: DataFrame, mine: str = "") -> list:
    """The columns of ``RANK``, none of them ever null, under names that begin with ``mine``."""
    row = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns if docs.schema[c].dataType.typeName() not in ("map", "variant")))
    own = (F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), row)
    return [column.alias(mine + name) for column, name in zip(own, RANK, strict=True)]


def rows_of(docs: DataFrame, columns: list[str], named: DataFrame, mine: str) -> DataFrame:
    """``columns`` of the rows of ``docs`` that ``named`` names by ``mine`` + ``RANK``, and its columns; of equal rows one. The key is a row's own, so copies of a text don't meet in one task."""
    keys = [mine + x for x in RANK]
    return docs.select(*(F.col(f"`{x}`") for x in columns), *ranked(docs, mine)).join(named, keys).dropDuplicates(keys)
