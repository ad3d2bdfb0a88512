"""Token counts kept up to date by signed deltas.

Totals by source, language and tokenizer version are never counted anew: each
batch of changes - inserts, deletes, revised counts - becomes one small table of
signed sums under its batch id. A batch is written beside the others and then renamed to its
id, which fails if that is taken: so it is committed whole and once, whoever tries again or at
the same time. Committed batches are added up into a snapshot now and then; the
totals are the last snapshot and the batches since.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOKENIZER_DIR = "/opt/tokenizers"
#: Version name -> vocabulary file (byte-level BPE ranks).
TOKENIZERS = {"byte-bpe-50k": "byte_bpe_50k.tiktoken", "byte-bpe-multi-50k": "byte_bpe_multi_50k.tiktoken"}
#: How these vocabularies cut a text before merging (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens", "n_chars")


def load_vocabularies(tokenizers: dict[str, str] | None = None, folder: str = TOKENIZER_DIR) -> dict[str, bytes]:
    """The vocabulary files' contents, read once on the driver: a fixed size each, whatever the corpus."""
    out = {}
    for version, name in (tokenizers or TOKENIZERS).items():
        with open(f"{folder}/{name}", "rb") as f:
            out[version] = f.read()
    return out


def _encoders(vocabularies: dict[str, bytes]):
    import tiktoken

    for version, ranks in vocabularies.items():
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        yield version, tiktoken.Encoding(version, pat_str=PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary


def count_tokens(docs: DataFrame, vocabularies: dict[str, bytes], columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """``docs`` once per tokenizer version, each of the named text columns replaced by ``<column>_tokens``; with a column ``tokenizer``.

    Texts are counted whole; null counts as empty. No shuffle. Columns of these names are replaced.
    """
    kept = [c for c in docs.columns if c not in columns and c not in ("tokenizer", *(f"{x}_tokens" for x in columns))]
    shared = docs.sparkSession.sparkContext.broadcast(vocabularies)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "tokenizer string", *(f"{c}_tokens long" for c in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = list(_encoders(shared.value))
        for batch in batches:
            for part in common.chunks(batch, columns[0]):
                rest = [part.column(c) for c in kept]
                texts = [part.column(c).to_pylist() for c in columns]
                for version, encode in encoders:
                    counts = [pa.array(np.fromiter((len(encode(t)) if t else 0 for t in x), np.int64, len(x))) for x in texts]
                    yield pa.RecordBatch.from_arrays([*rest, pa.array([version] * part.num_rows, pa.string()), *counts], names=[*kept, "tokenizer", *(f"{c}_tokens" for c in columns)])

    return docs.select(*(F.col(f"`{c}`") for c in kept), *columns).mapInArrow(run, schema)


def inserts(counts: DataFrame) -> DataFrame:
    """Signed rows that add documents: ``source, lang, tokenizer, n_docs, n_tokens, n_chars``."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), "n_tokens", "n_chars")


def deletes(counts: DataFrame) -> DataFrame:
    """Signed rows that take documents away again, by the counts they were added with."""
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"), (-F.col("n_chars")).alias("n_chars"))


def revisions(changed: DataFrame) -> DataFrame:
    """Signed rows for documents whose counts change from ``old_tokens, old_chars`` to ``n_tokens, n_chars``."""
    return changed.select(*KEYS, F.lit(0).cast("long").alias("n_docs"), (F.col("n_tokens") - F.col("old_tokens")).alias("n_tokens"), (F.col("n_chars") - F.col("old_chars")).alias("n_chars"))


class Rollup:
    """Totals in a folder that driver and executors share.

    ``batch=<id>`` is a committed batch. ``snapshot=<n>`` has the sums of many of them (``totals``) and
    their ids (``ids``); the folder of a batch that a snapshot holds stays, as the mark that its id is taken,
    and is emptied when the next snapshot is made. Folders in which a writer died begin with ``_`` and count for nothing.
    """

    SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"

    def __init__(self, spark: SparkSession, path: str, compact_after: int = 100):
        """A commit that makes ``compact_after`` batches since the last snapshot makes a new one."""
        self.spark, self.path, self.compact_after = spark, path, compact_after
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._paths(path).getFileSystem(self._conf)

    def _folder(self, batch_id: str) -> str:
        if not batch_id.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"not a batch id: {batch_id!r}")
        return f"{self.path}/batch={batch_id}"

    def _renamed(self, old: str, new: str) -> bool:
        """Rename unless the new name is taken; then the old folder goes."""
        fs = self.spark._jvm.org.apache.hadoop.fs
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            fs.FileContext.getFileContext(self._paths(self.path).toUri(), self._conf).rename(self._paths(old), self._paths(new), none)
        except Py4JJavaError:
            self._fs.delete(self._paths(old), True)
            if not self._fs.exists(self._paths(new)):
                raise
            return False
        return True

    def _names(self, kind: str) -> list[str]:
        at = self._paths(self.path)
        found = self._fs.listStatus(at) if self._fs.exists(at) else []
        return [n.split("=", 1)[1] for s in found if (n := s.getPath().getName()).startswith(f"{kind}=")]

    def _state(self) -> tuple[int, set[str], list[str]]:
        """(number of the last snapshot, ids that it holds, ids of the batches since)."""
        # batches first: one that is missing from this list can then only be too new for the snapshot
        batches = self._names("batch")
        last = max(map(int, self._names("snapshot")), default=0)
        held = {r["id"] for r in self.spark.read.schema("id string").parquet(f"{self.path}/snapshot={last}/ids").collect()} if last else set()
        return last, held, sorted(set(batches) - held)

    def committed(self, batch_id: str) -> bool:
        return self._fs.exists(self._paths(self._folder(batch_id)))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch of signed rows; False, and nothing done, if its id was committed before or by another writer meanwhile."""
        folder = self._folder(batch_id)
        if self.committed(batch_id):
            return False
        draft = f"{self.path}/_writing-{uuid.uuid4().hex}"
        # hot sources shrink to one row per task before the shuffle; what is left is a row per key
        changes.groupBy(*KEYS).agg(*(F.sum(c).cast("long").alias(c) for c in SUMS)).coalesce(1).write.parquet(draft)
        if not self._renamed(draft, folder):
            return False
        if len(self._state()[2]) >= self.compact_after:
            self.compact()
        return True

    def compact(self) -> bool:
        """Add all batches up into a new snapshot; False if there is none to add, or if another writer was first."""
        last, held, batches = self._state()
        if not batches:
            return False
        for done in held:  # read by nobody any more
            for s in self._fs.listStatus(self._paths(self._folder(done))):
                self._fs.delete(s.getPath(), True)
        for old in self._names("snapshot"):
            if int(old) < last:
                self._fs.delete(self._paths(f"{self.path}/snapshot={old}"), True)
        draft = f"{self.path}/_writing-{uuid.uuid4().hex}"
        self._sums(last, batches).coalesce(1).write.parquet(f"{draft}/totals")
        self.spark.createDataFrame([(x,) for x in sorted(held | set(batches))], "id string").coalesce(1).write.parquet(f"{draft}/ids")
        return self._renamed(draft, f"{self.path}/snapshot={last + 1}")

    def _sums(self, last: int, batches: list[str]) -> DataFrame:
        folders = ([f"{self.path}/snapshot={last}/totals"] if last else []) + [self._folder(x) for x in batches]
        rows = self.spark.read.schema(self.SCHEMA).option("pathGlobFilter", "*.parquet").parquet(*folders) if folders else self.spark.createDataFrame([], self.SCHEMA)
        return rows.groupBy(*KEYS).agg(*(F.sum(c).cast("long").alias(c) for c in SUMS))

    def totals(self) -> DataFrame:
        """Sums over all committed batches; keys whose documents are all gone are left out. Null sources and languages are keys like others; no batches give no rows."""
        last, _, batches = self._state()
        return self._sums(last, batches).where("n_docs <> 0 or n_tokens <> 0 or n_chars <> 0")


def collapsed(text: Column) -> Column:
    """A text with runs of blanks as one blank and none at its ends: the revision that the query applies."""
    return F.trim(F.regexp_replace(text, "[ \t]+", " "))


def op9_token_counts(spark, sf_dir: str, vocabularies: dict[str, bytes] | None = None) -> DataFrame:
    """Commits three batches made from the whole documents table and returns the totals.

    All documents are inserted, the batch is replayed (which must change nothing), later
    copies of a text are deleted, and the counts of documents whose blanks collapse are revised.
    A document is its id and text: rows that repeat both are all counted and share their fate, two
    texts under one id are two documents. Rows without an id are no later copies. Null texts count as empty; other
    columns are not read; an empty table gives no rows.
    """
    vocabularies = vocabularies or load_vocabularies()
    docs = common.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("*", F.sha2("text", 256).alias("digest"), F.length("text").cast("long").alias("n_chars"))
    counts = common.stored(count_tokens(docs, vocabularies).withColumnRenamed("text_tokens", "n_tokens"), "token-counts")
    rollup = Rollup(spark, f"{common.shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.commit("insert", inserts(counts))
    rollup.commit("insert", inserts(counts))
    # written first, so that a text with many copies is a skewed key that adaptive execution splits
    first = common.stored(counts.groupBy("digest").agg(F.min("doc_id").alias("first_id")), "first-copies")
    later = common.stored(counts.join(first, "digest").where("doc_id > first_id").select("doc_id", "digest", *KEYS, "n_tokens", "n_chars"), "later-copies")
    rollup.commit("delete-copies", deletes(later))
    changed = docs.withColumn("new_text", collapsed(F.col("text"))).where("new_text <> text").join(later.select("doc_id", "digest").distinct(), ["doc_id", "digest"], "left_anti")
    changed = count_tokens(changed.withColumn("new_chars", F.length("new_text").cast("long")), vocabularies, ("text", "new_text"))
    rollup.commit("collapse-blanks", revisions(changed.select(*KEYS, F.col("text_tokens").alias("old_tokens"), F.col("n_chars").alias("old_chars"), F.col("new_text_tokens").alias("n_tokens"), F.col("new_chars").alias("n_chars"))))
    return rollup.totals()
