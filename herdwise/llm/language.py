"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting n-grams of labelled texts is a Spark job; the matrix of log-probabilities
(languages x buckets, a fixed size per language) is broadcast, and batches of texts
are scored as sparse rows: bucket numbers of all their n-grams in one array, one
gather per language, one segmented sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: n-grams are hashed into 2 ** BITS buckets.
BITS = 15
ORDERS = (1, 2, 3)
#: Bound of the training sample: about this many labelled rows per language, chosen by a hash of the id.
MAX_ROWS_PER_LANG = 5_000
#: Bound of the model: the languages with the most labelled rows are learned, as many as this; the matrix has 2 ** BITS numbers for each.
MAX_LANGS = 1_000
UNDETERMINED = "und"
#: Bytes of text, and characters of one text, whose n-grams a task holds at a time.
CHUNK_BYTES = 1 << 20
PIECE = 1 << 18

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def held_out(doc_id):
    """Whether a document is kept out of training: crc32 of its id as text leaves 1 on division by 3. Null ids are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _ngrams(texts: list[str], limits: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order (buckets, where each text's begin). N-grams don't cross texts; ``limits`` are the numbers of places in each text at which they may begin."""
    sizes = np.array([len(t) for t in texts], np.int64)
    most = sizes if limits is None else np.minimum(sizes, limits)
    # surrogates can't be in Spark's strings, but a fixture may have them
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.cumsum(sizes) - sizes
    mixed, out = np.zeros(len(code), np.uint32), []
    for k in range(max(ORDERS)):
        n = max(0, len(code) - k)
        mixed = (mixed[:n] ^ code[k:]) * _MULTIPLIERS[k % 3]
        mixed ^= mixed >> np.uint32(15)
        if k + 1 in ORDERS:
            each = np.clip(sizes - k, 0, most)
            edges = np.bincount(first, minlength=len(code) + 1) - np.bincount(first + each, minlength=len(code) + 1)
            inside = np.cumsum(edges)[:n] > 0
            out.append(((mixed >> np.uint32(32 - BITS))[inside], np.concatenate([[0], np.cumsum(each)])))
    return out


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """(number of the text, n-grams) of pieces of the texts, lower-cased; a long text is cut, its pieces overlapping by what n-grams need."""
    owner, part, limits, size = [], [], [], 0
    for i, t in enumerate(texts):
        t = t.lower()
        for at in range(0, len(t), PIECE):
            if part and size + PIECE > CHUNK_BYTES:
                yield np.array(owner), _ngrams(part, limits)
                owner, part, limits, size = [], [], [], 0
            owner.append(i)
            part.append(t[at : at + PIECE + max(ORDERS) - 1])
            limits.append(PIECE)
            size += len(part[-1])
    if part:
        yield np.array(owner), _ngrams(part, limits)


class Model:
    """Languages in order and their log-probabilities, one row per bucket."""

    def __init__(self, langs: list[str], counts: np.ndarray, rows: np.ndarray, alpha: float = 0.1):
        self.langs = langs
        smooth = counts + alpha
        self.log_p = np.ascontiguousarray(np.log(smooth / smooth.sum(1, keepdims=True)), np.float32) if langs else np.empty((0, 1 << BITS), np.float32)
        self.prior = np.log((rows + 1.0) / (rows.sum() + len(rows))) if langs else np.empty(0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language (of equal ones the first by name) and its posterior probability; ``und`` and 0 for null, for texts without a letter, and without languages to choose from."""
        texts = [t or "" for t in texts]
        letter = np.array([any(map(str.isalpha, t)) for t in texts], bool)
        if not self.langs or not letter.any():
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        empty = ~letter
        total = np.tile(self.prior, (len(texts), 1))
        for owner, grams in _pieces(texts):
            for bucket, starts in grams:
                some = np.flatnonzero(starts[1:] > starts[:-1])  # reduceat needs segments that aren't empty
                if len(some):
                    np.add.at(total, owner[some], np.stack([np.add.reduceat(p[bucket], starts[:-1][some], dtype=np.float64) for p in self.log_p], 1))
        best = total.argmax(1)
        share = np.exp(total - total.max(1, keepdims=True))
        score = np.where(empty, 0.0, 1.0 / share.sum(1))
        return [UNDETERMINED if e else self.langs[b] for b, e in zip(best, empty, strict=True)], score


def train(docs: DataFrame, max_rows_per_lang: int = MAX_ROWS_PER_LANG) -> Model:
    """Learn from ``text`` and non-null ``lang`` of documents that are not held out.

    A language with more than ``max_rows_per_lang`` rows is sampled by a hash of the id
    down to about that many; smaller ones are used in full. Repeated rows each count; an empty table
    gives a model without languages, which finds none.
    """
    # null texts count for the prior only: asking for them would read all texts to count languages
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()}
    if not sizes:
        return Model([], np.empty((0, 1 << BITS)), np.empty(0))
    langs = sorted(sizes)
    draw = (F.xxhash64(F.col("doc_id").cast("long"), F.lit("language")).bitwiseAND(F.lit((1 << 30) - 1))) / float(1 << 30)
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, max_rows_per_lang / sizes[lang])))])
    sample = labelled.where(draw < share[F.col("lang")]).select("lang", "text")
    number = {lang: i for i, lang in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), 1 << BITS), np.int64)
        for batch in batches:
            for part in common.chunks(batch, "text", CHUNK_BYTES):
                which = np.array([number[x] for x in part.column("lang").to_pylist()], np.int64)
                for owner, grams in _pieces([t or "" for t in part.column("text").to_pylist()]):
                    for bucket, starts in grams:
                        cells, n = np.unique(np.repeat(which[owner], np.diff(starts)) * (1 << BITS) + bucket, return_counts=True)
                        total.ravel()[cells] += n
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[lang, bucket])], names=["lang", "bucket", "n"])

    counts = np.zeros((len(langs), 1 << BITS))
    got = sample.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts[got["lang"], got["bucket"]] = got["n"]
    return Model(langs, counts, np.array([sizes[x] for x in langs], float))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, all columns kept, with ``lang_pred`` and ``lang_score`` (columns of these names are replaced). Only ``text`` is looked at; repeated rows each get their row, an empty table gives none."""
    docs = docs.drop("lang_pred", "lang_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.chunks(batch, "text", CHUNK_BYTES):
                lang, score = shared.value.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score)], names=[*part.schema.names, "lang_pred", "lang_score"])

    schema = T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents whose language is known with a posterior of ``least`` or more; all columns kept. Null, empty and letterless texts go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.chunks(batch, "text", CHUNK_BYTES):
                lang, score = shared.value.predict(part.column("text").to_pylist())
                yield part.filter(pa.array([x != UNDETERMINED and s >= least for x, s in zip(lang, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
