"""How the tokens of two tokenizers lie on the same bytes, and which ids go together corpus-wide.

A text is encoded by either, the cumulated byte lengths of its tokens are their ends, and the ends that
both share cut it into groups. Tokens that end at the same byte are linked; a pair of
ids counts the links that it has in the whole corpus. A text whose tokens don't give its bytes
back (a tokenizer normalised it) has no tokens.

Each text is encoded once: what it needs later, its distinct pairs, is written. Pairs are summed in tasks,
then by pair and salt, then by pair. The counts go back to the texts as a broadcast table of a
measured size, or, beyond that, by a join.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .token_counts import PATTERN, TOKENIZER_DIR

BYTE_VOCABULARY = "byte_bpe_50k.tiktoken"
PIECE_VOCABULARY = "piece_bpe_32k.model"
#: Bytes of text that are encoded at a time.
CHUNK_BYTES = 1 << 20
#: Distinct pairs after which a task hands on what it has counted.
FLUSH_PAIRS = 1 << 20
#: First stage of the sums: a pair is dealt to so many groups.
SALTS = 16
#: The counts of so many pairs at most (24 bytes each) are broadcast.
BROADCAST_PAIRS = 2_000_000
#: A pair is its B id times this plus its A id.
PAIR = 1 << 32

_UNKNOWN_SPACE = "▁"


class Aligner:
    """Both tokenizers: ids and byte lengths. Made in a task, from the files' contents."""

    def __init__(self, ranks: bytes, model: bytes):
        import sentencepiece
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self._byte = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
        self._piece = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a_bytes = [b""] * (max(merges.values()) + 1)
        for token, i in merges.items():
            self.a_bytes[i] = token
        pieces = [self._piece.id_to_piece(i) for i in range(self._piece.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self._piece.is_byte(i) else p.replace(_UNKNOWN_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self._a_length, self._b_length = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        # an id and the separator after it
        self._words = [f"{i}{s}".encode() for s in ",|;" for i in range(max(len(self.a_bytes), len(self.b_bytes)))]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """For each text the ids of A and B, or None if it is empty or its bytes don't come back."""
        pieces = self._piece.encode(texts, num_threads=1)
        for text, b in zip(texts, pieces, strict=True):
            if not text:
                yield None
                continue
            a = self._byte.encode_ordinary(" " + text)
            whole = (" " + text).encode()
            same = b"".join(map(self.a_bytes.__getitem__, a)) == whole and b"".join(map(self.b_bytes.__getitem__, b)) == whole
            yield (np.array(a, np.int64), np.array(b, np.int64)) if same else None

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[int, str, np.ndarray, np.ndarray]:
        """(number of groups, their digest, linked A ids, linked B ids)."""
        ends_a, ends_b = np.cumsum(self._a_length[a]), np.cumsum(self._b_length[b])
        cuts = np.intersect1d(ends_a, ends_b)
        label_a, label_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        # the groups as text: A's ids, then B's, each id with the separator that follows it
        side = np.concatenate([2 * label_a, 2 * label_b + 1])
        order = np.argsort(side, kind="stable")
        ids, side = np.concatenate([a, b])[order], side[order]
        step = np.append(np.diff(side), 1)
        kind = np.where(step == 0, 0, np.where(side % 2 == 0, 1, 2))
        text = b"".join(map(self._words.__getitem__, (ids + kind * (len(self._words) // 3)).tolist()))[:-1]
        # links: for each cut, every A token that ends there with every B token that does (one each, unless tokens are empty)
        first_a, last_a = np.searchsorted(ends_a, cuts), np.searchsorted(ends_a, cuts, "right")
        first_b, last_b = np.searchsorted(ends_b, cuts), np.searchsorted(ends_b, cuts, "right")
        n_a, n_b = last_a - first_a, last_b - first_b
        n = n_a * n_b
        cut = np.repeat(np.arange(len(cuts)), n)
        k = np.arange(len(cut)) - np.repeat(np.cumsum(n) - n, n)
        return len(cuts), hashlib.sha256(text).hexdigest(), a[first_a[cut] + k // n_b[cut]], b[first_b[cut] + k % n_b[cut]]


def load_vocabularies(folder: str = TOKENIZER_DIR, byte_vocabulary: str = BYTE_VOCABULARY, piece_vocabulary: str = PIECE_VOCABULARY) -> tuple[bytes, bytes]:
    """The vocabulary files' contents, read once on the driver: a fixed size, whatever the corpus."""
    return tuple(open(f"{folder}/{name}", "rb").read() for name in (byte_vocabulary, piece_vocabulary))


def _lists(ends: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def aligned(docs: DataFrame, vocabularies: tuple[bytes, bytes]) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256`` and the distinct pairs of linked ids, ``pairs``, with how often each is linked, ``times``. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabularies)
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for batch in batches:
            aligner = aligner or Aligner(*shared.value)
            for part in common.chunks(batch, "text", CHUNK_BYTES):
                numbers, digests, pairs, times = [], [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                # bytes that are no UTF-8 become replacement characters, as in any text that Python reads
                for ids in aligner.encode([x.decode("utf-8", "replace") for x in part.column("text").to_pylist()]):
                    if ids is None:
                        numbers.append((0, 0, 0, 0, 0))
                        digests.append("")
                        continue
                    n_groups, digest, a, b = aligner.align(*ids)
                    own, n = np.unique(b * PAIR + a, return_counts=True)
                    numbers.append((len(ids[0]), len(ids[1]), n_groups, len(a), len(own)))
                    digests.append(digest)
                    pairs.append(own)
                    times.append(n)
                table = np.array(numbers, np.int64).reshape(-1, 5)
                ends = np.concatenate([[0], np.cumsum(table[:, 4])])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(np.ascontiguousarray(table[:, i])) for i in range(4)), pa.array(digests, pa.string()), _lists(ends, np.concatenate(pairs), pa.int64()), _lists(ends, np.concatenate(times), pa.int32())], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("text")).mapInArrow(run, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """``pair, n, best``: links of each pair of ids in the whole corpus, and whether no pair of its B id has more. Sums in tasks, then by pair and salt, then by pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            more = [np.asarray(batch.column(i).flatten()).astype(np.int64) for i in range(2)]
            pair, where = np.unique(np.concatenate([pair, more[0]]), return_inverse=True)
            sums = np.zeros(len(pair), np.int64)
            np.add.at(sums, where, np.concatenate([n, more[1]]))
            n = sums
            if len(pair) > FLUSH_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])
                pair, n = pair[:0], n[:0]
        if len(pair):
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

    own = rows.select("pairs", "times").mapInArrow(run, "pair long, n long").withColumn("salt", F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(SALTS)).cast("int"))
    counts = own.groupBy("pair", "salt").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("n"))
    counts = common.stored(counts, "pair-counts")
    highest = counts.groupBy(F.floor(F.col("pair") / PAIR).cast("long").alias("b")).agg(F.max("n").alias("most"))
    met = counts.withColumn("b", F.floor(F.col("pair") / PAIR).cast("long")).join(highest, "b")
    return common.stored(met.select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "ranked-pairs")


OUT = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _looked_up(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The counts as sorted arrays in every task; they were measured before."""
    table = counts.toArrow()
    order = np.argsort(table.column("pair").to_numpy())
    arrays = [table.column(x).to_numpy()[order] for x in ("pair", "n", "best")]
    shared = rows.sparkSession.sparkContext.broadcast(arrays)
    kept = [x for x in OUT if x not in ("n_best", "count_sum")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            own, times = batch.column("pairs"), batch.column("times")
            at = np.searchsorted(pair, np.asarray(own.flatten()))
            each = np.asarray(times.flatten()).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.asarray(own.value_lengths()))])
            sums = [np.concatenate([[0], np.cumsum(x)])[ends] for x in (each * best[at], each * n[at])]
            columns = {x: batch.column(x) for x in kept} | {x: pa.array(np.diff(s)) for x, s in zip(("n_best", "count_sum"), sums, strict=True)}
            yield pa.RecordBatch.from_arrays([columns[x] for x in OUT], names=list(OUT))

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.select(*kept, "pairs", "times").mapInArrow(run, schema)


def _joined(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by a join: a row per document and distinct pair. A frequent pair is a skewed key that adaptive execution splits, as both sides are plain shuffles."""
    numbered = common.stored(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    each = numbered.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("z")).select("row", F.col("z.pairs").alias("pair"), F.col("z.times").alias("times"))
    met = common.stored(each.join(counts, "pair").select("row", (F.col("times") * F.col("best").cast("long")).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum")), "counted")
    sums = met.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return numbered.join(sums, "row", "left").select(*(F.coalesce(x, F.lit(0).cast("long")).alias(x) if x in ("n_best", "count_sum") else x for x in OUT))


def align_tokens(docs: DataFrame, vocabularies: tuple[bytes, bytes] | None = None, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    Null and empty texts, and texts that either tokenizer changes, have zeros and ''. Strings of special tokens
    are plain text. Each row counts, rows that repeat an id or a text too; pairs that tie for a B id's highest count
    are all best. Texts are encoded whole, whatever their length. Only ``doc_id`` and ``text`` are read. An empty table gives no rows.
    """
    rows = common.stored(aligned(docs, vocabularies or load_vocabularies()), "aligned")
    counts = pair_counts(rows)
    return _looked_up(rows, counts) if counts.count() <= broadcast_pairs else _joined(rows, counts)


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    """``align_tokens`` of all of ``documents``: A is the byte-level vocabulary, B the pieces."""
    return align_tokens(common.read(spark, sf_dir, "documents"))
