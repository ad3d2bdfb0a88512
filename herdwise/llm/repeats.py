"""Substring dedup: find every passage of ``WINDOW`` words that stands more than once, and remove it everywhere.

1. *Candidates.* Each window belongs to its seed, the least-hashed run of ``SEED`` words in
   it: equal windows have equal seeds, and consecutive windows mostly share one, so a text
   has one seed, and one block of windows, for every dozen words. Seeds are counted over
   the corpus; blocks whose seed stands once are done with.
2. *Confirmation.* A block that stands twice as a whole recurs. Where blocks of one seed
   differ, one of each kind is read again and its windows are counted one by one. Blocks and
   windows count as equal if the 128-bit BLAKE2 digests of their words are, which no two
   different passages are known to share; seeds, 64-bit hashes, only bring them together.
3. *Automata.* Documents are dealt into shards of a few MB. A shard gets the places of its confirmed
   passages, compiles as many of their windows as cover them, each phrase once, into Aho-Corasick
   automata over word numbers, and streams its documents through them, which locates every occurrence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 35
#: Words of a seed.
SEED = 8
#: Bytes of text in a shard, on average.
SHARD_BYTES = 2 << 20
#: Words of phrases that one automaton holds at most (about 60 bytes each).
AUTOMATON_WORDS = 1_000_000
#: Bytes of text that are hashed together.
CHUNK_BYTES = 2 << 20
#: Bytes of text in a partition of shards, on average, as long as that makes no more partitions than these; a task holds one shard at a time.
PARTITION_BYTES, MAX_PARTITIONS = 16 << 20, 100_000

_BASE = 0x9E3779B97F4A7C15 | 1
BLOCKS_SCHEMA = "key long, seed long, block long, more long, start int, n int"


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: spreads every bit of a hash over all of it."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as long as were asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            steps = np.ones(size, np.uint64)
            steps[1:] = _BASE
            self.up = np.multiply.accumulate(steps)
            steps[1:] = pow(_BASE, -1, 1 << 64)
            self.down = np.multiply.accumulate(steps)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each range, whatever stands around it."""
    up, down = _POWERS.get(len(values) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)])
    return _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class _WordHashes(dict):
    """64-bit hashes of words, worked out once for each."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:  # started afresh when it has grown
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Words:
    """The words of some texts, end to end: their hashes, where each text's begin, and digests of any run of them."""

    def __init__(self, texts: list[bytes], hashes: _WordHashes):
        split = [t.split() for t in texts]
        flat = [w for own in split for w in own]
        self.first = np.cumsum([0] + [len(own) for own in split])
        self.hashes = np.fromiter(map(hashes.__getitem__, flat), np.uint64, len(flat))
        self.joined = memoryview(b" ".join(flat))
        self.ends = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)) + 1) - 1
        self.begins = np.concatenate([[0], self.ends[:-1] + 1]) if flat else self.ends

    def digests(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Two signed longs for the words [start, end) of each range."""
        joined, blake = self.joined, hashlib.blake2b
        spans = zip(self.begins[start].tolist(), self.ends[end - 1].tolist(), strict=True)
        return np.frombuffer(b"".join([blake(joined[a:b], digest_size=16).digest() for a, b in spans]), np.int64).reshape(-1, 2)


def _window_starts(first: np.ndarray, window: int) -> np.ndarray:
    """The words at which a window begins that stays inside its text."""
    n = np.maximum(0, np.diff(first) - window + 1)
    return np.repeat(first[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def blocks(w: Words, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every block of windows that share a seed: (text, seed hash, digest of all the block's words, first window, number of windows)."""
    words, first = w.hashes, w.first
    start = _window_starts(first, window)
    if not len(start):
        none = np.empty(0, np.int64)
        return none, none.astype(np.uint64), none.reshape(0, 2), none, none
    seeds = np.arange(len(words) - seed + 1)
    rank = _ranges(words, seeds, seeds + seed)
    reach = window - seed + 1
    # the last of the least seeds in each window: reverse, and take the first
    seen = np.lib.stride_tricks.sliding_window_view(rank, reach)
    at = np.empty(len(start), np.int64)
    for i in range(0, len(start), 1 << 17):
        part = start[i : i + (1 << 17)]
        at[i : i + len(part)] = part + reach - 1 - seen[part][:, ::-1].argmin(1)
    text = np.searchsorted(first, start, "right") - 1
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    last = np.append(new[1:], len(start)) - 1
    return text[new], rank[at[new]], w.digests(start[new], start[last] + window), start[new] - first[text[new]], last - new + 1


def _keyed(docs: DataFrame) -> DataFrame:
    """``key, text`` as bytes; equal keys are equal rows, and equal rows fare alike."""
    return docs.select(F.xxhash64(F.col("doc_id"), F.col("text")).alias("key"), common.text_bytes().alias("text"))


def candidate_blocks(docs: DataFrame) -> DataFrame:
    """All blocks of all texts: ``key, seed, block, more, start, n``. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for part in common.chunks(batch, "text", CHUNK_BYTES):
                text, seed, block, start, n = blocks(Words(part.column("text").to_pylist(), hashes))
                keys = np.asarray(part.column("key"))[text]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(seed.view(np.int64)), *(pa.array(np.ascontiguousarray(x)) for x in block.T), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["key", "seed", "block", "more", "start", "n"])

    return _keyed(docs).mapInArrow(run, BLOCKS_SCHEMA)


def _windows_of(docs: DataFrame, kinds: DataFrame) -> DataFrame:
    """``seed, window, more, key, start`` for every window of the blocks in ``kinds`` (``key, seed, start, n``)."""
    wanted = kinds.groupBy("key").agg(F.collect_list(F.struct("seed", "start", "n")).alias("b"))
    met = _keyed(docs).join(wanted, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for part in common.chunks(batch, "text", CHUNK_BYTES):
                words = Words(part.column("text").to_pylist(), hashes)
                lists = part.column("b")
                flat = lists.flatten()
                seed, start, n = (np.asarray(flat.field(i)).astype(np.int64) for i in range(3))
                doc = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(lists.offsets)))
                own = np.repeat(np.arange(len(n)), n)
                at = start[own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
                begin = words.first[doc[own]] + at
                digests = words.digests(begin, begin + WINDOW)
                yield pa.RecordBatch.from_arrays([pa.array(seed[own]), *(pa.array(np.ascontiguousarray(x)) for x in digests.T), pa.array(np.asarray(part.column("key"))[doc[own]]), pa.array(at.astype(np.int32))], names=["seed", "window", "more", "key", "start"])

    return met.select("key", "text", "b").mapInArrow(run, "seed long, window long, more long, key long, start int")


def recurring_windows(docs: DataFrame) -> DataFrame:
    """``key, start, n``: from ``start`` on, ``n`` consecutive windows of a document that recur. Every recurring window of every document is in one of the rows."""
    found = common.stored(candidate_blocks(docs), "blocks")
    # tables that a hot key is joined with are written first, so that either side of the join is a plain
    # shuffle: a seed with a third of all rows is then a skewed key that adaptive execution splits
    twice = common.stored(found.groupBy("seed").count().where("count > 1").select("seed"), "seeds")
    found = common.stored(found.join(twice, "seed"), "recurring-seeds")
    kinds = common.stored(found.groupBy("seed", "block", "more").agg(F.count("*").alias("times"), F.min(F.struct("key", "start", "n")).alias("one")), "kinds")
    same = ["seed", "block", "more"]
    whole = found.join(common.stored(kinds.where("times > 1").select(*same), "recurring-blocks"), same).select("key", "start", "n")
    several = common.stored(kinds.groupBy("seed").agg(F.count("*").alias("k"), F.min("times").alias("least")).where("k > 1 and least = 1").select("seed"), "several")
    windows = common.stored(_windows_of(docs, kinds.join(several, "seed").select("seed", "one.key", "one.start", "one.n")), "windows")
    same = ["seed", "window", "more"]
    again = common.stored(windows.groupBy(*same).count().where("count > 1").select(*same), "recurring-windows")
    return whole.unionByName(windows.join(again, same).select("key", "start", F.lit(1).alias("n")))


def _covered(words: list[int], first: np.ndarray, phrases: set[tuple[int, ...]]) -> np.ndarray:
    """Which words some phrase covers; texts lie end to end, ``first`` says where they begin."""
    edges = np.zeros(len(words) + 1, np.int64)
    batch: list[tuple[int, ...]] = []
    size = 0

    def stream() -> None:
        machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        for p in batch:
            machine.add_word(p)
        machine.make_automaton()
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= WINDOW:
                for end, n in machine.iter(tuple(words[a:b])):
                    edges[a + end + 1 - n] += 1
                    edges[a + end + 1] -= 1

    for p in phrases:
        batch.append(p)
        size += len(p)
        if size >= AUTOMATON_WORDS:
            stream()
            batch, size = [], 0
    if batch:
        stream()
    return np.cumsum(edges[:-1]) > 0


def phrase_starts(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, word) of as many windows as cover what the given stretches of windows do: in each run of consecutive ones every ``WINDOW``-th, and the last."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + n)[order]
    if not len(doc):
        return doc, start
    wide = int(end.max()) + 2  # one line for all documents, with a gap between any two
    low, reach = doc * wide + start, np.maximum.accumulate(doc * wide + end)
    new = np.flatnonzero(np.concatenate([[True], low[1:] > reach[:-1]]))
    first, last = low[new], reach[np.append(new[1:], len(low)) - 1] - 1
    each = (last - first) // WINDOW + 1
    at = np.repeat(first, each) + WINDOW * (np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each))
    at = np.unique(np.concatenate([at, last]))
    return at // wide, at % wide


def remove_repeats(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept`` (the words that are left, joined by one space).

    Null and empty texts have no words; texts of fewer than ``WINDOW`` words keep them all; rows
    that are repeated repeat each other's passages and lose them; no rows give no rows. Only
    ``doc_id`` and ``text`` are read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shard = F.pmod(F.col("key"), F.lit(max(1, -(-size // shard_bytes))))
    places = recurring_windows(docs).select(shard.alias("shard"), "key", "start", "n")
    texts = docs.select("doc_id", F.xxhash64(F.col("doc_id"), F.col("text")).alias("key"), common.text_bytes().alias("text")).select(shard.alias("shard"), "doc_id", "key", "text")

    def dedup(left: pa.Table, right: pa.Table) -> pa.Table:
        split = [t.split() for t in left.column("text").to_pylist()]
        first = np.cumsum([0] + [len(w) for w in split])
        gone = np.zeros(int(first[-1]), bool)
        if right.num_rows:
            number: dict[bytes, int] = {}
            words = [number.setdefault(w, len(number)) for doc in split for w in doc]
            keys = np.asarray(left.column("key"))
            by_key = np.argsort(keys, kind="stable")
            at = np.searchsorted(keys, np.asarray(right.column("key")), sorter=by_key)  # rows that are repeated share their passages
            doc, start = phrase_starts(by_key[at].astype(np.int64), *(np.asarray(right.column(c)).astype(np.int64) for c in ("start", "n")))
            begin = (first[doc] + start).tolist()
            gone = _covered(words, first, {tuple(words[a : a + WINDOW]) for a in begin})
        kept = [b" ".join([w for w, g in zip(doc, gone[a:b].tolist(), strict=True) if not g] if gone[a:b].any() else doc).decode() for doc, a, b in zip(split, first[:-1], first[1:], strict=True)]
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
        return pa.table({"doc_id": left.column("doc_id"), "n_words": pa.array(np.diff(first)), "n_removed": pa.array(removed.astype(np.int64)), "kept": pa.array(kept, pa.string())})

    # as many partitions as the texts need, so that a task's share doesn't grow with the corpus
    parts = min(MAX_PARTITIONS, max(1, -(-size // PARTITION_BYTES)))
    sides = (x.repartition(parts, "shard").groupBy("shard") for x in (texts, places))
    return next(sides).cogroup(next(sides)).applyInArrow(dedup, "doc_id long, n_words long, n_removed long, kept string")


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


