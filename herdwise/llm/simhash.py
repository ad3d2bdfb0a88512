"""SimHash near-duplicates by anchor-point covering.

Fingerprints are compared only where they meet at an *anchor*, a word of a
covering code. The code is the Hamming code of length n = 2^m - 1: perfect, so
every n-bit word lies within R = 1 of an anchor. Two fingerprints that differ in
t bits have a midpoint within ceil(t / 2) of both, and the midpoint has an anchor
within R; so copies of each fingerprint at all anchors within R + ceil(t / 2) let
every linked pair meet. (Copies within R + t, counted from one of the two, find
the same pairs; ``radius`` can ask for them.) With n = 63 and t = 2 that is 31.5
copies on average, whatever the corpus, and an anchor sees at most
2 * (1 + 63 + 1953) different fingerprints, so no group grows without bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, jaccard, verify
from .common import RANK, ranked, rows_of
from .components import connected_components

SEED = 42


@dataclass(frozen=True)
class Covering:
    """How fingerprints of ``64 * width`` bits meet: ``blocks`` lists the bits of each projection.

    A block of 2^m - 1 bits uses the Hamming code (R = 1) if ``radius`` is over 0; with
    radius 0 every word is its own anchor (the code of all words, R = 0).
    ``threshold`` is the number of differing bits at which two fingerprints link.
    """

    threshold: int
    radius: int
    blocks: tuple[tuple[int, ...], ...]
    width: int = 1


#: Every pair within 2 bits meets: the first 63 bits, Hamming code, R + ceil(2 / 2).
EXACT_2 = Covering(threshold=2, radius=2, blocks=(tuple(range(63)),))


def wide_covering(width: int = 4, threshold: int = 47, block: int = 16) -> Covering:
    """For loose thresholds, where no code of few anchors covers all pairs: twice as many blocks as fit side by side, the second half taking scattered bits.

    At 256 bits a similarity of 0.8 differs in 39 bits on average; a pair at that
    similarity meets in some block with probability 0.9, one at 0.9 with over 0.99.
    """
    n = 64 * width // block
    side = [tuple(range(i * block, (i + 1) * block)) for i in range(n)]
    across = [tuple((j * n + i) % (64 * width) for j in range(block)) for i in range(n)]
    return Covering(threshold, 0, tuple(side + across), width)


def _sum_bits(h: np.ndarray, width: int) -> np.ndarray:
    """For each bit of the (widened) hashes, in how many of them it is set."""
    words = [h]
    for _ in range(width - 1):  # further words: the last one mixed again (splitmix64's finaliser)
        z = words[-1] + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        words.append(z ^ (z >> np.uint64(31)))
    packed = np.stack(words, 1).view(np.uint8)
    total = np.zeros(64 * width, np.int64)
    for i in range(0, len(h), 255):  # sums of up to 255 bits fit a byte
        total += np.add.reduce(np.unpackbits(packed[i : i + 255], axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return total


def shingles(text: bytes, words: int) -> np.ndarray:
    """Hashes of the shingles of ``words`` words, repeats included; a shorter text is one shingle, one without words has none."""
    own = text.translate(common.LOWER).split()
    if not own:
        return np.empty(0, np.uint64)
    k = min(words, len(own))
    joined = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: len(own) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)


def _majority(h: np.ndarray, width: int) -> np.ndarray:
    if not len(h):
        return np.zeros(width, np.uint64)
    return np.packbits(_sum_bits(h, width) * 2 > len(h), bitorder="little").view(np.uint64)


def fingerprint(text: bytes, words: int = 3, width: int = 1) -> np.ndarray:
    """``width`` 64-bit words over the ``shingles``; a text without words gives zero."""
    return _majority(shingles(text, words), width)


def _words(width: int) -> list[str]:
    return [f"w{i}" for i in range(width)]


def fingerprints(docs: DataFrame, words: int = 3, width: int = 1) -> DataFrame:
    """``doc_id, w0, w1, ...`` (the 64-bit words as signed longs), one row per document. Null texts count as empty. No shuffle."""
    schema = ", ".join(["doc_id long", *(f"{w} long" for w in _words(width))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.chunks(batch, "text"):
                prints = np.stack([fingerprint(t, words, width) for t in part.column("text").to_pylist()]).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(np.ascontiguousarray(c)) for c in prints.T)], names=["doc_id", *_words(width)])

    return docs.select(F.col("doc_id").cast("long"), common.text_bytes().alias("text")).mapInArrow(run, schema)


@cache
def _patterns(n: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Error patterns of weight up to ``radius`` sorted by syndrome, and where each syndrome's begin."""
    found = [(0, 0)]
    for weight in range(1, radius + 1):
        for places in combinations(range(1, n + 1), weight):
            syndrome = pattern = 0
            for p in places:
                syndrome ^= p
                pattern |= 1 << (p - 1)
            found.append((syndrome, pattern))
    found.sort()
    return np.array([p for _, p in found], np.uint64), np.searchsorted([s for s, _ in found], np.arange(n + 2))


def _anchors(x: np.ndarray, n: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every anchor within ``radius`` of each n-bit word."""
    if not radius:
        return np.arange(len(x)), x
    patterns, starts = _patterns(n, radius)
    syndrome = np.zeros(len(x), np.int64)
    for s in range(n.bit_length()):
        mask = np.uint64(sum(1 << (p - 1) for p in range(1, n + 1) if p >> s & 1))
        syndrome |= (np.bitwise_count(x & mask).astype(np.int64) & 1) << s
    n_each = np.diff(starts)[syndrome]
    row = np.repeat(np.arange(len(x)), n_each)
    return row, x[row] ^ patterns[np.repeat(starts[syndrome], n_each) + np.arange(len(row)) - np.repeat(np.cumsum(n_each) - n_each, n_each)]


def _project(prints: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    if prints.shape[1] == 1 and bits == tuple(range(len(bits))):
        return prints[:, 0] & np.uint64((1 << len(bits)) - 1)
    out = np.zeros(len(prints), np.uint64)
    for i, b in enumerate(bits):
        out |= ((prints[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)) << np.uint64(i)
    return out


def replicate(nodes: DataFrame, c: Covering) -> DataFrame:
    """``block, anchor`` and the columns of ``nodes`` (``node`` and the words), once for each anchor that the fingerprint goes to."""
    names = ["node", *_words(c.width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                columns = [np.asarray(part.column(x)) for x in names]
                prints = np.stack([x.view(np.uint64) for x in columns[1:]], 1)
                for i, bits in enumerate(c.blocks):
                    row, anchor = _anchors(_project(prints, bits), len(bits), c.radius)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), i, np.int32)), pa.array(anchor.view(np.int64)), *(pa.array(x[row]) for x in columns)], names=["block", "anchor", *names])

    return nodes.select(*names).mapInArrow(run, "block int, anchor long, " + ", ".join(f"{x} long" for x in names))


def _local_roots(prints: np.ndarray, threshold: int) -> np.ndarray:
    """For each row of a group the first row of its component, where rows within ``threshold`` bits link.

    Breadth first: each row is compared only with the rows not reached yet, so a group
    of near copies costs a few passes; no list of pairs is made.
    """
    root = np.full(len(prints), -1)
    left = np.arange(len(prints))
    while len(left):
        first, frontier, left = left[0], left[:1], left[1:]
        root[first] = first
        while len(frontier) and len(left):
            at, frontier = frontier[0], frontier[1:]
            near = np.bitwise_count(prints[left] ^ prints[at]).sum(1, dtype=np.int64) <= threshold
            reached = left[near]
            root[reached] = first
            frontier = np.concatenate([frontier, reached])
            left = left[~near]
    return root


def links(nodes: DataFrame, c: Covering) -> DataFrame:
    """Edges ``a, b`` between nodes: at each anchor, each node's link to the first node of its component there. They connect what all pairs would."""
    names = ["node", *_words(c.width)]
    met = replicate(nodes, c).repartition("block", "anchor").sortWithinPartitions("block", "anchor", "node")

    def found(key: np.ndarray, node: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
        sizes = np.diff(np.append(starts, len(node)))
        two = starts[sizes == 2]
        two = two[np.bitwise_count(prints[two] ^ prints[two + 1]).sum(1, dtype=np.int64) <= c.threshold]
        a, b = [node[two + 1]], [node[two]]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            root = _local_roots(prints[s : s + n], c.threshold)
            other = np.flatnonzero(root != np.arange(n))
            a.append(node[s + other])
            b.append(node[s + root[other]])
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node, prints = np.empty((0, 2), np.int64), np.empty(0, np.int64), np.empty((0, c.width), np.uint64)
        for batch in batches:
            key = np.concatenate([key, np.stack([np.asarray(batch.column("block")).astype(np.int64), np.asarray(batch.column("anchor"))], 1)])
            node = np.concatenate([node, np.asarray(batch.column("node"))])
            prints = np.concatenate([prints, np.stack([np.asarray(batch.column(x)).view(np.uint64) for x in names[1:]], 1)])
            changes = np.flatnonzero((key[1:] != key[:-1]).any(1))
            if len(changes):  # the last group may go on in the next batch
                cut = changes[-1] + 1
                yield found(key[:cut], node[:cut], prints[:cut])
                key, node, prints = key[cut:], node[cut:], prints[cut:]
        if len(node):
            yield found(key, node, prints)

    return met.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, covering: Covering = EXACT_2) -> DataFrame:
    """One row per document: ``doc_id``, the fingerprint's words ``w0, ...`` and ``component_id``, the smallest doc_id it reaches over links.

    Copies go to all anchors within R + ceil(threshold / 2), which meets every pair that R + threshold would (see above).

    Equal fingerprints are one node, so copies cost nothing further. Null and empty texts
    have the fingerprint zero and link like any other; rows that repeat an id each get
    their row; rows without an id get the component of their fingerprint, null if no
    document of it has an id. An empty table gives no rows. Only ``doc_id`` and ``text`` are read.
    """
    names = _words(covering.width)
    prints = common.stored(fingerprints(docs, words, covering.width), "fingerprints")
    node = F.col("w0") if covering.width == 1 else F.xxhash64(*names)
    nodes = common.stored(prints.withColumn("node", node).groupBy("node").agg(F.min("doc_id").alias("first_id"), *(F.first(x).alias(x) for x in names)), "nodes")
    roots = connected_components(links(nodes, covering))
    owned = nodes.select("node", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # written first, so that a component with many nodes is a skewed key that adaptive execution splits
    lowest = common.stored(owned.groupBy("root").agg(F.min("first_id").alias("component_id")), "components")
    labels = owned.select("node", "root").join(lowest, "root").select("node", "component_id")
    # a fingerprint that a third of all documents share is a skewed key, which adaptive execution splits on the documents' side
    return prints.withColumn("node", node).join(labels, "node", "left").select("doc_id", *names, "component_id")


#: Nomination only, so well above the 39 bits by which a similarity of 0.8 differs on average.
NOMINATE_BITS = 60


def nominating(n: int) -> Covering:
    """The covering for ``n`` different texts: blocks of 16 bits, longer ones where anchors would have over 4 texts each on average (from 262,144 on), so that a long list of an anchor isn't one by chance. It decides what work anchors do, and no result (``drop_near_duplicates``)."""
    return wide_covering(threshold=NOMINATE_BITS, block=min(32, max(16, (max(1, n) - 1).bit_length() - 2)))


#: Documents link from this similarity on, in hundredths, counted exactly.
PERCENT = 80
#: Fingerprints of an anchor are compared with one another up to so many; more of them are left to the prefixes.
ANCHOR_LIST = 16


def _marked(docs: DataFrame, words: int, width: int) -> DataFrame:
    """One pass over the texts, two kinds of rows: a row's ``RANK``, ``node`` (a hash of its set of shingles), the words of the set's fingerprint, its size ``n`` and parity ``bits``; and a task's ``jaccard.counted``."""
    names = _words(width)
    schema = "none boolean, id long, row long, node long, " + ", ".join(f"{x} long" for x in names) + ", n int, bits binary, piece int, at binary, times binary"
    every = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(1 << jaccard.BUCKET_BITS, np.int64), set()
        for batch in batches:
            for part in common.chunks(batch, "text"):
                sets = jaccard.shingle_sets(part.column("text"), words)
                digests = [jaccard.digest(x) for x in sets]
                fresh = [x for x, d in zip(sets, digests, strict=True) if not (d in seen or seen.add(d))]
                if fresh:
                    total += jaccard.bucket_counts(fresh)
                node = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)[:, 0]
                prints = np.stack([_majority(x, width) for x in sets]).view(np.int64)
                none = pa.nulls(len(sets), pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in RANK), *(pa.array(np.ascontiguousarray(c)) for c in (node, *prints.T)), pa.array([len(x) for x in sets], pa.int32()), pa.array([verify.parity(x) for x in sets], pa.binary()), pa.nulls(len(sets), pa.int32()), none, none], names=every)
        counts = jaccard.counted(total)
        if len(counts[0]):
            empty = [pa.nulls(len(counts[0]), t) for t in (pa.bool_(), *[pa.int64()] * (3 + width), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*empty, *counts], names=every)

    return docs.select(*ranked(docs), common.text_bytes().alias("text")).mapInArrow(run, schema)


def anchor_pairs(met: DataFrame, c: Covering) -> DataFrame:
    """``a, b`` of all nodes within the threshold of each other at an anchor, from ``replicate``'s rows; an anchor's rows are few."""
    names = ["node", *_words(c.width)]
    dealt = met.repartition("block", "anchor").sortWithinPartitions("block", "anchor", "node")

    def found(key: np.ndarray, node: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
        sizes = np.diff(np.append(starts, len(node)))
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for n in np.unique(sizes[sizes > 1]):  # all groups of one size at once
            rows = starts[sizes == n][:, None] + np.arange(n)
            i, j = np.triu_indices(n, 1)
            for at in range(0, len(rows), max(1, 200_000 // len(i))):
                part = rows[at : at + max(1, 200_000 // len(i))]
                left, right = part[:, i].ravel(), part[:, j].ravel()
                near = np.bitwise_count(prints[left] ^ prints[right]).sum(1, dtype=np.int64) <= c.threshold
                a.append(node[left[near]])
                b.append(node[right[near]])
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node, prints = np.empty((0, 2), np.int64), np.empty(0, np.int64), np.empty((0, c.width), np.uint64)
        for batch in batches:
            key = np.concatenate([key, np.stack([np.asarray(batch.column("block")).astype(np.int64), np.asarray(batch.column("anchor"))], 1)])
            node = np.concatenate([node, np.asarray(batch.column("node"))])
            prints = np.concatenate([prints, np.stack([np.asarray(batch.column(x)).view(np.uint64) for x in names[1:]], 1)])
            changes = np.flatnonzero((key[1:] != key[:-1]).any(1))
            if len(changes):  # the last group may go on in the next batch
                cut = changes[-1] + 1
                yield found(key[:cut], node[:cut], prints[:cut])
                key, node, prints = key[cut:], node[cut:], prints[cut:]
        if len(node):
            yield found(key, node, prints)

    return dealt.mapInArrow(run, "a long, b long")


def _nominated(nodes: DataFrame, c: Covering) -> DataFrame:
    """Pairs ``a, b`` of nodes with nearby fingerprints at an anchor that few share."""
    at = replicate(nodes, c)
    hot = common.stored(at.groupBy("block", "anchor").agg(F.count("*").alias("m")).where(F.col("m") > ANCHOR_LIST).drop("m"), "anchors")
    return anchor_pairs(at.join(hot, ["block", "anchor"], "left_anti"), c).distinct()


def _left_over(met: DataFrame, roots: DataFrame) -> DataFrame:
    """Posting lists ``token, node, l, n, root, m`` of more than one root: what fingerprints linked already needs no list."""
    met = common.stored(met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    spread = met.groupBy("token").agg(F.count("*").alias("m"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token", "m")
    return common.stored(met.join(spread, "token"), "posting-lists")


def drop_near_duplicates(docs: DataFrame, words: int = 5, covering: Covering | None = None) -> DataFrame:
    """One document of each group, all columns kept. Documents link at a similarity of 0.8 or more of their sets of five-word shingles, groups are what links connect.

    Fingerprints at anchors nominate pairs, which are counted exactly. Prefixes (``jaccard``), which two sets that link always share,
    find every link between what the fingerprints left apart. So the groups are those of all pairs, and the covering, whose
    blocks grow with the corpus, moves work from one step to the other and changes no result. The document with the
    smallest id stays, one without an id only where none has one; rows that tie are ordered by a hash
    of all their columns, and of equal rows one stays. Null and empty texts, and texts without words, are one group; a shorter
    text is one shingle. Two texts under one id are two documents. An empty table gives an empty table.
    ``docs`` is read several times and must read alike each time.
    """
    width = covering.width if covering else 4
    mine = common.prefix(docs)
    most = jaccard.MOST_MATCHES
    best = [F.col(f"best.{x}").alias(mine + x) for x in RANK]
    marked = common.stored(_marked(docs, words, width), "marked")
    often = docs.sparkSession.sparkContext.broadcast(jaccard._frequencies(marked))
    rows = marked.where("piece is null")
    nodes = common.stored(rows.groupBy("node").agg(F.min(F.struct(*RANK)).alias("best"), *(F.first(x).alias(x) for x in (*_words(width), "n", "bits"))), "nodes")
    classes = nodes.select(F.col("node").alias("d0"), "n", "bits")
    ends = lambda pairs: pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))

    def sets(needed: DataFrame) -> DataFrame:
        named = nodes.join(needed.distinct(), "node").select("node", F.col("node").alias("class"), *best)
        return common.stored(jaccard.ordered_sets(rows_of(docs, ["text"], named, mine), often, words, most, PERCENT), "sets")

    # what later steps don't read goes as soon as that is certain, so that the disk holds a step's tables and not all of them
    spark, since = docs.sparkSession, common.mark()
    near = common.stored(verify.possible(_nominated(nodes.where("n > 0"), covering or nominating(nodes.count())), classes, PERCENT), "nominated")
    common.release(spark, since, keep=1)
    roots = connected_components(verify.pair_links(near, sets(ends(near)), PERCENT))
    common.release(spark, since, keep=1)
    lists_since = common.mark()
    lists = _left_over(jaccard.shared_postings(docs, often, words, most, PERCENT), roots)
    common.release(spark, lists_since, keep=1)
    headed = common.stored(verify.headed(lists.where(F.col("m") > verify.SHORT_LIST), ["token"]), "headed")
    pairs = common.stored(verify.possible(jaccard._short_candidates(lists, PERCENT), classes, PERCENT), "candidates")
    common.release(spark, lists_since, keep=2)
    whole = sets(ends(pairs).unionByName(headed.select("node")))
    links = verify.pair_links(pairs, whole, PERCENT).unionByName(verify.long_links(headed, whole, PERCENT))
    roots = connected_components(links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    common.release(spark, since, keep=1)
    owned = common.stored(nodes.select("node", "best").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "owned")
    kept = common.stored(owned.groupBy("root").agg(F.min("best").alias("best")).select(*best), "kept")
    return rows_of(docs, docs.columns, kept, mine).drop(*(mine + x for x in RANK))


def hex64(column):
    """A signed long as 16 hexadecimal digits of its unsigned value."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def op6_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", hex64(F.col("w0")).alias("fingerprint"), "component_id")
