"""Benchmark decontamination with a positional inverted index.

The index is partitioned by document, in segments of a few MB of text: a segment holds
the postings of all its terms, each term's positions in a row, and is written once as Parquet.
It knows nothing of any benchmark, so the next one is looked up in the same index. Corpus
counts of a benchmark's terms come from it. A benchmark window is then looked up from its
rarest term: the term's positions, minus its offset in the window, are the candidate starts, and
each further term's offset-adjusted postings are intersected with them, rarest first. What is
left are exact phrase matches; a looser lookup gives proximity matches.

The terms and windows of the benchmark go to every task while the benchmark is
smaller than ``BROADCAST_BYTES`` (its size is measured first). Beyond that the
same lookups run as joins of the full postings with the windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Consecutive words of an item that make a window.
WINDOW = 10
#: Benchmark text up to this size is looked up by broadcast, larger ones by joins.
BROADCAST_BYTES = 8 << 20
#: Bytes of text in a segment of the index (one document at least): a row of some 200 KB, which Java's heap holds without ado.
SEGMENT_BYTES = 256 << 10
#: A writer holds a row group in memory, a reader all rows of one (up to 4,096 rows, a segment each) at once: groups of a few segments, whose size is looked at from the first row on.
INDEX_OPTIONS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}
#: Candidate starts that a task looks at together.
CANDIDATES = 1 << 20

#: Lower-cases A-Z and turns every byte that is in no word into a space; bytes from 0x80 on are parts of word characters.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: The same for Spark's regular expressions, on text whose A-Z are lower-cased.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

INDEX_SCHEMA = "doc_ids array<long>, hashes array<long>, sizes array<int>, terms array<binary>, ends array<int>, positions array<int>"
MATCH_SCHEMA = "doc_id long, text_hash long, n_words int, n_hit int, items array<string>, starts array<int>, lengths array<int>"


def words(text: bytes) -> list[bytes]:
    """The words of a text given as UTF-8."""
    return text.translate(WORD_BYTES).split()


class Windows:
    """The distinct windows of a benchmark: term numbers, offsets and the items that have them; a row of numbers for each."""

    def __init__(self, items: list[tuple[str, bytes]], n: int = WINDOW):
        number: dict[bytes, int] = {}
        self.n, self.item_ids = n, sorted({i for i, _ in items})
        item_of = {i: k for k, i in enumerate(self.item_ids)}
        rows, owners = [np.empty((0, n), np.int32)], [np.empty(0, np.int64)]
        for item, text in items:
            ids = np.array([number.setdefault(w, len(number)) for w in words(text)], np.int32)
            if len(ids) >= n:
                rows.append(np.lib.stride_tricks.sliding_window_view(ids, n))
            elif len(ids):
                rows.append(np.append(ids, np.full(n - len(ids), -1, np.int32))[None])
            owners.append(np.full(len(rows[-1]) if len(ids) else 0, item_of[item]))
        self.vocabulary = list(number)
        flat, owner = np.ascontiguousarray(np.concatenate(rows)), np.concatenate(owners)
        _, first, which = np.unique(flat.view(np.dtype((np.void, 4 * n))).ravel(), return_index=True, return_inverse=True)
        self.terms = flat[first]
        self.lengths = (self.terms >= 0).sum(1)
        self.offsets = np.broadcast_to(np.arange(n, dtype=np.int8), self.terms.shape)
        pairs = np.unique(which * max(1, len(self.item_ids)) + owner)
        window, self.item_of = np.divmod(pairs, max(1, len(self.item_ids)))
        self.item_start = np.searchsorted(window, np.arange(len(self.terms) + 1))

    def rarest_first(self, counts: np.ndarray) -> None:
        """Order each window's terms by how often the corpus has them; windows with an unseen term can't occur and go."""
        rank = np.where(self.terms < 0, np.iinfo(np.int64).max, counts[self.terms] if len(counts) else 0)
        order = np.argsort(rank, axis=1, kind="stable")
        self.terms, self.offsets = np.take_along_axis(self.terms, order, 1), np.take_along_axis(self.offsets, order, 1)
        self.live = np.flatnonzero(np.take_along_axis(rank, order, 1)[:, 0] > 0) if len(rank) else np.empty(0, np.int64)


def build_index(docs: DataFrame) -> DataFrame:
    """One row per segment: its documents (ids, hashes of their texts, numbers of words), its distinct terms, and the postings of all terms, one after the other.

    ``ends`` says where each term's postings end. Positions count through the segment's documents, which lie end to end with one place between them. No shuffle.
    """

    def segment(part: pa.RecordBatch) -> pa.RecordBatch:
        number: dict[bytes, int] = {}
        own = [[number.setdefault(w, len(number)) for w in words(t)] for t in part.column("text").to_pylist()]
        sizes = np.array([len(x) for x in own], np.int32)
        ids = np.fromiter((t for x in own for t in x), np.int32, int(sizes.sum()))
        places = np.arange(len(ids), dtype=np.int32) + np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        ends = np.cumsum(np.bincount(ids, minlength=len(number))).astype(np.int32)
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        lists = [one(part.column("doc_id").to_pylist(), pa.int64()), one(part.column("text_hash").to_pylist(), pa.int64()), one(sizes, pa.int32()), one(list(number), pa.binary()), one(ends, pa.int32()), one(places[np.argsort(ids, kind="stable")], pa.int32())]
        return pa.RecordBatch.from_arrays(lists, names=["doc_ids", "hashes", "sizes", "terms", "ends", "positions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.chunks(batch, "text", SEGMENT_BYTES):
                yield segment(part)

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), common.text_bytes().alias("text")).mapInArrow(run, INDEX_SCHEMA)


def _slots(row: dict, terms: pa.Array) -> np.ndarray:
    """Where each of the benchmark's terms is among the segment's; -1 where it is not."""
    at = pc.index_in(row["terms"].values, value_set=terms)
    out = np.full(len(terms), -1, np.int64)
    some = np.flatnonzero(np.asarray(at.is_valid()))
    out[np.asarray(at.take(pa.array(some)))] = some
    return out


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}


def term_counts(index: DataFrame, vocabulary: list[bytes]) -> np.ndarray:
    """How often the corpus has each of the terms; one number per benchmark term and task comes back. Reads no positions."""
    shared = index.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(shared.value, pa.binary())
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for row in _rows(batch):
                slots = _slots(row, terms)
                some = slots >= 0
                total[some] += np.diff(np.asarray(row["ends"].values), prepend=0)[slots[some]]
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], names=["term", "n"])

    counts = np.zeros(len(vocabulary), np.int64)
    for term, n in index.select("terms", "ends").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n")).collect():
        counts[term] = n
    return counts


def _candidates(keys: np.ndarray, span: int, slots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of ``slots``, place of its rarest term), so many at a time; ``slots`` are the terms, in this segment, of the windows that it has all terms of."""
    first = slots[:, 0]
    lo, hi = np.searchsorted(keys, first * span), np.searchsorted(keys, (first + 1) * span)
    some = np.flatnonzero(hi > lo)
    at = 0
    while at < len(some):
        n = (hi - lo)[some[at:]]
        take = max(1, int(np.searchsorted(np.cumsum(n), CANDIDATES)))
        block, n = some[at : at + take], n[:take]
        at += take
        row = np.repeat(block, n)
        places = np.repeat(lo[block], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        yield row, keys[places] - slots[row, 0] * span


def phrase_starts(keys: np.ndarray, span: int, slots: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``slots``, start) of every exact occurrence, by intersecting offset-adjusted posting lists from the rarest term on."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for row, place in _candidates(keys, span, slots):
        start = place - offsets[row, 0]
        for j in range(1, slots.shape[1]):
            term = slots[row, j]
            wanted = term * span + start + offsets[row, j]
            i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            keep = (term < 0) | (keys[i] == wanted)
            row, start = row[keep], start[keep]
        found.append((row, start))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def near_starts(keys: np.ndarray, span: int, slots: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``slots``, place of its rarest term) wherever all other terms of the window stand within ``slop`` words of it, in any order."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for row, place in _candidates(keys, span, slots):
        for j in range(1, slots.shape[1]):
            term = slots[row, j]
            low = term * span + place - slop
            i = np.minimum(np.searchsorted(keys, low), len(keys) - 1)
            keep = (term < 0) | ((keys[i] >= low) & (keys[i] <= low + 2 * slop))
            row, place = row[keep], place[keep]
        found.append((row, place))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def match(index: DataFrame, w: Windows, slop: int | None = None) -> DataFrame:
    """One row per indexed document: the words that occurrences of windows cover, the items they belong to, and where they start.

    With ``slop`` it returns proximity matches: ``starts`` are then the places of each
    window's rarest term, and the words covered are those within ``slop`` of it.
    """
    shared = index.sparkSession.sparkContext.broadcast(w)
    gap = 1 if slop is None else 2 * slop + 1

    def one(row: dict, w: Windows, terms: pa.Array) -> pa.RecordBatch:
        sizes, ends, positions = (np.asarray(row[c].values).astype(np.int64) for c in ("sizes", "ends", "positions"))
        # documents stand one place apart; proximity asks for more
        stored, bases = np.cumsum(sizes + 1) - sizes - 1, np.cumsum(sizes + gap) - sizes - gap
        if gap > 1 and len(positions):
            positions += (bases - stored)[np.searchsorted(stored, positions, "right") - 1]
        span = int((sizes + gap).sum()) + gap + w.n
        counts = np.diff(ends, prepend=0)
        here = np.append(_slots(row, terms), -2)  # -2: a shorter window has no such term
        live = w.live[here[w.terms[w.live, 0]] >= 0]  # most windows go for want of their rarest term
        slots = here[w.terms[live]]
        live, slots = live[(slots != -1).all(1)], slots[(slots != -1).all(1)]
        if not len(positions) or not len(live):
            window, start = np.empty(0, np.int64), np.empty(0, np.int64)
        else:
            keys = np.repeat(np.arange(len(counts)), counts) * span + positions  # in order as they are stored
            at, start = phrase_starts(keys, span, slots, w.offsets[live]) if slop is None else near_starts(keys, span, slots, slop)
            window = live[at]
        order = np.argsort(start, kind="stable")
        window, start = window[order], start[order]
        doc = np.searchsorted(bases, start, "right") - 1
        low, high = (start, start + w.lengths[window]) if slop is None else (np.maximum(start - slop, bases[doc]), np.minimum(start + slop + 1, bases[doc] + sizes[doc]))
        edges = np.bincount(low, minlength=span + 1).astype(np.int64) - np.bincount(high, minlength=span + 1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(edges) > 0)])
        n_hit = covered[bases + sizes] - covered[bases]
        per_window = w.item_start[window + 1] - w.item_start[window]
        item = w.item_of[np.repeat(w.item_start[window], per_window) + np.arange(per_window.sum()) - np.repeat(np.cumsum(per_window) - per_window, per_window)]
        pairs = np.unique(np.repeat(doc, per_window) * len(w.item_ids) + item) if len(item) else np.empty(0, np.int64)
        items = [[] for _ in sizes]
        for p in pairs:
            items[p // len(w.item_ids)].append(w.item_ids[p % len(w.item_ids)])
        ends = pa.array(np.searchsorted(doc, np.arange(len(sizes) + 1)), pa.int32())
        starts = pa.ListArray.from_arrays(ends, pa.array((start - bases[doc]).astype(np.int32)))
        lengths = pa.ListArray.from_arrays(ends, pa.array((high - low).astype(np.int32)))
        return pa.RecordBatch.from_arrays([row["doc_ids"].values, row["hashes"].values, row["sizes"].values, pa.array(n_hit, pa.int32()), pa.array(items, pa.list_(pa.string())), starts, lengths], names=[x.split()[0] for x in MATCH_SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        terms = pa.array(w.vocabulary, pa.binary())
        for batch in batches:
            for row in _rows(batch):
                yield one(row, w, terms)

    return index.mapInArrow(run, MATCH_SCHEMA)


def _tokens(df: DataFrame, text: str):
    # F.lower would also change letters outside A-Z
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, NO_WORD), lambda w: w != "")


def match_by_joins(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, slop: int | None = None) -> DataFrame:
    """What ``build_index`` and ``match`` give, for a benchmark of any size: postings and windows meet in joins on terms."""
    rows = common.stored(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), _tokens(docs, "text").alias("w"), F.monotonically_increasing_id().alias("row")), "tokens")
    postings = rows.select("row", F.posexplode("w").alias("at", "term"))
    items = benchmark.select(F.col("item_id").cast("string"), _tokens(benchmark, "text").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - n))
    windows = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, n))).alias("window"))
    windows = windows.groupBy("window").agg(F.collect_set("item_id").alias("items")).select("items", "window", F.sha2(F.array_join("window", " "), 256).alias("id"), F.size("window").alias("length"))
    windows = common.stored(windows, "windows")
    terms = windows.select("id", "length", F.posexplode("window").alias("offset", "term"))
    counts = postings.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").count()
    rarest = terms.join(counts, "term").withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("count", "offset"))).where("k = 1")
    candidates = postings.join(rarest.select("id", "length", "offset", "term"), "term").select("row", "id", "length", "at", "offset")
    if slop is None:
        needed = candidates.select("row", "id", "length", (F.col("at") - F.col("offset")).alias("start")).where("start >= 0")
        needed = needed.join(terms.drop("length"), "id").select("row", "id", "length", "start", "term", (F.col("start") + F.col("offset")).alias("at"))
        hits = needed.join(postings, ["row", "at", "term"]).groupBy("row", "id", "length", "start").count().where("count = length")
        hits = hits.withColumn("words", F.col("length"))
    else:
        # places in stretches of slop + 1 words: what is near is in the same stretch or in a neighbouring one
        stretch = lambda c: F.floor(c / (slop + 1))
        needed = candidates.withColumnRenamed("at", "place").drop("offset").join(terms.drop("length"), "id")
        needed = needed.withColumn("stretch", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda o: stretch(F.col("place")) + o)))
        met = needed.join(postings.withColumn("stretch", stretch(F.col("at"))), ["row", "term", "stretch"]).where(F.abs(F.col("at") - F.col("place")) <= slop)
        near = met.groupBy("row", "id", "length", "place").agg(F.size(F.collect_set("offset")).alias("found")).where("found = length")
        size = rows.select("row", F.size("w").alias("size"))
        low = F.greatest(F.lit(0), F.col("place") - slop)
        hits = near.join(size, "row").select("row", "id", low.alias("start"), (F.least(F.col("size"), F.col("place") + slop + 1) - low).alias("words"))
    hits = common.stored(hits.join(windows.select("id", "items"), "id").select("row", "start", F.col("words").alias("length"), "items"), "hits")
    covered = hits.select("row", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("at")).distinct().groupBy("row").agg(F.count("*").cast("int").alias("n_hit"))
    # an item and a document may meet at many places: each pair once
    owners = hits.select("row", F.explode("items").alias("item")).distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    places = hits.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("p"))
    none = F.array().cast("array<string>")
    out = rows.select("row", "doc_id", "text_hash", F.size("w").alias("n_words")).join(covered, "row", "left").join(owners, "row", "left").join(places, "row", "left")
    return out.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("p.start", F.array().cast("array<int>")).alias("starts"), F.coalesce("p.length", F.array().cast("array<int>")).alias("lengths"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, slop: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: ``doc_id, text_hash, n_words, n_hit, items, starts, lengths``.

    Null and empty texts have no words and are never hit; an item without words has no
    window; a benchmark row without an ``item_id`` is an item named ''; repeated documents
    each get their row, and windows that several items have count for each; an empty benchmark hits
    nothing; other columns are not read. ``slop`` asks for proximity matches.
    """
    benchmark = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), common.text_bytes().alias("text"))
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > broadcast_bytes:
        return match_by_joins(docs, benchmark.withColumn("text", F.col("text").cast("string")), n, slop)
    return look_up(common.stored(build_index(docs), "postings", INDEX_OPTIONS), benchmark, n, slop)


def look_up(index: DataFrame, benchmark: DataFrame, n: int = WINDOW, slop: int | None = None) -> DataFrame:
    """The matches of a benchmark (``item_id, text``; of a size that was checked) in a stored index."""
    w = Windows([(r[0], bytes(r[1])) for r in benchmark.collect()], n)
    w.rarest_first(term_counts(index, w.vocabulary))
    return match(index, w, slop)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """The documents without any occurrence of a benchmark window, all columns kept. Rows with the same id and text share their fate."""
    hit = find_contamination(docs, benchmark, n).where("n_hit > 0").select("doc_id", "text_hash").distinct()
    # the document as one struct, so that no column of it can clash with the keys
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    return rows.join(hit, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left_anti").select("doc.*")


def op2_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("n_words").cast("long"), F.col("n_hit").cast("long"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: DuckDB: windows by brute force; \p{..} isn't needed as bytes from 0x80 on are word characters either way.
OP2_SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (select coalesce(item_id::varchar, '') as item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
bw as (select distinct item_id, array_to_string(w[i:i+9], ' ') as k, least(len(w), 10) as n from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, i, n, array_to_string(w[i:i+n-1], ' ') as k from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
hits as (select doc_id, i, dw.n, item_id from dw join bw on dw.k = bw.k and dw.n = bw.n),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as s from (select distinct doc_id, item_id::varchar as x from hits) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join its using (doc_id)
"""
