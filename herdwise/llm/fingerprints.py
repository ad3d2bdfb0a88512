"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Every shingle is hashed once. The high part of a hash names one of ``BINS`` bins, and a
bin keeps its smallest hash. Empty bins are filled by optimal densification: an empty
bin asks other bins, each chosen by a hash of its own number and the attempt's, until one holds a value,
and borrows that, hashed with its own number (else a text of one shingle would have one
digit many times, and agree with another by luck everywhere at once). Of each bin's value
the lowest four bits are kept, packed as one hexadecimal digit. Two fingerprints agree in a bin with probability J + (1 - J) / 16,
which the likeness corrects for.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORDS = 5
#: Bins, a power of 2; the standard error of a likeness is sqrt(J (1 - J) / BINS), 0.03 at most.
BINS = 256
BITS = 4
#: Word separators.
SPACE = r"[\x20\x09-\x0D]+"
#: Documents that are neighbours in id are dealt out in runs of about this many, or longer where that makes over RUNS_PER_PARTITION runs per shuffle partition.
RUN = 512
RUNS_PER_PARTITION = 4


def _bound(value: Column, f) -> Column:
    """``f(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Sorted 63-bit hashes of the shingles. A shorter text is one shingle; a text without words has the hash of an empty one."""
    own = F.filter(F.split(text, SPACE), lambda w: w != "")

    def hashes(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.shiftrightunsigned(F.xxhash64(*(F.get(w, i + k) for k in range(words))), 1))
        return F.when(F.size(w) >= words, many).otherwise(F.array(F.shiftrightunsigned(F.xxhash64(F.array_join(w, " ")), 1)))

    return F.sort_array(_bound(own, hashes))


def fingerprint(text: Column, words: int = WORDS, bins: int = BINS) -> Column:
    """The packed fingerprint: ``bins`` hexadecimal digits, four bits for each bin."""
    shift = 63 - (bins.bit_length() - 1)
    bin_of = lambda h: F.shiftright(h, shift).cast("int")

    def minima(h: Column) -> Column:
        # sorted, the first hash of each bin is its smallest
        return F.filter(h, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(h, F.greatest(i - 1, F.lit(0))))))

    digit = lambda x: F.lower(F.hex(x.bitwiseAND(F.lit((1 << BITS) - 1))))
    empties = lambda n: F.array_repeat(F.lit(None).cast("long"), n)

    def laid_out(low: Column) -> Column:
        # a value for each filled bin, a null for each empty one
        gap = lambda x, i: bin_of(x) - F.when(i == 0, -1).otherwise(bin_of(F.get(low, F.greatest(i - 1, F.lit(0))))) - 1
        filled = F.transform(low, lambda x, i: F.concat(empties(gap(x, i)), F.array(x)))
        return F.flatten(F.concat(filled, F.array(empties(bins - 1 - bin_of(F.element_at(low, -1))))))

    def densified(value: Column) -> Column:
        def asked(b: Column, first: int, last: int) -> Column:
            place = lambda a: F.hash(b, a).bitwiseAND(F.lit(bins - 1))
            return F.get(F.filter(F.transform(F.sequence(F.lit(first), F.lit(last)), lambda a: F.get(value, place(a))), lambda v: v.isNotNull()), F.lit(0))

        # few bins ask often: the stages are only as long as they need be; where so few are filled that a
        # bin has asked ``bins`` times in vain, its number picks one of them
        stages = [(0, 7), (8, 31), (32, 127), (128, bins - 1)]
        filled = F.filter(value, lambda v: v.isNotNull())
        borrowed = lambda b: F.xxhash64(F.coalesce(*(asked(b, x, y) for x, y in stages), F.get(filled, F.pmod(F.hash(b), F.size(filled)))), b)
        return F.array_join(F.transform(value, lambda v, b: digit(F.when(v.isNotNull(), v).otherwise(borrowed(b)))), "")

    return _bound(_bound(_bound(shingle_hashes(text, words), minima), laid_out), densified)


def likeness(a: Column, b: Column, bins: int = BINS) -> Column:
    """The estimated Jaccard similarity of two fingerprinted texts, corrected for digits that agree by chance; 0 to 1."""
    chance = 1.0 / (1 << BITS)
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return F.greatest(F.lit(0.0), (same / F.lit(float(bins)) - chance) / (1 - chance))


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, fp, next_text, next_fp``: each document beside the next one in descending id, the first after the last.

    One shuffle of the texts, by runs of neighbouring ids. The first document of each run is
    also sent to the end of the run before it, so no row needs another run. Documents
    without an id come last; equal ids are ordered by text, descending. Ids that many
    documents share, and documents without one, make runs of their own: equal rows of them become one
    that counts many times, and the others are dealt into ranges of their texts.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select("doc_id")
    n, nulls, top = ids.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.max("doc_id")).first()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(1, min(n // RUN, RUNS_PER_PARTITION * parts))
    shares = [i / wanted for i in range(1, wanted + 1)]
    found = ids.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * wanted)).alias("p")).first()["p"] or []
    heads = sorted({*found, top} - {None}, reverse=True)
    hot = sorted((x for x, times in Counter(found).items() if times > 1), reverse=True)
    # a number for each run, in order: those of a hot id before those of the smaller ids below it
    at, plain, special = 0, [], {}
    for t in heads:
        if t in hot:
            special[t] = at
            at += parts
        plain.append(at)
        at += 1
    below = F.size(F.filter(F.lit(heads[::256] or [0]), lambda t: t >= F.col("doc_id"))) - 1  # blocks of 256 runs first
    blocks = F.lit([heads[i : i + 256] for i in range(0, len(heads), 256)] or [[0]])
    index = below * 256 + F.size(F.filter(F.get(blocks, below), lambda t: t >= F.col("doc_id"))) - 1
    is_hot = F.col("doc_id").isNull() | F.col("doc_id").isin(hot) if hot else F.col("doc_id").isNull()
    rows = docs.where(~is_hot).select("*", F.get(F.lit(plain or [0]), index).alias("run"), F.lit(1).cast("long").alias("times"))
    if nulls or hot:
        many = docs.where(is_hot).groupBy("doc_id", "text").agg(F.count("*").alias("times"))
        many = common.stored(many.repartitionByRange(parts, F.desc_nulls_last("doc_id"), F.desc("text")).withColumn("part", F.spark_partition_id()), "shared-ids")
        start = F.coalesce(F.create_map(*[F.lit(x) for t, a in special.items() for x in (t, a)])[F.col("doc_id")], F.lit(at)) if special else F.lit(at)
        rows = rows.unionByName(many.select("doc_id", "text", (start + F.col("part")).alias("run"), "times"))
    # the first row of each run, and the run before it (runs without rows are passed over)
    firsts = rows.groupBy("run").agg(F.max(F.struct("doc_id", "text")).alias("first"))
    firsts = common.stored(firsts.select("run", "first.doc_id", "first.text"), "first-of-run")
    runs = firsts.select(F.col("run").alias("r"), F.coalesce(F.lag("run").over(Window.orderBy("run")), F.max("run").over(Window.partitionBy())).alias("before"))
    guests = firsts.join(runs, F.col("run") == F.col("r")).select("doc_id", "text", F.col("before").alias("run"), F.lit(1).cast("long").alias("times"), F.lit(1).alias("guest"))
    fps = rows.withColumn("guest", F.lit(0)).unionByName(guests).withColumn("fp", fingerprint(F.col("text")))
    order = Window.partitionBy("run").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc("text"))
    beside = fps.select("doc_id", "text", "fp", "guest", "times", F.lead("text").over(order).alias("next_text"), F.lead("fp").over(order).alias("next_fp")).where("guest = 0")
    # of rows that are the same, each but the last is followed by its like
    copy = beside.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy"))
    last = F.col("copy") == F.col("times")
    return copy.select("doc_id", "text", "fp", F.when(last, F.col("next_text")).otherwise(F.col("text")).alias("next_text"), F.when(last, F.col("next_fp")).otherwise(F.col("fp")).alias("next_fp"))


def edited(text: Column, other: Column) -> Column:
    """The text with its last third (rounded down) replaced by as many characters from the beginning of another."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(other, F.lit(1), third))


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Null texts count as empty; repeated rows each get theirs; an empty table gives no rows; a single document is its own next one. Whole texts are hashed, whatever their length; only ``doc_id`` and ``text`` are read."""
    rows = with_next(common.read(spark, sf_dir, "documents")).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.col("fp").alias("fingerprint"), "edited_fingerprint", likeness(F.col("fp"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
