"""Mixing sources to target weights by Poisson replication.

A source's documents are repeated ``rate`` times on average, where the rates give
each source its share of the mixture. How often one document is repeated is a
Poisson variable with that mean, drawn by inverting the distribution at a number
hashed from the document's id and the seed: any worker, on any retry, draws the
same. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 20
#: A rate above this is the sum of several equal ones: the distribution's first term, exp(-rate), would get close to the smallest double.
PART_RATE = 700.0
#: Up to so many sources, of at most 9 KB each, are broadcast.
BROADCAST_SOURCES = 2_000


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 13 hexadecimal digits of an MD5 digest: the same in any engine."""
    digits = F.substring(F.md5(F.concat_ws(":", key, F.lit(str(seed)))), 1, 13)
    return F.conv(digits, 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def draws(key: Column, seed: int, parts: Column) -> Column:
    """``parts`` such numbers; the first is ``uniform``'s own."""
    return F.transform(F.sequence(F.lit(1), parts), lambda i: F.when(i == 1, uniform(key, seed)).otherwise(uniform(F.concat_ws(":", key, i), seed)))


def poisson_cdf(rate: Column, n: Column) -> Column:
    """The first ``n`` values of the distribution function, term by term. After rate + 12 sqrt(rate) + 20 of them, what is left lies below the grid of ``uniform``."""
    start = F.struct(F.exp(-rate).alias("term"), F.array(F.exp(-rate)).alias("cdf"))
    return F.aggregate(F.sequence(F.lit(1), n), start, lambda a, k: F.struct((a["term"] * rate / k).alias("term"), F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + a["term"] * rate / k)).alias("cdf")))["cdf"]


def rates(docs: DataFrame, weights: dict[str, float] | None, total: float | None, source: str = "source") -> DataFrame:
    """``source, rate, parts, cdf``: one row per source, its mean number of repetitions, as the sum of how many equal means it is drawn, and the distribution function of one of those.

    ``weights`` are relative; a source that isn't named gets 0, and without weights all
    sources weigh the same. ``total`` is the number of rows to aim at, as many as there are by
    default. Sizes are counted over all documents, combined before the one small shuffle.
    """
    sizes = docs.groupBy(F.coalesce(F.col(source), F.lit("")).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.lit(1.0))
    else:
        pairs = [x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(float(v)))]
        weighed = sizes.withColumn("weight", F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(0.0)) if pairs else F.lit(0.0))
    weighed = common.stored(weighed, "sources")
    weight_sum, n_sum = weighed.agg(F.sum("weight"), F.sum("n").cast("double")).first()
    share = F.col("weight") / F.lit(weight_sum) if weight_sum else F.lit(0.0)
    rated = weighed.select("source", (share * F.lit(float(total if total is not None else n_sum or 0)) / F.col("n")).alias("rate"))
    rated = rated.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_RATE)).cast("int"))
    part = F.col("rate") / F.col("parts")
    return rated.withColumn("cdf", poisson_cdf(part, F.ceil(part + 12 * F.sqrt(part) + 20).cast("int")))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, seed: int = SEED, source: str = "source", key: str = "doc_id") -> DataFrame:
    """Every column of ``docs``, with ``copy`` (1, 2, ...) and ``position`` (the sort key of the global shuffle), one row per repetition, in shuffled order.

    Documents with a null id draw by the digest of their text; a null source is the source
    named ''. Rows that repeat an id draw the same number each. Columns that are called
    ``copy`` or ``position`` are replaced. An empty table gives an empty table.
    """
    docs = docs.drop("copy", "position")
    by_source = common.stored(rates(docs.select(source), weights, total, source), "rates")
    if by_source.count() <= BROADCAST_SOURCES:  # beyond that a shuffled join, whose skewed sources adaptive execution splits
        by_source = F.broadcast(by_source)
    identity = F.coalesce(F.col(key).cast("string"), F.sha2(F.col("text"), 256), F.lit(""))
    # the document as one struct, so that no column of it can clash with what is worked out beside it
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.coalesce(F.col(source), F.lit("")).alias("source"), identity.alias("id"))
    # a sum of independent Poisson variables is one of the summed mean
    count = F.aggregate("u", F.lit(0), lambda n, u: n + F.size(F.filter("cdf", lambda c: u >= c)))
    drawn = rows.join(by_source, "source").withColumn("u", draws(F.col("id"), seed, F.col("parts"))).withColumn("n", count).where("n > 0")
    copies = drawn.select("doc", "id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    position = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id"), F.col("copy"), F.lit(f"{seed} order"))), 1, 13), 16, 10).cast("long")
    placed = copies.select("doc", "copy", position.alias("position"))
    # positions are uniform over 52 bits: equal parts of them, sorted inside, are the global order, and nothing is sampled first
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartitionById(parts, F.floor(F.col("position") / F.lit(float(1 << 52)) * parts).cast("int"))
    return dealt.sortWithinPartitions("position", f"doc.{key}", "copy").select("doc.*", "copy", "position")


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(common.read(spark, sf_dir, "documents"))


OP10_SQL = f"""
with recursive sizes as (select coalesce(source, '') as source, count(*) as n from documents group by 1),
rates as (select source, (1.0::double / (select sum(1.0::double) from sizes)) * (select sum(n)::double from sizes) / n as rate from sizes),
terms as (
  select source, rate, 0 as k, exp(-rate) as term, exp(-rate) as cdf from rates
  union all
  select source, rate, k + 1, term * rate / (k + 1), cdf + term * rate / (k + 1) from terms where k < ceil(rate + 12 * sqrt(rate) + 20)
),
drawn as (select d.*, ('0x' || md5(d.doc_id::varchar || ':{SEED}')[1:13])::bigint::double / {1 << 52}::double as u from documents d),
counted as (select d.doc_id, count(*) as times from drawn d join terms t on coalesce(d.source, '') = t.source and d.u >= t.cdf group by d.doc_id),
copies as (select doc_id, unnest(range(1, times + 1))::int as copy from counted)
select d.*, c.copy, ('0x' || md5(d.doc_id::varchar || ':' || c.copy || ':{SEED} order')[1:13])::bigint as position from documents d join copies c using (doc_id)
"""
