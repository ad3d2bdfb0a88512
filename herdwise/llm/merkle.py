"""A Merkle manifest of a dataset by supersteps over RDDs, and the verification of every row against its root.

Each row is a leaf; the leaves of a language, by id, are one tree, and the languages' roots are the
leaves of a last tree. Trees climb in supersteps: a vertex sends its digest to its parent, a parent that
has heard from all its children hashes them and sends on. Vertices live in partitions by the
subtree of ``LEVELS`` levels that they belong to, so the messages of that many supersteps stay
where they are, and then one shuffle carries a single digest per subtree on. Reverse supersteps go back down: a
vertex hands each child its own path to the root with the child's sibling in front, until each leaf
holds what it needs to find the root again.

What a subtree's vertices know is written to the shared folder after every shuffle, so a lost executor costs one round.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import ranked
from . import common

#: Children of a vertex.
ARITY = 2
#: Levels of a subtree that is kept in one place: 1,024 leaves at most.
LEVELS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows are tampered with where this divides the crc32 of their id.
TAMPER_MODULUS = 7

_BLOCKS = "tree string, block long, size long, digests array<string>, ids array<long>, altered array<string>"
_TOPS = "tree string, at long, size long, digest string"


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: dict[str, Column] | None = None) -> Column:
    """The digest of a row: of its fields, ``-`` for null and else byte count, colon and value. ``columns`` replaces some of them."""
    own = {x: F.col(f"`{x}`") for x in FIELDS} | (columns or {})
    return F.sha2(F.concat(*(_field(own[x]) for x in FIELDS)), 256)


def _hash(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def superstep(messages: list[str]) -> list[str]:
    """One superstep of a subtree: neighbours report to their parent, each parent hashes what it got (the last one may have fewer children)."""
    return [_hash(messages[i : i + ARITY]) for i in range(0, len(messages), ARITY)]


def climb(digests: list[str], whole: bool, levels: int = LEVELS) -> list[list[str]]:
    """The digests of a subtree, level by level from its leaves: up to one vertex if it is a ``whole`` tree, else ``levels`` supersteps."""
    out = [digests]
    while len(out[-1]) > 1 if whole else len(out) <= levels:
        out.append(superstep(out[-1]))
    return out


def _descend(levels: list[list[str]], above: str) -> list[str]:
    """For each leaf of a subtree its path to the root, where ``above`` is the path of the subtree's top.

    A path is one step per level: for the siblings to the left ``<`` and the digest each, then ``.``, then ``>`` and the digest of each to the right.
    """
    paths = [above]
    for level in reversed(levels[:-1]):
        down = []
        for i in range(len(level)):
            first = i - i % ARITY
            step = "".join("<" + x for x in level[first:i]) + "." + "".join(">" + x for x in level[i + 1 : first + ARITY])
            down.append(step + paths[i // ARITY])
        paths = down
    return paths


def siblings(path: str) -> list[str]:
    """A path's digests in their order."""
    return path.replace("<", " ").replace(">", " ").replace(".", " ").split()


def fold(digest: str, path: str) -> str:
    """The root that a leaf with this path gives."""
    at, left, right, own = 0, [], [], False
    while at < len(path):
        kind = path[at]
        if own and kind != ">":  # the next level begins
            digest, left, right, own = _hash([*left, digest, *right]), [], [], False
        if kind == ".":
            own, at = True, at + 1
        else:
            (right if own else left).append(path[at + 1 : at + 65])
            at += 65
    return _hash([*left, digest, *right]) if own else digest


def _deal(key: tuple) -> int:
    return zlib.crc32(repr(key).encode())


def _gathered(messages: RDD, parts: int) -> Iterator:
    """Messages ``((tree, block), (place, size, digest, id, altered))`` brought to their subtree: one row of ``_BLOCKS`` each. A group holds ``ARITY ** levels`` messages at most."""

    def row(kv):
        (tree, block), got = kv
        got = sorted(got, key=lambda m: m[0])
        return tree, block, got[0][1], [m[2] for m in got], [m[3] for m in got], [m[4] for m in got]

    return messages.groupByKey(parts, _deal).map(row)


def _climb_all(leaves: RDD, parts: int, spark: SparkSession, name: str, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """(The subtrees of every round, the trees' roots) of leaves ``(tree, place, size of the tree, digest, id, altered)``."""
    width = ARITY**levels
    rounds, roots = [], None
    messages = leaves.map(lambda x: ((x[0], x[1] // width), x[1:]))
    while True:
        blocks = common.stored(spark.createDataFrame(_gathered(messages, parts), _BLOCKS), f"{name}-blocks")
        rounds.append(blocks)

        def up(row):
            top = climb(row.digests, row.size <= width, levels)[-1][0]
            # the tree's root, or a vertex of a tree whose leaves are the subtrees' tops
            return (row.tree, -1, row.size, top) if row.size <= width else (row.tree, row.block, -(-row.size // width), top)

        tops = common.stored(spark.createDataFrame(blocks.rdd.map(up), _TOPS), f"{name}-tops")
        done = tops.where("at < 0")
        roots = done if roots is None else roots.unionByName(done)
        rest = tops.where("at >= 0")
        if rest.isEmpty():
            return rounds, roots
        messages = rest.rdd.map(lambda x: ((x.tree, x.at // width), (x.at, x.size, x.digest, None, None)))


def _descend_all(rounds: list[DataFrame], heads: RDD, parts: int, levels: int) -> RDD:
    """Reverse supersteps: ``heads`` are ``(tree, (path of the root, what goes along))``; gives ``((tree, block), (row of the first round, path of each leaf, what went along))``."""
    width = ARITY**levels
    above = heads.map(lambda x: ((x[0], 0), x[1]))
    for i in range(len(rounds) - 1, -1, -1):
        blocks = rounds[i].rdd.map(lambda r: ((r.tree, r.block), r))

        def step(kv):
            (tree, block), (row, (path, along)) = kv
            return (tree, block), (row, _descend(climb(row.digests, row.size <= width, levels), path), along)

        reached = blocks.join(above, parts).map(step)
        if i:  # a tree that ended in an earlier round has its head there
            below = reached.flatMap(lambda kv: [((kv[0][0], kv[0][1] * width + j), (path, kv[1][2])) for j, path in enumerate(kv[1][1])])
            # block 0 of a tall tree hears from its parent, not from the head
            tall = rounds[i].rdd.map(lambda r: (r.tree, None)).distinct()
            above = above.filter(lambda kv: kv[0][1] == 0).map(lambda kv: (kv[0][0], kv[1])).subtractByKey(tall).map(lambda x: ((x[0], 0), x[1])).union(below)
    return reached


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """One row per document: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``subroot`` is the root of the document's language (null is one, and comes first), ``root`` that of
    all. ``folded_root`` is recomputed from the leaf and the siblings on its path, the leaf being that of a row whose n_chars is one
    higher where ``TAMPER_MODULUS`` divides the crc32 of the id; ``verified`` says that it is the root. Any column may be
    null, texts may be empty or of any length. Rows of a language that repeat an id are ordered by their
    leaf; equal rows are equal leaves, each with its place. ``levels`` of a tree are kept in one place. Rows without an id come first. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(*(F.col(f"`{x}`") for x in FIELDS))
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_MODULUS == 0) & F.col("n_chars").isNotNull()
    altered = F.when(tampered, leaf_digest({"n_chars": F.col("n_chars").cast("long") + 1}))
    hashed = own.select("lang", F.col("doc_id").cast("long").alias("doc_id"), leaf_digest().alias("leaf"), altered.alias("altered"))
    placed = ranked(hashed, ["lang"], [F.col("doc_id").asc_nulls_first(), F.col("leaf")], "leaves")
    leaves = placed.rdd.map(lambda r: (r.lang, r["__rank"] - 1, r["__size"], r.leaf, r.doc_id, r.altered))
    rounds, subroots = _climb_all(leaves, parts, spark, "language", levels)
    # code points order as UTF-8 bytes do
    languages = common.stored(spark.createDataFrame(subroots.rdd.map(lambda r: ((r.tree is not None, r.tree or ""), (r.tree, r.digest))).sortByKey().zipWithIndex().map(lambda x: (*x[0][1], x[1])), "tree string, digest string, at long"), "languages")
    n = languages.count()
    if not n:
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    top = languages.rdd.map(lambda r: (None, r.at, n, r.digest, r.at, r.tree))
    top_rounds, top_roots = _climb_all(top, parts, spark, "top", levels)
    root = top_roots.first().digest  # a single row
    down = _descend_all(top_rounds, spark.sparkContext.parallelize([(None, ("", None))], 1), parts, levels)
    heads = down.flatMap(lambda kv: [(tree, (path, digest)) for tree, digest, path in zip(kv[1][0].altered, kv[1][0].digests, kv[1][1], strict=True)])

    def rows(kv):
        row, paths, subroot = kv[1]
        for doc_id, leaf, other, path in zip(row.ids, row.digests, row.altered, paths, strict=True):
            folded = fold(other or leaf, path)
            yield doc_id, leaf, subroot, root, _hash(siblings(path)), folded, folded == root

    return spark.createDataFrame(_descend_all(rounds, heads, parts, levels).flatMap(rows), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """``manifest`` of all of ``documents``."""
    return manifest(common.read(spark, sf_dir, "documents"))


def _sql_field(c: str) -> str:
    return f"coalesce(strlen(({c})::varchar) || ':' || ({c})::varchar, '-')"


def _sql_leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_sql_field(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"


#: Levels by recursion; crc32 bit by bit over the digits of the id.
OP12_SQL = f"""
with recursive rows_ as (
  select *, coalesce('+' || lang, '-') as lk, {_sql_leaf("n_chars")} as leaf, xor(4294967295, list_reduce(
    list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
    lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end))) as crc from documents),
d as (
  select doc_id, lang, lk, leaf, case when crc % {TAMPER_MODULUS} = 0 and n_chars is not null then {_sql_leaf("n_chars + 1")} else leaf end as altered,
    row_number() over (partition by lk order by doc_id nulls first, leaf) - 1 as pos from rows_),
n as (
  select lk, 0 as level, pos, leaf as h, count(*) over (partition by lk) as size from d
  union all select lk, level + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (any_value(size) + 1) // 2 from n where size > 1 group by lk, level, pos // 2),
sub as (select lk, level as height, h as subroot from n where size = 1),
t as (select lk, subroot, row_number() over (order by lang nulls first) - 1 as place from sub join (select distinct lk, lang from d) using (lk)),
m as (
  select 0 as level, place as pos, subroot as h, count(*) over () as size from t
  union all select level + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (any_value(size) + 1) // 2 from m where size > 1 group by level, pos // 2),
top as (select level as top_height, h as root from m where size = 1),
proofs as (
  select lk, pos, sha256(coalesce(string_agg(h, '' order by step), '')) as proof_sha256 from (
    select x.lk, x.pos, x.level as step, n.h from (select d.lk, pos, unnest(range(height)) as level from d join sub using (lk)) x
      left join n on n.lk = x.lk and n.level = x.level and n.pos = xor(x.pos // (1 << x.level), 1)
    union all select x.lk, x.pos, 1000 + x.level, m.h from (select d.lk, pos, place, unnest(range(top_height)) as level from d join t using (lk), top) x
      left join m on m.level = x.level and m.pos = xor(x.place // (1 << x.level), 1)
    union all select lk, pos, -1, null from d)
  group by lk, pos),
f as (
  select lk, pos as own, 0 as level, pos as p, altered as h from d
  union all select f.lk, own, f.level + 1, p // 2, sha256(case when n.h is null then f.h when p % 2 = 0 then f.h || n.h else n.h || f.h end)
    from f join sub on sub.lk = f.lk and f.level < height left join n on n.lk = f.lk and n.level = f.level and n.pos = xor(p, 1)),
g as (
  select f.lk, own, 0 as level, place as p, h from f join sub on sub.lk = f.lk and f.level = height join t on t.lk = f.lk
  union all select g.lk, own, g.level + 1, p // 2, sha256(case when m.h is null then g.h when p % 2 = 0 then g.h || m.h else m.h || g.h end)
    from g join top on g.level < top_height left join m on m.level = g.level and m.pos = xor(p, 1))
select doc_id, leaf, subroot, root, proof_sha256, g.h as folded_root, g.h = root as verified
from d join sub using (lk) join proofs using (lk, pos) cross join top join g on g.lk = d.lk and g.own = d.pos and g.level = top_height
"""
