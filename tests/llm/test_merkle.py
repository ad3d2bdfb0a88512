import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from herdwise.llm import merkle

from helpers import awkward, docs, empty


def sha(x):
    return hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()


def leaf_of(r, more=0):
    def field(v):
        if v is None:
            return "-"
        return f"{len(str(v).encode())}:{v}"

    n = r["n_chars"]
    return sha("".join(field(x) for x in (r["doc_id"], r["source"], r["lang"], None if n is None else n + more, r["text"])))


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def path_of(levels, i):
    """(siblings, how to fold) from a leaf up."""
    out = []
    for level in levels[:-1]:
        first = i - i % 2
        out.append((level[first:i], level[i + 1 : first + 2]))
        i //= 2
    return out


def folded(x, path):
    for left, right in path:
        x = sha("".join([*left, x, *right]))
    return x


def brute(rows):
    """Plain trees of lists, in the rows' own words."""
    if not rows:
        return []
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    sort = lambda own: sorted(own, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
    own = {lang: (sort(trees[lang]), levels_of([leaf_of(r) for r in sort(trees[lang])])) for lang in order}
    top = levels_of([own[lang][1][-1][0] for lang in order])
    root, out = top[-1][0], []
    for k, lang in enumerate(order):
        for i, r in enumerate(own[lang][0]):
            path = path_of(own[lang][1], i) + path_of(top, k)
            bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            f = folded(leaf_of(r, int(bad)), path)
            out.append((r["doc_id"], leaf_of(r), own[lang][1][-1][0], root, sha("".join(x for a, b in path for x in a + b)), f, f == root))
    return sorted(out, key=repr)


def found(df, **kw):
    return sorted((tuple(r) for r in merkle.manifest(df, **kw).collect()), key=repr)


def some(spark, n, langs=("en", "de", None, "fr", "é", "z"), seed=1):
    rng = random.Random(seed)
    return docs(spark, [(i * 7 + rng.randrange(7), f"text {i} " * rng.randrange(4), rng.choice(langs), rng.choice(["a", None, "b"])) for i in range(n)])


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100])
def test_equals_plain_trees(spark, n):
    df = some(spark, n)
    want = brute([r.asDict() for r in df.collect()])
    assert found(df) == want
    assert n < 50 or {x[-1] for x in want} == {True, False}


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_many_rounds_of_supersteps(spark, levels):
    """Small subtrees, so that trees of different heights climb several rounds and come down again."""
    df = some(spark, 45, ("en",) * 8 + ("de", None, "x", "y", "z", "w", "v"))
    assert found(df, levels=levels) == brute([r.asDict() for r in df.collect()])


def test_awkward_rows(spark):
    df = awkward(spark).withColumn("n_chars", F.when(F.col("doc_id") != 4, F.col("n_chars"))).cache()
    assert found(df) == brute([r.asDict() for r in df.collect()])
    assert found(empty(spark)) == []


def test_tampering_shows(spark):
    df = some(spark, 300, ("en", "de"))
    for r in merkle.manifest(df).collect():
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0)
        assert r.verified == (r.folded_root == r.root)
    before = merkle.manifest(df).first().root
    assert merkle.manifest(df.withColumn("text", F.when(F.col("doc_id") % 97 == 0, "other").otherwise(F.col("text")))).first().root != before
    assert merkle.manifest(df.repartition(3, "text")).first().root == before


def test_a_row_of_nothing(spark):
    df = docs(spark, [(None, None, None, None)])
    (r,) = merkle.manifest(df).collect()
    assert r.leaf == sha("-----") and r.root == r.subroot == r.leaf == r.folded_root and r.proof_sha256 == sha("") and r.verified


def test_paths_fold():
    leaves = [sha(str(i)) for i in range(11)]
    levels = merkle.climb(leaves, True)
    paths = merkle._descend(levels, "")
    assert len(levels[-1]) == 1
    assert {merkle.fold(x, p) for x, p in zip(leaves, paths, strict=True)} == {levels[-1][0]}
    assert merkle.siblings(paths[0])[0] == leaves[1] and merkle.siblings(paths[10]) == [levels[1][4], levels[3][0]]
