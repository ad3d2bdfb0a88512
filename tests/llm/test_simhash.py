import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from helpers import awkward, docs, empty
from herdwise.llm import components
from herdwise.llm import simhash as S
from herdwise.llm import verify


def slow_fingerprint(text):
    w = text.translate({i: i + 32 for i in range(65, 91)}).encode().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("text", ["", "a", "A b", "a b c", "É Z a\x0bb\tc " * 200, "x " * 1000])
def test_fingerprints(text):
    assert int(S.fingerprint(text.encode())[0]) == slow_fingerprint(text)


def test_every_pair_within_two_bits_meets_at_an_anchor():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for _ in range(3):
        a, b = rng.integers(0, 63, (2, 300)).astype(np.uint64)
        y = x ^ (np.uint64(1) << a) ^ (np.uint64(1) << b)
        sets = []
        for v in (x, y):
            row, anchor = S._anchors(v & np.uint64((1 << 63) - 1), 63, 2)
            assert (np.bitwise_count(anchor ^ (v & np.uint64((1 << 63) - 1))[row]) <= 2).all()
            sets.append([set(anchor[row == i].tolist()) for i in range(300)])
        assert all(p & q for p, q in zip(*sets, strict=True))


def brute(nodes, threshold):
    left, root = set(range(len(nodes))), {}
    while left:
        first = min(left)
        todo = [first]
        left.discard(first)
        while todo:
            i = todo.pop()
            root[i] = first
            near = [j for j in left if (nodes[i] ^ nodes[j]).bit_count() <= threshold]
            left.difference_update(near)
            todo += near
    return root


def test_links_connect_what_all_pairs_would(spark):
    rng = random.Random(1)
    nodes = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(300):  # chains and dense clumps
        v = rng.choice(nodes)
        for _ in range(rng.randrange(1, 4)):
            v ^= 1 << rng.randrange(64)
        nodes.append(v)
    nodes = sorted(set(nodes))
    signed = [v - (1 << 64) if v >> 63 else v for v in nodes]
    edges = S.links(spark.createDataFrame([(v, v) for v in signed], "node long, w0 long"), S.EXACT_2)
    got = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    want = brute(nodes, 2)
    groups = {}
    for i, r in want.items():
        groups.setdefault(r, set()).add(signed[i])
    for g in groups.values():
        assert {got.get(v, v) for v in g} == {min(g)}


def test_components_of_a_long_chain(spark):
    n = 300
    ids = list(range(n))
    random.Random(2).shuffle(ids)
    edges = spark.createDataFrame([(ids[i], ids[i + 1]) for i in range(n - 1)] + [(1000, 1001), (5000, 5000)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    assert {got[i] for i in range(n)} == {0} and got[1001] == 1000 and 5000 not in got


def test_awkward_rows(spark):
    got = S.near_duplicates(awkward(spark)).collect()
    assert len(got) == awkward(spark).count()
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[2] == by[3] == by[1] == 1 and by[4] == by[5] == 4 and by[6] == 6
    assert S.near_duplicates(empty(spark)).count() == 0
    kept = S.drop_near_duplicates(awkward(spark))
    assert kept.columns == awkward(spark).columns
    # of the rows without an id one has a text of its own, the other has none like documents 1 to 3
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == [1, 4, 6, 7, 8, None]
    assert S.drop_near_duplicates(empty(spark)).count() == 0


def test_wide_fingerprints_catch_near_copies_and_leave_others(spark):
    rng = random.Random(4)
    rows, copies = [], []
    for i in range(60):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(80, 400))]
        rows.append((i, " ".join(w)))
        v = list(w)
        for _ in range(max(1, len(w) // 80)):
            v[rng.randrange(len(v))] = "changed"
        copies.append((1000 + i, " ".join(v)))
    kept = {r["doc_id"] for r in S.drop_near_duplicates(docs(spark, rows + copies)).collect()}
    assert set(range(60)) <= kept and len(kept) <= 63


def test_the_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefgh") for _ in range(40)) for _ in range(12)]
    texts = [b if rng.random() < 0.5 else b + " z" for b in base for _ in range(4)] + ["", "Q"]
    docs(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in S.op6_simhash_near_dedup(spark, str(tmp_path)).collect()}
    prints = [slow_fingerprint(t) for t in texts]
    want = brute(prints, 2)
    for i, p in enumerate(prints):
        assert got[i]["fingerprint"] == f"{p:016x}" and got[i]["component_id"] == want[i]


def jaccard(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


def pair_at(rng, n, shared):
    """Two texts of n shingles each of which ``shared`` are in both: the second goes on with other words."""
    a = [f"w{rng.randrange(10**6)}" for _ in range(n + 4)]
    return " ".join(a), " ".join(a[: shared + 4] + [f"v{rng.randrange(10**6)}" for _ in range(n - shared)])


def test_pairs_at_the_limit_are_dropped_and_pairs_below_stay_whatever_their_length(spark):
    rng, rows, want = random.Random(7), [], set()
    for i in range(240):
        n = rng.choice([9, 18, 45, 180, 360])
        a, b = pair_at(rng, n, 8 * n // 9 if i % 2 else 8 * n // 9 - max(1, n // 90))
        assert (jaccard(a, b) >= 0.8) == bool(i % 2)
        rows += [(2 * i, a), (2 * i + 1, b)]
        want |= {2 * i} if i % 2 else {2 * i, 2 * i + 1}
    short = [f"s{j}" for j in range(9)]
    rows += [(1000, " ".join(short)), (1001, " ".join(short[:8]))]  # four of five shingles
    got = {r["doc_id"] for r in S.drop_near_duplicates(docs(spark, rows)).collect()}
    assert got == want | {1000}


@pytest.mark.parametrize(("short", "anchor", "rows"), [(16, 64, 256), (1, 1, 8), (1, 1, 3), (2, 64, 5)])
def test_long_lists_link_as_all_pairs_do(spark, monkeypatch, short, anchor, rows):
    """Groups of near copies, a template that half of all texts share, and links that only chain."""
    monkeypatch.setattr(verify, "SHORT_LIST", short)
    monkeypatch.setattr(verify, "BLOCK_ROWS", rows)
    monkeypatch.setattr(S, "ANCHOR_LIST", anchor)
    rng = random.Random(21)
    texts = [t for _ in range(10) for t in pair_at(rng, 90, 85)]
    base = [f"b{i}" for i in range(104)]
    for _ in range(30):
        own = list(base)
        for _ in range(rng.randrange(5)):
            own[rng.randrange(104)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    template = [f"t{i}" for i in range(40)]
    texts += [" ".join(template + [f"x{rng.randrange(10**6)}" for _ in range(60)]) for _ in range(30)]
    rng.shuffle(texts)
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and jaccard(texts[i], texts[j]) >= 0.8:
                root = [root[j] if r == root[i] else r for r in root]
    want = {min(i for i in range(len(texts)) if root[i] == r) for r in set(root)}
    assert {r["doc_id"] for r in S.drop_near_duplicates(docs(spark, list(enumerate(texts)))).collect()} == want


def test_pieces_of_one_group_are_dealt_to_many_tasks(spark, monkeypatch):
    """One head's group of many blocks, whether its block count is joined by broadcast or by a shuffle."""
    monkeypatch.setattr(verify, "BLOCK_ROWS", 4)
    rng = random.Random(9)
    sets = [[(i, i, sorted({hash(tuple(t.split()[k : k + 5])) for k in range(len(t.split()) - 4)}))] for i, t in enumerate(t for _ in range(12) for t in pair_at(rng, 45, 40))]
    table = spark.createDataFrame([(*x[0], 1, len(x[0][2])) for x in sets], "node long, class long, own array<long>, l int, n int")
    met = table.select(F.lit(0).cast("long").alias("head"), "node")
    for threshold in ("10MB", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            found = verify.long_links(met, table, 80)
            plan = found._jdf.queryExecution().executedPlan().toString()
            got = {tuple(sorted(map(int, r))) for r in found.collect()}
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert got == {(2 * i, 2 * i + 1) for i in range(12)}
        pieces = plan[plan.index("FlatMapGroupsInArrow") :]
        dealt = next(line for line in pieces.splitlines() if "Exchange hashpartitioning" in line)
        assert "i#" in dealt and "j#" in dealt, plan


def test_a_repeated_id_loses_only_its_near_copy(spark):
    rng = random.Random(3)
    a, b = pair_at(rng, 45, 44)
    c, _ = pair_at(rng, 45, 40)
    got = S.drop_near_duplicates(docs(spark, [(1, a), (2, b), (2, c)])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, a), (2, c)]


def test_both_radii_give_equal_components(spark):
    rng = random.Random(12)
    nodes = [rng.getrandbits(64) for _ in range(15)]
    nodes += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in rng.choices(nodes, k=25)]
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in nodes})
    table = spark.createDataFrame([(v, v) for v in signed], "node long, w0 long")
    found = []
    for radius in (2, 3):
        edges = S.links(table, S.Covering(2, radius, (tuple(range(63)),)))
        found.append(sorted(map(tuple, components.connected_components(edges).collect())))
    assert found[0] == found[1] and found[0]


def test_rows_without_an_id_and_columns_of_any_name(spark):
    rng = random.Random(13)
    a, b = pair_at(rng, 45, 44)
    c, d = pair_at(rng, 45, 44)
    df = docs(spark, [(None, a), (None, a), (3, b), (None, c), (None, d), (None, d)]).selectExpr("*", "1 as __node", "'x' as ___best", "array(1) as `bands`", "map('a', 1) as m")
    got = S.drop_near_duplicates(df)
    rows = got.collect()
    assert got.columns == df.columns and sorted((r["doc_id"] or 0) for r in rows) == [0, 3]
    assert next(r for r in rows if r["doc_id"] is None)["text"] in (c, d)


@pytest.mark.parametrize(("n", "bits"), [(0, 16), (250_000, 16), (1 << 24, 22), (10**10, 32)])
def test_blocks_grow_with_the_corpus(n, bits):
    assert len(S.nominating(n).blocks[0]) == bits


@pytest.mark.parametrize("n", [0, 300_000, 1 << 24, 10**10])
def test_what_links_does_not_depend_on_the_size_that_the_covering_is_for(spark, n):
    """Pairs at exactly 0.8 that share none of 32 bands of six minima: blocks of one length or another miss each of them."""
    rows = []
    for i, (seed, size) in enumerate([(5908, 18), (42189, 9), (52797, 9), (89832, 18)]):
        a, b = pair_at(random.Random(seed), size, 8 * size // 9)
        assert jaccard(a, b) == 0.8
        rows += [(2 * i, a), (2 * i + 1, b)]
    assert {r["doc_id"] for r in S.drop_near_duplicates(docs(spark, rows), covering=S.nominating(n)).collect()} == {0, 2, 4, 6}


@pytest.mark.parametrize("blocks", [(), S.nominating(0).blocks])
def test_prefixes_complete_what_fingerprints_linked(spark, blocks):
    """Chains whose steps are at 0.8 or just below, with and without any anchors."""
    rng, rows, want = random.Random(33), [], set()
    for i in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(49)]
        for step in range(6):  # each text goes on from the last one
            rows.append((10 * i + step, " ".join(words)))
            n = 5 if i % 2 else 6
            words = words[n:] + [f"v{rng.randrange(10**6)}" for _ in range(n)]
        linked = jaccard(rows[-2][1], rows[-1][1]) >= 0.8
        assert linked == bool(i % 2)
        want |= {10 * i} if linked else {10 * i + step for step in range(6)}
    got = S.drop_near_duplicates(docs(spark, rows), covering=S.Covering(S.NOMINATE_BITS, 0, blocks, 4)).collect()
    assert {r["doc_id"] for r in got} == want
