from collections import Counter

import duckdb
import pytest

from helpers import awkward, docs, empty
from herdwise.llm import mixing as M


def test_the_query_equals_its_sql(spark, tmp_path):
    docs(spark, [(i, f"t{i}", "en", f"s{i % 3 if i % 2 else 0}") for i in range(400)]).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(M.OP10_SQL).fetchall())
    assert sorted(map(tuple, M.op10_mix_sources(spark, str(tmp_path)).collect())) == want


def test_shares_follow_the_weights_and_draws_are_stable(spark):
    df = docs(spark, [(i, "x", "en", "big" if i % 10 else "small") for i in range(6000)])
    out = M.mix(df, {"big": 1, "small": 3}, total=4000)
    n = Counter(r["source"] for r in out.select("source").collect())
    assert n["small"] == pytest.approx(3000, rel=0.08) and n["big"] == pytest.approx(1000, rel=0.12)
    again = M.mix(df.repartition(7), {"big": 1, "small": 3}, total=4000)
    key = lambda d: [(r["doc_id"], r["copy"]) for r in d.collect()]
    assert key(out) == key(again)
    order = [r["doc_id"] for r in out.collect()]
    assert order != sorted(order)


def test_repetitions_are_poisson(spark):
    df = docs(spark, [(i, "x") for i in range(20_000)])
    n = Counter(r["doc_id"] for r in M.mix(df, total=50_000).select("doc_id").collect())
    counts = Counter(n.get(i, 0) for i in range(20_000))
    import math

    for k in range(7):
        assert counts[k] / 20_000 == pytest.approx(math.exp(-2.5) * 2.5**k / math.factorial(k), abs=0.012)


def test_awkward_rows(spark):
    out = M.mix(awkward(spark), total=100)
    assert out.columns == [c for c in awkward(spark).columns if c not in ("copy", "position")] + ["copy", "position"]
    assert M.mix(empty(spark)).count() == 0
    assert M.mix(awkward(spark), {"nobody": 1.0}).count() == 0
    assert M.mix(docs(spark, [(1, "a")]), total=10_000).count() == pytest.approx(10_000, abs=500)
    named = docs(spark, [(i, "a") for i in range(50)]).selectExpr("*", *(f"'clash' as {c}" for c in ("doc", "id", "u", "n", "cdf", "parts", "rate", "__source", "__id")))
    assert M.mix(named).columns == [*named.columns, "copy", "position"] and {r["cdf"] for r in M.mix(named).collect()} == {"clash"}


def test_positions_are_in_order_over_all_partitions(spark):
    at = [r["position"] for r in M.mix(docs(spark, [(i, "x") for i in range(3000)])).collect()]
    assert at == sorted(at) and len(at) > 2500


def test_a_source_of_few_rows_among_many_is_repeated_in_full(spark):
    df = docs(spark, [(i, "x", "en", None if i == 7 else "big") for i in range(4000)])
    n = Counter(r["source"] for r in M.mix(df).select("source").collect())
    assert n[None] == pytest.approx(2000, abs=5 * 2000**0.5) and n["big"] == pytest.approx(2000, abs=5 * 2000**0.5)


def test_large_rates_are_poisson_too(spark):
    df = docs(spark, [(i, "x", "en", "few" if i < 60 else "big") for i in range(10_060)])
    n = Counter(r["doc_id"] for r in M.mix(df, {"few": 1}, total=90_000).select("doc_id").collect())
    times = [n[i] for i in range(60)]
    mean = sum(times) / 60
    assert set(n) == set(range(60)) and mean == pytest.approx(1500, abs=5 * (1500 / 60) ** 0.5)
    assert sum((t - mean) ** 2 for t in times) / 59 == pytest.approx(1500, rel=0.8)
