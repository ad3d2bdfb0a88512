import random
import re
from urllib.parse import urlparse

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from helpers import awkward, docs, empty
from herdwise.llm import common
from herdwise.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = {i: i + 32 for i in range(65, 91)}


def split(t):
    return WORD.findall((t or "").translate(LOW))


def brute(rows, items, n):
    out = []
    for doc_id, text in rows:
        w, hit, found = split(text), set(), set()
        for item, t in items:
            b = split(t)
            for window in [b[i : i + n] for i in range(max(1, len(b) - n + 1))] if b else []:
                for i in range(len(w) - len(window) + 1):
                    if w[i : i + len(window)] == window:
                        hit.update(range(i, i + len(window)))
                        found.add(str(item))
        out.append((doc_id, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=repr)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def rows_of(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(sorted(r["items"]))) for r in df.collect()), key=repr)


@pytest.mark.parametrize("path", ["index", "joins"])
def test_equals_brute_force(spark, path):
    rng = random.Random(3)
    words = ["the", "of", "É", "été", "x9", "Zed", "a", "b"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    rows = [(i, text(rng.randrange(60))) for i in range(40)] + [(100, None), (101, ""), (102, "the of")]
    items = [(i, text(rng.randrange(9))) for i in range(25)] + [(50, None), (51, "!!"), (52, "the of"), (53, rows[3][1])]
    got = D.find_contamination(docs(spark, rows), bench(spark, items), n=4, broadcast_bytes=1 << 20 if path == "index" else 0)
    assert rows_of(got) == brute(rows, items, 4)


def near_brute(rows, items, slop, n):
    """By trying every place of each window's rarest term."""
    every = [w for _, t in rows for w in split(t)]
    out = []
    for doc_id, text in rows:
        w, hit, found = split(text), set(), set()
        for item, t in items:
            b = split(t)
            for window in [b[i : i + n] for i in range(max(1, len(b) - n + 1))] if b else []:
                first = min(range(len(window)), key=lambda k: (every.count(window[k]), k))
                for at, word in enumerate(w):
                    if word == window[first] and all(x in w[max(0, at - slop) : at + slop + 1] for x in window):
                        hit.update(range(max(0, at - slop), min(len(w), at + slop + 1)))
                        found.add(str(item))
        out.append((doc_id, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("path", ["index", "joins"])
def test_proximity_equals_brute_force(spark, path):
    items = [(1, "red green blue"), (2, "red"), (3, "a b red")]
    rows = [(1, "green x red y z blue"), (2, "red a b c d e f g h blue green"), (3, "red green"), (4, "blue"), (5, None), (6, "b x a red red")]
    rng = random.Random(5)
    rows += [(10 + i, " ".join(rng.choice(["red", "green", "blue", "a", "b", "x", "y"]) for _ in range(rng.randrange(30)))) for i in range(30)]
    size = 1 << 20 if path == "index" else 0
    exact = {r["doc_id"]: r["n_hit"] for r in D.find_contamination(docs(spark, rows), bench(spark, items[:1]), broadcast_bytes=size).collect()}
    assert [exact[i] for i in (1, 2, 3)] == [0, 0, 0]
    near = D.find_contamination(docs(spark, rows), bench(spark, items), slop=3, broadcast_bytes=size)
    assert rows_of(near) == near_brute(rows, items, 3, D.WINDOW)


def test_one_index_serves_any_benchmark_and_segments_do_not_matter(spark, monkeypatch):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice("abcdefg") for _ in range(n))
    rows = [(i, text(rng.randrange(40))) for i in range(60)] + [(99, None)]
    monkeypatch.setattr(D, "SEGMENT_BYTES", 150)
    index = common.stored(D.build_index(docs(spark, rows)), "test-index")
    assert index.count() > 5
    for items in ([(i, text(5)) for i in range(9)], [(1, "a b c d e"), (2, "zzz"), (3, None)]):
        b = bench(spark, items).selectExpr("cast(item_id as string) as item_id", "cast(coalesce(text, '') as binary) as text")
        assert rows_of(D.look_up(index, b, 4)) == brute(rows, items, 4)


def test_awkward_rows_and_empty_tables(spark):
    b = bench(spark, [(1, "one two three four five six seven"), (2, None), (None, "not there")])
    got = {(r["doc_id"], r["n_hit"]) for r in D.find_contamination(awkward(spark), b).collect()}
    assert (4, 7) in got and (5, 7) in got and (1, 0) in got and (6, 0) in got
    assert D.find_contamination(empty(spark), b).count() == 0
    assert D.find_contamination(awkward(spark), b.where("false")).where("n_hit > 0").count() == 0
    nameless = D.find_contamination(awkward(spark), bench(spark, [(None, "a text without an id")])).where("n_hit > 0").collect()
    assert [(r["doc_id"], r["n_hit"], r["items"]) for r in nameless] == [(None, 5, [""])]
    clash = docs(spark, [(1, "one two three four five six seven"), (2, "x")]).selectExpr("*", *(f"'clash' as {c}" for c in ("hit_id", "hit_hash", "text_hash", "id", "hash", "doc")))
    assert D.drop_contaminated(clash, b).columns == clash.columns and [r["doc_id"] for r in D.drop_contaminated(clash, b).collect()] == [2]
    kept = D.drop_contaminated(awkward(spark), b)
    assert kept.columns == awkward(spark).columns and kept.count() == awkward(spark).count() - 3


def test_the_query_against_its_sql(spark, tmp_path):
    import duckdb

    docs(spark, [(1, "a b c d e f g h i j k l"), (2, "B C D E F G H I J K"), (3, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    bench(spark, [(7, "b c d e f g h i j k l"), (12, "a b c")]).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = D.op2_benchmark_decontamination(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(D.OP2_SQL).fetchall())


def test_the_index_is_written_in_row_groups_of_a_few_segments(spark):
    """A reader holds all rows of a row group at once: 100 segments in one would be some 40 MB."""
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(35_000)), lambda i: F.format_string("%x", F.pmod(F.xxhash64("id", i), F.lit(1_000_003)))), " ")
    df = common.stored(spark.range(100, numPartitions=1).select(F.col("id").alias("doc_id"), text.alias("text")), "texts")
    since = common.mark()
    found = D.find_contamination(df, df.where("doc_id = 7").select(F.lit("x").alias("item_id"), F.substring("text", 1, 200).alias("text")))
    assert [r.doc_id for r in found.where("n_hit > 0").collect()] == [7]
    assert common.mark() == since + 1
    groups = [meta.row_group(i).num_rows for path in found.inputFiles() for meta in [pq.ParquetFile(urlparse(path).path).metadata] for i in range(meta.num_row_groups)]
    assert sum(groups) == 100 and max(groups) < 50
