import hashlib
import random

import pytest
from pyspark.sql import functions as F

from helpers import awkward, docs, empty
from herdwise.llm import fingerprints as P


def rows_of(spark, tmp_path, table):
    table.write.parquet(f"{tmp_path}/documents.parquet")
    return P.op5_fingerprints(spark, str(tmp_path)).collect()


def jaccard(a, b):
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_edits_likeness_and_equal_texts(spark, tmp_path):
    rng = random.Random(2)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}é" for _ in range(n))
    texts = {i * 3: text(rng.choice([3, 8, 60, 400])) for i in range(1300)}
    texts[30] = texts[33]
    texts[36] = " ".join(texts[39].split()[:-2] or ["x"])
    got = {r["doc_id"]: r for r in rows_of(spark, tmp_path, docs(spark, list(texts.items())).repartition(3))}
    ids = sorted(texts, reverse=True)
    errors = []
    for i, nxt in zip(ids, ids[1:] + ids[:1], strict=True):
        t, m = texts[i], len(texts[i]) // 3
        edited = t[: len(t) - m] + texts[nxt][:m]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        errors += [got[i]["near_edited"] - jaccard(t, edited), got[i]["near_next"] - jaccard(t, texts[nxt])]
    assert got[30]["fingerprint"] == got[33]["fingerprint"] and got[33]["near_next"] == 1.0
    assert abs(sum(errors) / len(errors)) < 0.01 and max(map(abs, errors)) < 0.25


def test_fingerprints_equal_a_plain_version(spark):
    """Bins, minima and densification step by step in Python; the hash functions are Spark's own."""
    rng = random.Random(4)
    texts = ["", "one", "a b c d", "a b c d e", "a b c d e f", " ".join(f"w{rng.randrange(90)}" for _ in range(40)), " ".join(f"w{rng.randrange(900)}" for _ in range(700)), "x " * 300]
    table = {(r["b"], r["a"]): r["h"] for r in spark.range(P.BINS).select(F.col("id").cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(P.BINS - 1))).alias("a")).select("b", "a", F.hash("b", "a").alias("h")).collect()}
    pick = {r["b"]: r["h"] for r in spark.range(P.BINS).select(F.col("id").cast("int").alias("b")).select("b", F.hash("b").alias("h")).collect()}
    rows = [(i, s) for i, t in enumerate(texts) for w in [t.split()] for s in ([w[k : k + 5] for k in range(len(w) - 4)] if len(w) >= 5 else [[" ".join(w)]])]
    hashed = {}
    for n in (1, 5):
        part = [(i, *s) for i, s in rows if len(s) == n]
        df = spark.createDataFrame(part, "i int, " + ", ".join(f"s{k} string" for k in range(n)))
        for r in df.select("i", F.shiftrightunsigned(F.xxhash64(*(f"s{k}" for k in range(n))), 1).alias("h")).collect():
            hashed.setdefault(r["i"], set()).add(r["h"])
    want, borrowed = {}, []
    for i in range(len(texts)):
        low = {}
        for h in hashed[i]:
            b = h >> (63 - 8)
            low[b] = min(low.get(b, h), h)
        for b in range(P.BINS):
            if b in low:
                want[i, b] = low[b] & 15
            else:
                asked = next((low[x] for a in range(P.BINS) if (x := table[b, a] & (P.BINS - 1)) in low), None)
                filled = [low[x] for x in sorted(low)]
                borrowed.append((i, b, asked if asked is not None else filled[pick[b] % len(filled)]))
    for r in spark.createDataFrame(borrowed, "i int, b int, v long").select("i", "b", F.xxhash64("v", "b").bitwiseAND(F.lit(15)).alias("d")).collect():
        want[r["i"], r["b"]] = r["d"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", P.fingerprint(F.col("text")).alias("fp")).collect()
    for r in got:
        assert r["fp"] == "".join(f"{want[r['i'], b]:x}" for b in range(P.BINS)), texts[r["i"]][:30]


def test_shared_ids_and_missing_ids_are_spread(spark, monkeypatch):
    monkeypatch.setattr(P, "RUN", 4)
    rows = [(i, f"t{i}") for i in range(40)] + [(17, f"same id {i % 30}") for i in range(60)] + [(None, f"none {i % 50}") for i in range(80)]
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"], r["next_text"]) for r in P.with_next(docs(spark, rows)).collect())
    order = sorted(((i if i is not None else -1, t) for i, t in rows), reverse=True)
    assert got == sorted((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))


def test_awkward_rows(spark, tmp_path):
    got = rows_of(spark, tmp_path, awkward(spark))
    assert len(got) == awkward(spark).count()
    assert all(len(r["fingerprint"]) == P.BINS and 0 <= r["near_edited"] <= 1 for r in got)
    nothing = {r["fingerprint"] for r in got if r["doc_id"] in (1, 2, 3)}
    assert len(nothing) == 1
    # rows without an id come last, by text; the very last one meets the first
    last = next(r for r in got if r["doc_id"] is None and r["n_chars"] == 0)
    assert last["edited_sha256"] == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("rows", [[], [(5, "only one text here to see")]])
def test_empty_and_single(spark, tmp_path, rows):
    got = rows_of(spark, tmp_path, docs(spark, rows) if rows else empty(spark))
    assert len(got) == len(rows)
    if rows:
        assert got[0]["near_next"] == 1.0


def test_many_runs_find_their_neighbours(spark, monkeypatch):
    monkeypatch.setattr(P, "RUN", 1)
    monkeypatch.setattr(P, "RUNS_PER_PARTITION", 300)
    df = spark.range(900).select((F.col("id") * 7).alias("doc_id"), F.col("id").cast("string").alias("text")).unionByName(docs(spark, [(7, "1b"), (None, "n")]).select("doc_id", "text"))
    got = {(r["doc_id"], r["text"]): r["next_text"] for r in P.with_next(df).collect()}
    assert got[6293, "899"] == "898" and got[14, "2"] == "1b" and got[7, "1b"] == "1" and got[7, "1"] == "0" and got[0, "0"] == "n" and got[None, "n"] == "899" and len(got) == 902
