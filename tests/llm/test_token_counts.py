from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pytest

from helpers import awkward, docs, empty
from herdwise.llm import token_counts as T

VOCABULARIES = {"v1": "byte_bpe_50k.tiktoken", "v2": "byte_bpe_multi_50k.tiktoken"}


@pytest.fixture(scope="module")
def vocabularies():
    return T.load_vocabularies(VOCABULARIES)


def encoders(vocabularies):
    return dict(T._encoders(vocabularies))


def rows():
    return [(1, "the cat  sat", "en", "a"), (2, "the cat  sat", "en", "a"), (3, "été \t là", "fr", "b"), (4, None, None, None), (5, "", "en", "a"), (6, "  x  ", "en", None), (6, "  x  ", "en", None), (2, "c  d", "en", "a"), (None, "the cat  sat", "en", "a")]


def totals(df):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"], r["n_chars"]) for r in df.collect()}


def test_counts_are_the_tokenizers_own(spark, vocabularies):
    got = T.count_tokens(docs(spark, rows()).selectExpr("*", "'clash' as tokenizer", "'x' as text_tokens"), vocabularies).collect()
    enc = encoders(vocabularies)
    texts = Counter((r[0], len(enc[v](r[1] or ""))) for r in rows() for v in enc)
    assert Counter((r["doc_id"], r["text_tokens"]) for r in got) == texts
    assert T.count_tokens(empty(spark), vocabularies).count() == 0


def test_the_query_equals_a_recount_of_the_final_state(spark, tmp_path, vocabularies):
    docs(spark, rows()).write.parquet(f"{tmp_path}/documents.parquet")
    got = totals(T.op9_token_counts(spark, str(tmp_path), vocabularies))
    enc, want = encoders(vocabularies), Counter()
    first = {}
    for r in rows():
        if r[0] is not None:
            first[r[1] or ""] = min(first.get(r[1] or "", r[0]), r[0])
    for i, text, lang, source in rows():
        if i is None or first[text or ""] == i:
            final = T_collapsed(text or "")
            for v in enc:
                for k, x in enumerate((1, len(enc[v](final)), len(final))):
                    want[source, lang, v, k] += x
    keys = {k[:3] for k in want if any(want[*k[:3], j] for j in range(3))}
    assert got == {k: tuple(want[*k, j] for j in range(3)) for k in keys}


def T_collapsed(text):
    import re

    return re.sub("[ \t]+", " ", text).strip(" ")


def test_batches_are_committed_once(spark, tmp_path):
    r = T.Rollup(spark, f"file://{tmp_path}/rollup")
    assert r.totals().count() == 0
    a = spark.createDataFrame([("s", "en", "v", 5, 5), ("s", "en", "v", 7, 9), (None, None, "v", 1, 1)], "source string, lang string, tokenizer string, n_tokens long, n_chars long")
    assert r.commit("one", T.inserts(a)) and not r.commit("one", T.inserts(a))
    assert totals(r.totals()) == {("s", "en", "v"): (2, 12, 14), (None, None, "v"): (1, 1, 1)}
    assert r.commit("two", T.deletes(a.where("source is null or n_tokens = 5")))
    assert totals(r.totals()) == {("s", "en", "v"): (1, 7, 9)}
    (tmp_path / "rollup" / "_writing-half").mkdir()  # a writer that died
    assert totals(r.totals()) == {("s", "en", "v"): (1, 7, 9)}
    assert r.commit("half", T.inserts(a.where("false"))) and totals(r.totals()) == {("s", "en", "v"): (1, 7, 9)}
    with pytest.raises(ValueError):
        r.commit("../x", T.inserts(a))


def one(spark, n):
    return T.inserts(spark.createDataFrame([("s", "en", "v", n, 1)], "source string, lang string, tokenizer string, n_tokens long, n_chars long"))


def test_of_two_writers_of_a_batch_one_commits(spark, tmp_path):
    a, b = (T.Rollup(spark, f"file://{tmp_path}/rollup") for _ in range(2))
    changes = one(spark, 5)
    a.committed = lambda batch_id: False  # both looked before either wrote
    b.committed = lambda batch_id: False
    with ThreadPoolExecutor(2) as pool:
        done = list(pool.map(lambda r: r.commit("same", changes), (a, b)))
    assert sorted(done) == [False, True] and totals(a.totals()) == {("s", "en", "v"): (1, 5, 1)}
    assert not [p for p in (tmp_path / "rollup").iterdir() if p.name.startswith("_")]


def test_many_batches_are_read_in_few_files(spark, tmp_path):
    r = T.Rollup(spark, f"file://{tmp_path}/rollup", compact_after=7)
    for i in range(30):
        assert r.commit(f"b{i}", one(spark, i))
        assert len(r.totals().inputFiles()) <= 7
    assert totals(r.totals()) == {("s", "en", "v"): (30, sum(range(30)), 30)}
    assert not r.commit("b3", one(spark, 3)) and not r.commit("b29", one(spark, 3))  # held by a snapshot, or not yet
    assert r.compact() and not r.compact() and totals(r.totals()) == {("s", "en", "v"): (30, sum(range(30)), 30)}
    assert len(list((tmp_path / "rollup").glob("snapshot=*"))) <= 2


def test_awkward_rows(spark, tmp_path, vocabularies):
    awkward(spark).write.parquet(f"{tmp_path}/a/documents.parquet")
    got = totals(T.op9_token_counts(spark, f"{tmp_path}/a", vocabularies))
    n = len([r for r in awkward(spark).collect() if r["doc_id"] not in (2, 5)])  # 1 and 4 come first
    assert sum(v[0] for v in got.values()) == n * len(vocabularies)
    empty(spark).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert totals(T.op9_token_counts(spark, f"{tmp_path}/b", vocabularies)) == {}
