import random
import zlib

import numpy as np
import pytest

from helpers import awkward, docs, empty
from herdwise.llm import language as L

WORDS = {"en": "the of and to in that is was with from this by", "fr": "le la les des une dans pour avec sur est que qui", "de": "der die das und nicht mit von ein eine ist sich zu"}


def corpus(n=240):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choices(WORDS[lang].split(), k=30)), lang, "s"))
    return rows


def test_held_out_languages_are_found(spark, tmp_path):
    rows = corpus()
    docs(spark, [*rows, (1000, None), (1001, "123 !?"), (1002, "")]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in L.op4_language_id(spark, str(tmp_path)).collect()}
    for i, _, lang, _ in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1
    assert {got[i]["lang_pred"] for i in (1000, 1001, 1002)} == {"und"}


def test_scores_equal_plain_naive_bayes():
    texts = ["le chat", "the cat sat", "é"]
    counts = np.random.default_rng(0).integers(0, 9, (2, 1 << L.BITS)).astype(float)
    m = L.Model(["a", "b"], counts, np.array([3.0, 1.0]))
    lang, score = m.predict(texts)
    for t, got_lang, got in zip(texts, lang, score, strict=True):
        total = m.prior + sum(m.log_p[:, b].astype(float).sum(1) for b, _ in L._ngrams([t]))
        p = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        assert got_lang == m.langs[p.argmax()] and got == pytest.approx(p.max())


def test_ngrams_do_not_cross_texts():
    for order, (alone, together) in enumerate(zip(L._ngrams(["abc"]), L._ngrams(["abc", "", "x", "abc"]), strict=True)):
        bucket, starts = together
        assert list(bucket[starts[3] : starts[4]]) == list(alone[0]) and starts[3] - starts[2] == (1 if order == 0 else 0)


def test_labels_of_the_rows_themselves_do_not_matter(spark):
    rows = corpus(90)
    model = L.train(docs(spark, rows))
    plain = {r["doc_id"]: r["lang_pred"] for r in L.identify(docs(spark, rows), model).collect()}
    moved = {r["doc_id"]: r["lang_pred"] for r in L.identify(docs(spark, [(i, t, "zz", "q") for i, t, _, _ in rows]), model).collect()}
    assert plain == moved


def test_awkward_rows(spark):
    model = L.train(docs(spark, corpus(90)))
    got = L.identify(awkward(spark), model)
    assert got.count() == awkward(spark).count() and L.identify(empty(spark), model).count() == 0
    kept = L.keep_identified(awkward(spark), model)
    assert kept.columns == awkward(spark).columns and kept.where("text is null or trim(text) = ''").count() == 0
    assert {r["lang_pred"] for r in kept.collect()} == {"clash"}
    none = L.train(empty(spark))
    assert {r["lang_pred"] for r in L.identify(awkward(spark), none).collect()} == {"und"}


def test_long_texts_are_cut_without_a_trace(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcé İZ") for _ in range(n)) for n in (0, 1, 2, 9, 10, 11, 500)]
    m = L.Model(["a", "b"], np.random.default_rng(0).integers(0, 9, (2, 1 << L.BITS)).astype(float), np.array([3.0, 1.0]))
    whole = m.predict(texts)
    monkeypatch.setattr(L, "PIECE", 5)
    monkeypatch.setattr(L, "CHUNK_BYTES", 17)
    cut = m.predict(texts)
    assert cut[0] == whole[0] and cut[1] == pytest.approx(whole[1])


def test_predictions_equal_a_plain_count_of_ngrams(spark):
    """Naive Bayes over the same hashed n-grams, counted one by one."""
    rows = corpus(90)
    model = L.train(docs(spark, rows))
    bucket = lambda g: int(L._ngrams([g])[len(g) - 1][0][0])
    memo, counts, rows_of = {}, {}, {}

    def grams(t):
        t = t.lower()
        return [memo.setdefault(g, bucket(g)) for k in (1, 2, 3) for i in range(len(t) - k + 1) for g in [t[i : i + k]]]

    for i, t, lang, _ in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            rows_of[lang] = rows_of.get(lang, 0) + 1
            own = counts.setdefault(lang, np.zeros(1 << L.BITS))
            for b in grams(t):
                own[b] += 1
    langs = sorted(counts)
    for _, t, _, _ in rows[:30]:
        total = []
        for lang in langs:
            smooth = counts[lang] + 0.1
            total.append(np.log((rows_of[lang] + 1) / (sum(rows_of.values()) + len(langs))) + sum(np.log(smooth[b] / smooth.sum()) for b in grams(t)))
        p = np.exp(np.array(total) - max(total))
        (got,), (score,) = model.predict([t])
        assert got == langs[int(np.argmax(total))] and score == pytest.approx(1 / p.sum(), abs=1e-4)


def test_the_most_frequent_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_LANGS", 2)
    rows = corpus(90) + [(1000 + i, "xx yy", "zz", "s") for i in range(3)]
    n = {}
    for i, _, lang, _ in rows:
        n[lang] = n.get(lang, 0) + (zlib.crc32(str(i).encode()) % 3 != 1)
    assert L.train(docs(spark, rows)).langs == sorted(sorted(n, key=lambda x: (-n[x], x))[:2])
