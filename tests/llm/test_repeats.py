import hashlib
import random
from collections import Counter

from helpers import awkward, docs, empty
from herdwise.llm import repeats as R


def brute(texts):
    split = [(t or "").split() for t in texts]
    seen = Counter(tuple(w[i : i + R.WINDOW]) for w in split for i in range(len(w) - R.WINDOW + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - R.WINDOW + 1):
            if seen[tuple(w[i : i + R.WINDOW])] > 1:
                gone.update(range(i, i + R.WINDOW))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def texts(seed, vocabulary):
    rng = random.Random(seed)
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [words(rng.choice([34, 35, 36, 50, 90, 200])) for _ in range(14)]
    out = []
    for _ in range(90):
        doc = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            a, b = sorted((rng.randrange(len(p)), len(p) - rng.randrange(3)))
            doc += rng.choice([words(rng.randrange(60)), p, p[a:b], p + p])
        out.append(" ".join(doc))
    return [*out, out[0], out[1], None, "", "short text"]


def check(spark, given, **kw):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in R.remove_repeats(docs(spark, list(enumerate(given))), **kw).collect()}
    assert [got[i] for i in range(len(given))] == brute(given)


def test_equals_brute_force(spark):
    check(spark, texts(1, [f"w{i}" for i in range(800)] + ["é", "Ü!"]))


def test_small_vocabularies_and_small_shards(spark):
    check(spark, texts(2, ["a", "b", "c"]), shard_bytes=2000)
    check(spark, ["x " * 100, "y " * 34, "y " * 35, "z " * 36, "a b " * 40])


def test_many_automata(spark, monkeypatch):
    monkeypatch.setattr(R, "AUTOMATON_WORDS", 50)
    given = texts(3, [f"w{i}" for i in range(300)])
    first, words, numbers, phrases = [0], [], {}, set()
    seen = Counter(tuple(t.split()[i : i + R.WINDOW]) for t in given if t for i in range(len(t.split()) - R.WINDOW + 1))
    for t in given:
        own = [numbers.setdefault(w, len(numbers)) for w in (t or "").split()]
        words += own
        first.append(len(words))
    back = {v: k for k, v in numbers.items()}
    for a, b in zip(first, first[1:], strict=False):
        phrases |= {tuple(words[i : i + R.WINDOW]) for i in range(a, b - R.WINDOW + 1) if seen[tuple(back[x] for x in words[i : i + R.WINDOW])] > 1}
    import numpy as np

    assert int(R._covered(words, np.array(first), phrases).sum()) == sum(n for _, n, _ in brute(given))


def test_awkward_rows(spark):
    got = R.remove_repeats(awkward(spark))
    rows = got.collect()
    assert len(rows) == awkward(spark).count() and {r["doc_id"]: r["n_removed"] for r in rows}[6] == 0
    assert R.remove_repeats(empty(spark)).count() == 0
    same = " ".join(f"t{i}" for i in range(40))
    twice = R.remove_repeats(docs(spark, [(1, same), (1, same), (None, same)])).collect()
    assert [r["n_removed"] for r in twice] == [40, 40, 40]


def test_the_query_hashes_what_is_left(spark, tmp_path):
    given = texts(4, [f"w{i}" for i in range(500)])
    docs(spark, list(enumerate(given))).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in R.op7_substring_dedup(spark, str(tmp_path)).collect()}
    for i, (n, removed, kept) in enumerate(brute(given)):
        assert got[i] == (n, removed, hashlib.sha256(kept.encode()).hexdigest())


def thue_morse(n, a, b):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


def test_words_that_a_polynomial_hash_confuses_are_different(spark):
    rest = [f"w{i}" for i in range(34)]
    check(spark, [" ".join([thue_morse(4096, "a", "b"), *rest]), " ".join([thue_morse(4096, "b", "a"), *rest]), " ".join([thue_morse(4096, "a", "b"), *rest[:20]])])


def test_long_texts_and_columns_with_other_names(spark):
    rng = random.Random(6)
    long = " ".join(f"w{rng.randrange(400)}" for _ in range(150_000))
    passage = " ".join(f"p{i}" for i in range(60))
    check(spark, [long + " " + passage, "a " + passage + " b", long[:1000]])


def test_phrases_cover_what_their_stretches_do():
    import numpy as np

    rng = np.random.default_rng(7)
    doc, start, n = rng.integers(0, 4, 60), rng.integers(0, 600, 60), rng.integers(1, 80, 60)
    words = lambda d, s, k: {(a, w) for a, b, m in zip(d, s, k, strict=True) for w in range(b, b + m + R.WINDOW - 1)}
    d, s = R.phrase_starts(doc, start, n)
    given = {(a, w) for a, b, m in zip(doc, start, n, strict=True) for w in range(b, b + m)}
    assert words(d, s, np.ones(len(d), int)) == words(doc, start, n) and set(zip(d.tolist(), s.tolist(), strict=True)) <= given
