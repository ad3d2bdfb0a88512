import itertools
import random
import zlib

import numpy as np
import pytest

from helpers import awkward, docs, empty
from herdwise.llm import toxicity as X


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    for _ in range(20):
        n = int(rng.integers(1, 4))
        emission, gaps = rng.normal(size=n) * 2, rng.integers(0, 3, n + 1)
        transition, background = np.log(rng.dirichlet([1, 1], 2)), float(rng.normal())
        chain, at = [], []
        for i in range(n + 1):
            chain += [background] * int(gaps[i])
            if i < n:
                at.append(len(chain))
                chain.append(emission[i])
        total, marked = 0.0, np.zeros(n)
        for tags in itertools.product((0, 1), repeat=len(chain)):
            w = np.exp(-6.0 * tags[0] + sum(e for e, t in zip(chain, tags, strict=True) if t) + sum(transition[a, b] for a, b in itertools.pairwise(tags)))
            total += w
            marked += w * np.array([tags[k] for k in at])
        assert X.forward_backward(emission, gaps, transition, background) == pytest.approx(marked / total)


def small_chains():
    """Documents of tokens (features, tag) over three features, cut into pieces; some have no feature."""
    rng = random.Random(3)
    documents = [[([f for f in range(3) if rng.random() < 0.3], rng.randrange(2)) for _ in range(rng.randrange(0, 6))] for _ in range(6)]
    documents += [[([], 0)] * 4] * 3
    return documents, X.Chains(map(sparse, documents), 3)


def sparse(doc):
    return len(doc), [(i, own, tag) for i, (own, tag) in enumerate(doc) if own or tag]


def test_the_likelihood_equals_enumeration():
    documents, chains = small_chains()
    x = np.random.default_rng(1).normal(size=8)
    weights, any_token, transition = chains.unpack(x)
    want = 0.0
    for doc in documents:
        if not doc:
            continue
        each = [sum(weights[f] for f in own) + any_token for own, _ in doc]

        def score(tags, each=each):
            return X.START * tags[0] + sum(e for e, t in zip(each, tags, strict=True) if t) + sum(transition[a, b] for a, b in itertools.pairwise(tags))

        want += score([t for _, t in doc]) - np.log(sum(np.exp(score(tags)) for tags in itertools.product((0, 1), repeat=len(doc))))
    assert chains.value_and_slope(x, 0.0)[0] == pytest.approx(want)


def test_the_gradient_equals_differences_and_vanishes_at_the_optimum():
    _, chains = small_chains()
    f = lambda x: chains.value_and_slope(x, 0.3)
    x, h = np.random.default_rng(2).normal(size=8), 1e-5
    slope = f(x)[1]
    assert slope == pytest.approx([(f(x + h * e)[0] - f(x - h * e)[0]) / (2 * h) for e in np.eye(8)], abs=1e-5)
    best = X.maximize(f, np.zeros(8), steps=200, tolerance=1e-12)
    assert np.abs(f(best)[1]).max() < 1e-3 and f(best)[0] >= max(f(best + 0.1 * e)[0] for e in [*np.eye(8), *-np.eye(8)])


def test_pieces_are_cut_and_plain_ones_are_counted(monkeypatch):
    monkeypatch.setattr(X, "PIECE", 2)
    c = X.Chains(map(sparse, [[([], 0)] * 5, [([0], 1), ([], 0), ([], 0)]]), 1)
    assert sorted(zip(c.sizes.tolist(), c.times.tolist(), strict=True)) == [(1, 2.0), (2, 1.0), (2, 2.0)]


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    plain = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        w = rng.choices(plain, k=rng.randrange(10, 60))
        toxic = int(rng.random() < 0.3)
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(["Idiot", "scum", f"grobl{rng.choice('abcdefgh')}{rng.choice('uvwxyz')}"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    return rows, labels


def test_held_out_documents_are_told_apart_and_spans_are_right(spark, tmp_path):
    rows, labels = corpus()
    docs(spark, [*rows, (5000, None), (5001, "")]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in X.op8_toxicity(spark, str(tmp_path)).collect()}
    text, toxic = dict(rows), {i: t for i, _, t in labels}
    out = [i for i in text if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in set(out)) for i in text)
    assert np.mean([got[i]["predicted"] == toxic[i] for i in out]) > 0.95
    for i in out:
        for s in got[i]["spans"]:
            assert text[i][s["start"] : s["end"]].lower().startswith(("idiot", "scum", "grobl"))
    assert got[5000]["predicted"] == 0 and 0 <= got[5001]["score"] <= 1


def test_awkward_rows(spark):
    rows, labels = corpus(200)
    tagger = X.fit([(t.encode(), labels[i][2]) for i, t in rows])
    assert X.score_toxicity(awkward(spark), tagger).count() == awkward(spark).count() and X.score_toxicity(empty(spark), tagger).count() == 0
    none = X.train(empty(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] < 0.5 for r in X.score_toxicity(awkward(spark), none).collect()} == {True}
    assert X.fit([(b"a b", 1)]).score(np.empty(0)) > 0.5
