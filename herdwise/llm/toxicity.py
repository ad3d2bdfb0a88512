"""Toxic spans by a linear-chain conditional random field with two tags.

Documents carry labels, tokens do not: token tags for training come from the labels,
a token of a toxic document being tagged if a feature of its word is significantly
more frequent in toxic documents. The field has one weight per telling word feature
(the word, a prefix or a suffix), one for any token, and transition weights between the two
tags. All of them maximise the likelihood of the tag sequences of a bounded sample of documents: its
gradient is the observed counts minus those that forward-backward expects.

Scoring is a narrow Spark stage. A word's emission weight depends on the word alone,
so most tokens of a text have an emission that counts as plain background; the exact
forward-backward recursion then runs over the others, with the background between
them taken as a power of the transition matrix. Tag marginals become spans, and a
logistic function of their sum and maximum becomes the document's score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

AFFIXES = (3, 4, 5, 6)
#: Bounds of the training sample: about this many labelled rows of either label, chosen by a hash of the id.
MAX_ROWS_PER_LABEL = 3_000
#: ... and about this many bytes of text in all: the driver holds them.
MAX_SAMPLE_BYTES = 16 << 20
#: A token's marginal from here on is part of a toxic span.
SPAN_MARGINAL = 0.5
#: Log weight of a text that begins with a toxic token.
START = -6.0
#: Tokens of a training sequence at most; scoring takes whole texts.
PIECE = 64
#: Share of the telling features that may be so by chance.
DISCOVERY = 0.01

_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
#: Lower-cases A-Z and turns every byte that is in no word into a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SCHEMA = "doc_id long, score double, spans array<struct<start:int,end:int,marginal:double>>"


def held_out(doc_id):
    """Whether a document is kept out of training: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(word: bytes) -> list[bytes]:
    """The word, its prefixes and its suffixes."""
    return [b"w" + word, *(b"p" + word[:k] for k in AFFIXES if len(word) > k), *(b"s" + word[-k:] for k in AFFIXES if len(word) > k)]


def forward_backward(emission: np.ndarray, gaps: np.ndarray, transition: np.ndarray, background: float) -> np.ndarray:
    """Marginals of tag 1 at each of n tokens, in log space, exactly.

    ``emission[i]`` is the log weight of tag 1 against tag 0; ``gaps`` (n + 1 numbers) count
    the background tokens before, between and after them, whose log weight is ``background``.
    """
    step = np.exp(transition)  # [from, to]
    plain = step * np.exp([0.0, background])  # a step into a background token
    values, vectors = np.linalg.eig(plain)
    scale = np.abs(values).max()
    inverse = np.linalg.inv(vectors)

    def over(gap: int) -> np.ndarray:
        """The product of ``gap`` background steps, up to a factor."""
        return ((vectors * (values / scale) ** gap) @ inverse).real if gap else np.eye(2)

    n = len(emission)
    weight = np.exp(np.stack([np.zeros(n), np.minimum(emission, 60.0)], 1))
    start = np.array([1.0, np.exp(START)])
    alpha, beta = np.zeros((n, 2)), np.ones((n, 2))
    # before the first token there may be background, the first of which has no step into it
    at = start if not gaps[0] else (start * np.exp([0.0, background])) @ over(int(gaps[0]) - 1)
    for i in range(n):
        if i or gaps[0]:
            at = at @ (over(int(gaps[i])) if i else np.eye(2)) @ step
        at = at * weight[i]
        at = at / at.sum()
        alpha[i] = at
    after = over(int(gaps[n])) @ np.ones(2)
    for i in range(n - 1, -1, -1):
        beta[i] = after / after.sum()
        after = over(int(gaps[i])) @ (step @ (weight[i] * beta[i]))
    both = alpha * beta
    return both[:, 1] / both.sum(1)


class Tagger:
    """Weights of the field, for telling features only, and of the document score."""

    def __init__(self, weights: dict[bytes, float], bias: float, transition: np.ndarray, document: np.ndarray):
        self.weights, self.bias, self.transition, self.document = weights, bias, transition, document
        self.known: dict[bytes, float] = {}

    def emission(self, word: bytes) -> float:
        if len(self.known) > 500_000:  # a memo, started afresh when it has grown
            self.known.clear()
        got = self.known[word] = sum(self.weights.get(f, 0.0) for f in features(word)) + self.bias
        return got

    def tag(self, text: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Marginals and byte spans of the tokens that aren't background (those whose word has weight)."""
        plain, get, score, bias = text.translate(_WORDS), self.known.get, self.emission, self.bias
        own = plain.split()
        weights = [e if (e := get(w)) is not None else score(w) for w in own]
        index = [i for i, e in enumerate(weights) if e != bias]
        if not index:
            return np.empty(0), []
        places = [m.span() for m in _WORD.finditer(plain)]
        gaps = np.diff([-1, *index, len(own)]) - 1
        return forward_backward(np.array([weights[i] for i in index]), gaps, self.transition, bias), [places[i] for i in index]

    def score(self, marginals: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(_summary(marginals) @ self.document, -40, 40))))


def _summary(marginals: np.ndarray) -> np.ndarray:
    """What the document score looks at: a constant, the largest marginal, and the expected number of toxic tokens, damped."""
    return np.array([1.0, marginals.max(), np.log1p(marginals.sum())]) if len(marginals) else np.array([1.0, 0.0, 0.0])


def _logistic(x: np.ndarray, y: np.ndarray, l2: float, steps: int) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - l2 * w)
    return w


def _without_near_copies(texts: list[tuple[list[bytes], int]]) -> list[int]:
    """Numbers of the documents that don't share most of their five-word shingles with an earlier one (a sample of shingles by hash)."""
    seen: set[int] = set()
    out = []
    for d, (words, _) in enumerate(texts):
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))]
        own = {h for h in hashes if h % 8 == 0} or set(hashes)
        if 2 * len(own & seen) <= len(own):
            out.append(d)
        seen |= own
    return out


def _tail(c1: int, c0: int, share: float) -> float:
    """Log of (a bound on) the chance that at least c1 of c1 + c0 documents are toxic ones, if each is with chance ``share``."""
    n, p = c1 + c0, c1 / (c1 + c0)
    if p <= share:
        return 0.0
    return -n * (p * np.log(p / share) + ((1 - p) * np.log((1 - p) / (1 - share)) if p < 1 else 0.0))


def likelihood(emission: np.ndarray, tags: np.ndarray, sizes: np.ndarray, times: np.ndarray, transition: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of tag sequences under the field, and its gradient in the emissions and the transitions.

    Sequences are columns [token, sequence], longest first; ``sizes`` are their lengths and
    ``times`` how often each occurs. ``emission`` is the log weight of tag 1 against tag 0. The gradient is
    what was observed minus what forward-backward expects.
    """
    longest = len(emission)
    alive = np.searchsorted(-sizes, -np.arange(1, longest + 1), "right")  # columns that have a token t
    alpha = np.zeros((longest, 2, len(sizes)))
    alpha[0, 1] = START + emission[0]
    for t in range(1, longest):
        m = alive[t]
        for to in (0, 1):
            alpha[t, to, :m] = np.logaddexp(alpha[t - 1, 0, :m] + transition[0, to], alpha[t - 1, 1, :m] + transition[1, to]) + (emission[t, :m] if to else 0.0)
    last, column = sizes - 1, np.arange(len(sizes))
    total = np.logaddexp(alpha[last, 0, column], alpha[last, 1, column])
    beta = np.zeros_like(alpha)
    observed, expected, score = np.zeros((2, 2)), np.zeros((2, 2)), (tags[0] * (START + emission[0]) * times).sum()
    for t in range(longest - 1, 0, -1):
        m = alive[t]
        for a in (0, 1):
            moves = [transition[a, b] + (emission[t, :m] if b else 0.0) + beta[t, b, :m] for b in (0, 1)]
            beta[t - 1, a, :m] = np.logaddexp(*moves)
            for b in (0, 1):
                expected[a, b] += (np.exp(alpha[t - 1, a, :m] + moves[b] - total[:m]) * times[:m]).sum()
                observed[a, b] += times[:m][(tags[t - 1, :m] == a) & (tags[t, :m] == b)].sum()
        score += (tags[t, :m] * emission[t, :m] * times[:m]).sum()
    score += (observed * transition).sum()
    inside = np.arange(longest)[:, None] < sizes
    slope = np.where(inside, (tags - np.exp(alpha[:, 1] + beta[:, 1] - total)) * times, 0.0)
    return float(score - (total * times).sum()), slope, observed - expected


def maximize(value_and_slope, x: np.ndarray, steps: int = 50, tolerance: float = 1e-5) -> np.ndarray:
    """The maximum of a concave function, by limited-memory quasi-Newton steps with halving; it ends when a step gains less than ``tolerance`` of the value."""
    value, slope = value_and_slope(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, kept = slope.copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (s @ y)
            q -= a * y
            kept.append(a)
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1.0 / max(1.0, np.abs(slope).max())
        for (s, y), a in zip(past, reversed(kept), strict=True):
            q += (a - (y @ q) / (s @ y)) * s
        length = 1.0
        while length > 1e-8:
            new_value, new_slope = value_and_slope(x + length * q)
            if new_value >= value + 1e-4 * length * (slope @ q):
                break
            length /= 2
        else:
            return x
        step, turn = length * q, slope - new_slope
        if step @ turn > 1e-12:
            past = [*past[-9:], (step, turn)]
        gained = new_value - value
        x, value, slope = x + step, new_value, new_slope
        if gained <= tolerance * abs(value):
            return x
    return x


class Chains:
    """Training sequences: pieces of documents of at most ``PIECE`` tokens, as columns, longest first. Pieces without a telling feature differ by length alone, so each length of them is one column that counts many times."""

    def __init__(self, documents: Iterable[tuple[int, list[tuple[int, list[int], int]]]], n_features: int):
        """``documents``: (number of tokens, (place, features, tag) of the tokens that have a feature or tag 1)."""
        plain: Counter[int] = Counter()
        pieces: list[tuple[int, list[tuple[int, list[int], int]]]] = []
        for n, tokens in documents:
            full, rest = divmod(n, PIECE)
            plain[PIECE] += full
            plain[rest] += 1
            for k, own in groupby(tokens, key=lambda t: t[0] // PIECE):
                size = min(PIECE, n - k * PIECE)
                plain[size] -= 1
                pieces.append((size, [(at % PIECE, f, tag) for at, f, tag in own]))
        times = [1.0] * len(pieces)
        for size, n in plain.items():
            if size and n:
                pieces.append((size, []))
                times.append(float(n))
        order = sorted(range(len(pieces)), key=lambda i: -pieces[i][0])
        self.n_features = n_features
        self.sizes, self.times = np.array([pieces[i][0] for i in order], np.int64), np.array([times[i] for i in order])
        self.tags = np.zeros((int(self.sizes.max(initial=1)), len(order)))
        cells, flat = [], []
        for c, i in enumerate(order):
            for at, own, tag in pieces[i][1]:
                self.tags[at, c] = tag
                flat += own
                cells += [at * len(order) + c] * len(own)
        self.cell, self.feature = np.array(cells, np.int64), np.array(flat, np.int64)

    def unpack(self, x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """(feature weights, weight of any token, transitions)."""
        return x[: self.n_features], float(x[self.n_features]), x[self.n_features + 1 :].reshape(2, 2)

    def value_and_slope(self, x: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
        weights, any_token, transition = self.unpack(x)
        emission = np.bincount(self.cell, weights[self.feature], self.tags.size).reshape(self.tags.shape) + any_token
        value, slope, moves = likelihood(emission, self.tags, self.sizes, self.times, transition)
        features = np.bincount(self.feature, slope.ravel()[self.cell], self.n_features)
        return value - l2 / 2 * (x @ x), np.concatenate([features, [slope.sum()], moves.ravel()]) - l2 * x


def telling_features(texts: list[tuple[list[bytes], int]]) -> set[bytes]:
    """Features whose documents are toxic more often than chance allows: by the Benjamini-Hochberg rule at a false discovery rate of ``DISCOVERY``, and mostly. Near copies count once."""
    memo: dict[bytes, list[bytes]] = {}
    seen, rows_of = {0: Counter(), 1: Counter()}, {0: 0, 1: 0}
    for d in _without_near_copies(texts):
        words, y = texts[d]
        rows_of[y] += 1
        own: set[bytes] = set()
        for w in set(words):
            if w not in memo:
                memo[w] = features(w)
            own.update(memo[w])
        seen[y].update(own)
    share = rows_of[1] / (rows_of[0] + rows_of[1]) if rows_of[1] and rows_of[0] else 0.5
    tails = sorted((_tail(c, seen[0][f], share), f) for f, c in seen[1].items() if c > 2 * seen[0][f])
    level = np.log(DISCOVERY / max(1, len(seen[1])))
    last = max((i for i, (p, _) in enumerate(tails, 1) if p <= level + np.log(i)), default=0)
    return {f for _, f in tails[:last]}


def fit(sample: list[tuple[bytes, int]], l2: float = 0.1) -> Tagger:
    """Fit the field by the likelihood of token tags, weights and transitions together, then the document score on its marginals.

    A token of a toxic document is tagged if one of its features is telling. All telling
    features have a weight, regularised by ``l2``; words without any are background.
    A sample with one label only, or none, gives a field without features.
    """
    n1, n0 = sum(y for _, y in sample), sum(1 - y for _, y in sample)
    if not n1 or not n0:  # nothing to tell apart
        return Tagger({}, 0.0, np.array([[-0.01, -5.0], [-0.1, -2.0]]), np.array([4.0 if n1 else -4.0, 0.0, 0.0]))
    texts = [(t.translate(_WORDS).split(), y) for t, y in sample]
    names = sorted(telling_features(texts))
    number = {f: i for i, f in enumerate(names)}
    known: dict[bytes, list[int]] = {}
    for words, _ in texts:
        for w in words:
            if w not in known:
                known[w] = [number[f] for f in features(w) if f in number]
    chains = Chains(((len(words), [(i, known[w], y) for i, w in enumerate(words) if known[w]]) for words, y in texts), len(names))
    weights, any_token, transition = chains.unpack(maximize(lambda x: chains.value_and_slope(x, l2), np.zeros(len(names) + 5)))
    tagger = Tagger(dict(zip(names, weights.tolist(), strict=True)), any_token, transition, np.zeros(3))
    x = np.stack([_summary(tagger.tag(t)[0]) for t, _ in sample])
    tagger.document = _logistic(x, np.array([y for _, y in sample], float), 1.0, 12)
    tagger.known.clear()
    return tagger


def train(docs: DataFrame, labels: DataFrame, max_rows_per_label: int = MAX_ROWS_PER_LABEL, max_bytes: int = MAX_SAMPLE_BYTES) -> Tagger:
    """Learn from labelled documents that are not held out.

    A label with more than ``max_rows_per_label`` rows (or more text than its half of
    ``max_bytes``) is sampled by a hash of the id, whole texts only. A document with several
    labels counts as toxic if any says so; null labels are no labels.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("id"), common.text_bytes().alias("text"))
    met = common.stored(rows.select("id", F.octet_length("text").alias("bytes")).join(known, F.col("id") == F.col("doc_id")).select("id", "bytes", "toxic"), "labelled")
    draw = F.xxhash64("id", F.lit("toxicity")).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)
    chosen = F.lit(False)
    for r in met.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect():
        share = min(1.0, max_rows_per_label / r["n"], max_bytes / 2 / max(1, r["bytes"]))
        chosen = chosen | ((F.col("toxic") == r["toxic"]) & (draw < share))
    ids = common.stored(met.where(chosen).select("id", "toxic").distinct(), "sampled")
    # about max_rows_per_label ids of each label: counted, then sent to where the texts are
    few = ids.count() <= 4 * max_rows_per_label
    sample = rows.join(F.broadcast(ids) if few else ids, "id").select("id", "text", "toxic").orderBy("id", "text")
    return fit([(bytes(r["text"]), int(r["toxic"] > 0)) for r in sample.collect()])


def score_toxicity(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """One row per document: ``doc_id, score, spans``, the spans in code points with their marginals. No shuffle.

    Looks at ``text`` only. Null and empty texts, and texts without a suspicious word, get
    the score of a text without toxic tokens; repeated rows each get their row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())])

    def one(text: bytes) -> tuple[float, list[dict]]:
        marginals, at = shared.value.tag(text)
        spans, place, chars = [], 0, 0
        for p, (s, e) in zip(marginals, at, strict=True):
            if p >= SPAN_MARGINAL:
                chars += len(text[place:s].decode())
                end = chars + len(text[s:e].decode())
                spans.append({"start": chars, "end": end, "marginal": float(p)})
                place, chars = e, end
        return shared.value.score(marginals), spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.chunks(batch, "text"):
                got = [one(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s for s, _ in got], pa.float64()), pa.array([x for _, x in got], pa.list_(span))], names=["doc_id", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long"), common.text_bytes().alias("text")).mapInArrow(run, SCHEMA)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    found = score_toxicity(docs, train(docs, common.read(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
