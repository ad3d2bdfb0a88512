import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from herdwise.llm import alignment

from helpers import awkward, docs, empty


@pytest.fixture(scope="module")
def coders():
    """The vocabularies as their own libraries read them."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a = Tokenizer.from_file(f"{alignment.TOKENIZER_DIR}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    decode = decoders.ByteLevel()
    return a, decode, sentencepiece.SentencePieceProcessor(model_file=f"{alignment.TOKENIZER_DIR}/piece_bpe_32k.model")


def byte_of():
    """The byte-level alphabet: printable bytes are themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute(coders, rows):
    """Plain loops over tokens."""
    a_coder, _, b_coder = coders
    table, spaces = byte_of(), "▁"
    docs_, counts = [], Counter()
    for doc_id, text in rows:
        links, groups = [], []
        a = a_coder.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_coder.encode(text) if text else []
        raw_a = [bytes(table[c] for c in a_coder.id_to_token(i)) for i in a]
        raw_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace(spaces, " ").encode() for p in map(b_coder.id_to_piece, b)]
        if not text or b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            docs_.append((doc_id, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        i = j = 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            own = [], []
            while i < len(a) and ends_a[i] <= cut:
                own[0].append(a[i])
                i += 1
            while j < len(b) and ends_b[j] <= cut:
                own[1].append(b[j])
                j += 1
            groups.append((cut, *own))
            links.append((own[0][-1], own[1][-1]))  # no token of these vocabularies is empty
        counts.update(links)
        docs_.append((doc_id, a, b, groups, links))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for doc_id, a, b, groups, links in docs_:
        text = ";".join(",".join(map(str, g[1])) + "|" + ",".join(map(str, g[2])) for g in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=repr)


TEXTS = ["The quick brown fox, 1234 jumps!", "naïve café – 日本語 🙂", "  two  spaces\tand\n\nlines ", "<|endoftext|> and </s> <s> <unk> <0x41> text", "a", " ", "▁ piece mark", "x" * 300, "don't it's we'll", "ﬁ ligature Ａ wide", "é combining", None, "", "\x00 nul", "same same same same", "​ zero width", "١٢٣ arabic", "\r\n crlf"]


def found(df, **kw):
    return sorted((tuple(r) for r in alignment.align_tokens(df, **kw).collect()), key=repr)


def test_equals_plain_loops(spark, coders):
    rows = [(i, t) for i, t in enumerate(TEXTS * 2)]
    want = brute(coders, rows)
    assert found(docs(spark, rows).repartition(3)) == want
    assert sum(x[1] > 0 for x in want) > 20 and any(x[5] < x[4] for x in want)


def test_the_join_gives_the_same(spark, coders):
    rows = [(i % 9, t) for i, t in enumerate(TEXTS * 2)]
    df = docs(spark, rows)
    assert found(df, broadcast_pairs=0) == found(df) == brute(coders, rows)


def test_awkward_rows(spark, coders):
    df = awkward(spark)
    assert found(df) == brute(coders, [(r.doc_id, r.text) for r in df.collect()])
    assert found(empty(spark)) == []
    assert found(empty(spark), broadcast_pairs=-1) == []


def test_on_given_documents(spark, coders):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(df) == brute(coders, [(r.doc_id, r.text) for r in df.collect()])


def test_tokens_without_bytes_share_an_end():
    """Tokens that are empty end where the one before them ends: all of them link."""
    own = object.__new__(alignment.Aligner)
    own._a_length, own._b_length = np.array([1, 2, 0]), np.array([1, 2, 0])
    own.a_bytes = own.b_bytes = [b"x", b"yz", b""]
    own._words = [f"{i}{s}".encode() for s in ",|;" for i in range(3)]
    n, digest, a, b = own.align(np.array([0, 2, 1]), np.array([0, 1, 2]))
    assert n == 2 and digest == hashlib.sha256(b"0,2|0;1|1,2").hexdigest()
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 0), (2, 0), (1, 1), (1, 2)]


def test_counts_are_whatever_the_salt(spark):
    rows = spark.createDataFrame([([1, 5], [2, 3]), ([1], [4]), ([alignment.PAIR + 1], [1]), ([], [])], "pairs array<long>, times array<int>").repartition(4)
    got = {r.pair: (r.n, r.best) for r in alignment.pair_counts(rows).collect()}
    assert got == {1: (6, True), 5: (3, False), alignment.PAIR + 1: (1, True)}
    assert alignment.pair_counts(rows.where(F.size("pairs") > 5)).count() == 0
