"""Token counts, packing and the pre-token cache against the tokenizers library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tests.conftest import SMALL
from tests.llm.cases import empty_docs, odd_docs, odd_texts

from tabloom.llm import bpe
from tabloom.llm import queries as Q
from tabloom.llm.bpe import Encoder, Pieces
from tabloom.llm.hilbert import hilbert_index
from tabloom.llm.packing import pack
from tabloom.llm.token_counts import count_tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(Q.vocabulary())


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("ranks", [None, Q.vocabulary("byte_bpe_50k.tiktoken")])
def test_cache_equals_library(library, ranks):
    rng = random.Random(5)
    alphabet = "   abcXYZ 0129.,!?'’\n\t\r\x0b\x0c\x1c\x1f éßñçÉ  　あ²½́\U0001f600-_<|>"
    pieces = Pieces(Q.vocabulary(), tuple, lambda v: sum(v, ()), limit=50, ranks=ranks)
    for _ in range(1500):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        assert pieces.of(t) == tuple(ids(library, t)), repr(t)


@pytest.mark.parametrize("ranks", [None, Q.vocabulary("byte_bpe_50k.tiktoken")])
def test_encoder_equals_library(library, monkeypatch, ranks):
    """Texts of many kinds in one batch; the cache is soon full, and a part holds few texts."""
    monkeypatch.setattr(bpe, "TOGETHER", 300)
    rng = random.Random(8)
    alphabet = "   abcXYZ 0129.,!?'’\n\t\r\x0b\x0c\x1c\x1f\xa0éßñçÉ  　あ²½́\U0001f600-_<|>"
    plain = "abcXYZ01.,!?'’éß-_<|> \n"
    texts = ["", " ", "\n", "a", "a b", "a\nb", "a \nb", "a <|endoftext|> b", "a\n\nb c", "a\xa0b \xa0c d"]
    for i in range(1500):
        words = ["".join(rng.choice(alphabet if i % 3 == 0 else plain[:-2]) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(25))]
        texts.append("".join(w + rng.choice(" \n") for w in words).strip(rng.choice(" x")))
    encoder = Encoder(Q.vocabulary(), 50, ranks)
    for s in range(0, len(texts), 100):
        for t, x in zip(texts[s:s + 100], encoder.of(texts[s:s + 100]), strict=True):
            assert np.frombuffer(x, "<u2").tolist() == ids(library, t), repr(t)
    assert len(encoder.rows) == 50 and len(encoder.bounds) == 51
    assert encoder.of([]) == []


def test_new_words_are_encoded_together(library):
    """Words that the cache has no room for cost no call of the tokenizer each."""
    encoder = Encoder(Q.vocabulary(), 100, Q.vocabulary("byte_bpe_50k.tiktoken"))
    calls, ranks = [], encoder.pieces.ranks
    encoder.pieces.ranks = lambda t: calls.append(t) or ranks(t)
    texts = [" ".join(f"{chr(97 + i % 26)}{j}x{i}" for j in range(50)) for i in range(200)]
    for _ in range(2):
        calls.clear()
        assert [np.frombuffer(x, "<u2").tolist() for x in encoder.of(texts)] == [ids(library, t) for t in texts]
        assert len(calls) < 3 * len(texts) + 10      # the first word of each text is cut into its pieces


def test_counts_equal_library(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in Q.op10_token_counts(spark, SMALL).collect():
        assert r.n_tokens == len(ids(library, text[r.doc_id]))
        assert r.n_bytes == len(text[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 1024)


def test_counts_odd_rows(spark, library):
    out = count_tokens(odd_docs(spark), Q.vocabulary()).collect()
    assert len(out) == len(odd_texts()) + 2
    by = {r.doc_id: r for r in out}
    for i, t in enumerate(odd_texts()):
        assert by[i].n_tokens == len(ids(library, t)) and by[i].n_bytes == len((t or "").encode())
    assert count_tokens(empty_docs(spark), Q.vocabulary()).count() == 0


def test_hilbert_is_a_curve():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = hilbert_index(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        step = np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1)
        assert (step == 1).all()


def check_pack(rows, texts, library, size):
    seqs, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append(r)
        docs[r.doc_id].append(r)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    assert sum(sum(r.length for r in s) < size for s in seqs.values()) <= 1
    for d, own in docs.items():
        want = ids(library, texts[d]) + [1]
        copies = defaultdict(int)
        for r in own:
            assert r.doc_tokens == len(want)
            assert r.ids_crc32 == zlib.crc32(np.array(want[r.start:r.start + r.length], "<u4").tobytes())
            for k in range(r.start, r.start + r.length):
                copies[k] += 1
        assert len(copies) == len(want) and len(set(copies.values())) == 1


def test_pack_round_trip(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = Q.op4_hilbert_packing(spark, SMALL).collect()
    check_pack(rows, {r.doc_id: r.text for r in docs.collect()}, library, 2048)
    assert len({r.doc_id for r in rows}) == docs.count()


def test_pack_odd_rows(spark, library):
    rows = pack(odd_docs(spark), Q.vocabulary(), 64).collect()
    check_pack(rows, dict(enumerate(odd_texts())) | {None: "null id"}, library, 64)
    assert sum(r.length for r in rows if r.doc_id == 4) == 2 * rows[[r.doc_id for r in rows].index(4)].doc_tokens
    assert pack(empty_docs(spark), Q.vocabulary()).count() == 0


def test_neighbours_are_alike(spark):
    a, b = "red green blue yellow " * 40, "uno dos tres cuatro cinco " * 40
    docs = spark.createDataFrame([(i, (a, b)[i % 2]) for i in range(40)], "doc_id long, text string")
    rows = sorted(pack(docs, Q.vocabulary(), 1 << 20).collect(), key=lambda r: r.offset)
    kinds = [r.doc_id % 2 for r in rows]
    assert sum(x != y for x, y in zip(kinds, kinds[1:])) == 1
