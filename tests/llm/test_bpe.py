"""Merge replay against the tiktoken library, and round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from tidewatch.llm import bpe

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(7)

    def anything():
        ranges = [(32, 127), (0x100, 0x3000), (0x3000, 0xD800), (0xE000, 0x20000)]
        return "".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(1, 200)))

    few = ["".join(rng.choice("aabcdeiorst =-_*#01\n") for _ in range(rng.randrange(1, 500))) for _ in range(200)]
    fixed = ["", " ", "\n\n  x", "a" * 5000, "ab" * 3000 + "c", "don't we'LL 'tis it's", "ՠa ᲊb ǅ Ⅷ½ ٣", "　字字　", "\x1c\x1d a\x85b"]
    return fixed + few + [anything() for _ in range(200)]


def test_encoder_agrees_with_the_library(ranks, library):
    texts = odd_texts()
    encoder = bpe.Encoder(ranks, bpe.unicode_classes())
    for text, ids in zip(texts, encoder(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)


def test_tokens_do_not_depend_on_buffers_or_memory(ranks, monkeypatch):
    texts = odd_texts()[:120]
    whole = list(bpe.Encoder(ranks, bpe.unicode_classes())(texts))
    monkeypatch.setattr(bpe, "REMEMBERED", 30)
    monkeypatch.setattr(bpe, "PAIRS", 50)
    encoder = bpe.Encoder(ranks, bpe.unicode_classes())
    assert [ids for t in texts for ids in encoder([t])] == whole


def test_buffers_hold_every_row(monkeypatch):
    monkeypatch.setattr(bpe, "BUFFER_BYTES", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n if n != 3 else None for n in (0, 4, 6, 3, 25, 0, 1, 10, 11)])], names=["t"])
    parts = [p.column(0).to_pylist() for p in bpe._buffers(batch, 0)]
    assert [t for p in parts for t in p] == batch.column(0).to_pylist()
    assert all(len(p) == 1 or sum(len(t or "") for t in p) <= 10 for p in parts)


def test_lower_ranks_that_a_merge_makes_come_first_in_their_word():
    # "bc" and then "abc", whose rank is lower than that of "bc" itself, and the same pair again in one word
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"xx": 257, b"bc": 258, b"abca": 259, b"cb": 260}
    library = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    words = ["".join(rng.choice("abcx") for _ in range(rng.randrange(1, 30))) for _ in range(500)]
    found = bpe.Replay(ranks).merge([w.encode() for w in words])
    assert [w if w.encode() not in ranks else None for w in words] and all(
        ids == library.encode_ordinary(w) for w, ids in zip(words, found) if w.encode() not in ranks)


def test_query_on_odd_rows(spark, library):
    rows = [(None, "no id"), (1, None), (2, ""), (3, "twice"), (3, "twice"), (4, "long words " * 20_000), (5, "x" * 30_000)]
    df = spark.createDataFrame([(i, t, b"old", "d") for i, t in rows], "doc_id long, text string, ids binary, decoded string").repartition(3)
    out = bpe.decode(bpe.encode(df)).collect()
    assert out[0].asDict().keys() == {"doc_id", "text", "ids", "decoded"} and len(out) == len(rows)
    for r in out:
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == library.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]).decode() == (r["text"] or "")
    assert bpe.encode(df, decoded="decoded").drop("ids").exceptAll(bpe.decode(bpe.encode(df)).drop("ids")).count() == 0
    assert bpe.encode(df.limit(0)).count() == 0
    lost = bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary")).first()
    assert lost["decoded"] is None


def test_query_against_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    found = {r["doc_id"]: r for r in bpe.op11_bpe(spark, DIR).collect()}
    assert found.keys() == texts.keys()
    for i, text in texts.items():
        ids = library.encode_ordinary(text)
        assert found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
