"""Encoding and decoding against the tokenizers library, and on nulls, empty and long texts, repeated rows and empty tables."""

import hashlib
import random

import pyarrow as pa
import pytest

from wardlens.llm import bpe, queries, storage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def coder():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary()


def test_random_texts(coder, vocabulary):
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>",
             "a", "word", "It's", "we'll", "'S", "'", "é", "é", "ΑΣ", "İ", "ß", "ﬁ", "日本", "각", "1", "²", "½", "234", "!", "...", "​", "😀", "\x00", "Ᲊ", "K"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    assert vocabulary.encode(pa.array(texts)).to_pylist() == [x.ids for x in coder.encode_batch(texts, add_special_tokens=False)]


def test_every_character(coder, vocabulary):
    texts = [f"a{chr(i)}b" for i in range(0x30000) if not 0xD800 <= i < 0xE000]
    assert vocabulary.encode(pa.array(texts)).to_pylist() == [x.ids for x in coder.encode_batch(texts, add_special_tokens=False)]


def test_array_and_heap_merge_alike(coder, vocabulary):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdethéß") for _ in range(n)) for n in [1, 2, 3, *(rng.randint(4, 400) for _ in range(300))]]
    signs = [vocabulary.words(t)[0] for t in texts]
    ids, heads = vocabulary.word_ids(signs)
    for text, word, a, b in zip(texts, signs, heads, heads[1:]):
        assert vocabulary.merged_long(word) == ids[a:b].tolist() == coder.encode(text, add_special_tokens=False).ids
    assert max(map(len, signs)) > bpe.SHORT
    assert vocabulary.encode(pa.array(["x" * 100_000])).to_pylist()[0] == coder.encode("x" * 100_000, add_special_tokens=False).ids


def test_query_equals_the_library(spark, coder):
    storage.ready(spark)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op13_bpe_encoding(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = coder.encode(texts[r.doc_id], add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), coder.decode(ids, skip_special_tokens=False))]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), *sha)


def test_odd_rows(spark, coder):
    storage.ready(spark)
    rows = [(None, None, "x"), (1, "", None), (2, " \n\t", "x"), (3, "Word " * 30_000, "x"), (3, "Word " * 30_000, "x"), (None, "y" * 40_000, "x"), (4, "<|endoftext|>é", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    done = bpe.decode(bpe.encode(frame)).collect()
    want = [(i, coder.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows]
    key = lambda x: (x[0] or 0, len(x[1]))
    assert sorted(((r.doc_id, r.ids) for r in done), key=key) == sorted(want, key=key)
    assert all(r.text == coder.decode(r.ids, skip_special_tokens=False) for r in done)
    assert bpe.decode(bpe.encode(frame.limit(0))).count() == 0
    strange = spark.createDataFrame([(1, [320, -5, None, 10**6, 49407]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(strange).collect()} == {1: "a</w> <|endoftext|>", 2: "", 3: ""}
