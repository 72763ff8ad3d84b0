import random

import pytest

from quirework.llm import tokens


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    return lambda text: tok.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def codec():
    return tokens.Codec(tokens.serialise_model(tokens.read_ranks(tokens.default_vocabulary())), tokens.default_pattern())


def test_ids_equal_another_library(codec, reference):
    rng = random.Random(5)
    chars = "abcXYZ 019.,\n\t'éßñ中文日本語ไทยعربי€😀​　<|endoftext|>"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(0, 60))) for _ in range(400)]
    texts += ["<|endoftext|>", "it's we'll  THEY'RE", "a" * 3000, " " * 500, "\x00\x01 "]
    assert codec.encode_batch(texts) == [reference(t) for t in texts]
    assert [codec.decode(i) for i in codec.encode_batch(texts)] == texts


def test_null_empty_repeats_and_clashing_columns(spark, codec):
    rows = [(1, None, "x"), (2, "", "x"), (3, "two words", "x"), (3, "two words", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in tokens.encode_text(df).collect())
    want = codec.encode_batch(["two words"])[0]
    assert got == [(1, []), (2, []), (3, want), (3, want)]
    assert tokens.encode_text(df.limit(0)).count() == 0


def test_query_covers_every_document(spark, sf_dir, reference):
    got = {r.doc_id: list(r.ids) for r in tokens.p7_ids(spark, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert got == {k: reference(t) if t else [] for k, t in texts.items()}
