import hashlib
import random

import pytest
from siftline.llm import bpe, packing
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def byte_level():
    path = bpe.vocabulary()
    return path, Tokenizer.from_file(path)


def texts(k=1500):
    rng = random.Random(0)
    mixed = ["a", "b", "th", "E", " ", "\n", "é", "e\u0301", "日", "😀", "-", "_", "'s", "0", "1", "<|endoftext|>", "\t", "Σ", "İ", "<|", "\u1c89", "\u0561", "\x1c", "\u2028"]
    for i in range(k):
        n = rng.choice([5, 50, 400]) if i % 10 == 0 else rng.randint(0, 60)
        yield "".join(rng.choices([["a", "b", "c", "the", "in", "g"], ["日", "本", "é", "a", "😀"], mixed][i % 3], k=n))


def test_encodes_and_decodes_as_the_library(byte_level):
    path, tok = byte_level
    codecs = bpe.Codec(path, long=40, leaf=7, window=1), bpe.Codec(path)
    for t in texts():
        ids = tok.encode(t, add_special_tokens=False).ids
        assert all(c.encode(t) == ids for c in codecs)
        assert codecs[0].decode(ids) == tok.decode(ids, skip_special_tokens=False)


def test_long_unsplit_text(byte_level):
    path, tok = byte_level
    rng = random.Random(2)
    codec = bpe.Codec(path)
    for letters in ("abcdefgh", "a", "日本語é", "=-"):
        t = "x " + "".join(rng.choices(letters, k=30_000)) + " y"
        assert codec.encode(t) == tok.encode(t, add_special_tokens=False).ids


def test_words_of_some_length_are_trees(byte_level):
    path, tok = byte_level
    rng = random.Random(4)
    codec = bpe.Codec(path)
    spaces = [" ", " ", " ", "  ", "\n", " \n", "\t", "\u3000", " \u3000", "\u3000 ", "\x1c", " " * 17, " " * 18, "\n" * 40, " " * 19 + "\n", "\u3000" * 20]
    for k in range(600):
        letters = ["abcdefghijklmnop", "ab", "aé日", "a=-1'"][k % 4]
        t = "".join("".join(rng.choices(letters, k=rng.choice([1, 5, 15, 16, 17, 18, 33, 60]))) + rng.choice(spaces) for _ in range(12))
        t = rng.choice(["", " ", "\n", " " * 30]) + t
        before = codec.tree_pieces
        assert codec.encode(t) == tok.encode(t, add_special_tokens=False).ids
        if k % 4 == 0:
            assert codec.tree_pieces - before >= sum(len(w) > 16 for w in t.replace("\x1c", " ").split())
    assert codec.tree_pieces > 3000


def test_every_code_point(byte_level):
    path, tok = byte_level
    codec = bpe.Codec(path)
    for at in range(0, 0x11000, 256):
        t = "".join(f"a{c} b {c}{c}" for c in map(chr, range(at, at + 256)) if not "\ud800" <= c <= "\udfff")
        assert codec.encode(t) == tok.encode(t, add_special_tokens=False).ids


def test_query(spark, tmp_path, byte_level):
    _, tok = byte_level
    rows = [*texts(60), "", None, None]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = bpe.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = tok.encode(rows[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.n_tree_pieces <= r.n_tokens
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_then_decode(spark, byte_level):
    rows = [(i, t) for i, t in enumerate(texts(30))] + [(99, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    back = bpe.decode_ids(bpe.encode_texts(df, byte_level[0]), byte_level[0])
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in rows}
    assert bpe.encode_texts(df.limit(0), byte_level[0]).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.Codec(bpe.vocabulary(packing.WORDS))
