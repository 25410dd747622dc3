import random
import zlib

import numpy as np
import pytest
from siftline.llm import bpe, packing
from tests.llm.test_bpe import texts
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def words():
    path = bpe.vocabulary(packing.WORDS)
    return path, Tokenizer.from_file(path)


def test_ids_are_the_library_s(words):
    path, tok = words
    codec = packing.WordCodec(path, entries=50)
    t = list(texts())
    want = [e.ids for e in tok.encode_batch(t, add_special_tokens=False)]
    for at in range(0, len(t), 37):
        assert [x.tolist() for x in codec.encode(t[at : at + 37])] == want[at : at + 37]


def test_every_code_point(words):
    path, tok = words
    codec = packing.WordCodec(path)
    for at in range(0, 0x11000, 64):
        t = "".join(f"a{c} b {c}{c} A{c}e " for c in map(chr, range(at, at + 64)) if not "\ud800" <= c <= "\udfff")
        assert codec.encode([t])[0].tolist() == tok.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(30))
def test_plans_are_whole_and_tight(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.choice([7, 50, 300]))
    counts = np.zeros(size + 1, np.int64)
    for n in rng.integers(1, size + 1, rng.integers(0, 40)):
        counts[n] += rng.integers(1, 30)
    plan = packing.plan_packing(counts, size)
    back = np.zeros(size + 1, np.int64)
    for parts, many in plan:
        assert sum(parts) <= size and many > 0
        for n in parts:
            back[n] += many
    assert (back == counts).all()
    bins, greedy = sum(m for _, m in plan), first_fit(counts, size)
    assert -(-int((counts * np.arange(size + 1)).sum()) // size) <= bins <= greedy + 1 + greedy // 50


def first_fit(counts, size):
    gaps = []
    for n in range(size, 0, -1):
        for _ in range(int(counts[n])):
            i = min((i for i in range(len(gaps)) if gaps[i] >= n), key=lambda i: gaps[i], default=None)
            if i is None:
                gaps.append(size - n)
            else:
                gaps[i] -= n
    return len(gaps)


def test_two_take_the_place_of_the_smallest():
    counts = np.zeros(11, np.int64)
    counts[[6, 3, 2]] = 1, 1, 2
    assert packing.plan_packing(counts, 10)[0] == ([6, 2, 2], 1)


def test_query(spark, tmp_path, words):
    _, tok = words
    rng = random.Random(3)
    rows = [*texts(80), "", None, None, "the cat " * 6000, "x" * 9000, *(["a b c"] * 40)]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    spark.createDataFrame(list(zip(ids, rows, strict=True)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = packing.query(spark, str(tmp_path)).collect()
    want = set()
    for i, t in zip(ids, rows, strict=True):
        x = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want |= {(i, k, a, len(x[a : a + 4096]), zlib.crc32(x[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(x), 4096))}
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_empty_table(spark, words):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), words[0]).count() == 0


def test_the_word_cache_is_bounded():

    path = bpe.vocabulary(packing.WORDS)
    codec, library = packing.WordCodec(path, entries=1000), Tokenizer.from_file(path)
    for k in range(4):
        texts = [" ".join(f"w{k}x{i}" for i in range(5000)), "a" * 100_000, "the cat", ""]
        for t, ids in zip(texts, codec.encode(texts), strict=True):
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids
        assert len(codec.known) <= 1001 and max(map(len, codec.known)) <= packing.KNOWN_CHARS and len(codec.start) == len(codec.known)
