import itertools

import numpy as np
import pytest
from siftline.llm import webp
from siftline.llm.webp import CROSS_COLOUR, PALETTE, PREDICTOR, SUBTRACT_GREEN, Options

RNG = np.random.default_rng(1)


def images():
    out = [np.full((1, 1, 4), 255, np.uint8), np.zeros((3, 70, 4), np.uint8)]
    for h, w, colours in ((1, 7, 2), (5, 9, 3), (20, 33, 14), (40, 64, 200), (64, 64, 3000), (2, 300, 5)):
        table = RNG.integers(0, 256, (colours, 4)).astype(np.uint8)
        x = table[RNG.integers(0, colours, (h, w))]
        x[h // 2 :] = x[: h - h // 2]
        out.append(x)
    smooth = np.add.outer(np.arange(50), np.arange(64))[..., None] * np.array([1, 2, 3, 0]) + np.array([0, 5, 9, 255])
    return [*out, smooth.astype(np.uint8), RNG.integers(0, 256, (17, 64, 4)).astype(np.uint8)]


def same(a, b):
    return len(a) == len(b) and all(x.shape == y.shape and (x == y).all() for x, y in zip(a, b, strict=True))


CHOICES = [None, (), *((k,) for k in (PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN)), *itertools.permutations((PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN), 3)]


@pytest.mark.parametrize("transforms", CHOICES)
def test_round_trip(transforms):
    x = images()
    assert same(webp.decode(webp.encode(x, Options(transforms))), x)


@pytest.mark.parametrize(("cache", "copies", "groups", "tile"), [(0, False, 1, 3), (1, True, 1, 2), (11, True, 3, 2), (5, False, 2, 4), (0, True, 5, 3)])
def test_round_trip_of_codes(cache, copies, groups, tile):
    x = images()
    assert same(webp.decode(webp.encode(x, Options((SUBTRACT_GREEN,), tile, cache, copies, groups, 4))), x)


@pytest.mark.parametrize("more", [(), (PREDICTOR,), (SUBTRACT_GREEN, CROSS_COLOUR, PREDICTOR)])
def test_palettes(more):
    x = [i for i in images() if len(np.unique(i.reshape(-1, 4), axis=0)) <= 256]
    assert same(webp.decode(webp.encode(x, Options((PALETTE, *more), cache_bits=3))), x)


def test_each_file_stands_alone():
    x = images()
    files = webp.encode(x)
    assert files == [webp.encode([i])[0] for i in x]
    assert same([webp.decode([f])[0] for f in files], x)


def test_a_file_written_by_hand():
    """A 2 x 1 image: simple codes, green 0 or 1 by a bit; red 0, blue 3, alpha 255 by none."""
    out, at = 0, 0
    for value, n in ((0x2F, 8), (1, 14), (0, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1), (0b011, 3), (0, 1), (1, 8), (0b001, 3), (0, 1), (0b101, 3), (3, 8), (0b101, 3), (255, 8), (0b001, 3), (0, 1), (0b10, 2)):
        out |= value << at
        at += n
    data = out.to_bytes((at + 7) // 8, "little")
    import struct

    file = b"RIFF" + struct.pack("<I", 12 + len(data)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data
    assert webp.decode([file])[0].tolist() == [[[0, 0, 3, 255], [0, 1, 3, 255]]]


def test_near_distances():
    assert len(webp.NEAR) == 120
    assert webp.NEAR[:12] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2)]
    assert webp.NEAR[-6:] == [(7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6)] or webp.NEAR[-2:] == [(8, 6), (8, 7)]


def test_huffman_lengths():
    counts = np.zeros((4, 40), np.int64)
    counts[0, 3] = 5
    counts[1, :40] = 1.6 ** np.arange(40)  # deeper than the limit without it
    counts[2, [1, 5, 9]] = 1, 1, 2
    counts[3] = 1
    got = webp.huffman_lengths(counts)
    assert got[0].nonzero()[0].tolist() == [3] and got[2, [1, 5, 9]].tolist() == [2, 2, 1]
    assert got.max() <= 15 and all(np.sum(2.0 ** -r[r > 0].astype(float)) == 1 for r in got[1:])


def test_broken_files_raise():
    good = webp.encode(images())[5]
    for bad in (b"", good[:30], good[:15] + b"X" + good[16:], good[:20] + b"\x00" + good[21:]):
        with pytest.raises(webp.WebPError):
            webp.decode([bad])
