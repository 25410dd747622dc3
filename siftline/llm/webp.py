"""Lossless WebP in numpy, for many images at once.

The bitstream has no places to start from within an image, but a batch has many images: all of them are decoded in step,
a pixel of each at a time, and each step is a few numpy calls over the images that still have pixels. Encoding works on
flat arrays of all pixels of a batch.

Decoding covers the whole format: simple and normal prefix codes, meta prefix codes, back-references, colour cache, and
the predictor, cross-colour, subtract-green and colour-indexing transforms, in any order.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from .common import flat, gather

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
MAX_BITS = 15
#: Fixed values of the format: the order in which code length code lengths are stored, and the colour cache's multiplier.
LENGTH_ORDER = np.array([17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15])
CACHE_MULTIPLIER = np.uint32(0x1E35A7BD)
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
#: Distance codes that name a place near the pixel: (left, up), nearest first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
_NEAR_X, _NEAR_Y = np.array(NEAR).T


class WebPError(ValueError):
    """The bytes aren't a lossless WebP image that follows the format."""


# ---------------------------------------------------------------- prefix codes


def _reversed(bits: int) -> np.ndarray:
    out = np.zeros(1, np.int64)
    for _ in range(bits):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


_REVERSED = [_reversed(b) for b in range(MAX_BITS + 1)]


def decode_tables(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For codes given by rows of lengths: flat entries (symbol << 4 | bits), each code's start, and its index mask.

    A code of one symbol takes no bits.
    """
    n, size = lengths.shape
    used = (lengths > 0).sum(axis=1)
    row, sym = np.nonzero(lengths)
    ln = lengths[row, sym].astype(np.int64)
    ln[used[row] == 1] = 0
    if (used == 0).any():
        raise WebPError("a prefix code without symbols")
    most = np.zeros(n, np.int64)
    np.maximum.at(most, row, ln)
    order = np.lexsort((sym, ln, row))
    row, sym, ln = row[order], sym[order], ln[order]
    width = np.int64(1) << (most[row] - ln)
    if (np.bincount(row, width, n).astype(np.int64) != np.int64(1) << most).any():
        raise WebPError("a prefix code that isn't complete")
    entries = np.repeat((sym << 4 | ln).astype(np.uint16), width)
    count = np.int64(1) << most
    start = np.cumsum(count) - count
    out = np.empty_like(entries)
    for b in np.unique(most).tolist():
        rows = start[most == b]
        out[rows[:, None] + np.arange(1 << b)] = entries[rows[:, None] + _REVERSED[b]]
    return out, start, count - 1


def huffman_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Code lengths of Huffman codes for rows of counts, all rows in step; a lone symbol gets length 1."""
    counts = counts.astype(np.int64)
    n, size = counts.shape
    out = np.zeros((n, size), np.uint8)
    todo, floor = np.arange(n), 0
    while len(todo):
        c = counts[todo]
        c = np.where(c > 0, np.maximum(c, floor), 0)
        got = _huffman(c)
        fine = got.max(axis=1) <= limit
        out[todo[fine]] = got[fine]
        todo = todo[~fine]
        floor = max(2 * floor, 2)
    return out


def _huffman(counts: np.ndarray) -> np.ndarray:
    n, size = counts.shape
    big = np.iinfo(np.int64).max // 4
    used = (counts > 0).sum(axis=1)
    width = int(used.max(initial=0))
    order = np.argsort(np.where(counts > 0, counts, big), axis=1, kind="stable")[:, :width]
    leaf = np.full((n, width + 2), big)
    leaf[:, :width] = np.where(np.arange(width) < used[:, None], np.take_along_axis(counts, order, axis=1), big)
    node = np.full((n, width + 2), big)
    parent = np.zeros((n, 2 * width + 2), np.int64)  # leaves first, then inner nodes
    i, j = np.zeros(n, np.int64), np.zeros(n, np.int64)
    all_rows = np.arange(n)
    for k in range(width - 1):
        live = all_rows[used > k + 1]
        total = np.zeros(len(live), np.int64)
        for _ in range(2):
            a, b = leaf[live, i[live]], node[live, j[live]]
            take = a <= b
            at = np.where(take, i[live], width + j[live])
            parent[live, at] = width + k
            total += np.where(take, a, b)
            i[live] += take
            j[live] += ~take
        node[live, k] = total
    depth = np.zeros((n, 2 * width + 2), np.int64)
    for k in range(width - 3, -1, -1):
        live = all_rows[used > k + 2]
        depth[live, width + k] = depth[live, parent[live, width + k]] + 1
    got = np.take_along_axis(depth, parent[:, :width], axis=1) + 1
    out = np.zeros((n, size), np.int64)
    row, col = np.nonzero(np.arange(width) < used[:, None])
    out[row, order[row, col]] = got[row, col]
    return out


def code_words(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, bits) by row and symbol: canonical codes, turned so that the first bit is the lowest; a lone symbol takes none."""
    row, sym = np.nonzero(lengths)
    ln = lengths[row, sym].astype(np.int64)
    order = np.lexsort((sym, ln, row))
    row, sym, ln = row[order], sym[order], ln[order]
    before = np.cumsum(np.int64(1) << (MAX_BITS - ln)) - (np.int64(1) << (MAX_BITS - ln))
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(row)))
    word = _REVERSED[MAX_BITS][(before - np.repeat(before[first], size)) & (1 << MAX_BITS) - 1]
    alone = np.repeat(size == 1, size)
    words, bits = np.zeros(lengths.shape, np.uint32), np.zeros(lengths.shape, np.uint8)
    words[row, sym] = np.where(alone, 0, word)
    bits[row, sym] = np.where(alone, 0, ln)
    return words, bits


# ---------------------------------------------------------------- decoding


class Bits:
    """Bit streams side by side in one buffer, each with a position of its own."""

    def __init__(self, streams: list[bytes]):
        size = np.array([len(s) for s in streams], np.int64)
        data = b"".join(s + bytes(16) for s in streams) + bytes(16)
        self.view = np.ndarray((len(data) - 8,), "<u8", data, 0, (1,))
        starts = np.cumsum(size + 16) - size - 16
        self.pos, self.end = starts * 8, (starts + size) * 8

    def peek(self, rows) -> np.ndarray:
        """At least 57 bits from each stream."""
        p = self.pos[rows]
        return self.view[p >> 3] >> (p & 7).astype(np.uint64)

    def read(self, rows: np.ndarray, n) -> np.ndarray:
        got = (self.peek(rows) & ((np.uint64(1) << np.asarray(n).astype(np.uint64)) - np.uint64(1))).astype(np.int64)
        self.pos[rows] += n
        return got

    def check(self, rows) -> None:
        if (self.pos[rows] > self.end[rows]).any():
            raise WebPError("the data ends too soon")


def _read_code(bits: Bits, rows: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Lengths of the next prefix code of each stream; sizes: symbols of its alphabet."""
    out = np.zeros((len(rows), width), np.uint8)
    simple = bits.read(rows, 1) == 1
    if simple.any():
        at, r = np.flatnonzero(simple), rows[simple]
        two, wide = bits.read(r, 1) == 1, bits.read(r, 1)
        first = bits.read(r, 1 + 7 * wide)
        out[at, first] = 1
        second = bits.read(r[two], 8)
        out[at[two], second] = 1
    if not simple.all():
        at, r = np.flatnonzero(~simple), rows[~simple]
        n = 4 + bits.read(r, 4)
        of_lengths = np.zeros((len(r), 19), np.uint8)
        for k in range(int(n.max())):
            more = np.flatnonzero(n > k)
            of_lengths[more, LENGTH_ORDER[k]] = bits.read(r[more], 3)
        table, start, mask = decode_tables(of_lengths)
        left = sizes[at].copy()
        given = np.flatnonzero(bits.read(r, 1))
        if len(given):
            left[given] = 2 + bits.read(r[given], 2 + 2 * bits.read(r[given], 3))
        place, last = np.zeros(len(r), np.int64), np.full(len(r), 8)
        live = np.arange(len(r))
        while True:
            live = live[(left[live] > 0) & (place[live] < sizes[at[live]])]
            if not len(live):
                break
            entry = table[start[live] + (bits.peek(r[live]) & mask[live].astype(np.uint64)).astype(np.int64)]
            bits.pos[r[live]] += entry & 15
            sym = (entry >> 4).astype(np.int64)
            left[live] -= 1
            plain = sym < 16
            x, s = live[plain], sym[plain]
            out[at[x], place[x]] = s
            place[x] += 1
            last[x] = np.where(s > 0, s, last[x])
            for code, extra, base in ((16, 2, 3), (17, 3, 3), (18, 7, 11)):
                x = live[sym == code]
                if len(x):
                    many = base + bits.read(r[x], extra)
                    if (place[x] + many > sizes[at[x]]).any():
                        raise WebPError("code lengths run over")
                    if code == 16:
                        run, k = flat(many)
                        out[at[x][run], place[x][run] + k] = last[x][run]
                    place[x] += many
        bits.check(r)
    return out


def _value(bits: Bits, rows: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Lengths and distances: a prefix, and extra bits from 4 on."""
    extra = np.maximum(prefix - 2, 0) >> 1
    got = bits.read(rows, extra)
    return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << extra) + got + 1)


def _entropy_image(bits: Bits, rows: np.ndarray, width: np.ndarray, height: np.ndarray, main: bool) -> tuple[np.ndarray, np.ndarray]:
    """Decodes the next image of each stream: flat ARGB, and each image's start."""
    n = len(rows)
    cache_bits = np.zeros(n, np.int64)
    has = np.flatnonzero(bits.read(rows, 1))
    cache_bits[has] = bits.read(rows[has], 4)
    if ((cache_bits[has] < 1) | (cache_bits[has] > 11)).any():
        raise WebPError("a colour cache of an unknown size")
    groups, meta, meta_start, meta_bits, meta_width = np.ones(n, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    with_meta = np.flatnonzero(bits.read(rows, 1)) if main else np.zeros(0, np.int64)
    if len(with_meta):
        b = bits.read(rows[with_meta], 3) + 2
        w, h = _tiles(width[with_meta], b), _tiles(height[with_meta], b)
        pixels, start = _entropy_image(bits, rows[with_meta], w, h, False)
        meta = (pixels.astype(np.int64) >> 8) & 0xFFFF
        meta_start[with_meta], meta_bits[with_meta], meta_width[with_meta] = start, b, w
        groups[with_meta] = np.maximum.reduceat(meta, start) + 1
    sizes = LITERALS + LENGTHS + np.where(cache_bits > 0, 1 << cache_bits, 0)
    first = np.cumsum(groups) - groups
    lengths = [np.zeros((int(groups.sum()), int(s)), np.uint8) for s in (sizes.max(), 256, 256, 256, DISTANCES)]
    for g in range(int(groups.max())):
        x = np.flatnonzero(groups > g)
        for k, out in enumerate(lengths):
            size = sizes[x] if k == 0 else np.full(len(x), out.shape[1])
            out[first[x] + g] = _read_code(bits, rows[x], size, out.shape[1])
    (tg, sg, mg), (tr, sr, mr), (tb, sb, mb), (ta, sa, ma), (td, sd, md) = map(decode_tables, lengths)
    mg, mr, mb, ma, md = (m.astype(np.uint64) for m in (mg, mr, mb, ma, md))

    # Images with most pixels first, so that those still at work are a prefix.
    pixels = width * height
    order = np.argsort(-pixels, kind="stable")
    most = pixels[order]
    rows, first, cache_bits, w, with_m = rows[order], first[order], cache_bits[order], width[order], np.isin(order, with_meta)
    m_start, m_bits, m_width = meta_start[order], meta_bits[order], meta_width[order]
    start = np.cumsum(pixels) - pixels
    base = start[order]
    out = np.zeros(int(pixels.sum()), np.uint32)
    cache_size = np.where(cache_bits > 0, 1 << cache_bits, 0)
    cache_start = np.cumsum(cache_size) - cache_size
    cache = np.zeros(int(cache_size.sum()) + 1, np.uint32)
    cached, cache_shift = cache_bits > 0, (32 - cache_bits).astype(np.uint32)
    all_cached, no_cache, no_meta, one_alpha = cached.all(), not cached.any(), not with_m.any(), not ma.any()
    left, dist = np.zeros(n, np.int64), np.ones(n, np.int64)
    pos = bits.pos[rows]
    view = bits.view
    ends = np.searchsorted(-most, -np.arange(int(pixels.max())), "left")  # images with more than p pixels
    alpha_of = ta[sa[first]].astype(np.uint32) >> 4 << 24 if one_alpha and no_meta else None
    for p, live in enumerate(ends.tolist()):
        at = base[:live] + p
        lefts = left[:live]
        if copying := bool(lefts.any()):
            idle = np.flatnonzero(lefts == 0)
        else:
            idle = slice(0, live)
        code = first[:live][idle]
        if not no_meta and live:
            x = np.arange(live)[idle]
            y = x[with_m[x]]
            if len(y):
                code = code.copy()
                code[with_m[x]] += meta[m_start[y] + (p // w[y] >> m_bits[y]) * m_width[y] + (p % w[y] >> m_bits[y])]
        q = pos[:live][idle]
        window = view[q >> 3] >> (q & 7).astype(np.uint64)
        entry = tg[sg[code] + (window & mg[code]).astype(np.int64)]
        used = (entry & 15).astype(np.uint64)
        sym = (entry >> 4).astype(np.uint32)
        literal = sym < LITERALS
        if all_literal := bool(literal.all()):
            lit_code, lit_q, green, win, lit_used = code, q, sym, window >> used, used
        else:
            lit_code, lit_q, green, lit_used = code[literal], q[literal], sym[literal], used[literal]
            win = window[literal] >> lit_used
        entry = tr[sr[lit_code] + (win & mr[lit_code]).astype(np.int64)]
        colour = (entry >> 4).astype(np.uint32) << 16 | green << 8
        lit_used = lit_used + (entry & 15)
        lit_q = lit_q + lit_used.astype(np.int64)
        win = view[lit_q >> 3] >> (lit_q & 7).astype(np.uint64)
        entry = tb[sb[lit_code] + (win & mb[lit_code]).astype(np.int64)]
        colour |= entry >> 4
        b_used = (entry & 15).astype(np.uint64)
        if alpha_of is not None:
            colour |= alpha_of[:live][idle] if all_literal else alpha_of[:live][idle][literal]
        else:
            win = win >> b_used
            entry = ta[sa[lit_code] + (win & ma[lit_code]).astype(np.int64)]
            colour |= (entry >> 4).astype(np.uint32) << 24
            b_used = b_used + (entry & 15)
        lit_q = lit_q + b_used.astype(np.int64)
        if all_literal:
            value, q = colour, lit_q
        else:
            value = np.zeros(len(sym), np.uint32)
            value[literal] = colour
            q = q + used.astype(np.int64)
            q[literal] = lit_q
            x = np.arange(live)[idle]
            hit = np.flatnonzero(sym >= LITERALS + LENGTHS)
            if len(hit):
                value[hit] = cache[cache_start[x[hit]] + sym[hit] - (LITERALS + LENGTHS)]
            ref = np.flatnonzero(~literal & (sym < LITERALS + LENGTHS))
            if len(ref):
                bits.pos[rows[x[ref]]] = q[ref]
                r = rows[x[ref]]
                many = _value(bits, r, sym[ref].astype(np.int64) - LITERALS)
                c = code[ref]
                entry = td[sd[c] + (bits.peek(r) & md[c]).astype(np.int64)]
                bits.pos[r] += entry & 15
                far = _value(bits, r, (entry >> 4).astype(np.int64))
                near = np.minimum(far, len(NEAR)) - 1
                back = np.where(far > len(NEAR), far - len(NEAR), np.maximum(1, _NEAR_X[near] + _NEAR_Y[near] * w[x[ref]]))
                if (back > p).any() or (p + many > most[x[ref]]).any():
                    raise WebPError("a back-reference beyond the image")
                q[ref] = bits.pos[r]
                left[x[ref]], dist[x[ref]] = many, back
        pos[:live][idle] = q
        if copying or not all_literal:
            out[at[idle]] = value
            busy = np.flatnonzero(left[:live])
            if len(busy):
                out[at[busy]] = out[at[busy] - dist[busy]]
                left[busy] -= 1
        else:
            out[at] = value
        if not no_cache:
            if all_cached:
                v = out[at]
                cache[cache_start[:live] + (v * CACHE_MULTIPLIER >> cache_shift[:live])] = v
            else:
                y = np.flatnonzero(cached[:live])
                v = out[at[y]]
                cache[cache_start[y] + (v * CACHE_MULTIPLIER >> cache_shift[y])] = v
    bits.pos[rows] = pos
    bits.check(rows)
    return out, start


def _tiles(size: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (size + (1 << bits) - 1) >> bits


def _channels(argb: np.ndarray) -> np.ndarray:
    """(..., 4): blue, green, red, alpha."""
    return np.ascontiguousarray(argb).view(np.uint8).reshape(*argb.shape, 4)


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a & b) + ((a ^ b) >> 1)


def predictions(mode: np.ndarray, left: np.ndarray, top: np.ndarray, top_left: np.ndarray, top_right: np.ndarray) -> np.ndarray:
    """By the 14 modes of the format; (n, 4) channels in any of the arguments but mode."""
    ll, tt, tl = (x.astype(np.int64) for x in (left, top, top_left))
    by_left = np.abs(tt - tl).sum(axis=1) < np.abs(ll - tl).sum(axis=1)
    half = _average(left, top).astype(np.int64)
    step = half - tl
    out = np.zeros_like(left)
    out[:, 3] = 255
    made = {
        1: lambda: left,
        2: lambda: top,
        3: lambda: top_right,
        4: lambda: top_left,
        5: lambda: _average(_average(left, top_right), top),
        6: lambda: _average(left, top_left),
        7: lambda: _average(left, top),
        8: lambda: _average(top_left, top),
        9: lambda: _average(top, top_right),
        10: lambda: _average(_average(left, top_left), _average(top, top_right)),
        11: lambda: np.where(by_left[:, None], left, top),
        12: lambda: np.clip(ll + tt - tl, 0, 255).astype(np.uint8),
        13: lambda: np.clip(half + np.where(step < 0, -(-step >> 1), step >> 1), 0, 255).astype(np.uint8),
    }
    for m in np.unique(mode).tolist():
        if m in made:
            x = mode == m
            out[x] = made[m]()[x]
    return out


def undo_predictor(image: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """image: (height, width, 4) residuals; modes by tile."""
    h, w, _ = image.shape
    out = image.copy()
    out[0, 0, 3:] += np.uint8(255)  # the first pixel is predicted as black
    out[0] = np.cumsum(out[0], axis=0, dtype=np.uint8)
    kinds = np.unique(modes)
    if h > 1 and kinds.tolist() == [2]:
        return np.cumsum(out, axis=0, dtype=np.uint8)
    if h > 1 and kinds.tolist() == [1]:
        out[:, 0] = np.cumsum(out[:, 0], axis=0, dtype=np.uint8)
        out[1:] = np.cumsum(out[1:], axis=1, dtype=np.uint8)
        return out
    wide = np.arange(w) >> bits
    for y in range(1, h):
        row = modes[y >> bits][wide]
        out[y, 0] += out[y - 1, 0]
        for x in range(1, w):
            right = out[y - 1, x + 1] if x + 1 < w else out[y, 0]
            out[y, x] += predictions(row[x : x + 1], out[y, None, x - 1], out[y - 1, None, x], out[y - 1, None, x - 1], right[None])[0]
    return out


def _delta(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (t.view(np.int8).astype(np.int64) * c.view(np.int8).astype(np.int64) >> 5).astype(np.uint8)


def cross_colour(image: np.ndarray, elements: np.ndarray, bits: int, undo: bool) -> np.ndarray:
    """image: (height, width, 4); elements: (rows, columns, 4) of tiles: green to red, green to blue, red to blue."""
    h, w, _ = image.shape
    e = np.ascontiguousarray(elements[np.arange(h) >> bits][:, np.arange(w) >> bits])
    to_red, to_blue, red_to_blue = (np.ascontiguousarray(e[..., k]) for k in range(3))
    out = image.copy()
    green, red = np.ascontiguousarray(image[..., 1]), np.ascontiguousarray(image[..., 2])
    if undo:
        out[..., 2] += _delta(to_red, green)
        out[..., 0] += _delta(to_blue, green) + _delta(red_to_blue, np.ascontiguousarray(out[..., 2]))
    else:
        out[..., 2] -= _delta(to_red, green)
        out[..., 0] -= _delta(to_blue, green) + _delta(red_to_blue, red)
    return out


def container_chunk(data: bytes) -> bytes:
    """The VP8L chunk of a simple or extended file."""
    if len(data) < 20 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise WebPError("no WebP container")
    at = 12
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"VP8L":
            if at + 8 + size > len(data):
                raise WebPError("the data ends too soon")
            return data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise WebPError("no lossless image")


def decode(files: list[bytes]) -> list[np.ndarray]:
    """Pixels of each file: (height, width, 4) bytes in the order red, green, blue, alpha."""
    if not files:
        return []
    bits = Bits([container_chunk(f) for f in files])
    n = len(files)
    every = np.arange(n)
    if (bits.read(every, 8) != 0x2F).any():
        raise WebPError("no lossless bitstream")
    width, height = bits.read(every, 14) + 1, bits.read(every, 14) + 1
    opaque = bits.read(every, 1) == 0
    if bits.read(every, 3).any():
        raise WebPError("an unknown version")
    transforms: list[list[tuple]] = [[] for _ in range(n)]
    coded = width.copy()
    rows = every
    while len(rows := rows[bits.read(rows, 1) == 1]):
        kind = bits.read(rows, 2)
        if any(k in [t[0] for t in transforms[r]] for r, k in zip(rows.tolist(), kind.tolist(), strict=True)):
            raise WebPError("a transform given twice")
        for k in (PREDICTOR, CROSS_COLOUR):
            if len(r := rows[kind == k]):
                b = bits.read(r, 3) + 2
                w, h = _tiles(coded[r], b), _tiles(height[r], b)
                pixels, start = _entropy_image(bits, r, w, h, False)
                for i, row in enumerate(r.tolist()):
                    transforms[row].append((k, int(b[i]), pixels[start[i] : start[i] + w[i] * h[i]].reshape(h[i], w[i])))
        for row in rows[kind == SUBTRACT_GREEN].tolist():
            transforms[row].append((SUBTRACT_GREEN,))
        if len(r := rows[kind == PALETTE]):
            size = bits.read(r, 8) + 1
            pixels, start = _entropy_image(bits, r, size, np.ones(len(r), np.int64), False)
            packed = np.select([size <= 2, size <= 4, size <= 16], [3, 2, 1], 0)
            for i, row in enumerate(r.tolist()):
                table = np.cumsum(_channels(pixels[start[i] : start[i] + size[i]]), axis=0, dtype=np.uint8)
                transforms[row].append((PALETTE, int(packed[i]), table, int(coded[row])))
            coded[r] = _tiles(coded[r], packed)
    pixels, start = _entropy_image(bits, every, coded, height, True)
    out = []
    for i in range(n):
        image = _channels(pixels[start[i] : start[i] + coded[i] * height[i]].reshape(height[i], coded[i]))
        for t in reversed(transforms[i]):
            if t[0] == PREDICTOR:
                image = undo_predictor(image, (t[2] >> 8 & 15).astype(np.int64), t[1])
            elif t[0] == CROSS_COLOUR:
                image = cross_colour(image, _channels(t[2]), t[1], True)
            elif t[0] == SUBTRACT_GREEN:
                image = image.copy()
                image[..., 0] += image[..., 1]
                image[..., 2] += image[..., 1]
            else:
                image = _from_palette(image, *t[1:])
        image = image[..., [2, 1, 0, 3]]
        if opaque[i]:
            image[..., 3] = 255
        out.append(image)
    return out


def _from_palette(image: np.ndarray, packed: int, table: np.ndarray, width: int) -> np.ndarray:
    index = image[..., 1].astype(np.int64)
    if packed:
        each = 8 >> packed
        index = (index[..., None] >> (each * np.arange(1 << packed)) & (1 << each) - 1).reshape(len(index), -1)[:, :width]
    full = np.zeros((256, 4), np.uint8)  # indexes beyond the table are transparent black
    full[: len(table)] = table
    return full[index]


# ---------------------------------------------------------------- encoding


#: Bits for a pixel's place among those encoded together.
_PLACE = np.uint64((1 << 24) - 1)


class Tokens:
    """(image, value, bits), in order for each image; a value has 32 bits at most."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, image, value, bits) -> None:
        image = np.asarray(image)
        self.parts.append((image, np.broadcast_to(np.asarray(value), image.shape), np.broadcast_to(np.asarray(bits), image.shape)))

    def ordered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        image = np.concatenate([p[0] for p in self.parts])
        order = np.argsort(image, kind="stable")
        return image[order], np.concatenate([p[1].astype(np.uint64) for p in self.parts])[order], np.concatenate([p[2].astype(np.int64) for p in self.parts])[order]

    def packed(self, n: int) -> list[bytes]:
        image, value, bits = self.ordered()
        total = np.bincount(image, bits, n).astype(np.int64)
        words = total + 31 >> 5
        first = np.cumsum(words) - words
        ends = np.cumsum(bits)
        before = np.cumsum(total) - total
        at = ends - bits - before[image] + 32 * first[image]
        shifted = value << (at & 31).astype(np.uint64)
        word = at >> 5
        out = np.zeros(int(words.sum()) + 1, np.uint64)
        new = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[new]] = np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), new)
        over = np.flatnonzero(shifted >> np.uint64(32))
        out[word[over] + 1] += shifted[over] >> np.uint64(32)
        data = out.astype("<u4").tobytes()
        return [data[4 * a : 4 * a + (t + 7 >> 3)] for a, t in zip(first.tolist(), total.tolist(), strict=True)]


#: The code in which code lengths are written: 13 symbols of four bits, six of five.
_LENGTH_CODE = np.full(19, 4, np.uint8)
_LENGTH_CODE[[1, 2, 13, 14, 15, 16]] = 5
_LENGTH_WORDS, _LENGTH_BITS = (x[0] for x in code_words(_LENGTH_CODE[None]))


def _code_tokens(tokens: Tokens, image: np.ndarray, lengths: np.ndarray) -> None:
    """A prefix code for each image."""
    used = (lengths > 0).sum(axis=1)
    first = lengths.argmax(axis=1) if lengths.shape[1] else np.zeros(len(image), np.int64)
    last = lengths.shape[1] - 1 - (lengths[:, ::-1] > 0).argmax(axis=1)
    simple = (used <= 1) | ((used == 2) & (last < 256))
    two = simple & (used == 2)
    lead = np.where(two, (lengths > 0).argmax(axis=1), first)
    if (simple & (lead > 255)).any():
        raise ValueError("a lone symbol above 255 can't be written")
    x = np.flatnonzero(simple)
    wide = lead[x] > 1
    tokens.add(image[x], 1 | two[x].astype(np.int64) << 1 | wide.astype(np.int64) << 2 | lead[x] << 3, 4 + 7 * wide)
    x = np.flatnonzero(two)
    tokens.add(image[x], last[x], 8)
    x = np.flatnonzero(~simple)
    tokens.add(image[x], 0 | 15 << 1, 5)
    stored = _LENGTH_CODE[LENGTH_ORDER].astype(np.int64)
    for part in (stored[:10], stored[10:]):
        tokens.add(image[x], int((part << 3 * np.arange(len(part))).sum()), 3 * len(part))
    tokens.add(image[x], 0, 1)
    if not len(x):
        return
    seq = lengths[x].ravel().astype(np.int64)
    row = np.repeat(np.arange(len(x)), lengths.shape[1])
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (seq[1:] != 0) | (seq[:-1] != 0)]))
    run, value, who = np.diff(np.append(new, len(seq))), seq[new], row[new]
    # Zeros go by runs of 138, then a shorter run of 11 or more, of 3 or more, or one by one.
    whole, rest = run // 138, run % 138
    whole, rest = np.where(value == 0, whole, 0), np.where(value == 0, rest, 0)
    singles = np.where(value > 0, 1, np.where(rest < 3, rest, 0))
    count = np.stack([whole, (rest >= 11).astype(np.int64), ((rest >= 3) & (rest < 11)).astype(np.int64), singles], axis=1)
    symbol = np.stack([np.full_like(run, 18), np.full_like(run, 18), np.full_like(run, 17), value], axis=1)
    extra = np.stack([np.full_like(run, 127), rest - 11, rest - 3, np.zeros_like(run)], axis=1)
    extra_bits = np.broadcast_to(np.array([7, 7, 3, 0]), count.shape)
    many = count.ravel()
    symbol, extra, extra_bits = np.repeat(symbol.ravel(), many), np.repeat(extra.ravel(), many), np.repeat(extra_bits.ravel(), many)
    tokens.add(np.repeat(np.repeat(image[x][who], 4), many), _LENGTH_WORDS[symbol].astype(np.int64) | extra << _LENGTH_BITS[symbol], _LENGTH_BITS[symbol] + extra_bits)


def _prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix, extra bits, their number) of lengths and distances from 1."""
    v = value - 1
    top = np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1
    extra = np.maximum(top - 1, 0)
    prefix = np.where(v < 4, v, 2 * top + (v >> np.maximum(top - 1, 0) & 1))
    extra = np.where(v < 4, 0, extra)
    return prefix, v & (1 << extra) - 1, extra


def _matches(argb: np.ndarray, image: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pixel, length, distance) of copies of at least 4 pixels; runs of pixels whose next four stood before at one distance."""
    n = len(argb)
    none = np.zeros(0, np.int64)
    if n < 5:
        return none, none, none
    ok = np.zeros(n, bool)
    ok[: n - 3] = image[: n - 3] == image[3:]
    at = np.flatnonzero(ok)
    a = argb.astype(np.uint64)
    key = a[at] * np.uint64(0x9E3779B97F4A7C15) + a[at + 1]
    for k in (2, 3):
        key = (key ^ key >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + a[at + k]
    key = (key ^ image[at].astype(np.uint64)) * np.uint64(0x94D049BB133111EB)
    # The place in the low bits: equal keys are in order after one plain sort. Pixels are compared below.
    key = np.sort(key & ~_PLACE | at.astype(np.uint64))
    at = (key & _PLACE).astype(np.int64)
    prev, here = at[:-1], at[1:]
    same = (key[1:] ^ key[:-1] <= _PLACE) & (image[prev] == image[here])
    prev, here = prev[same], here[same]
    for k in range(4):
        same = argb[prev + k] == argb[here + k]
        prev, here = prev[same], here[same]
    if not len(here):
        return none, none, none
    dist = np.zeros(n, np.int64)
    dist[here] = here - prev
    go = (dist > 0) & np.concatenate([[False], (dist[1:] == dist[:-1]) & (image[1:] == image[:-1])])
    start = np.flatnonzero((dist > 0) & ~go)
    stop = np.flatnonzero((dist > 0) & ~np.append(go[1:], False)) + 4  # the last four reach further
    before = np.concatenate([[0], stop[:-1]])
    before = np.where(np.concatenate([[-1], image[start[:-1]]]) == image[start], before, 0)
    begin = np.maximum(start, before)
    keep = stop - begin >= 4
    begin, stop, d = begin[keep], stop[keep], dist[start[keep]]
    return begin, np.minimum(stop - begin, 4096), d


def _entropy_tokens(tokens: Tokens, argb: np.ndarray, pixels: np.ndarray, width: np.ndarray, ids: np.ndarray, main: bool, cache_bits: np.ndarray, copies: bool = True, meta: tuple[int, list[np.ndarray]] | None = None) -> None:
    """Writes images (flat argb, `pixels` of them each) to the streams `ids`. meta: tile bits and each image's group by tile."""
    n = len(pixels)
    image, place = flat(pixels)
    tokens.add(ids, (cache_bits > 0) | cache_bits << 1, np.where(cache_bits > 0, 5, 1))
    group = np.zeros(len(argb), np.int64)
    groups = 1
    if main:
        tokens.add(ids, 0 if meta is None else 1 | meta[0] - 2 << 1, 1 if meta is None else 4)
        if meta is not None:
            b, tiles = meta
            groups = int(max(t.max() for t in tiles)) + 1
            flat_tiles = np.concatenate([t.ravel() for t in tiles]).astype(np.uint32) << 8 | np.uint32(0xFF000000)
            size = np.array([t.size for t in tiles])
            _entropy_tokens(tokens, flat_tiles, size, np.array([t.shape[1] for t in tiles]), ids, False, np.zeros(n, np.int64))
            x, y = place % width[image] >> b, place // width[image] >> b
            wide = np.array([t.shape[1] for t in tiles])
            group = (flat_tiles >> 8 & 0xFFFF).astype(np.int64)[(np.cumsum(size) - size)[image] + y * wide[image] + x]
    begin, length, dist = _matches(argb, image, place) if copies else (np.zeros(0, np.int64),) * 3
    covered = np.zeros(len(argb), bool)
    covered[gather(begin, length)] = True
    hit = np.zeros(len(argb), bool)
    shift = (32 - cache_bits).astype(np.uint32)
    slot = np.zeros(len(argb), np.int64)
    with_cache = np.flatnonzero(cache_bits[image] > 0)
    if len(with_cache):
        slot[with_cache] = argb[with_cache] * CACHE_MULTIPLIER >> shift[image[with_cache]]
        key = np.sort(image[with_cache] << 35 | slot[with_cache] << 24 | with_cache)
        order = key & (1 << 24) - 1
        same = (key[1:] >> 24 == key[:-1] >> 24) & (argb[order][1:] == argb[order][:-1])
        hit[order[1:][same]] = True
    hit &= ~covered
    literal = ~hit & ~covered
    code = image * groups + group
    lit, cached = np.flatnonzero(literal), np.flatnonzero(hit)
    ch = _channels(argb)
    lp, lx, lb = _prefix(length)
    plane = np.full(int(8 * max(width.max(initial=1), 1) + 9), 0)
    dist_code = dist + len(NEAR)
    for w in np.unique(width).tolist():
        plane[:] = 0
        for k in range(len(NEAR) - 1, -1, -1):
            d = NEAR[k][0] + NEAR[k][1] * w
            if d >= 1:
                plane[d] = k + 1
        x = np.flatnonzero((width[image[begin]] == w) & (dist < len(plane)))
        dist_code[x] = np.where(plane[dist[x]] > 0, plane[dist[x]], dist_code[x])
    dp, dx, db = _prefix(dist_code)
    green_size = LITERALS + LENGTHS + (1 << int(cache_bits.max()) if cache_bits.any() else 0)
    count = lambda c, s, size: np.bincount(c * size + s, minlength=n * groups * size).reshape(-1, size)
    green = count(np.concatenate([code[lit], code[cached], code[begin]]), np.concatenate([ch[lit, 1].astype(np.int64), LITERALS + LENGTHS + slot[cached], LITERALS + lp]), green_size)
    alone = ((green > 0).sum(axis=1) == 1) & (green.argmax(axis=1) > 255)
    green[alone, 0] += 1
    counts = [green, *(count(code[lit], ch[lit, k].astype(np.int64), 256) for k in (2, 0, 3)), count(code[begin], dp, DISTANCES)]
    for c in counts:
        c[c.sum(axis=1) == 0, 0] = 1
    lengths = [huffman_lengths(c) for c in counts]
    sizes = LITERALS + LENGTHS + np.where(cache_bits > 0, 1 << cache_bits, 0)
    for g in range(groups):
        for k, ln in enumerate(lengths):
            mine = ln[g::groups]
            if k:
                _code_tokens(tokens, ids, mine)
            else:
                for s in np.unique(sizes).tolist():
                    x = np.flatnonzero(sizes == s)
                    _code_tokens(tokens, ids[x], mine[x, :s])
    (gw, gb), (rw, rb), (bw, bb), (aw, ab), (dw, dbits) = map(code_words, lengths)
    # Data in the order of pixels: two values for each literal and copy, one for each cached pixel.
    c, g, r, b, a = code[lit], ch[lit, 1], ch[lit, 2], ch[lit, 0], ch[lit, 3]
    cc, cb = code[cached], code[begin]
    many = np.zeros(len(argb), np.int64)
    many[lit], many[cached], many[begin] = 2, 1, 2
    at = np.cumsum(many) - many
    value, size = np.zeros(int(many.sum()), np.uint64), np.zeros(int(many.sum()), np.uint8)
    value[at[lit]] = gw[c, g].astype(np.uint64) | rw[c, r].astype(np.uint64) << gb[c, g]
    size[at[lit]] = gb[c, g] + rb[c, r]
    value[at[lit] + 1] = bw[c, b].astype(np.uint64) | aw[c, a].astype(np.uint64) << bb[c, b]
    size[at[lit] + 1] = bb[c, b] + ab[c, a]
    value[at[cached]] = gw[cc, LITERALS + LENGTHS + slot[cached]]
    size[at[cached]] = gb[cc, LITERALS + LENGTHS + slot[cached]]
    value[at[begin]] = gw[cb, LITERALS + lp].astype(np.uint64) | lx.astype(np.uint64) << gb[cb, LITERALS + lp]
    size[at[begin]] = gb[cb, LITERALS + lp] + lb
    value[at[begin] + 1] = dw[cb, dp].astype(np.uint64) | dx.astype(np.uint64) << dbits[cb, dp]
    size[at[begin] + 1] = dbits[cb, dp] + db
    tokens.add(ids[np.repeat(image, many)], value, size)


@dataclass(frozen=True)
class Options:
    """transforms: None lets each image have what suits it; else kinds in order. tile: bits of a tile. modes, elements: see encode()."""

    transforms: tuple[int, ...] | None = None
    tile: int = 3
    cache_bits: int | None = None
    copies: bool = True
    groups: int = 1
    seed: int = 0


def _entropy(channel: np.ndarray, image: np.ndarray, n: int) -> np.ndarray:
    counts = np.bincount(image * 256 + channel, minlength=n * 256).reshape(n, 256).astype(np.float64)
    total = counts.sum(axis=1, keepdims=True)
    return np.where(counts > 0, counts * np.log2(np.maximum(total, 1) / np.maximum(counts, 1)), 0).sum(axis=1)


def _choose(images: list[np.ndarray]) -> list[tuple[int, ...]]:
    """A palette for few colours; else none, subtract-green, or the pixel to the left or above as a prediction, whichever has least entropy."""
    n = len(images)
    pixels = np.array([x.shape[0] * x.shape[1] for x in images])
    row = np.repeat(np.arange(n), pixels)
    argb = np.concatenate([x.reshape(-1, 4) for x in images]).view(np.uint32).ravel()
    key = np.sort(row << 32 | argb)
    new = np.concatenate([[True], key[1:] != key[:-1]])
    colours = np.bincount(key[new] >> 32, minlength=n)
    bits = lambda parts: sum(_entropy(np.concatenate([p[..., k].ravel() for p in parts]).astype(np.int64), row, n) for k in range(3))
    plain = bits(images)
    green = bits([np.stack([x[..., 0] - x[..., 1], x[..., 1], x[..., 2] - x[..., 1]], axis=-1) for x in images])
    above = bits([np.concatenate([x[:1], x[1:] - x[:-1]]) for x in images])
    out: list[tuple[int, ...]] = []
    for k in range(n):
        if colours[k] <= 16 or (colours[k] <= 256 and 4 * colours[k] <= pixels[k]):
            out.append((PALETTE,))
        elif above[k] < 0.9 * min(plain[k], green[k]):
            out.append((PREDICTOR,))
        else:
            out.append((SUBTRACT_GREEN,) if green[k] < plain[k] else ())
    return out


def encode(images: list[np.ndarray], options: Options = Options()) -> list[bytes]:
    """Files of images given as (height, width, 4) bytes in the order red, green, blue, alpha; sides of 1 to 16384.

    An image's file depends on the image and the options alone. Given transforms use tiles with modes and elements drawn
    from options.seed; without them predictors use the pixel above.
    """
    if not images:
        return []
    for x in images:
        if not (1 <= x.shape[0] <= 16384 and 1 <= x.shape[1] <= 16384):
            raise ValueError("sides must be 1 to 16384")
    if sum(x.shape[0] * x.shape[1] for x in images) > int(_PLACE):
        if len(images) == 1:
            raise ValueError("an image of more than 2^24 pixels")
        return encode(images[: len(images) // 2], options) + encode(images[len(images) // 2 :], options)
    n = len(images)
    tokens = Tokens()
    every = np.arange(n)
    current = [np.ascontiguousarray(x[..., [2, 1, 0, 3]]) for x in images]
    shape = np.array([x.shape[:2] for x in images])
    alpha = np.array([bool((x[..., 3] != 255).any()) for x in images])
    tokens.add(every, 0x2F | shape[:, 1] - 1 << 8, 22)
    tokens.add(every, shape[:, 0] - 1 | alpha.astype(np.int64) << 14, 18)
    chosen = _choose(current) if options.transforms is None else [options.transforms] * n
    for step in range(4):
        for kind in (PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE):
            ids = np.array([i for i in range(n) if len(chosen[i]) > step and chosen[i][step] == kind], np.int64)
            if not len(ids):
                continue
            tokens.add(ids, 1 | kind << 1, 3)
            if kind == SUBTRACT_GREEN:
                for i in ids.tolist():
                    x = current[i] = current[i].copy()
                    x[..., 0] -= x[..., 1]
                    x[..., 2] -= x[..., 1]
            elif kind == PALETTE:
                _palette_tokens(tokens, ids, current)
            else:
                b = options.tile
                tokens.add(ids, b - 2, 3)
                extra = []
                for i in ids.tolist():
                    h, w = current[i].shape[:2]
                    rng = np.random.default_rng([options.seed, kind])
                    tile = np.zeros((h + (1 << b) - 1 >> b, w + (1 << b) - 1 >> b, 4), np.uint8)
                    tile[..., 3] = 255
                    if kind == PREDICTOR:
                        tile[..., 1] = 2 if options.transforms is None else rng.integers(0, 14, tile.shape[:2])
                        current[i] = _do_predictor(current[i], tile[..., 1].astype(np.int64), b)
                    else:
                        tile[..., :3] = rng.integers(0, 256, (*tile.shape[:2], 3))
                        current[i] = cross_colour(current[i], tile, b, False)
                    extra.append(tile.reshape(-1, 4).view(np.uint32).ravel())
                _entropy_tokens(tokens, np.concatenate(extra), np.array([len(x) for x in extra]), np.array([current[i].shape[1] + (1 << b) - 1 >> b for i in ids]), ids, False, np.zeros(len(ids), np.int64))
    tokens.add(every, 0, 1)
    pixels = np.array([x.shape[0] * x.shape[1] for x in current])
    argb = np.concatenate([x.reshape(-1, 4) for x in current]).view(np.uint32).ravel()
    if options.cache_bits is not None:
        cache = np.full(n, options.cache_bits)
    else:
        cache = np.where((pixels >= 512) & np.array([PALETTE not in c for c in chosen]), 7, 0)
    meta = None
    if options.groups > 1:
        rng = np.random.default_rng(options.seed)
        b = options.tile
        meta = b, [np.append(rng.integers(0, options.groups, (x.shape[0] + (1 << b) - 1 >> b) * (x.shape[1] + (1 << b) - 1 >> b) - 1), options.groups - 1).reshape(x.shape[0] + (1 << b) - 1 >> b, -1) for x in current]
    _entropy_tokens(tokens, argb, pixels, np.array([x.shape[1] for x in current]), every, True, cache, options.copies, meta)
    return [b"RIFF" + struct.pack("<I", 12 + len(d) + len(d) % 2) + b"WEBPVP8L" + struct.pack("<I", len(d)) + d + bytes(len(d) % 2) for d in tokens.packed(n)]


def _palette_tokens(tokens: Tokens, ids: np.ndarray, current: list[np.ndarray]) -> None:
    tables = []
    for i in ids.tolist():
        h, w = current[i].shape[:2]
        table, index = np.unique(current[i].reshape(-1, 4).view(np.uint32).ravel(), return_inverse=True)
        if len(table) > 256:
            raise ValueError("a palette has 256 colours at most")
        packed = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
        ch = _channels(table)
        tables.append(np.concatenate([ch[:1], ch[1:] - ch[:-1]]).view(np.uint32).ravel())
        each, many = 8 >> packed, 1 << packed
        wide = np.zeros((h, -(-w // many) * many), np.int64)
        wide[:, :w] = index.reshape(h, w)
        small = np.zeros((h, wide.shape[1] // many, 4), np.uint8)
        small[..., 1] = (wide.reshape(h, -1, many) << each * np.arange(many)).sum(axis=2)
        small[..., 3] = 255
        current[i] = small
    size = np.array([len(t) for t in tables])
    tokens.add(ids, size - 1, 8)
    _entropy_tokens(tokens, np.concatenate(tables), size, size, ids, False, np.zeros(len(ids), np.int64))


def _do_predictor(image: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    h, w, _ = image.shape
    right = np.empty_like(image)
    right[:, :-1] = image[:, 1:]
    right[:-1, -1] = image[1:, 0]  # at the row's end: the first of the row below, that is of the predicted pixel's row
    right[-1, -1] = 0
    out = image.copy()
    out[0, 1:] -= image[0, :-1]
    out[0, 0, 3:] -= np.uint8(255)
    out[1:, 0] -= image[:-1, 0]
    if h > 1 and w > 1:
        mode = modes[np.arange(1, h) >> bits][:, np.arange(1, w) >> bits].ravel()
        part = lambda x: np.ascontiguousarray(x).reshape(-1, 4)
        out[1:, 1:] -= predictions(mode, part(image[1:, :-1]), part(image[:-1, 1:]), part(image[:-1, :-1]), part(right[:-1, 1:])).reshape(h - 1, w - 1, 4)
    return out
