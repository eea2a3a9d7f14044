"""10. Media columns: lossless WebP, written and read as arrays.

write_media() stores bytes as lossless WebP images 16 pixels wide (four bytes a pixel: red, green, blue, alpha; 64 bytes a row), a long
payload as several images of ROWS rows, one after the other. read_images() decodes any lossless WebP: prefix codes, back-references,
colour cache, meta codes, and the predictor, cross-colour, subtract-green and palette transforms. All images of a batch are decoded
together: a step reads one symbol of each, by numpy operations over the images still open, so the cost follows the longest image
of the batch and not the number of symbols.

The writer chooses by image, and by size alone. The plain way is text: literal pixels, the colour cache, and back-references for repeated runs, with a second group of prefix codes and meta codes
that choose between them by tile where the tiles save more bits than the second group's header takes. An image of few colours, where that is shorter, gets a palette with packed indices. An image whose pixels take
fewer bits as differences from the left or from above is also written as pictures are, and kept so where it is the shortest in the end: green subtracted (if residuals shrink), a predictor for each tile (the one of
fourteen with the smallest residuals), cross-colour multipliers for each tile (by least squares). Running text never gains by those; binary columns and real pictures do. Codes are fixed for each kind, made from
expected frequencies.

Defined results: a null text counts as empty (one row of zeros); a very long text is several images; repeated rows and null ids are stored each; equal texts give equal
values; an empty table gives no rows; other columns are not read. There are no ties.
"""

import hashlib
import heapq
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

WIDTH, ROWS, CACHE_BITS, RUN = 16, 128, 8, 4
#: Bits of a tile's side.
TILE = 4
HASH = 0x1E35A7BD
#: Fixed values of the format: order of the code length codes, and the near distances as (x, y).
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


# --- prefix codes ---------------------------------------------------------------------------------------------------------------


def code_lengths(weights) -> list[int]:
    """Huffman code lengths of symbols with weights over 0 (0: no code); weights keep them at 15 or less."""
    heap = [(w, i, [i]) for i, w in enumerate(weights) if w]
    out = [0] * len(weights)
    heapq.heapify(heap)
    while len(heap) > 1:
        (a, i, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in x + y:
            out[s] += 1
        heapq.heappush(heap, (a + b, i, x + y))
    if max(out) > 15:  # flatter weights
        return code_lengths([w and w + max(weights) / 4096 for w in weights])
    return out


def codes(lengths) -> np.ndarray:
    """Canonical codes, bits reversed as the stream holds them."""
    out, code = np.zeros(len(lengths), "u8"), 0
    for n in range(1, 16):
        for s, k in enumerate(lengths):
            if k == n:
                out[s] = int(f"{code:0{n}b}"[::-1], 2)
                code += 1
        code <<= 1
    return out


def table(lengths) -> np.ndarray:
    """symbol << 4 | bits for each value of the next max(lengths) bits; a lone symbol takes no bits."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) < 2:
        return np.asarray([(used[0] if used else 0) << 4], "i4")
    most = max(lengths)
    out = np.zeros(1 << most, "i4")
    for s, c in zip(used, codes(lengths)[used].tolist(), strict=True):
        out[c :: 1 << lengths[s]] = s << 4 | lengths[s]
    return out


class Bits:
    """Bits of one image, lowest first; only headers are read this way."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def peek(self, n: int) -> int:
        a = self.at >> 3
        return int.from_bytes(self.data[a : (self.at + n + 7) >> 3], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        a = self.at >> 3
        v = int.from_bytes(self.data[a : a + 5], "little") >> (self.at & 7)
        self.at += n
        return v & ((1 << n) - 1)


def _read_code(b: Bits, size: int) -> list[int]:
    lengths = [0] * size
    if b.read(1):
        two = b.read(1)
        first = b.read(8 if b.read(1) else 1)
        lengths[first] = 1
        if two:
            lengths[b.read(8)] = 1
        return lengths
    own = [0] * 19
    for k in LENGTH_ORDER[: 4 + b.read(4)]:
        own[k] = b.read(3)
    most = 2 + b.read(2 + 2 * b.read(3)) if b.read(1) else size
    by, n = table(own).tolist(), max(own)
    at, last = 0, 8
    while at < size and most:
        most -= 1
        a = b.at
        e = by[b.read(n) if len(by) > 1 else 0]
        b.at = a + (e & 15)
        k = e >> 4
        if k < 16:
            lengths[at] = k
            at += 1
            last = k or last
        else:
            value, n_more = (last, 3 + b.read(2)) if k == 16 else (0, 3 + b.read(3)) if k == 17 else (0, 11 + b.read(7))
            for _ in range(n_more):
                lengths[at] = value
                at += 1
    return lengths


class Group:
    """The five tables of a code group."""

    def __init__(self, lengths):
        self.tables = [table(x) for x in lengths]


# --- decoding -------------------------------------------------------------------------------------------------------------------


class _Job:
    """An image (or the small image of a transform) whose header has been read."""

    def __init__(self, data, at, width, height, cache_bits, groups, meta=None, meta_bits=0):
        self.data, self.at, self.width, self.height, self.cache_bits, self.groups, self.meta, self.meta_bits = data, at, width, height, cache_bits, groups, meta, meta_bits


def _decode(jobs: list[_Job]) -> list[np.ndarray]:
    """The pixels (ARGB) of all jobs, a symbol of each at a step; sets at to the bit after the image."""
    if not jobs:
        return []
    order = sorted(range(len(jobs)), key=lambda i: -jobs[i].width * jobs[i].height)
    own = [jobs[i] for i in order]
    count = np.asarray([j.width * j.height for j in own], "i8")
    base = np.cumsum(count) - count
    out = np.zeros(count.sum(), "u4")
    # all data as 64-bit words, each image from a word on
    size = np.asarray([len(j.data) // 8 + 3 for j in own], "i8")
    word = np.cumsum(size) - size
    raw = np.zeros(size.sum() * 8, "u1")
    for j, w in zip(own, word.tolist(), strict=True):
        raw[8 * w : 8 * w + len(j.data)] = np.frombuffer(j.data, "u1")
    words = raw.view("<u8")
    # tables of all groups in one array
    known, flat, at = {}, [], 0
    offset, mask = [], []
    for j in own:
        for g in j.groups:
            if id(g) not in known:
                known[id(g)] = len(offset)
                o, m = [], []
                for t in g.tables:
                    o.append(at)
                    m.append(len(t) - 1)
                    flat.append(t)
                    at += len(t)
                offset.append(o)
                mask.append(m)
    flat, offset, mask = np.concatenate(flat), np.asarray(offset, "i8").T.copy(), np.asarray(mask, "u8").T.copy()
    first = np.asarray([known[id(j.groups[0])] for j in own], "i8")
    metas = any(j.meta is not None for j in own)
    if metas:
        maps = [np.asarray([known[id(g)] for g in j.groups])[j.meta] if j.meta is not None else first[i : i + 1] for i, j in enumerate(own)]
        map_at = np.cumsum([0, *map(len, maps)])[:-1]
        maps = np.concatenate(maps)
        meta_bits = np.asarray([j.meta_bits if j.meta is not None else 40 for j in own], "i8")
        across = np.asarray([-(-j.width // (1 << j.meta_bits)) for j in own], "i8")
    wide = np.asarray([j.width for j in own], "i8")
    bits = np.asarray([j.cache_bits for j in own], "i8")
    cache_at = np.cumsum(np.where(bits > 0, 1 << bits, 0)) - np.where(bits > 0, 1 << bits, 0)
    cache = np.zeros(int(np.where(bits > 0, 1 << bits, 0).sum()) + 1, "u4")
    place, pos = word * 64 + np.asarray([j.at for j in own], "i8"), np.zeros(len(own), "i8")
    live = np.flatnonzero(count > 0)
    one, low6, shift = np.uint64(1), np.uint64(63), (32 - bits).astype("u8")
    while len(live):
        p = place[live]
        a, s = p >> 6, p.astype("u8") & low6
        w = words[a] >> s | (words[a + 1] << (low6 - s)) << one
        if metas:
            x, y = pos[live] % wide[live], pos[live] // wide[live]
            g = maps[map_at[live] + (y >> meta_bits[live]) * across[live] + (x >> meta_bits[live])]
        else:
            g = first[live]
        e = flat[offset[0][g] + (w & mask[0][g]).astype("i8")]
        sym, used = e >> 4, (e & 15).astype("u8")
        to = base[live] + pos[live]
        lit = np.flatnonzero(sym < 256)
        if len(lit):
            lw, lg, n = w[lit] >> used[lit], g[lit], used[lit]
            argb = sym[lit].astype("u4") << np.uint32(8)
            for k, up in ((1, 16), (2, 0), (3, 24)):
                e = flat[offset[k][lg] + (lw & mask[k][lg]).astype("i8")]
                m = (e & 15).astype("u8")
                lw = lw >> m
                n = n + m
                argb |= (e >> 4).astype("u4") << np.uint32(up)
            used[lit] = n
            out[to[lit]] = argb
            at = live[lit]
            if len(cache) > 1:
                c = bits[at] > 0
                h = (argb * np.uint32(HASH)).astype("u8") >> shift[at]
                cache[np.where(c, cache_at[at] + h.astype("i8"), len(cache) - 1)] = argb
            pos[at] += 1
        if len(lit) < len(live):
            hit = np.flatnonzero(sym >= 280)
            at = live[hit]
            out[to[hit]] = cache[cache_at[at] + sym[hit] - 280]
            pos[at] += 1
            for i in np.flatnonzero((sym >= 256) & (sym < 280)).tolist():
                k, v, n, gi = int(live[i]), int(w[i]), int(used[i]), int(g[i])
                length, n = _extra(int(sym[i]) - 256, v, n)
                e = int(flat[offset[4][gi] + ((v >> n) & int(mask[4][gi]))])
                dist, n = _extra(e >> 4, v, n + (e & 15))
                if dist > 120:
                    dist -= 120
                else:
                    dist = max(1, NEAR[dist - 1][0] + NEAR[dist - 1][1] * int(wide[k]))
                t = int(to[i])
                length = min(length, int(count[k] - pos[k]))
                if dist > pos[k]:
                    raise ValueError("a back-reference reaches before the image")
                run = np.resize(out[t - dist : t - dist + min(dist, length)], length)
                out[t : t + length] = run
                if bits[k]:
                    cache[cache_at[k] + ((run * np.uint32(HASH)) >> np.uint32(32 - bits[k])).astype("i8")] = run
                pos[k] += length
                used[i] = n
        place[live] += used.astype("i8")
        live = live[pos[live] < count[live]]
    pixels = [None] * len(jobs)
    for k, i in enumerate(order):
        pixels[i] = out[base[k] : base[k] + count[k]]
        jobs[i].at = int(place[k] - word[k] * 64)
    return pixels


def _extra(prefix: int, w: int, n: int) -> tuple[int, int]:
    """Value of a length or distance prefix and its extra bits, and the bits read so far."""
    if prefix < 4:
        return prefix + 1, n
    k = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << k) + ((w >> n) & ((1 << k) - 1)) + 1, n + k


#: Headers of code groups that were read before, by their number, cache bits and length in bits: writers with fixed codes repeat them in each image.
_SEEN: dict = {}


def _codes(b: Bits, n: int, cache_bits: int) -> list[Group]:
    """n code groups."""
    seen = _SEEN.setdefault((n, cache_bits), {})
    for bits, known in seen.items():
        if (groups := known.get(b.peek(bits))) is not None:
            b.at += bits
            return groups
    sizes, at = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40), b.at
    groups = [Group([_read_code(b, s) for s in sizes]) for _ in range(n)]
    bits, b.at = b.at - at, at
    if sum(map(len, seen.values())) > 64:
        seen.clear()
    seen.setdefault(bits, {})[b.peek(bits)] = groups
    b.at = at + bits
    return groups


def _small(b: Bits, width: int, height: int) -> np.ndarray:
    """The image of a transform or of meta codes."""
    cache_bits = b.read(4) if b.read(1) else 0
    groups = _codes(b, 1, cache_bits)
    if not cache_bits and width * height <= 256:  # a few symbols, read one by one unless they are references
        at, out = b.at, []
        tables = [(t.tolist(), len(t).bit_length() - 1) for t in groups[0].tables]
        while len(out) < width * height:
            pixel = []
            for by, n in tables[:4]:
                a = b.at
                e = by[b.read(n)] if n else by[0]
                b.at = a + (e & 15)
                pixel.append(e >> 4)
                if pixel[0] > 255:
                    break
            if pixel[0] > 255:
                break
            green, red, blue, alpha = pixel
            out.append(blue | green << 8 | red << 16 | alpha << 24)
        else:
            return np.asarray(out, "u4").reshape(height, width)
        b.at = at
    job = _Job(b.data, 0, width, height, cache_bits, groups)
    job.at = b.at
    out = _decode([job])[0]
    b.at = job.at
    return out.reshape(height, width)


def _open(data: bytes) -> tuple[_Job, int, int, list]:
    """Reads an image's header and transforms -> what is left to decode, its width and height, the transforms."""
    b = Bits(data)
    if b.read(8) != 0x2F:
        raise ValueError("not a lossless image")
    width, height = b.read(14) + 1, b.read(14) + 1
    b.read(1)
    if b.read(3):
        raise ValueError("an unknown version")
    now, transforms = width, []
    while b.read(1):
        kind = b.read(2)
        if kind in (0, 1):
            k = b.read(3) + 2
            transforms.append((kind, now, k, _small(b, -(-now // (1 << k)), -(-height // (1 << k)))))
        elif kind == 2:
            transforms.append((2, now, 0, None))
        else:
            n = b.read(8) + 1
            colours = _small(b, n, 1)[0]
            colours = np.cumsum(colours.view("u1").reshape(-1, 4), axis=0, dtype="u1").view("u4").ravel()
            k = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((3, now, k, colours))
            now = -(-now // (1 << k))
    cache_bits = b.read(4) if b.read(1) else 0
    meta, meta_bits, n = None, 0, 1
    if b.read(1):
        meta_bits = b.read(3) + 2
        small = _small(b, -(-now // (1 << meta_bits)), -(-height // (1 << meta_bits)))
        meta = (small >> np.uint32(8) & np.uint32(0xFFFF)).astype("i8").ravel()
        n = int(meta.max()) + 1
    groups = _codes(b, n, cache_bits)
    job = _Job(data, 0, now, height, cache_bits, groups, meta, meta_bits)
    job.at = b.at
    return job, width, height, transforms


def _undo(pixels: np.ndarray, transform) -> np.ndarray:
    """One transform inverted on rows of ARGB pixels."""
    kind, width, k, data = transform
    if kind == 3:
        index = _indices(pixels, width, k)
        return np.where(index < len(data), data[np.minimum(index, len(data) - 1)], 0).astype("u4")
    if kind == 1:
        return _uncross(pixels, data[np.arange(len(pixels)) >> k], k)
    p = pixels.view("u1").reshape(*pixels.shape, 4).copy()  # blue, green, red, alpha
    if kind == 2:
        p[..., 0] += p[..., 1]
        p[..., 2] += p[..., 1]
    else:
        _unpredict(p, data >> np.uint32(8) & np.uint32(15), k)
    return p.view("u4").reshape(pixels.shape)


def _unpredict(p: np.ndarray, modes: np.ndarray, k: int) -> None:
    """Adds each pixel's prediction, in place. Modes that don't look left take a row's stretch at once."""
    height, width = p.shape[:2]
    p[0, 0, 3] = (int(p[0, 0, 3]) + 255) & 255
    p[0] = np.cumsum(p[0], axis=0, dtype="u1")
    half = lambda a, b: ((a.astype("i4") + b) >> 1).astype("u1")
    for y in range(1, height):
        row, up = p[y], p[y - 1]
        row[0] += up[0]
        for x0 in range(0, width, 1 << k):
            a, b = max(1, x0), min(width, x0 + (1 << k))
            if a >= b:
                continue
            mode = int(modes[y >> k, x0 >> k])
            t, tl = up[a:b], up[a - 1 : b - 1]
            tr = up[a + 1 : b + 1] if b < width else np.concatenate([up[a + 1 :], row[:1]])
            if mode in (0, 14, 15):
                row[a:b, 3] += 255
            elif mode == 1:
                row[a - 1 : b] = np.cumsum(row[a - 1 : b], axis=0, dtype="u1")
            elif mode in (2, 3, 4, 8, 9):
                row[a:b] += {2: lambda: t, 3: lambda: tr, 4: lambda: tl, 8: lambda: half(tl, t), 9: lambda: half(t, tr)}[mode]()
            else:
                for x in range(b - a):
                    left, T, TL, TR = row[a + x - 1], t[x], tl[x], tr[x]
                    if mode == 5:
                        guess = half(half(left, TR), T)
                    elif mode == 6:
                        guess = half(left, TL)
                    elif mode == 7:
                        guess = half(left, T)
                    elif mode == 10:
                        guess = half(half(left, TL), half(T, TR))
                    elif mode == 11:
                        l4, t4, c4 = left.astype("i4"), T.astype("i4"), TL.astype("i4")
                        guess = left if np.abs(t4 - c4).sum() < np.abs(l4 - c4).sum() else T
                    elif mode == 12:
                        guess = np.clip(left.astype("i4") + T - TL, 0, 255).astype("u1")
                    else:
                        m = half(left, T).astype("i4")
                        d = m - TL
                        guess = np.clip(m + np.where(d < 0, -(-d // 2), d // 2), 0, 255).astype("u1")
                    row[a + x] += guess


def _undo_together(images: list[np.ndarray], transforms: list[tuple]) -> list[np.ndarray]:
    """One transform of each image (the same kind, width and tile size) inverted, all images at once."""
    kind, width, k, _ = transforms[0]
    if kind == 0:
        return _unpredict_together(images, [t[3] >> np.uint32(8) & np.uint32(15) for t in transforms], k)
    height = np.asarray([len(x) for x in images])
    rows = np.concatenate(images)
    if kind == 2:
        rows = _undo(rows, (2, width, 0, None))
    elif kind == 1:
        data = np.concatenate([t[3] for t in transforms])
        tiles = np.asarray([len(t[3]) for t in transforms])
        y = np.arange(len(rows)) - np.repeat(np.cumsum(height) - height, height)
        rows = _uncross(rows, data[np.repeat(np.cumsum(tiles) - tiles, height) + (y >> k)], k)
    else:
        colours = [t[3] for t in transforms]
        n = np.asarray([len(c) for c in colours])
        index = _indices(rows, width, k).astype("i8")
        most = np.repeat(n, height)[:, None]
        rows = np.where(index < most, np.concatenate(colours)[np.repeat(np.cumsum(n) - n, height)[:, None] + np.minimum(index, most - 1)], 0).astype("u4")
    return np.split(rows, np.cumsum(height)[:-1])


def _indices(pixels: np.ndarray, width: int, k: int) -> np.ndarray:
    """Palette indices of packed pixels."""
    x, each = np.arange(width), 8 >> k
    green = pixels >> np.uint32(8) & np.uint32(0xFF)
    return green[:, x >> k] >> ((x & ((1 << k) - 1)) * each).astype("u4") & np.uint32((1 << each) - 1)


def _uncross(pixels: np.ndarray, data: np.ndarray, k: int) -> np.ndarray:
    """Cross-colour inverted; data has the multipliers of each row."""
    p = pixels.view("u1").reshape(*pixels.shape, 4).copy()
    t = data.view("i1").reshape(*data.shape, 4)[:, np.arange(p.shape[1]) >> k].astype("i4")  # green to red, green to blue, red to blue
    green = p[..., 1].view("i1").astype("i4")
    red = (p[..., 2] + (t[..., 0] * green >> 5)).astype("u1")
    p[..., 0] = (p[..., 0] + (t[..., 1] * green >> 5) + (t[..., 2] * red.view("i1").astype("i4") >> 5)).astype("u1")
    p[..., 2] = red
    return p.view("u4").reshape(pixels.shape)


def _guesses(mode: int, left, t, tl, tr) -> np.ndarray:
    """What predictor `mode` says, from the neighbours' samples (last axis: the four channels; 16-bit)."""
    half = lambda a, b: (a + b) >> 1
    if mode == 5:
        return half(half(left, tr), t)
    if mode == 10:
        return half(half(left, tl), half(t, tr))
    if mode == 11:
        return np.where((np.abs(t - tl).sum(-1) < np.abs(left - tl).sum(-1))[..., None], left, t)
    if mode == 12:
        return np.clip(left + t - tl, 0, 255)
    if mode == 13:
        m = half(left, t)
        d = m - tl
        return np.clip(m + np.where(d < 0, -(-d // 2), d // 2), 0, 255)
    pairs = {1: (left, left), 2: (t, t), 3: (tr, tr), 4: (tl, tl), 6: (left, tl), 7: (left, t), 8: (tl, t), 9: (t, tr)}
    return half(*pairs[mode]) if mode in pairs else np.broadcast_to(np.asarray([0, 0, 0, 255], "i2"), t.shape)


def _unpredict_together(images: list[np.ndarray], modes: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Predictors undone pixel by pixel, each over all images that still have the row."""
    order = sorted(range(len(images)), key=lambda i: -len(images[i]))
    height, width = np.asarray([len(images[i]) for i in order]), images[0].shape[1]
    p = np.zeros((height[0], width, len(images), 4), "u1")
    m = np.zeros((modes[order[0]].shape[0], modes[0].shape[1], len(images)), "u1")
    for at, i in enumerate(order):
        p[: len(images[i]), :, at] = images[i].view("u1").reshape(len(images[i]), width, 4)
        m[: len(modes[i]), :, at] = modes[i]
    p[0, 0, :, 3] += 255
    p[0] = np.cumsum(p[0], axis=0, dtype="u1")
    for y in range(1, height[0]):
        n = int(np.searchsorted(-height, -y, "left"))  # images that have this row
        row, up = p[y, :, :n], p[y - 1, :, :n].astype("i2")
        row[0] += up[0].astype("u1")
        for tile in range(-(-width >> k) if k else width):
            own = m[y >> k, tile, :n]
            groups = [(mode, np.flatnonzero(own == mode)) for mode in np.unique(own).tolist()]
            for x in range(max(1, tile << k), min(width, (tile + 1) << k)):
                for mode, g in groups:
                    right = up[x + 1, g] if x + 1 < width else row[0, g].astype("i2")
                    row[x, g] += _guesses(mode, row[x - 1, g].astype("i2"), up[x, g], up[x - 1, g], right).astype("u1")
    out: list = [None] * len(images)
    for at, i in enumerate(order):
        out[i] = np.ascontiguousarray(p[: height[at], :, at]).view("u4").reshape(height[at], width)
    return out


def chunks(media: bytes) -> list[bytes]:
    """The lossless streams of images that stand one after the other."""
    out, at = [], 0
    while at < len(media):
        if media[at : at + 4] != b"RIFF" or media[at + 8 : at + 12] != b"WEBP":
            raise ValueError("not a WebP image")
        stop, k = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little"), at + 12
        while k < stop:
            n = int.from_bytes(media[k + 4 : k + 8], "little")
            if media[k : k + 4] == b"VP8L":
                out.append(media[k + 8 : k + 8 + n])
            k += 8 + n + (n & 1)
        at = stop + (stop - at & 1)
    return out


def read_images(streams: list[bytes]) -> list[np.ndarray]:
    """Pixels (rows of ARGB as unsigned 32-bit) of lossless streams."""
    opened = [_open(s) for s in streams]
    out = [p.reshape(height, job.width) for p, (job, _, height, _) in zip(_decode([o[0] for o in opened]), opened, strict=True)]
    todo = [list(o[3]) for o in opened]
    while any(todo):
        groups: dict[tuple, list[int]] = {}
        for i, t in enumerate(todo):
            if t:
                groups.setdefault(t[-1][:3], []).append(i)
        for own in groups.values():
            last = [todo[i].pop() for i in own]
            done = _undo_together([out[i] for i in own], last) if len(own) > 4 else [_undo(out[i], t) for i, t in zip(own, last, strict=True)]
            for i, rows in zip(own, done, strict=True):
                out[i] = rows
    return out


# --- writing --------------------------------------------------------------------------------------------------------------------


def _text_weights() -> list[float]:
    """How often bytes are expected, by a rule: blanks, then letters by their usual order, then UTF-8 and the rest."""
    w = [0.02] * 256
    for i, c in enumerate(b" etaoinhrsdlucmfwygpbvkxqjz"):
        w[c] = 16 / (1 + 0.3 * i)
    for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
        w[c] = 0.25
    for c in b".,\n!|":
        w[c] = 1.5
    w[0xC3] = 3
    for c in range(0xA0, 0xC0):
        w[c] = 0.2
    return w


def _other_weights() -> list[float]:
    """Bytes of stretches that are no running text: digits, capitals, signs, UTF-8."""
    return [1.0 if 97 <= c < 123 else 3.0 if 32 <= c < 127 else 2.0 if c >= 128 else 0.1 for c in range(256)]


def _residual_weights() -> list[float]:
    """Differences: small ones are likelier."""
    return [np.exp(-min(c, 256 - c) / 12) + 0.02 for c in range(256)]


def _header(lengths) -> list[tuple[int, int]]:
    """The bits (value, number) of a code's lengths: single ones, repeats of the last, runs of zeros."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) == 1:
        return [(0b101 | used[0] << 3, 11)]
    items, i, last = [], 0, 8
    while i < len(lengths):
        n = 1
        while i + n < len(lengths) and lengths[i + n] == lengths[i]:
            n += 1
        if not lengths[i] and n >= 3:
            n = min(n, 138)
            items.append((17, n - 3, 3) if n < 11 else (18, n - 11, 7))
        elif lengths[i] and lengths[i] == last and n >= 3:
            n = min(n, 6)
            items.append((16, n - 3, 2))
        else:
            items.append((lengths[i], 0, 0))
            n, last = 1, lengths[i] or last
        i += n
    count = [sum(s == k for s, _, _ in items) for k in range(19)]
    own = code_lengths([n if k > 16 else 1 + n for k, n in enumerate(count)])
    while max(own) > 7:
        own = code_lengths([n and 40 + n if k > 16 else 40 + n for k, n in enumerate(count)])
    c = codes(own)
    out = [(0, 1), (15, 4), *((own[k], 3) for k in LENGTH_ORDER), (0, 1)]
    for s, more, m in items:
        out += [(int(c[s]), own[s]), (more, m)]
    return out


class _Set:
    """Fixed codes of a group (green with lengths and cache, red, blue, alpha, distances) from weights; a number is a lone symbol."""

    def __init__(self, *weights):
        lengths = [[int(s == w) for s in range(256)] if isinstance(w, int) else code_lengths(w) for w in weights]
        self.header = [b for x in lengths for b in _header(x)]
        # a lone symbol takes no bits
        self.lengths = [np.asarray(x, "u8") * (sum(map(bool, x)) > 1) for x in lengths]
        self.codes = [codes(x) * (sum(map(bool, x)) > 1) for x in lengths]

    def pixels(self, green, red, blue, alpha) -> tuple[np.ndarray, np.ndarray]:
        """Values and bits of literal pixels."""
        value, n = self.codes[0][green], self.lengths[0][green]
        for k, v in ((1, red), (2, blue), (3, alpha)):
            value = value | self.codes[k][v] << n
            n = n + self.lengths[k][v]
        return value, n


def _joined(bits) -> list[tuple[int, int]]:
    """Bits as few pairs (value, number), of 48 at most."""
    value = n = 0
    for v, k in bits:
        value |= v << n
        n += k
    return [(value >> i & ((1 << min(48, n - i)) - 1), min(48, n - i)) for i in range(0, n, 48)]


class _Writer:
    """The writer's fixed codes and the fixed parts of its headers."""

    def __init__(self):
        flat, far = [1.0] * 256, [1.0] * 40
        sets = {}
        for name, w in (("text", _text_weights()), ("other", _other_weights())):
            total = sum(w)
            sets[name] = _Set(w + [total / 900] * 24 + [total / 1200] * (1 << CACHE_BITS), w, w, w, far)
        sets["colours"] = _Set(flat + [0] * 24, flat, flat, flat, 0)
        sets["index"] = _Set([1.0] * 280, 0, 0, 255, far)
        sets["modes"] = _Set([1.0] * 14 + [0] * 266, 0, 0, 255, 0)
        sets["crosses"] = _Set(flat + [0] * 24, flat, flat, 255, 0)
        w = _residual_weights()
        sets["residual"] = _Set(w + [0.01] * 24, w, w, w, far)
        self.__dict__ |= sets
        h = {k: x.header for k, x in sets.items()}
        cache, plain = [(1, 1), (CACHE_BITS, 4)], [(0, 1)]
        choice = [(0b011, 3), (0, 1), (1, 8), *[(0b101, 11)] * 2, (0b101 | 255 << 3, 11), (0b101, 11)]  # two symbols, 0 and 1
        tile = (TILE - 2, 3)
        parts = {
            "text_head": [(0, 1), *cache, (0, 1), *h["text"]],
            "meta_head": [(0, 1), *cache, (1, 1), tile, *plain, *choice], "meta_rest": [*h["text"], *h["other"]],
            "palette_head": [(1, 1), (3, 2)], "palette_colours": [*plain, *h["colours"]], "palette_rest": [(0, 1), *plain, (0, 1), *h["index"]],
            "green_head": [(1, 1), (2, 2)], "mode_head": [(1, 1), (0, 2), tile, *plain, *h["modes"]], "cross_head": [(1, 1), (1, 2), tile, *plain, *h["crosses"]],
            "residual_rest": [(0, 1), *plain, (0, 1), *h["residual"]],
        }
        self.parts = {k: tuple(np.asarray(x, "u8") for x in zip(*_joined(v), strict=True)) for k, v in parts.items()}

    def size(self, name: str) -> int:
        """Bits of a fixed part."""
        return int(self.parts[name][1].sum())

    def part(self, name: str, images: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A fixed part for each of the images."""
        v, n = self.parts[name]
        return np.repeat(images, len(v)), np.tile(v, len(images)), np.tile(n, len(images))


_WRITER: list[_Writer] = []


def _prefix(value: int) -> tuple[int, int, int]:
    """A length or distance as prefix, extra bits, their number."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    k = v.bit_length() - 2
    return 2 * (k + 1) + (v >> k & 1), v & ((1 << k) - 1), k


def _runs(pixels: np.ndarray, strip: np.ndarray, stop: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of runs of RUN or more pixels that stood before in the same image, greedily from the left."""
    n = len(pixels) - RUN + 1
    if n < 2:
        return []
    key = strip[:n].astype("u8") * np.uint64(0x9E3779B97F4A7C15)
    for k in range(RUN):
        key = (key ^ pixels[k : k + n]) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    o = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[o[1:]] == key[o[:-1]])
    here, there = o[same + 1], o[same]
    fit = (strip[here] == strip[there]) & (here + RUN <= stop[here])
    for k in range(RUN):
        fit &= pixels[np.minimum(here + k, len(pixels) - 1)] == pixels[np.minimum(there + k, len(pixels) - 1)]
    here, there = here[fit], there[fit]
    o = np.argsort(here)
    out, end = [], 0
    for i, j in zip(here[o].tolist(), there[o].tolist(), strict=True):
        if i < end:
            continue
        most = min(int(stop[i]) - i, 4096)
        differ = np.flatnonzero(pixels[i : i + most] != pixels[j : j + most])
        length = int(differ[0]) if len(differ) else most
        out.append((i, length, i - j))
        end = i + length
    return out


def _with_references(value, n, pixels, strip, stop, sets: list[_Set], group) -> np.ndarray:
    """Puts references into value and n where they are shorter than the literal pixels; returns which places are written."""
    use = np.ones(len(pixels), bool)
    for i, length, dist in _runs(pixels, strip, stop):
        s = sets[group[i] if len(sets) > 1 else 0]
        v = bits = 0
        for code, size, base, (p, extra, m) in ((s.codes[0], s.lengths[0], 256, _prefix(length)), (s.codes[4], s.lengths[4], 0, _prefix(dist + 120))):
            k = int(size[base + p])
            v |= (int(code[base + p]) | extra << k) << bits
            bits += k + m
        if bits < n[i : i + length].sum():
            value[i], n[i] = v, bits
            use[i + 1 : i + length] = False
    return use


def _samples(pixels: np.ndarray) -> tuple[np.ndarray, ...]:
    """Green, red, blue, alpha."""
    return tuple((pixels >> np.uint32(k) & np.uint32(255)).astype("i8") for k in (8, 16, 0, 24))


def _rows_of(strip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted image numbers: the numbers, where each starts, how many it has."""
    first = np.flatnonzero(np.r_[True, strip[1:] != strip[:-1]])
    return strip[first], first, np.diff(np.r_[first, len(strip)])


def _text_images(w: _Writer, pixels, strip, stop) -> list:
    """Blocks (image, value, bits) of images with the cache, references and, where they pay, meta codes."""
    at = (pixels * np.uint32(HASH)) >> np.uint32(32 - CACHE_BITS)
    # a pixel is in the cache if the last one in its place was the same
    o = np.argsort(strip << CACHE_BITS | at, kind="stable")
    a, b = o[1:], o[:-1]
    held = np.zeros(len(pixels), bool)
    held[a] = (pixels[a] == pixels[b]) & (strip[a] == strip[b])
    both = []
    for s in (w.text, w.other):
        v, n = s.pixels(*_samples(pixels))
        both.append((np.where(held, s.codes[0][280 + at], v), np.where(held, s.lengths[0][280 + at], n)))
    images, first, count = _rows_of(strip)
    # tiles take the group with fewer bits, in images where that saves more than the second group costs
    y = (np.arange(len(pixels)) - np.repeat(first, count)) // WIDTH >> TILE
    tiles = (count // WIDTH + (1 << TILE) - 1) >> TILE
    tile = np.repeat(np.cumsum(tiles) - tiles, count) + y
    bits = [np.bincount(tile, weights=n, minlength=int(tiles.sum())) for _, n in both]
    owner = np.repeat(np.arange(len(images)), tiles)
    saved = np.bincount(owner, weights=np.maximum(bits[0] - bits[1], 0), minlength=len(images))
    high = saved > w.size("meta_head") + tiles + w.size("meta_rest") - w.size("text_head")
    other = (bits[1] < bits[0]) & high[owner]
    group = other[tile].astype("i8")
    value, n = (np.where(group, both[1][k], both[0][k]) for k in (0, 1))
    use = _with_references(value, n, pixels, strip, stop, [w.text, w.other], group)
    meta = high[owner]
    one = np.ones(int(meta.sum()), "u8")
    return [w.part("text_head", images[~high]), w.part("meta_head", images[high]), (images[owner[meta]], other[meta].astype("u8"), one), w.part("meta_rest", images[high]), (strip[use], value[use], n[use])]


def _palette_images(w: _Writer, pixels, strip) -> list:
    """Blocks of images with a palette."""
    images, first, count = _rows_of(strip)
    key, place = np.unique(strip.astype("u8") << np.uint64(32) | pixels, return_inverse=True)
    owner, colour = (key >> np.uint64(32)).astype("i8"), key.astype("u4")
    _, start, n = _rows_of(owner)
    index = place - np.repeat(start, count)
    k = np.where(n <= 2, 3, np.where(n <= 4, 2, np.where(n <= 16, 1, 0)))
    # colours as steps from the one before
    c = colour.view("u1").reshape(-1, 4)
    step = c - np.concatenate([np.zeros((1, 4), "u1"), c[:-1]])
    step[start] = c[start]
    cv, cn = w.colours.pixels(*_samples(np.ascontiguousarray(step).view("u4").ravel()))
    # 1 << k indices to a pixel; rows start anew
    packs = np.repeat(k, count)
    x = (np.arange(len(pixels)) - np.repeat(first, count)) % WIDTH
    inside = x & ((1 << packs) - 1)
    head = np.flatnonzero(inside == 0)
    packed = np.add.reduceat(index << inside * (8 >> packs), head).astype("u4") << np.uint32(8) | np.uint32(255 << 24)
    own = strip[head]
    _, f, m = _rows_of(own)
    v, bits = w.index.pixels(*_samples(packed))
    use = _with_references(v, bits, packed, own, np.repeat(f + m, m), [w.index], None)
    size = (images, (n - 1).astype("u8"), np.full(len(n), 8, "u8"))
    return [w.part("palette_head", images), size, w.part("palette_colours", images), (owner, cv, cn), w.part("palette_rest", images), (own[use], v[use], bits[use])]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype("u1").view("i1").astype("i4")


def _picture_images(w: _Writer, pixels, strip) -> list:
    """Blocks of images with green subtracted, predictors and cross-colour by tile."""
    images, first, count = _rows_of(strip)
    height = count // WIDTH
    p = pixels.view("u1").reshape(-1, WIDTH, 4).astype("i2")  # blue, green, red, alpha
    row = np.repeat(np.arange(len(images)), height)
    top = np.zeros(len(p), bool)
    top[np.cumsum(height) - height] = True
    less = np.stack([np.bincount(row, weights=np.abs(_signed(p[..., c] - g)).sum(1)) for c in (0, 2) for g in (0, p[..., 1])])
    green = less[1] + less[3] < less[0] + less[2]
    for c in (0, 2):
        p[..., c] = np.where(green[row][:, None], p[..., c] - p[..., 1], p[..., c]) & 255
    # predictors: for each tile that with the smallest residuals
    tiles = (height + (1 << TILE) - 1) >> TILE
    tile = np.repeat(np.cumsum(tiles) - tiles, height) + (np.arange(len(p)) - np.repeat(np.cumsum(height) - height, height) >> TILE)
    up = np.concatenate([np.zeros((1, WIDTH, 4), "i2"), p[:-1]])
    left = np.concatenate([np.zeros((len(p), 1, 4), "i2"), p[:, :-1]], axis=1)
    tl = np.concatenate([np.zeros((len(p), 1, 4), "i2"), up[:, :-1]], axis=1)
    tr = np.concatenate([up[:, 1:], p[:, :1]], axis=1)
    best, mode, res = np.full(int(tiles.sum()), np.inf), np.zeros(int(tiles.sum()), "i8"), np.zeros(p.shape, "u1")
    for m in range(14):
        r = (p - _guesses(m, left, up, tl, tr)).astype("u1")
        cost = np.bincount(tile, weights=np.abs(r.view("i1").astype("i2")).sum((1, 2)), minlength=len(best))
        better = cost < best
        best[better], mode[better] = cost[better], m
        rows = better[tile]
        res[rows] = r[rows]
    res[top] = (p - left)[top].astype("u1")
    res[:, 0] = (p - up)[:, 0].astype("u1")
    res[top, 0] = (p[top, 0] - np.asarray([0, 0, 0, 255])).astype("u1")
    # cross-colour: least squares by tile
    b, g, r = (_signed(res[..., c]) for c in range(3))
    total = lambda x: np.bincount(tile, weights=x.sum(1), minlength=len(best))
    by = lambda x, y: np.clip(np.rint(32 * total(x * y) / np.maximum(1, total(y * y))), -128, 127).astype("i4")
    gr = by(r, g)
    gb = by(b, g)
    rest = _signed(b - (gb[tile][:, None] * g >> 5))
    rb = by(rest, r)
    res[..., 2] = (r - (gr[tile][:, None] * g >> 5)).astype("u1")
    res[..., 0] = (b - (gb[tile][:, None] * g >> 5) - (rb[tile][:, None] * r >> 5)).astype("u1")
    owner = np.repeat(images, tiles)
    modes = w.modes.pixels(mode, *(np.zeros(len(mode), "i8"),) * 3)
    crosses = w.crosses.pixels(gb & 255, rb & 255, gr & 255, np.zeros(len(gb), "i8"))
    flat = res.view("u4").ravel()
    v, bits = w.residual.pixels(*_samples(flat))
    use = _with_references(v, bits, flat, strip, np.repeat(first + count, count), [w.residual], None)
    return [w.part("green_head", images[green]), w.part("mode_head", images), (owner, *modes), w.part("cross_head", images), (owner, *crosses), w.part("residual_rest", images), (strip[use], v[use], bits[use])]


def _step_bits(w: _Writer, pixels, strip) -> np.ndarray:
    """Bits of each image's pixels as differences from the one to the left or from the one above, whichever way is shorter."""
    p = pixels.view("u1").reshape(-1, 4)
    out = []
    for k in (1, WIDTH):
        step = p.copy()
        step[k:] -= p[:-k]
        own = np.zeros(len(p), bool)
        own[k:] = strip[k:] == strip[:-k]
        n = sum(w.residual.lengths[s][step[:, c]] for s, c in enumerate((1, 2, 0, 3)))
        out.append(np.bincount(strip, weights=n * own))
    return np.minimum(*out)


def write_media(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a multiple of 64 bytes) as one or several images."""
    if not payloads:
        return []
    if not _WRITER:
        _WRITER.append(_Writer())
    w = _WRITER[0]
    size = WIDTH * 4 * ROWS
    rows, owner = [], []
    for i, p in enumerate(payloads):
        for a in range(0, len(p), size):
            rows.append(len(p[a : a + size]) // (4 * WIDTH))
            owner.append(i)
    rgba = np.frombuffer(b"".join(payloads), "u1").reshape(-1, 4)
    pixels = np.ascontiguousarray(rgba[:, [2, 1, 0, 3]]).view("u4").ravel()
    rows = np.asarray(rows, "i8")
    count = rows * WIDTH
    strip = np.repeat(np.arange(len(rows)), count)
    stop = np.repeat(np.cumsum(count), count)
    taken = lambda made: np.bincount(np.concatenate([b[0] for b in made]), weights=np.concatenate([b[2] for b in made]), minlength=len(rows))
    chosen = lambda made, some: [tuple(x[some[b[0]]] for x in b) for b in made]
    text = _text_images(w, pixels, strip, stop)
    long = taken(text)
    key = np.sort(strip.astype("u8") << np.uint64(32) | pixels)
    colours = np.bincount((key[np.r_[True, key[1:] != key[:-1]]] >> np.uint64(32)).astype("i8"), minlength=len(rows))
    head = sum(int(n.sum()) for k, (_, n) in w.parts.items() if k.startswith("palette"))
    indices = np.where(colours <= 2, 2, np.where(colours <= 4, 4, np.where(colours <= 16, 8, 16)))
    packed = head + 32 * colours + 8 * rows * indices
    palette = (colours <= 256) & (packed < long)
    short = np.where(palette, packed, long)
    picture, blocks = _step_bits(w, pixels, strip) < short, []
    if picture.any():
        mine = picture[strip]
        made = _picture_images(w, pixels[mine], strip[mine])
        picture &= taken(made) < short
        blocks += chosen(made, picture)
    palette &= ~picture
    if palette.any():
        mine = palette[strip]
        blocks += _palette_images(w, pixels[mine], strip[mine])
    blocks += chosen(text, ~(picture | palette))
    image, value, n = (np.concatenate([b[k] for b in blocks]) for k in range(3))
    o = np.argsort(image, kind="stable")
    image, value, n = image[o], value[o], n[o]
    # each image starts at a 64-bit word
    bits = np.bincount(image, weights=n, minlength=len(rows)).astype("i8")
    words = (bits + 63) // 64 + 1
    base = np.cumsum(words) - words
    inside = np.cumsum(n).astype("i8") - n.astype("i8")
    place = base[image] * 64 + inside - inside[np.searchsorted(image, np.arange(len(rows)))][image]
    packed = np.zeros(int(words.sum()) + 1, "u8")
    shift = place.astype("u8") & np.uint64(63)
    np.bitwise_or.at(packed, place >> 6, value << shift)
    np.bitwise_or.at(packed, (place >> 6) + 1, np.where(shift > 0, value >> (np.uint64(63) - shift) >> np.uint64(1), 0))
    raw = packed.tobytes()
    out: list[list[bytes]] = [[] for _ in payloads]
    for i, h, b, at in zip(owner, rows.tolist(), bits.tolist(), base.tolist(), strict=True):
        data = b"\x2f" + (WIDTH - 1 | (h - 1) << 14 | 1 << 28).to_bytes(4, "little") + raw[8 * at : 8 * at + (b + 7) // 8]
        pad = b"\0" * (len(data) & 1)
        out[i].append(b"RIFF" + struct.pack("<I", 12 + len(data) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data + pad)
    return [b"".join(x) for x in out]


def read_media(media: list[bytes]) -> list[bytes]:
    """The payloads of media that write_media() made."""
    streams = [chunks(m) for m in media]
    images = iter(read_images([s for x in streams for s in x]))
    out = []
    for x in streams:
        p = np.concatenate([next(images).ravel() for _ in x]) if x else np.zeros(0, "u4")
        rgba = np.stack([p >> np.uint32(16), p >> np.uint32(8), p, p >> np.uint32(24)], axis=1).astype("u1")
        out.append(rgba.tobytes())
    return out


# --- Spark ----------------------------------------------------------------------------------------------------------------------


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))


def _parts(values: list[bytes], most: int = 12 << 20):
    """Consecutive values of about `most` bytes together."""
    some, size = [], 0
    for v in values:
        if some and size + len(v) > most:
            yield some
            some, size = [], 0
        some.append(v)
        size += len(v)
    if some:
        yield some


def store(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, media binary, as a written table."""

    def run(batches):
        for b in batches:
            p = [payload(t) for t in b.column(2).to_pylist()]
            media = [m for some in _parts(p) for m in write_media(some)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(media, "binary")], names=["doc_id", "n_bytes", "media"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    return written(rows.mapInArrow(run, "doc_id long, n_bytes long, media binary"))


def feature(raw: bytes) -> str:
    """Size, mean samples by channel and the number of differing samples of a decoded payload."""
    p = np.frombuffer(raw, "u1").reshape(-1, 4)
    mean = ",".join(f"{m:.3f}" for m in p.mean(0))
    return f"{WIDTH}x{len(p) // WIDTH} mean={mean} distinct={np.count_nonzero(np.bincount(p.ravel(), minlength=256))}"


def features(stored: DataFrame) -> DataFrame:
    """stored(doc_id, n_bytes, media) -> the contract's columns, computed from the decoded media."""

    def run(batches):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            media = b.column(2).to_pylist()
            raw = [p for some in _parts(media) for p in read_media(some)]
            cols = [
                (b.column(0), "doc_id"), (b.column(1), "n_bytes"), (pa.array(map(len, raw), "int64"), "payload_bytes"), (pa.array(map(sha, raw), "string"), "payload_sha256"),
                (pa.array([zlib.crc32(p[-64:]) for p in raw], "int64"), "tail_crc32"), (pa.array(map(len, media), "int64"), "media_bytes"),
                (pa.array(map(sha, media), "string"), "media_sha256"), (pa.array(map(feature, raw), "string"), "feature"),
            ]
            yield pa.RecordBatch.from_arrays([c for c, _ in cols], names=[n for _, n in cols])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
